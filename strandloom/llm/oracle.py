"""DuckDB SQL for the queries that SQL can express; the tables are views of the same names."""

from __future__ import annotations

from strandloom.llm import clustering, decontamination, embedding, licenses, mixing, secrets, sharding
from strandloom.llm.shared import UNSPACED


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def mix_sql() -> str:
    weight = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(mixing.WEIGHTS))
    n = len(mixing.WEIGHTS)
    prefix = "coalesce(sum(size) OVER (PARTITION BY skey ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"""WITH sized AS (
 SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::VARCHAR, 'null'), coalesce(source, 'null'), coalesce(md5(text), 'null'))) AS digest, coalesce('s' || source, 'n') AS skey FROM documents),
totals AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM totals),
weighted AS (SELECT *, CASE no % {n} {weight} END AS weight, source_size * {mixing.MAX_EPOCHS} AS cap, sum(source_size) OVER () * {mixing.SHARE} AS goal FROM ranked),
levels AS (SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
clamped AS (SELECT *, cap <= weight * level AS full_cap FROM levels),
targets AS (SELECT skey, source_size, CASE WHEN full_cap THEN cap ELSE weight * arg_min(CASE WHEN NOT full_cap THEN level END, CASE WHEN NOT full_cap THEN cap / weight END) OVER () END AS target FROM clamped),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
rows_ AS (SELECT s.doc_id, s.size, s.digest, p.*, p.target - p.whole * p.source_size AS need, s.size * {mixing.LARGE} > p.source_size AS large FROM sized s JOIN plan p USING (skey)),
large AS (SELECT *, (before + size / 2 <= need * large_size / source_size)::BIGINT AS extra FROM (SELECT *, {prefix} AS before, sum(size) OVER (PARTITION BY skey) AS large_size FROM rows_ WHERE large)),
spent AS (SELECT skey, sum(size * extra) AS spent FROM large GROUP BY skey),
rest AS (SELECT *, (before + size / 2 <= need - coalesce(spent, 0) AND size > 0)::BIGINT AS extra FROM (SELECT *, {prefix} AS before FROM rows_ WHERE NOT large) LEFT JOIN spent USING (skey))
SELECT doc_id, size, source_size, target::DOUBLE AS target, (size * (whole + extra))::BIGINT AS taken FROM (SELECT doc_id, size, source_size, target, whole, extra FROM large UNION ALL SELECT doc_id, size, source_size, target, whole, extra FROM rest)"""


def decontamination_sql() -> str:
    """BM25 against every passage, without an index; then the triples that question and answer share with it."""
    d = decontamination
    unspaced = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in UNSPACED)
    listed = lambda x: f"regexp_extract_all(regexp_replace(lower({x}), '([{unspaced}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}_]+')"
    grams = lambda words, n: f"list_distinct(list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string({words}[i:i + {n} - 1], ' ')))"
    size = "CASE " + " ".join(f"WHEN n <= {d.MIN_SEGMENT << k} THEN {d.MIN_SEGMENT << k}" for k in range(20)) + " END"
    part = lambda p: f"n_{p}, CASE WHEN n_{p} > 0 THEN {grams(p, f'n_{p}')} ELSE [] END AS g_{p}"
    share = lambda p: f"CASE WHEN n_{p} = 0 THEN 1.0 ELSE len(list_intersect(g_{p}, {grams('words', f'n_{p}')})) / len(g_{p}) END AS {p}_overlap"
    return f"""WITH sentences AS (SELECT item_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?\n。！？]+\\s*'), lambda x: {listed('x')}), lambda w: len(w) > 0) AS s FROM benchmark),
split AS (SELECT item_id, CASE WHEN len(s) > 1 THEN flatten(s[1:len(s) - 1]) ELSE s[1][1:len(s[1]) - greatest(1, len(s[1]) // 4)] END AS q, CASE WHEN len(s) > 1 THEN s[len(s)] ELSE s[1][len(s[1]) - greatest(1, len(s[1]) // 4) + 1:] END AS a FROM sentences WHERE len(s) > 0),
items AS (SELECT *, {size} AS size, {part('q')}, {part('a')} FROM (SELECT row_number() OVER () AS k, item_id, q, a, list_concat(q, a) AS w, len(q) + len(a) AS n, least(len(q), {d.NGRAM}) AS n_q, least(len(a), {d.NGRAM}) AS n_a FROM split)),
terms AS (SELECT k, n, t, count(*) AS f FROM (SELECT k, n, unnest(w) AS t FROM items) GROUP BY ALL),
known AS (SELECT t, count(*) AS df FROM terms GROUP BY t),
total AS (SELECT count(*) AS items, avg(n) AS mean FROM items),
raw AS (SELECT k, t, ln(1 + (items - df + 0.5) / (df + 0.5)) * f * {d.K1 + 1} / (f + {d.K1} * ({1 - d.B} + {d.B} * n / mean)) AS x FROM terms JOIN known USING (t) CROSS JOIN total),
impacts AS (SELECT k, size, t, x / sum(x) OVER (PARTITION BY k) AS x FROM raw JOIN items USING (k)),
docs AS (SELECT row_number() OVER () AS d, doc_id, {listed('text')} AS w FROM documents WHERE text IS NOT NULL),
passages AS (SELECT d, doc_id, size, place, w[place + 1:place + 2 * size] AS words FROM (SELECT d, doc_id, w, size, unnest(range(0, len(w), size)) AS place FROM docs CROSS JOIN (SELECT DISTINCT size FROM items))),
scored AS (SELECT d, place, size, k, sum(x) AS score FROM (SELECT d, place, size, unnest(list_distinct(words)) AS t FROM passages) JOIN impacts USING (size, t) GROUP BY ALL HAVING sum(x) >= {d.MIN_SCORE}),
shares AS (SELECT d, doc_id, k, item_id, score, {share('q')}, {share('a')} FROM scored JOIN passages USING (d, place, size) JOIN items USING (k, size)),
hits AS (SELECT *, row_number() OVER (PARTITION BY d, k ORDER BY score DESC, q_overlap DESC, a_overlap DESC) AS r FROM shares WHERE q_overlap >= {d.MIN_OVERLAP} AND a_overlap >= {d.MIN_OVERLAP})
SELECT doc_id, item_id, round(score, 6) AS score, round(q_overlap, 6) AS question_overlap, round(a_overlap, 6) AS answer_overlap FROM hits WHERE r = 1"""


def licenses_sql() -> str:
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(licenses.KNOWN.items()))
    fixed = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(licenses.DIGESTS.items()))
    return f"""WITH known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT sha256({licenses.canonical_sql('body')}) AS digest, license_id FROM (VALUES {known}) t(license_id, body) UNION ALL SELECT digest, license_id FROM (VALUES {fixed}) u(license_id, digest)) GROUP BY 1),
forms AS (SELECT doc_id, {licenses.canonical_sql('text')} AS form FROM documents)
SELECT doc_id, length(form) AS canonical_chars, sha256(form) AS digest, license_id, license_id IS NOT NULL AS is_license FROM (SELECT *, sha256(form) AS d FROM forms) f LEFT JOIN known k ON f.d = k.digest"""


def secrets_sql() -> str:
    n, alphabet = len(secrets.ALPHABET), quoted(secrets.ALPHABET)
    ordinary = ", ".join(f"({quoted(x)})" for x in secrets.ORDINARY)
    cell = lambda flag, count: f"(coalesce({count}, 0) + {secrets.BACK_OFF} * {flag}_after.p) / (coalesce({flag}_row.n, 0) + {secrets.BACK_OFF})"

    def spans(pattern: str, group: int, least: int, rank: int) -> str:
        p = quoted(pattern)
        ends = "list_transform(range(1, len(m) + 1), lambda i: {'start': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'keep': length(q[i]) >= " + str(least) + ", 'token': m[i]})"
        return f"SELECT doc_id, {rank} AS rank, unnest({ends}) AS s FROM (SELECT doc_id, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {group}) AS q, string_split_regex(t, {p}) AS g FROM docs WHERE regexp_matches(t, {p}))"

    base = " UNION ALL ".join(f"SELECT doc_id, rank, s.start AS a, s.start + s.n AS b FROM ({spans(p, g, least, r)}) WHERE s.keep" for r, (_, p, g, least) in enumerate(secrets.BASE))
    kinds = "[" + ", ".join(map(quoted, secrets.KINDS)) + "]"
    listed = f"coalesce(string_agg(concat({kinds}[rank + 1], ':', a::BIGINT, ':', b::BIGINT), ',' ORDER BY a, rank, b), '')"
    two = lambda times, base, first=0: f"lpad(({first} + i * {times} % {base})::VARCHAR, 2, '0')"
    year, month, day, time = "(1990 + i % 40)", two(1, 12, 1), two(7, 28, 1), [two(5, 24), two(11, 60), two(13, 60)]
    named = f"[concat({year}, '-', {month}, '-', {day}, 'T', concat_ws('-', {', '.join(time)}), 'Z'), concat_ws('/', w, {year}, {month}, {day}), concat_ws('-', w, {year}, lpad((i * 37)::VARCHAR, 6, '0')), concat(w, '_', {year}, {month}, {day}, '_', {', '.join(time)})]"
    return f"""WITH words AS (SELECT token, row_number() OVER () - 1 AS no FROM (VALUES {ordinary}) t(token)),
ordinary AS (SELECT unnest(list_distinct([token, upper(regexp_replace(token, '([a-z])([A-Z])', '\\1_\\2', 'g'))])) AS token, false AS random FROM words
 UNION ALL SELECT unnest({named}), false FROM (SELECT i, lower(token) AS w FROM range(1, {secrets.N_DATED + 1}) r(i) JOIN words ON no = i % {len(secrets.ORDINARY)})),
digests AS (SELECT sha256(id::VARCHAR) AS h FROM range(1, {secrets.N_RANDOM + 1}) r(id)),
plain AS (SELECT h, replace(to_base64(unhex(h)), '=', '') AS b FROM digests),
sample AS (SELECT * FROM ordinary UNION ALL SELECT unnest([h, b, upper(regexp_replace(b, '[+/]', '', 'g'))]), true FROM plain),
grams AS (SELECT random, strpos({alphabet}, substr(token, i::BIGINT, 1)) - 1 AS a, strpos({alphabet}, substr(token, i::BIGINT + 1, 1)) - 1 AS b FROM (SELECT *, unnest(range(1, length(token))) AS i FROM sample)),
counts AS (SELECT random, a, b, count(*) AS n FROM grams WHERE a >= 0 AND b >= 0 GROUP BY ALL),
letters AS (SELECT unnest(range(0, {n})) AS c),
after AS (SELECT r.random, c, (coalesce(sum(n), 0) + 0.5) / ((SELECT sum(n) FROM counts x WHERE x.random = r.random) + {0.5 * n}) AS p FROM letters CROSS JOIN (VALUES (true), (false)) r(random) LEFT JOIN counts k ON k.random = r.random AND k.b = c GROUP BY r.random, c),
row_ AS (SELECT random, a, sum(n) AS n FROM counts GROUP BY random, a),
ratios AS (SELECT x.c AS a, y.c AS b, round(1000 * ln(({cell('t', 't.n')}) / ({cell('f', 'f.n')})))::BIGINT AS r FROM letters x CROSS JOIN letters y
 LEFT JOIN counts t ON t.random AND t.a = x.c AND t.b = y.c LEFT JOIN counts f ON NOT f.random AND f.a = x.c AND f.b = y.c
 JOIN after t_after ON t_after.random AND t_after.c = y.c JOIN after f_after ON NOT f_after.random AND f_after.c = y.c
 LEFT JOIN row_ t_row ON t_row.random AND t_row.a = x.c LEFT JOIN row_ f_row ON NOT f_row.random AND f_row.a = x.c),
docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({base}),
runs AS (SELECT row_number() OVER () AS k, doc_id, s.start AS a, s.start + s.n AS b, s.token AS token FROM ({spans(secrets.RUN, 0, secrets.MIN_RUN, 3)})),
scored AS (SELECT k, sum(r) AS x FROM (SELECT k, strpos({alphabet}, substr(token, i::BIGINT, 1)) - 1 AS a, strpos({alphabet}, substr(token, i::BIGINT + 1, 1)) - 1 AS b FROM (SELECT *, unnest(range(1, length(token))) AS i FROM runs)) JOIN ratios USING (a, b) GROUP BY k),
more AS (SELECT doc_id, 3 AS rank, a, b FROM runs JOIN scored USING (k) WHERE regexp_matches(token, '[A-Za-z]') AND x >= {secrets.MIN_SUM} AND x >= {secrets.MIN_MEAN} * (b - a - 1) AND NOT EXISTS (SELECT 1 FROM base z WHERE z.doc_id = runs.doc_id AND z.a < runs.b AND runs.a < z.b)),
base_of AS (SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {r}) AS n_{b[0]}" for r, b in enumerate(secrets.BASE))}, {listed} AS listed FROM base GROUP BY doc_id),
all_of AS (SELECT doc_id, {listed} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{b[0]}, 0) AS n_{b[0]}" for b in secrets.BASE)}, sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN base_of USING (doc_id) LEFT JOIN all_of USING (doc_id)"""


def embedding_sql() -> str:
    return f"""WITH RECURSIVE good AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {embedding.MIN_COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN lowest USING (vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)"""


def clusters_sql() -> str:
    """K-means by plain distances to all centroids, a pair of subqueries a round."""
    k = clustering
    steps = f"""WITH good AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda v: floor({k.SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings
 WHERE len(embedding) = {k.DIMS} AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v) OR abs(v) >= {k.LARGEST // k.SCALE})) = 0),
entries AS MATERIALIZED (SELECT row_id, i, x[i] AS v FROM good, range(1, {k.DIMS + 1}) AS r(i)),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x AS c FROM (SELECT sha256('{k.SEED}:' || vec_id) AS h, x FROM good WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k.CLUSTERS}))"""
    for r in range(k.ROUNDS + 1):
        # squares in doubles are exact, as integers of the test tables are small
        steps += f""",
a{r} AS MATERIALIZED (SELECT row_id, arg_min(cluster, (far, cluster)) AS cluster, min(far) AS distance FROM (SELECT row_id, cluster, list_distance(x::DOUBLE[], c::DOUBLE[]) AS root, round(root * root)::BIGINT AS far FROM good, c{r}) GROUP BY row_id)"""
        if r < k.ROUNDS:
            steps += f""",
m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT cluster, i, sum(v)::BIGINT AS s, count(*) AS n FROM entries JOIN a{r} USING (row_id) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, old.c) AS c FROM c{r} old LEFT JOIN m{r} m USING (cluster))"""
    last = k.ROUNDS
    return f"""{steps}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN good USING (row_id) JOIN c{last} USING (cluster)"""


def warc_sql() -> str:
    bits = "array_to_string(list_transform(string_split(sha1(payload), ''), lambda h: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', h)]), '')"
    five = "list_sum(list_transform([1, 2, 3, 4, 5], lambda k: CASE WHEN substr(bits, 5 * i + k, 1) = '1' THEN 2 ** (5 - k) ELSE 0 END))::INT"
    return f"""WITH pages_ AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
hashed AS (SELECT *, {bits} AS bits, min(page_id) OVER (PARTITION BY payload) AS first_id FROM pages_)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {five} + 1, 1)), '') AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to, CASE WHEN page_id = first_id THEN true END AS digest_ok FROM hashed"""


def shards_sql() -> str:
    """Quantiles, the curve step by step (one subquery a bit and dimension), ranks; CRC by its table."""
    bits, dims = sharding.BITS, ("lang", "source", "size")
    passed = lambda upto: f"least(({upto}) * {2**bits} // all_, {2**bits - 1})"
    points = lambda c: f"SELECT coalesce(list(v), []) FROM (SELECT v, n, sum(n) OVER (ORDER BY v)::BIGINT AS upto, sum(n) OVER ()::BIGINT AS all_ FROM (SELECT {c} AS v, count(*) AS n FROM meta WHERE {c} IS NOT NULL GROUP BY 1)) WHERE {passed('upto')} > {passed('upto - n')}"
    step = "c"
    for _ in range(8):
        step = f"list_transform({step}, lambda v: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END)"
    table = step.replace("(c, lambda", "(range(0, 256), lambda", 1)
    # bytes of the text as numbers, folded over the table
    octets = "list_transform(range(0, octet_length(encode(t))), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)"
    crc = f"xor(4294967295, list_reduce({octets}, lambda acc, v: xor(acc >> 8, tab[xor(acc & 255, v) + 1]), 4294967295::BIGINT))"
    n = len(dims)
    curve = "SELECT *, c0 AS x0, c1 AS x1, c2 AS x2 FROM cells"
    for b in range(bits - 1, 0, -1):
        q = 2**b
        for i in range(n):
            swap = f"CASE WHEN x{i} & {q} <> 0 THEN 0 ELSE xor(x0, x{i}) & {q - 1} END" if i else "0"
            first = f"xor(xor(x0, CASE WHEN x{i} & {q} <> 0 THEN {q - 1} ELSE 0 END), {swap})"
            curve = f"SELECT * REPLACE ({first} AS x0{f', xor(x{i}, {swap}) AS x{i}' if i else ''}) FROM ({curve})"
    for i in range(1, n):
        curve = f"SELECT * REPLACE (xor(x{i}, x{i - 1}) AS x{i}) FROM ({curve})"
    curve = f"SELECT *, 0 AS tw FROM ({curve})"
    for b in range(bits - 1, 0, -1):
        curve = f"SELECT * REPLACE (CASE WHEN x{n - 1} & {2**b} <> 0 THEN xor(tw, {2**b - 1}) ELSE tw END AS tw) FROM ({curve})"
    digits = " + ".join(f"((xor(x{i}, tw) >> {b}) & 1) * {2 ** (b * n + n - 1 - i)}" for b in range(bits) for i in range(n))
    cut = lambda i, c: f"len(list_filter(q{i}, lambda q: coalesce({c} > q, false)))"
    return f"""WITH crc_table AS (SELECT {table} AS tab),
meta AS (SELECT doc_id, lang, source, t, h, octet_length(encode(t)) + 1 AS size FROM (SELECT *, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents)),
sums AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE {crc} END AS text_crc32 FROM meta CROSS JOIN crc_table),
cuts AS (SELECT {', '.join(f'({points(c)}) AS q{i}' for i, c in enumerate(dims))}),
cells AS (SELECT doc_id, size, text_crc32, {", ".join(f"{cut(i, c)} AS c{i}" for i, c in enumerate(dims))} FROM sums CROSS JOIN cuts),
placed AS (SELECT doc_id, size, text_crc32, {digits} AS hilbert, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS d FROM ({curve})),
ranked AS (SELECT *, row_number() OVER (ORDER BY hilbert, d, doc_id, size, text_crc32) - 1 AS r, count(*) OVER () AS n FROM placed),
dealt AS (SELECT *, (r * {sharding.N_SHARDS}) // n AS shard FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (r - (shard * n + {sharding.N_SHARDS - 1}) // {sharding.N_SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, hilbert::BIGINT AS hilbert FROM dealt"""
