"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers (DataFrame operations only).

Base spans.  Three kinds of leftmost, non-overlapping matches (``BASE``), of which those that are too short are dropped
after matching.  A span is the whole match, in code points, end exclusive.

Model.  Two first-order Markov chains over characters, one of random strings and one of ordinary identifiers and words,
are counted from labelled samples (``samples``, or another table of token and is_random).  A pair of characters adds the
logarithm of the ratio of its two conditional probabilities, in thousandths and rounded, so that sums are exact.  A run
of at least ``MIN_RUN`` token characters, a letter among them (long numbers are no secrets), becomes a span of kind
``random`` if its sum and its mean are high enough and it overlaps no base span.

Positions come from splitting a text at its matches: a match starts after all earlier gaps and matches.  Texts without
a match, nearly all of them, are only searched.

Scale.  One narrow pass over whole texts, no shuffle, no Python.  The model is an array literal of about 4,600 integers
whatever the corpus.

Cases.  Null text: as empty, no spans.  Repeated rows: each gets its row.  Extra columns are ignored.  Empty table: no
rows.  Very long texts: linear in their length and, up to a million matches, nearly so in their matches (``_scan``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: kind, pattern, group whose length counts, least length.  Fixed values.  (Of "access" and "hex", a match that is long
#: enough takes its whole run either way, so the least length may stand in the pattern and fewer matches are dropped.)
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
KINDS = (*(b[0] for b in BASE), "random")
RUN = r"[A-Za-z0-9+/_-]{16,}"
MIN_RUN = 16
#: A run is random from this sum and this mean of its pairs on, in thousandths of a natural logarithm.
MIN_SUM, MIN_MEAN = 10_000, 600
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
N_RANDOM = 2_000
#: Names with dates and numbers among the ordinary samples, of four forms each.
N_DATED = 150
#: Weight, in pairs, of a character's share of all pairs against its share after the one before.
BACK_OFF = 4.0
_SPAN = "struct<start:bigint,rank:int,end:bigint>"
_BLOCK = 128
#: Labelled as ordinary: identifiers and long words of several languages.
ORDINARY = """
getUserAccountById setDefaultConfiguration maxConnectionPoolSize number_of_retries_before_failure isAuthenticationRequired updateCustomerAddress
parseRequestHeaders background-color-transparent internationalization responsibilities characteristically telecommunications
infrastructure_as_code deploymentEnvironmentName read_only_replica_count lastModifiedTimestamp serialVersionUID HttpServletRequestWrapper
AbstractSingletonProxyFactoryBean test_function_returns_expected_value DATABASE_CONNECTION_TIMEOUT DEFAULT_BUFFER_SIZE ENABLE_EXPERIMENTAL_FEATURES
usr/local/share/applications home/projects/source/main/resources assets/images/thumbnails/header content-security-policy access-control-allow-origin
understanding misunderstanding straightforwardness counterproductive environmental transformation organizational recommendations
Geschwindigkeitsbegrenzung Verantwortungsbewusstsein Wissenschaftlichkeit Unabhaengigkeitserklaerung Nachrichtenagentur Zusammenarbeit
Bundesverfassungsgericht Arbeitsgemeinschaft Entwicklungsmoeglichkeiten Lebensversicherungsgesellschaft Selbstverstaendlichkeit einheitlichkeit
anticonstitutionnellement responsabilisation professionnellement developpement gouvernementales particulierement commercialisation renseignements
desafortunadamente responsabilidades administraciones internacionalmente establecimientos acontecimientos electrodomesticos caracteristicas
threatening nevertheless therefore heretofore withstanding throughout another weathering gatherings handbreadths thousandths something everything
listOfPendingTransactions calculateTotalAmount renderTemplateWithContext onClickHandler useEffectCallback componentDidMount createReadStream
fetchRemoteRepository initializeApplicationContext validateInputParameters convertStringToInteger currentWorkingDirectory temporaryFileName
user_session_identifier primary_key_column foreign_key_constraint unique_index_name created_at_timestamp updated_by_user
vertical-align-middle navigation-bar-collapse font-family-monospace search-engine-optimization frequently-asked-questions
proportionality incomprehensible interdisciplinary representatives multidimensional notwithstanding entertainment announcements
documentation configuration implementation authentication authorization notification subscription verification
src/components/dashboard/widgets tests/integration/fixtures docs/reference/getting-started release-candidate-branch feature/add-login-page
heutzutage entsprechend gesellschaftlich wirtschaftliche politischen Regierung oeffentlichkeit unterschiedlich verschiedene
quelquefois aujourdhui maintenant longtemps certainement evidemment heureusement difficilement simplement naturellement
cuarenta mientras siempre entonces tambien nosotros vosotros trabajadores profesores estudiantes universidad gobierno
""".split()


def samples(spark: SparkSession, n_random: int = N_RANDOM, n_dated: int = N_DATED) -> DataFrame:
    """token, is_random: ``ORDINARY`` as written and in capitals (words apart by _), times, and names with dates or numbers; and hexadecimal, base-64 and upper-case strings made of digests of 1, 2, ..., n_random."""
    words = spark.createDataFrame([(x,) for x in ORDINARY], "token string")
    capitals = F.upper(F.regexp_replace("token", "([a-z])([A-Z])", "$1_$2"))
    written = words.select(F.explode(F.array_distinct(F.array("token", capitals))).alias("token"))
    i = F.col("id")
    two = lambda times, base, first=0: F.lpad((first + i * times % base).cast("string"), 2, "0")
    year, month, day, hour, minute, second = (1990 + i % 40).cast("string"), two(1, 12, 1), two(7, 28, 1), two(5, 24), two(11, 60), two(13, 60)
    word = F.lower(F.lit(ORDINARY)[(i % len(ORDINARY)).cast("int")])
    named = F.array(
        F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit("T"), hour, F.lit("-"), minute, F.lit("-"), second, F.lit("Z")), F.concat_ws("/", word, year, month, day),
        F.concat_ws("-", word, year, F.lpad((i * 37).cast("string"), 6, "0")), F.concat(word, F.lit("_"), year, month, day, F.lit("_"), hour, minute, second),
    )
    ordinary = written.unionByName(spark.range(1, n_dated + 1).select(F.explode(named).alias("token"))).select("token", F.lit(False).alias("is_random"))
    hexed = F.sha2(F.col("id").cast("string"), 256)
    plain = F.regexp_replace(F.base64(F.unhex(hexed)), "=", "")
    forms = F.array(hexed, plain, F.upper(F.regexp_replace(plain, "[+/]", "")))
    return ordinary.unionByName(spark.range(1, n_random + 1).select(F.explode(forms).alias("token"), F.lit(True).alias("is_random")))


def fit(labelled: DataFrame) -> list[int]:
    """The table of log-likelihood ratios: entry ``a * len(ALPHABET) + b`` is for the pair of characters a, b.

    ``labelled`` is bounded by the caller; the driver gets at most len(ALPHABET) ** 2 counts for each label.
    """
    n = len(ALPHABET)
    chars = labelled.where("length(token) > 1").select("is_random", F.split("token", "").alias("c"))
    pairs = chars.select("is_random", F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("a"), F.expr("slice(c, 2, size(c) - 1)").alias("b"))).alias("p"))
    pairs = pairs.select("is_random", F.expr(f"locate(p.a, '{ALPHABET}')").alias("a"), F.expr(f"locate(p.b, '{ALPHABET}')").alias("b"))
    counts = {(r.is_random, r.a - 1, r.b - 1): r.n for r in pairs.where("a > 0 and b > 0").groupBy("is_random", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {k: sum(v for (x, _, _), v in counts.items() if x == k) for k in (True, False)}
    after = {(k, b): (sum(counts.get((k, a, b), 0) for a in range(n)) + 0.5) / (total[k] + 0.5 * n) for k in (True, False) for b in range(n)}
    rows = {(k, a): sum(counts.get((k, a, b), 0) for b in range(n)) for k in (True, False) for a in range(n)}
    prob = lambda k, a, b: (counts.get((k, a, b), 0) + BACK_OFF * after[k, b]) / (rows[k, a] + BACK_OFF)
    return [round(1000 * math.log(prob(True, a, b) / prob(False, a, b))) for a in range(n) for b in range(n)]


def _scan(rows: Column, zero: Column, step, made: str) -> Column:
    """What ``step(carry, row)``, a pair of the next carry and a value of type ``made``, gives for each row in turn.

    A fold that appends copies its list at each row; here it does so within blocks of ``_BLOCK`` rows, and the blocks' lists are appended.
    """

    def cut(rows: Column) -> Column:
        last = F.greatest(F.floor((F.size(rows) - 1) / _BLOCK).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(rows, i * _BLOCK + 1, F.lit(_BLOCK)))

    blocks = F.transform(F.array(rows), cut)[0]  # a variable, or rows would be made again for each block

    def block(done: Column, part: Column) -> Column:
        def row(state: Column, x: Column) -> Column:
            carry, value = step(state["at"], x)
            return F.struct(carry.cast("bigint").alias("at"), F.concat(state["out"], F.array(value.cast(made))).cast(f"array<{made}>").alias("out"))

        begin = F.struct(done["at"].alias("at"), F.array().cast(f"array<{made}>").alias("out"))
        return F.aggregate(part, begin, row, lambda s: F.struct(s["at"].alias("at"), F.concat(done["out"], F.array(s["out"])).cast(f"array<array<{made}>>").alias("out")))

    begin = F.struct(zero.cast("bigint").alias("at"), F.array().cast(f"array<array<{made}>>").alias("out"))
    return F.aggregate(blocks, begin, block, lambda s: F.flatten(s["out"]))


def _found(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans (start, rank, end) of the pattern's matches whose group has the least length."""
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("g"), whole.alias("m"), part.alias("p"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["g"])
        end = start + F.length(x["m"])
        return end, F.when(F.length(x["p"]) >= least, F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))

    spans = F.filter(_scan(rows, F.lit(0), step, _SPAN), lambda x: x.isNotNull())
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _apart(base: Column, more: Column) -> Column:
    """Base spans and those further ones that overlap none of them, sorted.  ``more`` are disjoint, and none is empty."""
    fields = lambda s: [s[x].alias(x) for x in ("start", "rank", "end")]
    is_base = lambda s: s["rank"] < len(BASE)

    def forward(reached: Column, s: Column) -> tuple[Column, Column]:  # how far base spans reach that start no later
        return F.when(is_base(s), F.greatest(reached, s["end"])).otherwise(reached), F.when(is_base(s) | (s["start"] >= reached), F.struct(*fields(s)))

    def backward(begins: Column, s: Column) -> tuple[Column, Column]:  # where the next base span starts
        return F.when(is_base(s), s["start"]).otherwise(begins), F.when(is_base(s) | (s["end"] <= begins), F.struct(*fields(s)))

    there = lambda x: x.isNotNull()
    right = F.filter(_scan(F.array_sort(F.concat(base, more)), F.lit(0), forward, _SPAN), there)
    both = F.reverse(F.filter(_scan(F.reverse(right), F.lit(2**62), backward, _SPAN), there))
    return F.when((F.size(base) > 0) & (F.size(more) > 0), both).otherwise(F.concat(base, more))


def _score(token: Column, ratios: Column, codes: Column) -> Column:
    chars = F.split(token, "")
    n = F.length(token)
    code = lambda c: codes[F.ascii(c)]
    pairs = F.zip_with(F.slice(chars, 1, n - 1), F.slice(chars, 2, n - 1), lambda a, b: ratios[code(a) * len(ALPHABET) + code(b)])
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _random(text: Column, ratios: list[int]) -> Column:
    """Spans of runs that look random."""
    table, codes = F.lit(ratios), F.lit([max(0, ALPHABET.find(chr(i))) for i in range(128)])
    runs = F.regexp_extract_all(text, F.lit(RUN), 0)
    spans = _found(text, RUN, 0, MIN_RUN, len(BASE))
    scored = F.zip_with(spans, F.transform(runs, lambda t: F.when(t.rlike("[A-Za-z]"), _score(t, table, codes)).otherwise(0)), lambda s, x: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), x.alias("x")))
    good = F.filter(scored, lambda s: (s["x"] >= MIN_SUM) & (s["x"] >= MIN_MEAN * (s["end"] - s["start"] - 1)))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ratios: list[int] | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of struct(start, rank, end), sorted; rank indexes ``KINDS``.  base has the fixed patterns' spans, spans all."""
    ratios = fit(samples(docs.sparkSession)) if ratios is None else ratios
    t = F.col("__t")
    out = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    base = F.concat(*[_found(t, pattern, group, least, rank) for rank, (_, pattern, group, least) in enumerate(BASE)])
    out = out.select("doc_id", F.array_sort(base).alias("base"), _random(t, ratios).alias("more"))
    return out.select("doc_id", "base", _apart(F.col("base"), F.col("more")).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_rows(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{b[0]}") for i, b in enumerate(BASE)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
