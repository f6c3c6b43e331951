"""Language, tokens and decontamination: operators that read each text by itself."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from strandloom.llm import decontamination as D
from strandloom.llm import langid, queries, tokencount

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_language(spark, sf).collect()
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) > 0.97 * len(held)
    assert sum(r.rejected for r in rows) < 0.02 * len(rows)


def test_language_cases(docs_of):
    texts = ["the cat and the dog are in the house " * 3, "der hund und die katze sind im haus " * 3] * 6 + [None, "", "123 !! ½²", "the house and the dog", "x" * 200_000]
    docs = docs_of(texts, langs=["en", "de"] * 6 + ["en", None, "en", None, None], extra=True)
    model = langid.fit(docs)
    assert set(model) == {"de", "en"}
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert [rows[i].lang_pred for i in (12, 13, 14)] == ["und"] * 3 and all(rows[i].rejected and rows[i].score == 0 for i in (12, 13, 14))
    assert rows[15].lang_pred == "en" and rows[16].lang_pred in model and rows[0].lang_pred == "en" and rows[1].lang_pred == "de"
    assert langid.predict(docs.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0)) == {} and langid.predict(docs, {}).where("lang_pred <> 'und'").count() == 0
    kept = langid.predict(docs_of(["a b", None], ids=[2**60 + 1, None]), model, keep=("doc_id", "n_chars")).collect()
    assert {r.doc_id for r in kept} == {2**60 + 1, None}


def test_short_texts_are_told_apart():
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    learned = {}
    for r in rows:
        if r["text"] and len(r["text"]) <= langid.SAMPLE_CHARS and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            learned.setdefault(r["lang"], []).append(r["text"])
    model = tuple(sorted((k, langid._joined(v[:400])) for k, v in learned.items()))
    for text, lang in (("Avec.", "fr"), ("die katze und der hund", "de")):
        found, margin = langid.classify(text, model)
        assert found == lang and margin >= langid.MIN_MARGIN
    few = [r for r in rows if r["text"] and 2 <= len(r["text"].split()) <= 10]
    found = [langid.classify(r["text"], model) for r in few]
    assert sum(p >= langid.MIN_MARGIN and k == r["lang"] for (k, p), r in zip(found, few)) > 0.95 * len(few)


def test_language_equals_brute_force(spark):
    """Every document of the query, classified anew: letters only, blocks of 1,024 bytes, one dictionary after the other."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in queries.op8_language(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        letters = " ".join("".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()).encode()
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not letters:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        while len(letters) < 256:
            letters = letters + b" " + letters
        sizes = {}
        for lang, raw in model.items():
            packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(packer.compress(letters[i : i + 1024])) for i in range(0, len(letters), 1024))
        first, second = sorted(sizes.values())[:2]
        if first < 0.99 * second:
            assert got[r.doc_id].lang_pred == min(sizes, key=sizes.get)
            if len(letters) > 600:
                assert abs(got[r.doc_id].score - (1 - first / second)) < 1e-9


def test_documents_without_an_id_are_neither_learned_from_nor_held_out(docs_of):
    assert docs_of(["x"], ids=[None]).select(langid.in_training(), langid.held_out()).first() == (False, False)


def test_labels_of_held_out_documents_are_not_read(docs_of):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert langid.fit(docs_of(["le chat et le chien"] * len(ids), ids=ids, langs=["fr"] * len(ids))) == {}


def library_counts(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(PATH)


def test_tokens_of_random_texts(counter):
    rng = random.Random(3)
    letters = list("abcdstmrvel'' \n\t  1239!?.é ñ中国🎉  \u0085\x1c½²Ⅷ́ا") + ["<|endoftext|>", "'re", "'ll ", "the", "   "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += [None, "", "<|endoftext|>", "'", " '", "'r", "a" * 5000, " " * 3000, "=" * 700, "the" * 2000]
    assert counter.count(texts) == library_counts(texts)


def test_every_code_point(counter):
    texts = [f"a{chr(p)}b 1{chr(p)}2 .{chr(p)}." for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    assert counter.count(texts) == library_counts(texts)


def test_state_maps_compose(counter):
    rng = random.Random(8)
    text = "".join(rng.choice("ab '\n1.re") for _ in range(3001))
    import numpy as np

    classes = counter.classes.take(np.frombuffer((text + "\0").encode("utf-32-le"), np.uint32)).copy()
    classes[-1] = tokencount._END
    state, want = tokencount._START, np.zeros(len(classes), bool)
    for i, c in enumerate(classes.tolist()):
        mark = counter.mark[state * tokencount._CLASSES + c]
        want[i] |= bool(mark & 1)
        if mark & 2:
            want[i - 1] = True
        state = counter.next[state * tokencount._CLASSES + c]
    assert (counter.marks(classes) == want).all()


def test_token_query(spark, docs_of):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in queries.op5_token_counts(spark, sf).collect()}
    for r, n in zip(docs, library_counts([r.text for r in docs])):
        assert tuple(rows[r.doc_id]) == (r.doc_id, len((r.text or "").encode()), n, n > 512)
    odd = tokencount.count_tokens(docs_of([None, "", "hi"], ids=[2**61, None, 1], extra=True), PATH).collect()
    assert {(r.doc_id, r.n_tokens) for r in odd} == {(2**61, 0), (None, 0), (1, 1)}


def plain_words(text):
    """Letter by letter: a new word at each blank or sign, and around each letter of a script without spaces."""
    out, held = [], ""
    for c in (text or "").lower() + " ":
        alone = c.isalnum() and any(a <= ord(c) <= b for a, b in ((0xE00, 0x109F), (0x1780, 0x17FF), (0x3005, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)))
        if (c.isalnum() or c == "_") and not alone:
            held += c
            continue
        out += [x for x in (held, c if alone else "") if x]
        held = ""
    return out


def plain_hits(texts, items):
    """Every item against every passage, without an index: its own BM25, passages and overlaps."""
    split = []
    for k, text in items:
        parts = [w for s in re.split(r"[.!?\n。！？]+\s*", text or "") if (w := plain_words(s))]
        if len(parts) > 1:
            split.append((k, sum(parts[:-1], []), parts[-1]))
        elif parts:
            n = max(1, len(parts[0]) // 4)
            split.append((k, parts[0][:-n], parts[0][-n:]))
    n_items = len(split)
    df = Counter(t for _, q, a in split for t in set(q + a))
    mean = sum(len(q + a) for _, q, a in split) / max(1, n_items)
    out = []
    for text in texts:
        words, found = plain_words(text), {}
        for k, q, a in split:
            bag = Counter(q + a)
            n = len(q + a)
            raw = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean)) for t, f in bag.items()}
            size = 32
            while size < n:
                size *= 2
            for at in range(0, len(words), size):
                passage = words[at : at + 2 * size]
                have = set(passage)
                score = sum(x for t, x in raw.items() if t in have) / sum(raw.values())
                shares = []
                for part in (q, a):
                    g = min(3, len(part))
                    wanted = {tuple(part[i : i + g]) for i in range(len(part) - g + 1)} if g else set()
                    there = {tuple(passage[i : i + g]) for i in range(len(passage) - g + 1)} if g else set()
                    shares.append(len(wanted & there) / len(wanted) if wanted else 1.0)
                if score >= 0.5 and min(shares) >= 0.5:
                    found[k] = max(found.get(k, 0.0), round(score, 9))
        out.append(found)
    return out


def test_decontamination_equals_plain_search(spark, docs_of):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    items = [(i, f"{sentence(rng.randint(6, 20))} {sentence(rng.randint(2, 8))}") for i in range(60)] + [(60, ""), (61, None), (62, "single words only here now")]
    texts = []
    for k in range(200):
        parts = [sentence(12) for _ in range(rng.randint(0, 30))]
        if k % 3 == 0:
            body = rng.choice(items[:60])[1]
            parts.insert(rng.randint(0, len(parts)), body.upper().replace(".", " !") if k % 2 else " ".join(w for w in body.split() if rng.random() > 0.15 * (k % 4)))
        texts.append(" ".join(parts))
    texts += [None, "", "!!", items[0][1], items[1][1] + " " + items[2][1], "single words only here now"]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as hits")
    rows = {r.doc_id: {h.item_id: round(h.score, 9) for h in r.hits} for r in D.decontaminate(docs_of(texts, extra=True), benchmark).collect()}
    assert dict(enumerate(plain_hits(texts, items))) == rows
    assert set(rows[203]) == {0} and set(rows[204]) == {1, 2} and set(rows[205]) == {62} and not rows[200]


@pytest.mark.parametrize("index_bytes", [1 << 30, 4_000])
def test_items_of_any_length_whole_and_by_parts(spark, docs_of, monkeypatch, index_bytes):
    monkeypatch.setattr(D, "INDEX_BYTES", index_bytes)
    monkeypatch.setattr(D, "BLOCK", 2)
    monkeypatch.setattr(D, "CELLS", 300)
    rng = random.Random(5)
    word = lambda: f"t{min(rng.randint(0, 500), rng.randint(0, 500))}"
    body = lambda n: " ".join(word() for _ in range(n))
    items = [(i, f"{body(n)}. {body(max(1, n // 5))}") for i, n in enumerate([5, 5, 9, 20, 31, 32, 40, 64, 90, 150, 300, 700, 2000] * 2)]
    items.append((99, items[7][1]))
    texts = [f"{body(rng.randint(0, 200))} {t} {body(rng.randint(0, 200))}" for _, t in items]
    texts += [" ".join(w for w in t.split() if rng.random() > 0.2) for _, t in items] + [body(3000), "", None]
    rows = {r.doc_id: {h.item_id: round(h.score, 9) for h in r.hits} for r in D.decontaminate(docs_of(texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert rows == dict(enumerate(plain_hits(texts, items)))
    assert all(items[i][0] in rows[i] for i in range(len(items)))


def test_items_without_an_id_are_reported(spark, docs_of):
    items = spark.createDataFrame([(None, "alpha beta gamma delta. epsilon"), (3, "one two three four five. six")], "item_id long, text string")
    rows = D.decontaminate(docs_of(["alpha beta gamma delta. epsilon", "one two three four five. six", "x"]), items).collect()
    assert [[h.item_id for h in r.hits] for r in sorted(rows)] == [[None], [3], []]


def test_decontamination_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL["op1_decontaminate"]).fetchall()
    got = queries.op1_decontaminate(spark, sf).select("doc_id", "item_id", "score", "question_overlap", "answer_overlap").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_large_benchmarks_are_dealt_to_parts(spark, docs_of, monkeypatch):
    rng = random.Random(7)
    items = [(i, " ".join(f"t{rng.randint(0, 400)}" for _ in range(20)) + ". " + " ".join(f"t{rng.randint(0, 400)}" for _ in range(4))) for i in range(40)]
    docs = docs_of([t for _, t in items[:10]] + ["nothing here"])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = D.decontaminate(docs, benchmark).collect()
    monkeypatch.setattr(D, "INDEX_BYTES", 1500)
    parts = D.decontaminate(docs, benchmark).collect()
    shape = lambda rows: {r.doc_id: [(h.item_id, round(h.score, 9)) for h in r.hits] for r in rows}
    assert shape(parts) == shape(whole) and all(whole[i].hits for i in range(10))


def test_equal_items_and_items_without_an_id_in_bounded_parts(spark, docs_of, monkeypatch):
    rng = random.Random(9)
    item = lambda: " ".join(f"t{rng.randint(0, 400)}" for _ in range(20)) + ". " + " ".join(f"t{rng.randint(0, 400)}" for _ in range(4))
    same, long = item(), " ".join(f"l{i}" for i in range(900)) + ". l5 l9 l2"
    items = [(None, item()) for _ in range(15)] + [(4, same)] * 15 + [(5, long)]
    docs = docs_of([t for _, t in items[:15]] + [same, long, "nothing here"])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = D.decontaminate(docs, benchmark).collect()
    monkeypatch.setattr(D, "INDEX_BYTES", 700)
    dealt = D._dealt(D._items(benchmark, "item_id", "text", None, None).withColumn("number", F.monotonically_increasing_id()), 2).collect()
    sizes = {}
    for r in dealt:
        sizes.setdefault(r.part, []).append(len(r.q))
    assert len(dealt) == len(items) and all(sum(x) <= 700 or len(x) == 1 for x in sizes.values())
    shape = lambda rows: {r.doc_id: sorted((h.item_id is None, h.item_id or 0, round(h.score, 9)) for h in r.hits) for r in rows}
    assert shape(D.decontaminate(docs, benchmark).collect()) == shape(whole)
    assert len(shape(whole)[15]) == 15 and len(shape(whole)[16]) == 1 and all(shape(whole)[i] for i in range(15)) and not shape(whole)[17]


def unspaced(rng, n):
    return "".join(chr(rng.choice((0x4E00, 0x3041, 0x0E01)) + rng.randint(0, 40)) for _ in range(n))


def test_scripts_without_spaces_are_decontaminated(spark, docs_of, tmp_path):
    rng = random.Random(12)
    items = [(i, f"{unspaced(rng, 45)}。{unspaced(rng, 15)}") for i in range(5)] + [(9, f"mixed words {unspaced(rng, 20)} and more of them. tail words here")]
    texts = [f"{unspaced(rng, 300)}{t}{unspaced(rng, 200)}" for _, t in items] + [unspaced(rng, 600), f"plain words and {unspaced(rng, 30)}"]
    docs, benchmark = docs_of(texts), spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: {h.item_id: round(h.score, 9) for h in r.hits} for r in D.decontaminate(docs, benchmark).collect()}
    assert rows == dict(enumerate(plain_hits(texts, items))) and [list(rows[i]) for i in range(8)] == [[0], [1], [2], [3], [4], [9], [], []]
    for name, df in (("documents", docs), ("benchmark", benchmark)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op1_decontaminate"]).fetchall()
    got = queries.op1_decontaminate(spark, str(tmp_path)).select("doc_id", "item_id", "score", "question_overlap", "answer_overlap").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs_of(["a b"]), none).first().hits == []
    assert D.decontaminate(docs_of([]), spark.createDataFrame([(1, "a b. c")], "item_id long, text string")).count() == 0


def test_long_document_is_searched_whole(spark, docs_of):
    item = "alpha beta gamma delta epsilon zeta eta theta iota. kappa lambda mu"
    text = "filler " * 60_000 + item + " filler" * 50
    assert D.decontaminate(docs_of([text]), spark.createDataFrame([(5, item)], "item_id long, text string")).first().hits[0].item_id == 5


def merged(text, ranks):
    """Number of tokens by merging the leftmost pair of the lowest rank until none has one."""
    symbols = list(text)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not pairs:
            return len(symbols)
        _, i = min(pairs)
        symbols[i : i + 2] = ["".join(symbols[i : i + 2])]


def test_transducer_equals_merging(monkeypatch):
    """Small vocabularies with many overlaps, and tables emptied after few states."""
    import numpy as np

    from strandloom.llm import countmachine

    monkeypatch.setattr(countmachine, "STATES", 40)
    monkeypatch.setattr(countmachine, "PART_BYTES", 64)
    monkeypatch.setattr(countmachine, "LONG_PIECE", 30)
    rng = random.Random(12)
    alphabet = [chr(b) if chr(b) in "abc" else f"<{b}>" for b in range(256)]
    for _ in range(60):
        symbols, merges = ["a", "b", "c"], []
        while len(merges) < rng.randint(3, 40):
            pair = rng.choice(symbols), rng.choice(symbols)
            if pair not in merges and "".join(pair) not in symbols and len("".join(pair)) < 9:
                merges.append(pair)
                symbols.append("".join(pair))
        machine, ranks = countmachine.Transducer(alphabet, merges), {p: r for r, p in enumerate(merges)}
        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 50))) for _ in range(60)]
        size = np.array([len(t) for t in texts])
        first = np.cumsum(size) - size
        got = machine.counts(np.frombuffer("".join(texts).encode(), np.uint8), first, size)
        assert got.tolist() == [merged(t, ranks) for t in texts]


def test_transducer_refuses_merges_out_of_order():
    from strandloom.llm import countmachine

    with pytest.raises(ValueError):
        countmachine.Transducer([chr(b) for b in range(256)], [("ab", "c"), ("a", "b")])


def test_no_texts_no_tokens(docs_of):
    assert tokencount.count_tokens(docs_of([]), PATH).count() == 0
