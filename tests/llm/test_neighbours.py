"""Near-duplicates, embeddings, components, archives and the pipeline."""

import base64
import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import components, embedding, mixing, neardup, warc
from strandloom.llm.shared import Sets


def text_of(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def edited(rng, text, k):
    words = text.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**9)}"
    return " ".join(words)


def plain_chain(a, b):
    """Longest common subsequence, by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_classes(ids, texts):
    """All pairs: those that share 0.3 of their labelled shingles link if their words align to 0.8."""
    held = [neardup.words(t) for t in texts]
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in held]
    sets = Sets(len(ids))
    for i, a in enumerate(held):
        for j in range(i):
            b = held[j]
            shared = (bags[i] & bags[j]).total()
            if not shared or shared < 0.3 * (bags[i].total() + bags[j].total() - shared):
                continue
            chain = plain_chain(a, b)
            if chain >= 0.8 * (len(a) + len(b) - chain):
                sets.join(i, j)
    smallest = {}
    for i, k in enumerate(ids):
        smallest[sets.find(i)] = min(k, smallest.get(sets.find(i), k))
    return {k: smallest[sets.find(i)] for i, k in enumerate(ids)}


def test_banded_alignment_equals_the_whole_table(monkeypatch):
    rng = random.Random(21)
    for trial in range(400):
        monkeypatch.setattr(neardup, "SEGMENT", rng.choice([3, 8, 64]))
        monkeypatch.setattr(neardup, "WHOLE", rng.choice([0, 1 << 15]))
        a = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 90))]
        b = [x for x in a if rng.random() > rng.choice([0, 0.05, 0.2])]
        for _ in range(rng.choice([0, 1, 3, 9, 30])):
            b.insert(rng.randint(0, len(b)), rng.choice("abcdefghijkl"))
        if trial % 7 == 0:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        least = rng.choice([0.5, 0.8, 0.9])
        chain = plain_chain(a, b)
        want, got = chain / (len(a) + len(b) - chain), neardup.alignment(a, b, least)
        assert got == want if want >= least else got <= want


def test_near_duplicates_equal_all_pairs(docs_of):
    rng = random.Random(1)
    texts = []
    for g in range(25):
        first = text_of(rng, rng.choice([3, 8, 40, 120, 300]))
        texts += [first] + [edited(rng, first, rng.choice([0, 1, 1, 2, 4, 9])) for _ in range(rng.randint(0, 6))]
    half = text_of(rng, 200).split()
    texts += [" ".join(half), " ".join(half[100:] + half[:100]), " ".join(half).upper().replace(" ", ", ")]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(texts, ids=ids, extra=True)).collect()}
    want = plain_classes(ids, texts)
    assert {k: r.class_id for k, r in got.items()} == want
    assert all(r.kept == (r.class_id == k) for k, r in got.items())
    moved = ids[-3:]
    assert want[moved[0]] == want[moved[2]] and want[moved[0]] != want[moved[1]]  # the order of a text counts


def test_large_group_is_dealt_to_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 8)
    rng = random.Random(3)
    first = text_of(rng, 80)
    texts = [edited(rng, first, 1) for _ in range(60)] + [text_of(rng, 80) for _ in range(20)]
    out = neardup.near_duplicates(docs_of(texts)).collect()
    assert {r.doc_id: r.class_id for r in out} == plain_classes(list(range(80)), texts)


def forest_classes(n, links):
    sets = Sets(n)
    assert all(sets.join(a, b) for a, b in links)
    return {i: sets.find(i) for i in range(n)}


def test_tiles_find_the_links_of_all_pairs():
    rng = random.Random(9)
    firsts = [text_of(rng, rng.choice([6, 12, 13, 40])) for _ in range(6)]
    texts = [edited(rng, rng.choice(firsts), rng.choice([0, 1, 1, 2])) for _ in range(150)] + ["a b", "a b c d e f"]
    held, ids = [neardup.words(t) for t in texts], list(range(len(texts)))
    for tile in (1, 7, 64, 1000):
        assert forest_classes(len(texts), neardup.forest(held, [0] * len(texts), tile=tile)) == plain_classes(ids, texts)
    side = [i % 3 // 2 for i in ids]
    across = Sets(len(texts))
    for a in ids:
        for b in ids[:a]:
            if side[a] != side[b] and plain_classes([0, 1], [texts[a], texts[b]])[1] == 0:
                across.join(a, b)
    for tile in (7, 1000):
        links = neardup.forest(held, side, tile=tile)
        assert all(side[a] != side[b] for a, b in links)
        assert forest_classes(len(texts), links) == {i: across.find(i) for i in ids}


def test_memory_of_a_block_of_short_texts():
    words = "one two three four five six seven eight nine ten eleven twelve thirteen".split()
    texts = [[*words[:-1], f"x{i}"] for i in range(7_000)]
    tracemalloc.start()
    try:
        links = neardup.forest(texts, [i % 2 for i in range(len(texts))])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(links) == len(texts) - 1  # 8 shingles of 10
    assert peak < 150e6  # one matrix of 7,000 x 7,000 has 196 MB in single precision


def test_classes_of_a_group_that_blocks_leave_apart(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 4)
    rng = random.Random(13)
    shared = text_of(rng, 60)
    firsts = [f"{shared} {text_of(rng, 90)}" for _ in range(6)]  # one group by what they share, several classes
    texts = [edited(rng, rng.choice(firsts), rng.choice([1, 2, 5])) for _ in range(70)]
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    out = neardup.near_duplicates(docs_of(texts)).collect()
    assert {r.doc_id: r.class_id for r in out} == plain_classes(list(range(70)), texts)


def test_short_texts_in_many_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 4)
    rng = random.Random(11)
    first = text_of(rng, 14)
    texts = [edited(rng, first, 1) for _ in range(60)]
    out = neardup.near_duplicates(docs_of(texts)).collect()
    assert {r.doc_id: r.class_id for r in out} == plain_classes(list(range(60)), texts)


def test_chained_texts_are_not_compared_with_the_whole_chain(docs_of, monkeypatch):
    """Texts that share half with the next one: a chain of candidates without links, whose tasks grow with its length and not with the square."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 4)
    dealt, verified = [], neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda tasks: dealt.append(tasks.count()) or verified(tasks))
    rng = random.Random(8)
    halves = [text_of(rng, 40, 10**9) for _ in range(97)]
    texts = [f"{a} {b}" for a, b in zip(halves, halves[1:])]
    texts += [edited(rng, t, 2) for t in texts[::12]]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(list(enumerate(texts)))).collect()}
    assert got == plain_classes(range(len(texts)), texts)
    assert sum(dealt) < 8 * len(texts)


def test_copies_of_many_sketches_are_verified_once(docs_of, monkeypatch):
    """One class whose texts have many hubs: what the first pass joins is not dealt again for each of them."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 16)
    dealt, verified = [], neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda tasks: dealt.append(tasks.count()) or verified(tasks))
    rng = random.Random(21)
    first = text_of(rng, 120)
    texts = [edited(rng, first, 4) for _ in range(120)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(list(texts))).collect()}
    assert got == plain_classes(range(len(texts)), texts)
    assert sum(dealt) < 6 * len(texts)


def test_texts_of_one_common_passage_in_many_lengths(docs_of, monkeypatch):
    """Hubs' groups above two blocks are dealt by length too; copies of any length are found."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 6)
    rng = random.Random(22)
    passage = text_of(rng, 60)
    texts = [f"{passage} {text_of(rng, rng.randint(1, 120), 10**9)}" for _ in range(80)]
    texts += [edited(rng, rng.choice(texts), 3) for _ in range(30)]
    texts += [" ".join(t.split()[:-4]) for t in texts[:10]]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(texts)).collect()}
    assert got == plain_classes(range(len(texts)), texts)


def test_texts_of_other_words_are_not_aligned(monkeypatch):
    rng = random.Random(23)
    passage = text_of(rng, 60)
    texts = [f"{passage} {text_of(rng, 60, 10**9)}".split() for _ in range(60)]
    looks, aligned = [], neardup.alignment
    monkeypatch.setattr(neardup, "alignment", lambda *a: looks.append(1) or aligned(*a))
    assert neardup.forest(texts, [0] * len(texts)) == [] and len(looks) < 60


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    written, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda *a: written.append(1) or cut(*a))
    links = [(i, i + 1) for i in range(0, 400)] + [(900, 800), (-5, -9)]
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(401)} | {900: 800, 800: 800, -5: -9, -9: -9} and len(written) == 2
    monkeypatch.setattr(components, "FEW", 0)
    assert got == {r.id: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}


def test_near_duplicate_cases(docs_of):
    texts = [None, "", "  ", "!!!", "!!!", "???", "one two", "One, two.", "a b c d e f", "a b c d e f", None]
    rows = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(texts)).collect()}
    assert rows == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10}
    docs = docs_of(["same text of some words"] * 5 + ["same text of some words", "other"], ids=[4, 4, 2, 9, None, 2, 2])
    kept = neardup.drop_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text[:5]) for r in kept) == [(False, 2, "other"), (False, 2, "same "), (True, 0, "same ")]
    assert neardup.near_duplicates(docs_of([])).count() == 0 and neardup.drop_duplicates(docs_of([])).count() == 0


def test_one_id_with_several_texts(docs_of):
    rng = random.Random(12)
    a, b, c = (text_of(rng, 60) for _ in range(3))
    rows = [(7, a), (7, b), (7, a), (3, edited(rng, b, 1)), (9, edited(rng, a, 1)), (7, c), (7, edited(rng, c, 1)), (7, None), (5, "??"), (5, "one two")]
    docs = docs_of([t for _, t in rows], ids=[k for k, _ in rows])
    got = sorted((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect())
    assert got == [(3, 3), (5, 5), (5, 5), (7, 3), (7, 7), (7, 7), (7, 7), (7, 7), (7, 7), (9, 7)]
    kept = sorted((r.doc_id, r.text or "") for r in neardup.drop_duplicates(docs).collect())
    ones = [(k, t) for k, t in kept if t not in (c, rows[6][1])]
    assert ones == sorted([(3, rows[3][1]), (5, "??"), (5, "one two"), (7, a), (7, "")]) and len(kept) == 6  # b of 7 is a near copy of 3


def test_long_texts_and_repeated_shingles(docs_of):
    rng = random.Random(6)
    long = text_of(rng, 30_000)
    texts = [long, edited(rng, long, 20), "la " * 5000, "la " * 4990, "la " * 300]
    rows = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(texts)).collect()}
    assert rows == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(500, x) for x in range(501, 700)] + [(7, 7)]
    sets = Sets(1000)
    for a, b in links:
        sets.join(a, b)
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for a, b in links for x in (a, b) if a != b}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_links(ids, vectors, least=0.95):
    x = np.stack(vectors).astype(float)
    n = np.sqrt((x * x).sum(1))
    near = (x @ x.T) / (n[:, None] * n[None, :]) >= least
    np.fill_diagonal(near, False)
    sets = Sets(len(ids))
    for i, j in np.argwhere(near):
        sets.join(int(i), int(j))
    low = {}
    for i, k in enumerate(ids):
        low[sets.find(i)] = min(k, low.get(sets.find(i), k))
    return {k: (int(near[i].sum()), low[sets.find(i)]) for i, k in enumerate(ids)}


@pytest.mark.parametrize("dim, spread", [(3, 0.3), (16, 0.1), (64, 0.02)])
def test_embeddings_equal_all_pairs(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(embedding, "SMALL", 40)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(40, dim))
    x = (centres[rng.integers(0, 40, 700)] + rng.normal(size=(700, dim)) * spread).astype("f4")
    x[5] = x[6]
    x[7] = 2 * x[6]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(700), x)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == plain_links([k for k, _ in rows], [v for _, v in rows])


def test_embedding_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (8, [3.0]), (9, []), (None, [1.0, 0.0]), (10, [float("inf"), 1.0]), (2, [2.0, 0.0])]
    out = embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as n_links"))
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in out.collect() if r.vec_id is not None)
    assert got == [((False, k), n, c, k == c) for k, n, c in [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (9, 0, 9), (10, 0, 10)]]
    assert out.where("vec_id is null").first().n_links == 0
    assert embedding.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cover_tree_nests_and_covers():
    rng = np.random.default_rng(0)
    unit = embedding._unit(rng.normal(size=(500, 4)))
    first, parent = embedding.build(unit)
    tree = embedding.Tree(unit, first, parent)
    for level in range(tree.last):
        centres = np.flatnonzero(first <= level)
        gap = embedding._distances(unit, unit[centres]).min(axis=1)
        assert level >= embedding._LEVELS or gap.max() <= 2.0 / 2**level + 1e-3
        for c in centres:
            below = tree.below(int(c), level)
            assert embedding._distances(unit[below], unit[[c]]).max() <= tree.radius[level][c] + 1e-7


def test_archives(spark):
    rng = random.Random(5)
    pages = [(i, f"http://x.org/{i}?q=é\r\n", "<p>" + rng.choice(["a", "b", "ü"]) * rng.randint(0, 6) + "</p>") for i in range(120)]
    pages += [(500, None, None), (501, "u", ""), (502, "u", "\x1f\x8b\x08WARC/1.1 " * 50), (None, "n", "<p>none</p>"), (503, "big", "".join(rng.choice("abcdefgh") for _ in range(300_000))), (3, pages[3][1], pages[3][2])]
    rng.shuffle(pages)
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1 as refers_to")
    files = warc.write_archives(table.repartition(3))
    first = {}
    for k, _, h in pages:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    for size in (997, 1 << 24):
        rows = warc.read_archives(files, with_payload=True, range_bytes=size).collect()
        assert len(rows) == len(pages) and all(r.digest_ok is (True if r.record_type == "response" else None) for r in rows)
        want = sorted((repr(k), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), repr(None if k == first.get(h or "", k) else first[h or ""])) for k, _, h in pages)
        assert sorted((repr(r.page_id), r.payload_bytes, r.payload_digest, repr(r.refers_to)) for r in rows) == want
        assert all((r.record_type == "revisit") == (r.refers_to is not None) == (r.payload is None) for r in rows)
    assert warc.read_archives(warc.list_archives(spark, files.first().path.rpartition("/")[0])).count() == len(pages)
    assert warc.read_archives(warc.write_archives(table.limit(0))).count() == 0
    assert warc.with_responses(table, min_bytes=10**6).where("refers_to is not null").count() == 0


def test_broken_archives(spark, tmp_path):
    good = [warc.record(i, f"u{i}", "x" * i, None) for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"junk\x1f\x8b\x08junk" + good[0] + good[1][: len(good[1]) // 2] + good[2] + b"\x1f\x8b\x08" + good[3] + good[4][:-9])
    rows = warc.read_archives(warc.list_archives(spark, f"file://{tmp_path}")).collect()
    assert sorted(r.page_id for r in rows) == [0, 2, 3]


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from strandloom.llm import decontamination, langid, mixing

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = pipeline.run(spark, sf).collect()
    rows = [r.asDict() for r in docs.collect()]
    model = tuple(sorted(langid.fit(docs).items()))
    rows = [r for r in rows if (p := langid.classify(r["text"], model))[0] != "und" and p[1] >= langid.MIN_MARGIN]
    classes = plain_classes([r["doc_id"] for r in rows], [r["text"] for r in rows])
    rows = [r for r in rows if classes[r["doc_id"]] == r["doc_id"]]
    items = [(r.item_id, *decontamination.split_item(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    full = [" ".join(q + a) for _, q, a in items]
    dirty = {r["doc_id"] for r in rows if any(f" {f} " in f" {' '.join(decontamination.words(r['text']))} " for f in full)}
    kept = spark.createDataFrame([r for r in rows if r["doc_id"] not in dirty], docs.schema)
    times = {r.doc_id: r.whole + r.extra for r in mixing.mix(kept).collect() if r.whole + r.extra}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == times
    shards = [sum(r.shard == k for r in out) for k in range(8)]
    assert max(shards) - min(shards) <= 1 and {tuple(r)[:5] for r in out} <= {tuple(r) for r in kept.collect()}


def test_words_of_scripts_without_spaces():
    assert neardup.words("Das Haus、春が来た。 x_1 ไทย 龍") == ["das", "haus", "春", "が", "来", "た", "x_1", "ไ", "ท", "ย", "龍"]
    assert neardup.words("Ünï 12") == ["ünï", "12"] and neardup.words(None) == []


def test_near_copies_in_scripts_without_spaces(spark, docs_of):
    rng = random.Random(13)
    plain = lambda n: "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(n))
    texts = []
    for _ in range(6):
        text = plain(600)
        texts += [text, text[:300] + "字" + text[301:], text[:100] + "、" + text[100:] + "。"]  # one letter changed; signs added
    texts += [plain(600) for _ in range(6)]
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(texts)).collect()}
    assert classes == {i: i // 3 * 3 if i < 18 else i for i in range(24)} == plain_classes(range(24), texts)


#: Names that some stage gives to columns of its own.
MADE = (
    "rejected score hits __digest digest size taken Hilbert lang_pred whole extra __text __kept __as __id __times __no __whole __extra __h __a __b __c0 __c1 __r __n __off __all __top __in "
    "row stays class_id node skey bucket before need goal"
).split()


@pytest.fixture
def odd(docs_of):
    """Documents of every odd kind, with extra columns whose names clash with those that stages make."""
    rng = random.Random(31)
    en = lambda n: " ".join(rng.choice("the of and to in that was with for house water light over under again people".split()) for _ in range(n))
    de = lambda n: " ".join(rng.choice("der die das und nicht auch haus wasser licht wieder leute durch werden".split()) for _ in range(n))
    plain = [(i, (en if i % 2 else de)(60), "en" if i % 2 else "de", f"s{i % 3}") for i in range(40)]
    item = "the river crossed seven bridges before noon. nobody counted twelve lanterns"
    more = [(None, en(50), "en", None), (None, de(50), None, "s1"), (7, en(45), "en", "s0"), (7, plain[7][1], "en", "s0"), (50, None, "en", "s0"), (51, "", "de", None), (52, "12 !!", None, "s2"), (53, en(40_000), "en", "s2"), (54, f"{en(30)} {item} {en(30)}", "en", "s1"), (55, plain[3][1], "en", "s1")]
    rows = [(k, t, a, s, len(t or "")) for k, t, a, s in plain + more]

    def make(spark):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for c in MADE:
            df = df.withColumn(c, F.concat_ws(":", F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("n")), F.md5(F.coalesce("text", F.lit("-")))))
        return df

    return make, rows, item


def test_stages_keep_columns_and_odd_rows(spark, odd, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    make, rows, item = odd
    spark.createDataFrame([(1, item), (None, "entirely other words stand here. none match")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make(spark)
    of = lambda df: sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect()))
    everything = sorted((k is None, k or 0, t or "") for k, t, *_ in rows)
    out = {name: stage(spark, docs, str(tmp_path)) for name, stage in pipeline.STAGES}
    for name in ("language", "near_duplicates", "decontaminate", "mix"):
        assert out[name].columns == docs.columns
    input_rows = {tuple(r) for r in docs.collect()}
    for name in ("language", "near_duplicates", "decontaminate", "mix"):
        assert {tuple(r) for r in out[name].collect()} <= input_rows  # every value of every column
    same = [c for c in docs.columns if c != "Hilbert"]
    assert Counter(tuple(r) for r in out["shard"].select(*same).collect()) == Counter(tuple(r) for r in docs.select(*same).collect())
    assert of(out["language"]) == [x for x in everything if x[1] not in (50, 51, 52)]
    assert of(out["near_duplicates"]) == sorted(set(everything) - {(False, 55, rows[3][1])})
    assert of(out["decontaminate"]) == [x for x in everything if x[1] != 54]
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.size] = taken.get((r.doc_id, r.size), 0) + r.whole + r.extra
    got = Counter((r.doc_id, len((r.text or "").split())) for r in out["mix"].collect())
    assert got == {k: n for k, n in taken.items() if n}
    assert out["shard"].count() == len(rows) and [c for c in out["shard"].columns if c.lower() == "hilbert"] == ["hilbert"]
    alone = docs.where("doc_id is not null").dropDuplicates(["doc_id"])  # ids of one row each: another path
    assert {tuple(r) for r in pipeline.near_duplicates(spark, alone, str(tmp_path)).collect()} <= input_rows
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
