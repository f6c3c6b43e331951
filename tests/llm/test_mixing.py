import re

import duckdb
import pytest

from strandloom.llm import mixing, queries


def fill(sizes):
    """Targets by repeated clamping, sources in order."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    goal, clamped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in clamped]
        left = goal - sum(clamped.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return clamped | target
        clamped |= {s: 2.0 * sizes[s] for s in over}


def check(rows, texts, sources):
    sizes = {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = fill(sizes)
    taken, largest = {}, {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6


def test_targets_and_samples(docs_of):
    texts = ["w " * (1 + (i * 37) % 90) for i in range(400)] + ["long " * 3000, "", None, "a b c\x0bd"]
    sources = ["src%d" % ((i * i) % 11 if i % 3 else 0) for i in range(400)] + ["src0", "src1", "src2", None]
    docs = docs_of(texts, sources=sources, extra=True)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    check(rows, texts, sources)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr)
    again = mixing.repeated(docs, mixing.mix(docs))
    assert again.columns == docs.columns and again.count() == sum(r.whole + r.extra for r in rows)


@pytest.mark.parametrize("texts, sources", [([], []), ([None, ""], ["a", None]), (["one"], ["a"]), (["x y"] * 6, ["a", "b", "c", "d", "e", None])])
def test_small_tables(docs_of, texts, sources):
    rows = mixing.mix(docs_of(texts, sources=sources)).collect()
    assert len(rows) == len(texts)
    if texts:
        check(rows, texts, sources)


def test_repeated_rows(docs_of):
    rows = mixing.mix(docs_of(["a b c"] * 40, ids=[7] * 40, sources=["a"] * 20 + ["b"] * 20)).collect()
    check(rows, ["a b c"] * 40, ["a"] * 20 + ["b"] * 20)


def test_rows_without_or_with_equal_ids(docs_of):
    docs = docs_of(["a b", "c d", "e f", "g"], ids=[None, None, 5, 5], sources=["x"] * 4)
    mixed = mixing.mix(docs).collect()
    out = [(r.doc_id, len(r.text)) for r in mixing.repeated(docs, mixing.mix(docs)).collect()]
    assert sorted(out, key=repr) == sorted(((r.doc_id, 2 * r.size - 1) for r in mixed for _ in range(r.whole + r.extra)), key=repr)


def test_equal_rows_share_their_extra_repetitions(docs_of):
    docs = docs_of(["a b c"] * 60 + ["x " * 30] * 7, ids=[None] * 60 + [3] * 7, sources=["a"] * 60 + ["b"] * 7)
    mixed = mixing.mix(docs).collect()
    out = [r.source for r in mixing.repeated(docs, mixing.mix(docs)).collect()]
    for s in "ab":
        assert out.count(s) == sum(r.whole + r.extra for r in mixed if r.source == s)
    assert mixing.repeated(docs.limit(0), mixing.mix(docs.limit(0))).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op3_mix"])
    columns = [d[0] for d in want.description]
    got = {r[0]: r for r in map(tuple, queries.op3_mix(spark, sf).select(columns).collect())}
    for r in want.fetchall():
        assert got[r[0]] == pytest.approx(r)
