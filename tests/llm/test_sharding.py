import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import queries, sharding


@pytest.mark.parametrize("n, bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(spark, n, bits):
    side = 2**bits
    grid = spark.range(side**n).select(*[F.expr(f"cast((id div {side**i}) % {side} as int)").alias(f"c{i}") for i in range(n)])
    rows = grid.withColumn("h", sharding.hilbert_index([f"c{i}" for i in range(n)], bits)).orderBy("h").toPandas()
    assert (rows.h.to_numpy() == np.arange(side**n)).all()
    assert (np.abs(np.diff(rows[[f"c{i}" for i in range(n)]].to_numpy(), axis=0)).sum(1) == 1).all()


def check(rows, n_rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert sum(map(len, by.values())) == n_rows
    counts = [len(by.get(k, ())) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    spans = sorted((min(r.hilbert for r in p), max(r.hilbert for r in p)) for p in by.values())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_shards(docs_of):
    texts = [("é" * (i % 50)) + "x" * (i * i % 3000) for i in range(500)] + [None, "", None]
    docs = docs_of(texts, langs=[["en", "de", None][i % 3] for i in range(503)], sources=[f"s{i % 7}" if i % 5 else "s0" for i in range(503)], extra=True)
    out = sharding.hilbert_shards(docs)
    assert out.columns == [c for c in docs.columns if c not in ("hilbert", "shard", "slot")] + ["hilbert", "shard", "slot"]
    rows = out.collect()
    check(rows, 503)
    assert sorted(map(str, rows)) == sorted(map(str, sharding.hilbert_shards(docs.repartition(5)).collect()))


@pytest.mark.parametrize("n", [0, 1, 5, 64])
def test_equal_and_few_rows(docs_of, n):
    rows = sharding.hilbert_shards(docs_of(["same"] * n, ids=[3] * n)).collect()
    check(rows, n)


def test_equal_metadata_is_dealt_to_64_cells(spark):
    digests = spark.range(6400).select(sharding.id_digest("id").alias("h"))
    counts = [r["count"] for r in digests.groupBy(F.expr(sharding.salt("h"))).count().collect()]
    assert len(counts) == 64 and max(counts) < 200


def test_null_ids(docs_of):
    check(sharding.hilbert_shards(docs_of(["a", "b", None], ids=[None, 1, None])).collect(), 3)


def test_cut_points_are_exact_at_any_number_of_values(spark):
    values = [(i * 7919) % 30_011 for i in range(30_011)] + [5] * 9_000
    for kind, made in (("long", values), ("string", [f"https://host/{v:06d}" for v in values])):
        table = spark.createDataFrame([(v,) for v in made] + [(None,)] * 50, f"v {kind}").repartition(9)
        ordered = sorted(made)
        want = sorted({ordered[-(-i * len(ordered) // 32) - 1] for i in range(1, 32)})
        assert sharding.cut_points(table, F.col("v"), 5) == want


def test_strings_count_by_their_whole_value(docs_of):
    docs = docs_of(["t"] * 640, sources=[f"https://example.org/{i % 32:02d}" for i in range(640)])
    rows = sharding.quantised(docs, ("source",), 5, None).collect()
    assert len({r["__c0"] for r in rows}) == 32 and all((a.source < b.source) <= (a["__c0"] < b["__c0"]) for a in rows[:40] for b in rows)


def test_hot_points_are_split_further_in_large_tables(docs_of, monkeypatch):
    docs = docs_of(["same"] * 400, extra=True).selectExpr("*").withColumnRenamed("shard", "Shard")
    monkeypatch.setattr(sharding, "CELL_ROWS", 1)
    out = sharding.hilbert_shards(docs)
    assert [c for c in out.columns if c.lower() == "shard"] == ["shard"]
    check(out.collect(), 400)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op4_hilbert_shards"])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, queries.op4_hilbert_shards(spark, sf).select(columns).collect())) == sorted(want.fetchall())


def test_query_and_pruning(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_hilbert_shards(spark, sf).collect()
    check(rows, 1000)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in rows:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    kinds = lambda of: np.mean([len({docs[r.doc_id].source for r in rows if of(r) == k}) for k in range(8)])
    assert kinds(lambda r: r.shard) < 0.8 * kinds(lambda r: zlib.crc32(b"%d" % r.doc_id) % 8)
