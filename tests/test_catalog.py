import duckdb
import pytest

import __spark_entry__ as entry
from strandloom.operators import frames
from strandloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) <= set(entry.queries())


def plain(v):
    return int(v) if isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    a = sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=repr)
    b = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)
    assert a == b


def test_translation_tables_come_from_one_scan(spark, monkeypatch, tmp_path):
    calls, scanned = [], frames.scanned
    monkeypatch.setattr(frames, "scanned", lambda *a: calls.append(1) or scanned(*a))
    spark.createDataFrame([(1, "no frame")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.QUERIES["q15_translation_tables"](spark, str(tmp_path)).collect()}
    assert got == {(t, 0, None) for t in catalog.TABLES} and len(calls) == 1
