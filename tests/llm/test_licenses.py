import hashlib
import os
import re

import duckdb
import pytest

from strandloom.llm import licenses, queries
from strandloom.llm.known_licenses import DIGESTS, KNOWN


def brute(text):
    t = "".join(c.lower() if c.isascii() else c for c in text)
    t = re.sub(r"(?m)^[^\w\n]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]|<|\[|by )[^\n]*$", " ", t).replace("all rights reserved", " ")
    t = re.sub(r"[\W_]+", " ", t).strip(" ")
    for a, b in licenses.SPELLINGS:
        t = t.replace(a, b)
    return t


def test_known_texts_in_other_clothes(docs_of):
    texts, want = [], []
    for name, body in KNOWN.items():
        lines = re.sub(r"(.{1,60}) ", r"\1\n", body)
        dressed = "Copyright (c) 2001 Some One. All rights reserved.\n\n" + "".join(f" * {x}\n" for x in lines.split("\n"))
        texts += [body, body.upper(), dressed.replace("license", "licence"), body + " and more"]
        want += [name, name, name, None]
    texts += [None, "", "...", "MIT"]
    want += [None] * 4
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs_of(texts, extra=True)).collect()}
    assert [rows[i].license_id for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        assert rows[i].digest == (None if t is None else hashlib.sha256(brute(t).encode()).hexdigest())
        assert rows[i].is_license == (want[i] is not None)


FULL = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.exists(f"{FULL}/GPL-3"), reason="no licence texts on this machine")
def test_full_texts(docs_of):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    texts = [open(f"{FULL}/{f}", encoding="utf-8").read() for f in files]
    texts += ["\n".join(f"# {x.strip()}" for x in t.upper().split("\n")) for t in texts] + [t[:-200] for t in texts]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs_of(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [*files.values()] * 2 + [None] * len(files) and set(files.values()) <= set(DIGESTS)


def test_matches_equal_sql(spark, docs_of):
    """The query's SQL on documents that do hold licences."""
    texts = [*KNOWN.values(), *(b.replace(",", ";\n") for b in KNOWN.values()), "no licence", None]
    docs = docs_of(texts)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(queries.ORACLE_SQL["op9_licenses"])
    columns = [d[0] for d in want.description]
    got = licenses.scan_licenses(docs).select(columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr) and got.where("is_license").count() == 2 * len(KNOWN)


def test_empty_and_repeated(docs_of):
    assert licenses.scan_licenses(docs_of([])).count() == 0
    assert licenses.scan_licenses(docs_of([KNOWN["MIT"]] * 3, ids=[1] * 3)).where("license_id = 'MIT'").count() == 3


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op9_licenses"])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, queries.op9_licenses(spark, sf).select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
