import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table of texts, with extra columns whose names clash with results."""

    def make(texts, ids=None, langs=None, sources=None, extra=False):
        ids = list(range(len(texts))) if ids is None else ids
        langs, sources = langs or ["en"] * len(texts), sources or ["s"] * len(texts)
        rows = [(i, t, a, s, None if t is None else len(t)) for i, t, a, s in zip(ids, texts, langs, sources)]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            for c in ("size", "taken", "shard", "slot", "hits", "kept", "class_id", "spans", "base", "digest", "score", "lang_pred", "n_tokens", "rejected", "component_id", "hilbert", "payload", "bucket", "whole", "skey"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make
