"""One query for each operator over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import clustering, decontamination, embedding, langid, licenses, mixing, neardup, oracle, quality, secrets, sharding, tokencount, warc, whitening
from strandloom.llm.shared import cut, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents: one row for each document and item that it holds."""
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = found.select("doc_id", F.explode("hits").alias("h"))
    return hits.select("doc_id", "h.item_id", *[F.round(f"h.{c}", 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def op2_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixing all documents to target weights."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharding all documents along a Hilbert curve over language, source and size; the law is ``rows``."""
    docs = table(spark, sf_dir, "documents")
    meta = cut(docs.select("doc_id", "lang", "source", sharding.text_size().alias("size"), sharding.text_crc32().alias("text_crc32")), "shard-meta")
    out = sharding.hilbert_shards(meta, dimensions=("lang", "source", "size"), text=None, ties=("size", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under a public byte-level BPE vocabulary."""
    import public_tokenizers

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to WARC archives and read back."""
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of all documents, looked up among known licences."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.digest_rows(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings dealt to 40 clusters by five rounds of k-means."""
    return clustering.with_totals(*clustering.cluster(table(spark, sf_dir, "embeddings")))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened along the 32 leading eigenvectors of their covariance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels that are not held out."""
    stats = quality.statistics_of(table(spark, sf_dir, "documents"))
    found = quality.score(stats, quality.fit(stats, table(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_embedding_near_duplicates": op2_embedding_near_duplicates,
    "op3_mix": op3_mix,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_token_counts": op5_token_counts,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_warc": op7_warc,
    "op8_language": op8_language,
    "op9_licenses": op9_licenses,
    "op10_secrets": op10_secrets,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_whiten": op12_whiten,
    "op13_quality": op13_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": oracle.decontamination_sql(),
    "op2_embedding_near_duplicates": oracle.embedding_sql(),
    "op3_mix": oracle.mix_sql(),
    "op4_hilbert_shards": oracle.shards_sql(),
    "op7_warc": oracle.warc_sql(),
    "op9_licenses": oracle.licenses_sql(),
    "op10_secrets": oracle.secrets_sql(),
    "op11_centroid_clusters": oracle.clusters_sql(),
}
