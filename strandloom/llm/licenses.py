"""Licence scans by canonical digest lookup (DataFrame operations only).

A text is brought to a canonical form, and the SHA-256 of the whole form is looked up among the digests of known
licence texts.  Two texts match iff they differ only in what the form leaves out:

1. ASCII case;
2. lines that are copyright notices (first word "copyright", "(c)" or the sign, then a year, name sign or "by"),
   and "all rights reserved";
3. punctuation, comment marks, white space and line breaks;
4. spellings that count as equivalent (``SPELLINGS``, after the usual matching guidelines for licences).

The known texts and digests are a fixed list (``known_licenses.py``), so the joined side has a proven bound: one row for each
entry of that list, whatever the corpus; only such a list is broadcast, and a larger one is joined by a shuffle.

Cases.  Null text: null digest, no licence.  Text without letters or digits: canonical form empty, digest of the empty
string, no licence.  Very long text: linear.  Ties, names of one canonical form: the first name.  Extra columns are ignored.  Repeated rows: each gets its row.  Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.known_licenses import DIGESTS, KNOWN

#: Matching is on substrings of the canonical text, in this order.
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("honour", "honor"),
    ("non infringement", "noninfringement"),
    ("sub license", "sublicense"),
    ("wilful", "willful"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)
NOTICE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]|<|\[|by )[^\n]*$"
RESERVED = r"all rights reserved"
NOT_WORD = r"[^\p{L}\p{N}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Known lists up to this many rows are broadcast.
BROADCAST_ROWS = 10_000


def canonical(text: Column) -> Column:
    """The canonical form; see the module's text."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), NOTICE, " ")
    out = F.trim(F.regexp_replace(F.replace(out, F.lit(RESERVED), F.lit(" ")), NOT_WORD, " "))
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(usual))
    return out


def canonical_sql(text: str) -> str:
    """The same form in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), {quote(NOTICE)}, ' ', 'g')"
    out = f"trim(regexp_replace(replace({out}, '{RESERVED}', ' '), {quote(NOT_WORD)}, ' ', 'g'))"
    for other, usual in SPELLINGS:
        out = f"replace({out}, {quote(other)}, {quote(usual)})"
    return out


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """license_id, digest: one row for each distinct canonical form, under the first name; ``known``: texts, ``digests``: digests of canonical forms."""
    rows = spark.createDataFrame(sorted(known.items()), "license_id string, body string").select("license_id", F.sha2(canonical(F.col("body")), 256).alias("digest"))
    return rows.unionByName(spark.createDataFrame(sorted(digests.items()), "license_id string, digest string")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", known: dict[str, str] = KNOWN, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """One row for each document: doc_id, canonical_chars, digest, license_id (null: no known licence), is_license."""
    form = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(text)).alias("form"))
    form = form.select("doc_id", F.length("form").cast("long").alias("canonical_chars"), F.sha2("form", 256).alias("digest"))
    listed = known_digests(docs.sparkSession, known, digests)
    found = form.join(F.broadcast(listed) if len(known) + len(digests) <= BROADCAST_ROWS else listed, "digest", "left")
    return found.select("doc_id", "canonical_chars", "digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))
