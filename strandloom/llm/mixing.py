"""Mixing sources to target weights by capped water-filling (DataFrame operations only).

Targets.  The sources, in code-point order with null last, have the weights ``weights``, repeating.  Together they
share ``share`` times the words of all documents.  A source's target stops at ``max_epochs`` times its own words, and
what is above that goes to the sources below their caps by weight, until none is above.  The fixpoint has a closed
form: with the sources sorted by cap/weight, a source is clamped iff its cap is at most its weight's part of what its
predecessors left, and all others take ``level * weight``.  So it takes one window over the table of sources.

Sampling.  A source with target/words = 1.4 repeats each document once, and 40 % of its words once more.  Those come
from a prefix of its documents in the order of a seeded digest: first among documents above 1/64 of the source, then
among the rest, which make up for what the large ones missed.  So the words taken come within half a document of the
target, the small kind where there are any.

Scale.  Prefix sums within a source are made of digest buckets (4096 for each source and kind): sums by bucket, a
window over those sums, and a window within each bucket, so that no task gets a whole source.

Cases.  Null or blank text: size 0, taken 0.  Null source: a source of its own, last.  No words at all: every target 0.
A row's digest is of its id, source and whole text, so rows without an id or with equal ids are told apart by their texts;
rows equal in all three tie, and which of them is taken is immaterial.  Empty table: no rows.  Very long texts: linear;
one that is longer than the target of its source is not taken more often than the target's rounding asks.  Columns of the
input that are not used are ignored, whatever their names.  Sources are ranked in one task, a row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.shared import cut, orderable, positional, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
#: A document above 1/LARGE of its source's words counts as large.
LARGE = 64


def water_fill(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources(skey, source, source_size)`` with ``weight``, ``target`` added; one row for each source."""
    everything = Window.partitionBy()
    ranked = sources.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "no")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    ranked = ranked.withColumn("clamped", F.col("cap") <= F.col("weight") * F.col("level"))
    ranked = ranked.withColumn("level", F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), F.col("no"), F.col("level").alias("at")))).over(everything)["at"])
    return ranked.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * F.col("level"))).select("skey", "source", "source_size", "weight", "target")


def _prefix(docs: DataFrame) -> DataFrame:
    """Adds ``before``: the words of the documents ahead of each within its source (skey), in the order of digest and size."""
    sums = docs.groupBy("skey", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("skey", "bucket").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    return docs.join(sums, ["skey", "bucket"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("offset")


def _digest(doc_id: str, source: str, text: str, seed: str) -> Column:
    parts = [F.coalesce(x, F.lit("null")) for x in (F.col(doc_id).cast("string"), F.col(source).cast("string"), F.md5(F.col(text)))]
    return F.md5(F.concat_ws("|", F.lit(seed), *parts))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row for each document: doc_id, size, source, source_size, target, whole, extra, taken, digest.

    ``whole + extra`` is how often the mix repeats the document; ``digest`` names it.  See the module's text for the cases.
    """
    digest = _digest(doc_id, source, text, seed)
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words_of(text).alias("size"), digest.alias("digest"))
    sized = sized.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("bucket", F.substring("digest", 1, 3))
    sized = cut(sized, "mix-sizes")  # read three times below; the texts are read once
    sources = sized.groupBy("skey").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("source_size"))
    plan = water_fill(sources, weights, share, max_epochs)
    plan = cut(plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)), "mix-plan")
    plan = plan.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    docs = sized.drop("source").join(plan.select("skey", "source", "source_size", "target", "whole", "need"), "skey")
    large = F.col("size") * LARGE > F.col("source_size")
    taken = F.col("before") + F.col("size") / 2 <= F.col("goal")

    sums = docs.where(large).groupBy("skey").agg(F.sum("size").alias("large_size"))
    first = _prefix(docs.where(large).join(sums, "skey").withColumn("goal", F.col("need") * F.col("large_size") / F.col("source_size")))
    first = cut(first.withColumn("extra", taken.cast("int")).drop("large_size"), "mix-large")
    spent = first.groupBy("skey").agg(F.sum(F.col("size") * F.col("extra")).alias("spent"))
    rest = _prefix(docs.where(~large).join(spent, "skey", "left").withColumn("goal", F.col("need") - F.coalesce("spent", F.lit(0))))
    rest = rest.withColumn("extra", (taken & (F.col("size") > 0)).cast("int"))
    columns = ["doc_id", "size", "source", "source_size", "target", "whole", "extra", "digest"]
    return first.select(columns).unionByName(rest.select(columns)).withColumn("taken", (F.col("size") * (F.col("whole") + F.col("extra"))).cast("long"))


def repeated(docs: DataFrame, mixed: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` as often as ``mixed``, made of them with the same seed, says; documents that are not taken go.

    Of rows that are equal in id, source and text, as many get an extra repetition as the mix gives to all of them, the least
    by all columns first; they are one window task.  All columns come out as they are, whatever their names.
    """
    columns = docs.columns
    docs, names = positional(docs)
    times = mixed.groupBy(F.col("digest").alias("__digest")).agg(F.max("whole").cast("int").alias("__whole"), F.sum("extra").cast("int").alias("__extra"))
    out = docs.withColumn("__digest", _digest(names[doc_id], names[source], names[text], seed)).join(times.where("__whole + __extra > 0"), "__digest")
    one = F.row_number().over(Window.partitionBy("__digest").orderBy(*orderable(docs))) <= F.col("__extra")
    out = out.withColumn("__times", F.col("__whole") + one.cast("int")).where("__times > 0").withColumn("__no", F.explode(F.sequence(F.lit(1), "__times")))
    return out.select(*names.values()).toDF(*columns)
