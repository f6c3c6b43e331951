"""Sharding along a Hilbert curve (DataFrame operations only).

Several metadata columns are quantised to ``bits`` bits each, the quantised point's index on the Hilbert curve orders
the rows, and the order is cut into runs of equal row counts.  A run then covers a compact region of the metadata
space, so that the files' min/max statistics prune on any of the columns.

Quantising.  A column's values, numbers or whole strings, are cut to cells at its exact quantiles: its distinct values are
counted, sorted in range partitions and summed up, and at most 2**bits - 1 of them a column come to the driver.

Order without a global sort.  The sort key is (curve index, digest of the id).  Counts of the key's leading bits
(1024 cells, each split again by further bits of the curve and bits of the digest) give every cell's offset by two
small windows; a row's rank is its cell's offset plus its number within the cell.  A hot point of the metadata space is
split by the digest's bits, 6 of them or as many as leave ``CELL_ROWS`` rows a cell even if all rows are one point.

Cases.  Null metadata: the lowest cell.  Null text: no bytes, CRC 0.  Very long texts: only their bytes are counted.  Ties: rows with equal key order by id, size and
CRC; rows equal in all of these are interchangeable.  Empty table: no rows.  Fewer rows than shards: some shards are
empty.  Extra columns are kept, whatever their names; one named like an output column, in any case, is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.shared import cut, positional

BITS = 5
DIMENSIONS = ("lang", "source", "text")
N_SHARDS = 8
_DIGEST_BITS, _HASH_BITS = 60, 6
_TOP_BITS = 10
CELL_ROWS = 1 << 20


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def text_crc32(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit(""))).cast("long")


def hilbert_index(cells: Sequence[str], bits: int) -> Column:
    """Index on the Hilbert curve through a grid of 2**bits cells a side (Skilling 2004), as an SQL expression of integer columns.

    The point is walked from the top bit down with an ``aggregate`` over bit masks, whose state is the point.
    """
    n, names = len(cells), [f"x{i}" for i in range(len(cells))]
    masks = f"array({', '.join(str(2**b) for b in range(bits - 1, 0, -1))})" if bits > 1 else "cast(array() as array<int>)"
    state = lambda xs: f"named_struct({', '.join(f'{k!r}, {v}' for k, v in zip(names, xs))})"
    step = state([f"p.{k}" for k in names])
    for i in range(n):  # one dimension at a time, each on the state that the one before has left
        flip = f"if((s.x{i} & q) <> 0, q - 1, 0)"
        swap = f"if((s.x{i} & q) <> 0, 0, (s.x0 ^ s.x{i}) & (q - 1))"
        new = [f"s.{k}" for k in names]
        new[0] = f"s.x0 ^ {flip}" + (f" ^ {swap}" if i else "")
        if i:
            new[i] = f"s.x{i} ^ {swap}"
        step = f"transform(array({step}), s -> {state(new)})[0]"
    walked = f"aggregate({masks}, {state(cells)}, (p, q) -> {step})"
    gray, prior = [], ""
    for k in names:  # Gray decoding
        prior = f"p.{k}" + (f" ^ {prior}" if prior else "")
        gray.append(prior)
    last = f"p.{names[-1]}"
    twist = f"aggregate({masks}, 0, (t, q) -> if((({last}) & q) <> 0, t ^ (q - 1), t))"
    decoded = f"transform(array({walked}), p -> {state(gray)})[0]"
    final = f"transform(array({decoded}), p -> {state([f'p.{k} ^ {twist}' for k in names])})[0]"
    digits = " + ".join(f"shiftleft(cast(shiftright(p.{k}, {b}) & 1 as bigint), {b * n + n - 1 - i})" for b in range(bits) for i, k in enumerate(names))
    return F.expr(f"transform(array({final}), p -> {digits})[0]")


def _value(column: str, text: str | None) -> Column:
    """The column, or the bytes of the text column."""
    return F.octet_length(F.col(column)) if column == text else F.col(f"`{column}`")


def cut_points(docs: DataFrame, value: Column, bits: int) -> list:
    """The distinct values at the exact 1/2**bits, 2/2**bits, ... quantiles: the least that have so much of the rows at or below them."""
    counts = docs.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.orderBy("v").withColumn("part", F.spark_partition_id()), "shard-values")
    sums = counts.groupBy("part").agg(F.sum("n").alias("rows"))  # a row for each range partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy()).alias("all"))
    within = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.join(F.broadcast(sums), "part").withColumn("upto", F.col("offset") + F.sum("n").over(within))
    passed = lambda upto: F.expr(f"least(({upto}) * {2**bits} div all, {2**bits - 1})")
    return sorted(r.v for r in placed.where(passed("upto") > passed("upto - n")).select("v").collect())


def quantised(docs: DataFrame, dimensions: Sequence[str], bits: int, text: str | None) -> DataFrame:
    """Adds ``__c0``, ``__c1``, ...: the cells of the dimensions.  A run over each metadata column; the driver gets its cut points."""
    for i, c in enumerate(dimensions):
        value = _value(c, text)
        cuts = cut_points(docs, value, bits)
        cell = sum(((value > F.lit(x)).cast("int") for x in cuts), F.lit(0))
        docs = docs.withColumn(f"__c{i}", F.coalesce(cell, F.lit(0)).cast("int"))
    return docs


def id_digest(doc_id: str) -> Column:
    """The first ``_DIGEST_BITS`` bits of the id's digest."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(digest, 1, _DIGEST_BITS // 4), 16, 10).cast("long")


def salt(digest: str, bits: int = _HASH_BITS) -> str:
    """The digest's first bits, as SQL."""
    return f"shiftrightunsigned({digest}, {_DIGEST_BITS - bits})"


def hilbert_shards(docs: DataFrame, *, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS, n_shards: int = N_SHARDS, doc_id: str = "doc_id", text: str | None = "text", ties: Sequence[str] = ()) -> DataFrame:
    """``docs`` with ``hilbert`` (long), ``shard`` (int, 0 to n_shards - 1) and ``slot`` (long, gapless from 0 in each shard); shards' row counts are at most one apart.

    text: the dimension that counts by its length in bytes, if any.  ties: columns that order rows of equal key and id; with a text, its size and CRC do.
    """
    total = bits * len(dimensions)
    low = max(0, total - _TOP_BITS)
    columns = [c for c in docs.columns if c.lower() not in ("hilbert", "shard", "slot")]
    named, names = positional(docs)
    kept, docs = [names[c] for c in columns], named
    doc_id, text, dimensions, ties = names[doc_id], text and names[text], [names[c] for c in dimensions], [names[c] for c in ties]
    hashed = max(_HASH_BITS, (docs.count() // CELL_ROWS).bit_length())
    keyed = quantised(docs, dimensions, bits, text).withColumn("hilbert", hilbert_index([f"__c{i}" for i in range(len(dimensions))], bits))
    keyed = keyed.withColumn("__h", id_digest(doc_id))
    keyed = keyed.withColumn("__a", F.expr(f"cast(shiftright(hilbert, {low}) as int)"))
    keyed = keyed.withColumn("__b", F.expr(f"shiftleft(hilbert & {2**low - 1}, {hashed}) | {salt('__h', hashed)}"))
    counts = keyed.groupBy("__a", "__b").agg(F.count(F.lit(1)).alias("__n"))
    tops = counts.groupBy("__a").agg(F.sum("__n").alias("__n"))
    before = Window.orderBy("__a").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__a", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__top"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    inner = Window.partitionBy("__a").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0))).join(tops, "__a").select("__a", "__b", (F.col("__top") + F.col("__in")).alias("__off"), "__all")
    cell = Window.partitionBy("__a", "__b").orderBy("hilbert", "__h", doc_id, *ties, *([text_size(text), text_crc32(text)] if text else []))
    ranked = keyed.join(offsets, ["__a", "__b"]).withColumn("__r", F.col("__off") + F.row_number().over(cell) - 1)
    ranked = ranked.withColumn("shard", F.expr(f"cast((__r * {n_shards}) div __all as int)"))
    ranked = ranked.withColumn("slot", F.expr(f"cast(__r - (cast(shard as bigint) * __all + {n_shards - 1}) div {n_shards} as bigint)"))
    return ranked.select(*kept, "hilbert", "shard", "slot").toDF(*columns, "hilbert", "shard", "slot")
