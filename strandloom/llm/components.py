"""Connected components of a link table, by alternating stars (large-star, small-star), all in DataFrames.

Each round replaces the links by stars around smaller ids; the rounds needed grow with the logarithm of the largest
component, and with links that already are stars two suffice.  Minima are combined before the shuffle and written, so that
the joins that a hub makes uneven have two plain exchanges and are split at run time.  Every round ends in a written table, and
the tables of the round before are deleted.  Up to ``FEW`` links, a fixed bound, need no rounds: one task joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shared import Sets, cut, discard

#: Links that one task joins, about 30 MB of Python; a round over so few costs more than the task, whatever the cluster.
FEW = 1 << 16


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: the smallest id reachable, of every other id of the links in all batches."""
    pairs = [np.stack((b.column(0).to_numpy(), b.column(1).to_numpy())) for b in batches if b.num_rows]
    if pairs:
        ids, places = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
        sets = Sets(len(ids))  # ids are sorted, so a set's root is its smallest id
        for x, y in places.reshape(2, -1).T.tolist():
            sets.join(x, y)
        roots = np.array([sets.find(i) for i in range(len(ids))])
        at = np.flatnonzero(roots != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(ids[roots[at]], pa.int64())], names=["u", "v"])


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id reachable) of every id that has a link to another one."""
    pair = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    pair = cut(pair, "links")
    state, before = _state(pair), None
    if 0 < state[0] <= FEW:
        old, pair = pair, cut(pair.coalesce(1).mapInArrow(_joined, "u bigint, v bigint"), "links")
        discard(old)
        state = before
    while state != before and state[0]:
        both = pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = cut(both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        root = cut(large.groupBy("u").agg(F.min("v").alias("m")), "root")
        moved = large.join(root, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, pair = pair, cut(moved.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, state = state, _state(pair)
        discard(old, least, large, root)
    return pair.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(pair.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
