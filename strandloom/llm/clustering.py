"""Centroid clustering by Yinyang k-means, exact in integers.

Vectors become integers (``SCALE`` times the component, rounded down), distances are squared and exact, ties go to the smaller
number, and a centroid is the componentwise floor of its vectors' mean; an empty cluster keeps its centroid.

Filters (Ding et al. 2015).  The starting centroids are grouped once, about ``GROUP`` to a group.  A vector carries an upper bound of
the distance to its centroid and, for each group, one lower bound of the distances to the group's other centroids.  When centroids
have moved, the upper bound grows by its own centroid's drift and a group's lower bound shrinks by the group's largest.  First
globally: if no lower bound is at or below the upper one, made exact if need be, the vector stays.  Then by group: only groups
whose bound is at or below it are looked at, and in these only centroids that their own drift may have brought near; these are
measured exactly.  Bounds are doubles and are compared with a margin for their rounding, so that they only ever save work.

Scale.  Vectors and bounds are one table; a round is a narrow pass that writes the next table, and a second one that adds up
vectors by cluster within tasks; the driver gets sums of fixed size (clusters times components) and no window or shuffle has a row for
each vector, so a cluster of any size is no hot key.  A lost executor costs its tasks of the running pass.

Cases.  Vectors that are null, of another length than ``dims``, or that hold null or non-finite components are left out, as are those with a
component of 2**27 / SCALE (524,288) and more, whose squared distances don't fit 64 bits.  Null id: clustered, but no starting centroid.  Repeated ids or
rows: each is a vector of its own; among starting ones they tie and order by their components.  Fewer vectors than clusters: so many clusters.  Empty table: no
rows.  Extra columns are ignored, whatever their names.  Sums are exact up to 2**36 vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shared import cut, discard, finite_rows, summed

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
#: Centroids a group, about; sweeps that group them.
GROUP, GROUP_SWEEPS = 10, 5
#: Components below this can't overflow squared distances of 64 components; up to ``EXACT`` doubles hold all sums exactly.
LARGEST, EXACT = 1 << 27, 1 << 22
#: Vectors measured at a time.
SLICE = 2_048
#: Bounds are compared with a relative and an absolute margin of this size.
MARGIN = 1e-9
STATE = "vec_id bigint, x array<int>, cluster int, upper double, lower array<double>"


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Components as integers; a row with one that is too large has ``LARGEST`` there."""
    return np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:  # products of doubles, every sum below 2**53
        x, c = x.astype(np.float64), c.astype(np.float64)
    return ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)).astype(np.int64)


def grouped(centroids: np.ndarray, size: int = GROUP, sweeps: int = GROUP_SWEEPS) -> np.ndarray:
    """The group of each centroid: k-means of the centroids, from the first of them."""
    n = max(1, len(centroids) // size)
    means = centroids[:n].astype(np.float64)
    for _ in range(sweeps):
        group = ((centroids[:, None, :] - means[None]) ** 2).sum(2).argmin(1)
        means = np.stack([centroids[group == g].mean(0) if (group == g).any() else means[g] for g in range(n)])
    return np.unique(group, return_inverse=True)[1]


def assign(x: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first assignment: cluster, upper and lower bounds, all of them exact."""
    far = squared(x, centroids)
    cluster = far.argmin(1)  # the first of equal ones
    root = np.sqrt(far)
    upper = root[np.arange(len(x)), cluster]
    root[np.arange(len(x)), cluster] = np.inf
    lower = np.stack([root[:, group == g].min(1) for g in range(group.max() + 1)], 1)
    return cluster, upper, lower


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster and bounds after the centroids have moved by ``drift`` to ``centroids``, and how many distances were measured."""
    n_groups = int(group.max()) + 1
    moved = lower - np.array([drift[group == g].max() for g in range(n_groups)])
    upper, new, measured = upper + drift[cluster], cluster.copy(), 0
    may = lambda low, up: low <= up * (1 + MARGIN) + MARGIN
    open_ = np.flatnonzero(may(moved.min(1), upper))
    own = np.empty(len(x), np.int64)
    own[open_] = ((x[open_] - centroids[cluster[open_]]) ** 2).sum(1)
    upper[open_] = np.sqrt(own[open_])
    measured += len(open_)
    open_ = open_[may(moved[open_].min(1), upper[open_])]
    best, root = own.copy(), upper.copy()
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of a group: rows, members, bounds of their distances
    for g in range(n_groups):
        rows = open_[may(moved[open_, g], root[open_])]
        members = np.flatnonzero(group == g)
        near = np.empty((len(rows), len(members)))
        for k, j in enumerate(members.tolist()):
            mine = cluster[rows] == j
            near[:, k] = np.where(mine, upper[rows], lower[rows, g] - drift[j])
            look = np.flatnonzero(may(near[:, k], root[rows]) & ~mine)
            far = squared(x[rows[look]], centroids[j : j + 1])[:, 0]
            measured += len(look)
            near[look, k] = np.sqrt(far)
            at = rows[look]
            won = (far < best[at]) | (far == best[at]) & (j < new[at])
            best[at[won]], new[at[won]] = far[won], j
            root[at[won]] = np.sqrt(far[won])
        seen.append((rows, members, near))
    left = np.flatnonzero(new != cluster)
    old_group = group[cluster[left]]
    moved[left, old_group] = np.minimum(moved[left, old_group], upper[left])  # unless the group was looked at, see below
    for g, (rows, members, near) in enumerate(seen):
        near[new[rows][:, None] == members[None, :]] = np.inf
        moved[rows, g] = near.min(1)
    return new, root, moved, measured


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 1), values.dtype)


def _state(ids: pa.Array, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    lists = lambda m, kind: pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel(), kind))
    columns = [ids, lists(x.astype(np.int32), pa.int32()), pa.array(cluster.astype(np.int32)), pa.array(upper), lists(lower, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "cluster", "upper", "lower"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def _kept(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """vec_id and x of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at, values = finite_rows(batch.column(1), dims)
            x = whole(values, scale)
            fits = (np.abs(x) < LARGEST).all(1)
            x = x[fits].astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dims, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[fits])), lists], names=["vec_id", "x"])

    return vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("x")).mapInArrow(run, "vec_id bigint, x array<int>")


def _sums(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """Of each cluster, the sums of its vectors' components and, last, their number."""

    def find(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in _slices(batches):
            x, cluster = _matrix(batch.column(1)).astype(np.int64), batch.column(0).to_numpy(zero_copy_only=False)
            for j in np.unique(cluster).tolist():
                mine = cluster == j
                total[j, :dims] += x[mine].sum(0)
                total[j, dims] += int(mine.sum())
        return total

    return summed(state.select("cluster", "x"), find)


def cluster(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of every vector that takes part, and the final centroids.

    The ``clusters`` vectors of least SHA-256 of ``seed:vec_id`` are the first centroids; after ``rounds`` rounds, vectors are assigned once more.
    """
    kept = cut(_kept(vectors, vec_id, embedding, dims, scale), "cluster-vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").select(digest.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    if not first:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), np.empty((0, dims), np.int64)
    now = np.array([r["x"] for r in first], np.int64)
    group = grouped(now)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _matrix(batch.column(1)).astype(np.int64)
            yield _state(batch.column(0), x, *assign(x, now, group))

    def onward(new: np.ndarray, drift: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                x, lower = _matrix(batch.column(1)).astype(np.int64), _matrix(batch.column(4))
                found = reassign(x, batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(), lower, new, drift, group)
                yield _state(batch.column(0), x, *found[:3])

        return run

    state = cut(kept.mapInArrow(begin, STATE), "cluster-state")
    discard(kept)
    for _ in range(rounds):
        sums = _sums(state, len(now), dims)
        new = np.where(sums[:, dims:] > 0, sums[:, :dims] // np.maximum(sums[:, dims:], 1), now)
        drift = np.sqrt(((new - now) ** 2).sum(1))
        old, state = state, cut(state.mapInArrow(onward(new, drift), STATE), "cluster-state")
        discard(old)
        now = new

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            mine = batch.column(2).to_numpy()
            far = ((_matrix(batch.column(1)).astype(np.int64) - now[mine]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(far)], names=["vec_id", "cluster", "distance"])

    out = cut(state.select("vec_id", "x", "cluster").mapInArrow(measured, "vec_id bigint, cluster int, distance bigint"), "clusters")
    discard(state)
    return out, now


def with_totals(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia (sums of distances; null beyond 64 bits) and centroid_sha256."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row a cluster
    fits = lambda x: x if x < 2**63 else None
    total = fits(sum(sums.values()))
    rows = [(j, fits(sums.get(j, 0)), total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
