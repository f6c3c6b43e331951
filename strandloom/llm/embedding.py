"""Embedding near-duplicates: exact pairs above a cosine threshold by dual traversal of cover trees.

On unit vectors, cosine >= c is Euclidean distance <= tau = sqrt(2 - 2c).  A cover tree has nested levels of centres
with halving radii: every point is within a level's radius of a centre of that level, and a level's centres are also
centres of the next.  A node knows the exact largest distance to a point below it (its covering radius).  Two nodes with
centres at distance d hold no link if d > tau + r1 + r2, and only links if d + r1 + r2 <= tau; else their children are
compared.  Points that are left meet in double precision, cosine against the threshold.

Distributed.  Equal vectors are merged first.  The top levels of one tree, fitted on at most ``SAMPLE`` vectors, deal
all vectors to at most ``CELLS`` cells; pairs of cells are pruned by the same bound.  Cells are dealt to blocks of at most ``BLOCK_ROWS``
vectors, each with a tree of its own, built once; each pair of blocks of surviving cells is a task, which traverses the
two trees.  It returns its vectors' link counts and their root in a spanning forest, never the pairs; ``components`` joins
the forests.

Scale.  A task holds two blocks.  Vectors are sent once for each partner block: where vectors have no clusters (random
directions in 64 dimensions lie about 1.4 apart, far beyond any covering radius that helps) no exact metric tree
prunes, all pairs of blocks remain, and work grows with the square of the rows.  Groups of near copies fall into one node
and are counted whole.

Cases.  Null, zero, null or non-finite components, null id: no links, its own component.  Vectors of different length
never link.  Equal vectors link with each other.  Repeated rows count as other vectors.  Empty table: no rows.  Extra columns are ignored, whatever their names.  Very long vectors:
blocks have a fixed number of rows, so a task's memory grows with the length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.components import connected
from strandloom.llm.shared import Sets, by_key, cut

MIN_COSINE = 0.95
SAMPLE, CELLS = 2_048, 64
BLOCK_ROWS, LEAST_BLOCKS, SMALL = 8_192, 8, 512
_TILE = 1_024
_LEVELS = 6
_SLACK = 1e-9
#: Room for the error of single-precision dot products of unit vectors.
_ROOM = 1e-4


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def cover(points: np.ndarray, centres: list[int], radius: float) -> list[int]:
    """The centres, and as many more points as leave none further than ``radius`` from all of them (unit vectors)."""
    centres, least = list(centres), 1.0 - radius * radius / 2.0
    for first in range(0, len(points), _TILE):
        part = points[first : first + _TILE]
        near = np.zeros(len(part), bool)
        for at in range(0, len(centres), _TILE):
            near |= (part @ points[centres[at : at + _TILE]].T).max(axis=1) >= least
        far = np.flatnonzero(~near)
        within = part[far] @ part[far].T >= least
        taken, covered = np.zeros(len(far), bool), np.zeros(len(far), bool)
        for k in range(len(far)):
            if not covered[k]:
                taken[k] = True
                covered |= within[k]
        centres += (first + far[taken]).tolist()
    return centres


def build(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cover tree of points: the first level in which each is a centre, and its parent there; the last level is all points.

    Single precision shapes the tree; what depends on it, the covering radii, is measured afterwards.
    """
    points = unit.astype(np.float32)
    first, parent = np.full(len(points), -1), np.zeros(len(points), np.int64)
    net, level = [0], 0
    first[0] = 0
    while len(net) < len(points):
        level += 1
        finer = cover(points, net, 2.0 / 2**level) if level < _LEVELS else [*net, *np.flatnonzero(first < 0).tolist()]
        new = np.array(finer[len(net) :], np.int64)
        for at in range(0, len(new), _TILE):
            best = np.full(min(_TILE, len(new) - at), -9.0)
            for k in range(0, len(net), _TILE):
                near = points[new[at : at + _TILE]] @ points[net[k : k + _TILE]].T
                who = near.argmax(axis=1)
                value = near[np.arange(len(near)), who]
                more = value > best
                best[more] = value[more]
                parent[new[at : at + len(best)][more]] = np.array(net)[who[more] + k]
        first[new] = level
        net = finer
    return first, parent


class Tree:
    """A cover tree with exact covering radii; a node is a point at a level."""

    def __init__(self, raw: np.ndarray, first: np.ndarray, parent: np.ndarray):
        self.raw, self.unit = raw, _unit(raw)
        self.norm = np.sqrt((raw * raw).sum(axis=1))
        self.small = self.unit.astype(np.float32)
        self.last = int(first.max())
        self.first, self.parent = first, parent
        above = np.arange(len(raw))
        self.above, self.radius, self.count = {}, {}, {}
        for level in range(self.last, -1, -1):
            late = first[above] > level
            above = np.where(late, parent[above], above)
            gap = self.unit - self.unit[above]
            far = np.zeros(len(raw))
            np.maximum.at(far, above, np.sqrt((gap * gap).sum(axis=1)))
            self.above[level], self.radius[level], self.count[level] = above, far, np.bincount(above, minlength=len(raw))
        self.newcomers, self.kids_of = {}, {}
        for level in range(1, self.last + 1):
            new = np.flatnonzero(first == level)
            new = new[np.argsort(parent[new], kind="stable")]
            self.newcomers[level] = new, parent[new]

    def kids(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next level's nodes below each node, itself first: where they begin, how many they are, and the list of all."""
        if level not in self.kids_of:
            n = len(self.raw)
            new, parents = self.newcomers.get(level + 1, (np.empty(0, np.int64),) * 2)
            count = 1 + np.bincount(parents, minlength=n)
            begin = np.cumsum(count) - count
            listed = np.empty(n + len(new), np.int64)
            listed[begin] = np.arange(n)
            listed[np.delete(np.arange(n + len(new)), begin)] = new
            self.kids_of[level] = begin, count, listed
        return self.kids_of[level]

    def below(self, node: int, level: int) -> np.ndarray:
        """All points below a node."""
        return np.flatnonzero(self.above[min(level, self.last)] == node)

    def at(self, table: dict[int, np.ndarray], level: int, nodes: np.ndarray) -> np.ndarray:
        return table[min(level, self.last)][nodes]


def traverse(x: Tree, y: Tree, least: float, whole, some) -> None:
    """Calls ``whole(points of x, points of y)`` for node pairs all of whose pairs link, ``some(points, points)`` for single links.

    Bounds are compared as dot products in single precision, with room for its error; a link is decided in double.
    """
    tau = math.sqrt(2.0 - 2.0 * least)

    def decide(p: np.ndarray, q: np.ndarray) -> None:
        for k in range(0, len(p), _TILE * 16):
            a, b = p[k : k + _TILE * 16], q[k : k + _TILE * 16]
            good = np.einsum("ij,ij->i", x.raw[a], y.raw[b]) / (x.norm[a] * y.norm[b]) >= least
            if good.any():
                some(a[good], b[good])

    def compare(level: int, a: np.ndarray, b: np.ndarray) -> None:
        """Nodes a of x against nodes b of y, both of a level."""
        for i in range(0, len(a), _TILE):
            p = a[i : i + _TILE]
            r = x.at(x.radius, level, p)
            for j in range(0, len(b), _TILE):
                q = b[j : j + _TILE]
                s = y.at(y.radius, level, q)
                dots = x.small[p] @ y.small[q].T
                # most nodes of a fine level are single points, for which one bound does; the others get their own
                wide_p, wide_q = np.flatnonzero(r > 0), np.flatnonzero(s > 0)
                keep = dots >= 1.0 - (tau + _ROOM) ** 2 / 2.0
                if len(wide_p) or len(wide_q):
                    reach = lambda u, v: 1.0 - np.minimum(2.0, tau + _ROOM + u[:, None] + v[None, :]) ** 2 / 2.0
                    keep[wide_p] = dots[wide_p] >= reach(r[wide_p], s) - _ROOM
                    keep[:, wide_q] = dots[:, wide_q] >= reach(r, s[wide_q]) - _ROOM
                m, n = np.nonzero(keep)
                follow(level, p[m], q[n])

    def follow(level: int, u: np.ndarray, v: np.ndarray) -> None:
        """Node pairs that a bound has not ruled out, level by level: decided, taken whole, or dealt to their children."""
        while len(u):
            points = (x.at(x.count, level, u) == 1) & (y.at(y.count, level, v) == 1)
            if level >= max(x.last, y.last):
                points[:] = True
            decide(u[points], v[points])
            u, v = u[~points], v[~points]
            gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", x.unit[u], y.unit[v])))
            spread = x.at(x.radius, level, u) + y.at(y.radius, level, v)
            full = gap + spread <= tau - _SLACK
            for k in np.flatnonzero(full).tolist():
                whole(x.below(u[k], level), y.below(v[k], level))
            near = ~full & (gap <= tau + spread + _SLACK)
            u, v = u[near], v[near]
            (bx, cx, lx), (by, cy, ly) = x.kids(level), y.kids(level)
            level += 1
            size = cx[u] * cy[v]
            for k in np.flatnonzero(size > _TILE).tolist():
                compare(level, lx[bx[u[k]] : bx[u[k]] + cx[u[k]]], ly[by[v[k]] : by[v[k]] + cy[v[k]]])
            u, v, size = u[size <= _TILE], v[size <= _TILE], size[size <= _TILE]
            pair = np.repeat(np.arange(len(u)), size)
            local = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            u, v = lx[bx[u[pair]] + local // cy[v[pair]]], ly[by[v[pair]] + local % cy[v[pair]]]

    compare(0, np.array([0]), np.array([0]))


def linked(ids: list[int], copies: np.ndarray, first: Tree, second: Tree | None, least: float) -> list[tuple[int, int, int]]:
    """(id, links to other distinct vectors weighted by copies, root) for each vector with links: within one block, or across two (ids: of both)."""
    shift = len(first.raw) if second is not None else 0
    links, sets = np.zeros(len(ids), np.int64), Sets(len(ids))

    def whole(p: np.ndarray, q: np.ndarray) -> None:
        q = q + shift
        links[p] += copies[q].sum()
        if shift:
            links[q] += copies[p].sum()
        for k in (*p.tolist(), *q.tolist()):
            sets.join(int(p[0]), k)

    def some(p: np.ndarray, q: np.ndarray) -> None:
        q = q + shift
        np.add.at(links, p, copies[q])
        if shift:
            np.add.at(links, q, copies[p])
        for i, j in zip(p.tolist(), q.tolist()):
            sets.join(i, j)

    traverse(first, second if second is not None else first, least, whole, some)
    if not shift:
        links -= copies  # each vector has met itself
    smallest: dict[int, int] = {}
    for i, k in enumerate(ids):
        r = sets.find(i)
        smallest[r] = min(smallest.get(r, k), k)
    return [(ids[i], int(links[i]), smallest[sets.find(i)]) for i in np.flatnonzero(links > 0).tolist()]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _usable(vector: str) -> F.Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _top(sample: np.ndarray) -> np.ndarray:
    """The deepest level of a cover tree over the sample that has at most CELLS centres."""
    net = [0]
    for level in range(1, _LEVELS):
        finer = cover(sample, net, 2.0 / 2**level)
        if len(finer) > CELLS:
            break
        net = finer
    return sample[net]


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    if dict(rows.dtypes)["v"] not in ("array<float>", "array<double>"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    good = rows.where(F.col("vec_id").isNotNull() & _usable("v"))
    distinct = cut(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    found = None
    for (size,) in sorted(distinct.select(F.size("v")).distinct().collect()):
        part = _pairs(distinct.where(F.size("v") == size), min_cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = distinct.sparkSession.createDataFrame([], "id bigint, links bigint, root bigint")
    found = cut(found, "vector-links")
    components = connected(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reps = distinct.join(links, F.col("rep") == links["id"], "left").drop("id").join(components, F.col("rep") == components["id"], "left")
    reps = reps.select("v", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked_rows = good.join(reps, "v").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where(~(F.col("vec_id").isNotNull() & _usable("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _pairs(distinct: DataFrame, least: float) -> DataFrame:
    """id, links, root of vectors of one length, from each pair of blocks."""
    spark = distinct.sparkSession
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow()["v"]
    tops = _top(_unit(_matrix(sample)))
    kind = dict(distinct.dtypes)["v"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(_unit(_matrix(pa.chunked_array([batch.column(2)]))), tops)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["rep", "copies", "v", "cell", "gap"])

    placed = distinct.select("rep", "copies", "v").mapInArrow(assign, f"rep bigint, copies bigint, v {kind}, cell int, gap double")
    if len(tops) == 1:  # one cell needs no placing
        placed = distinct.select("rep", "copies", "v", F.lit(0).alias("cell"))
        cells = {0: (distinct.count(), 2.0)}
    else:
        placed = cut(placed, "vector-cells")
        cells = {r.cell: (r.n, r.radius) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()}
    first, blocks = {}, 0
    for c, (n, _) in sorted(cells.items()):
        first[c] = blocks, max(1 if n <= SMALL else LEAST_BLOCKS, -(-n // BLOCK_ROWS))
        blocks += first[c][1]
    tau, apart = math.sqrt(2.0 - 2.0 * least), _distances(tops, tops)
    partners = []
    for c, (_, r) in cells.items():
        near = [p for p, (_, s) in cells.items() if apart[c, p] <= tau + r + s + 1e-6]
        partners.append((c, *first[c], [b for p in near for b in range(first[p][0], first[p][0] + first[p][1])]))
    if len(partners) == 1:
        _, begin, n, near = partners[0]
        dealt = placed.withColumn("first", F.lit(begin)).withColumn("n", F.lit(n)).withColumn("partners", F.array(*map(F.lit, near)))
    else:
        dealt = placed.join(F.broadcast(spark.createDataFrame(partners, "cell int, first int, n int, partners array<int>")), "cell")  # at most CELLS rows
    dealt = dealt.withColumn("block", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("n"))).cast("int"))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, 1):
            shape = build(_unit(_matrix(t["v"])))
            t = t.append_column("place", pa.array(np.arange(t.num_rows))).append_column("level", pa.array(shape[0])).append_column("parent", pa.array(shape[1]))
            yield from t.combine_chunks().to_batches(max_chunksize=4_096)

    # A block's tree is built once, and travels with the vectors as level and parent.
    grown = dealt.select("block", "rep", "copies", "v", "partners").repartition("block").sortWithinPartitions("block", "rep")
    schema = f"block int, rep bigint, copies bigint, v {kind}, partners array<int>, place bigint, level bigint, parent bigint"
    tasks = grown.mapInArrow(trees, schema).withColumn("other", F.explode("partners"))
    tasks = tasks.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "place", "rep", "copies", "v", "level", "parent")
    tasks = tasks.repartition("low", "high").sortWithinPartitions("low", "high", "side", "place")

    def tree(t: pa.Table) -> Tree:
        return Tree(_matrix(t["v"]), t["level"].to_numpy(), t["parent"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, 2):
            other = int(t["side"].to_numpy().sum())
            if t["low"][0].as_py() == t["high"][0].as_py():
                first, second = tree(t), None
            elif 0 < other < t.num_rows:
                first, second = tree(t.slice(0, t.num_rows - other)), tree(t.slice(t.num_rows - other))
            else:
                continue
            found = linked(t["rep"].to_pylist(), t["copies"].to_numpy(), first, second, least)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["id", "links", "root"])

    return tasks.mapInArrow(run, "id bigint, links bigint, root bigint")
