"""MinHash near-duplicates by Order MinHash, verified by banded alignment.

Words are runs of word characters, lower case, and single letters in scripts without spaces between words (``shared.UNSPACED``); a k-mer is a shingle of ``SHINGLE`` words, labelled with how often it has
occurred in the text before.  (A text of fewer words is one shingle.)

Sketches.  For each of ``SKETCHES`` hash functions, the ``PICKED`` labelled shingles of least hash are taken and put in
the order that they have in the text (Marcais et al. 2019), so that a sketch agrees with a probability that falls with
moved as well as with changed text.  Two texts that share a part s of their labelled shingles agree in one sketch with odds
of about s**2; at s = 0.4, which is what a tenth of the words changed leaves, they miss all of them with odds of 1.5 %, at 0.5 of 0.1 %.

Verification.  Texts that sketches connect are a candidate group.  Within it, a pair that shares at least ``MIN_SHARED``
of its labelled shingles, counted by matrix products, and enough of its words in any order, is aligned word by word: the longest chain of equal words in the order
of both texts.  At similarity s no word of it lies further off the diagonal than the longer text has words beyond the
chain, the band, and only the band is computed, a row of it at a time as the bits of an integer.  With L chained words of
n and m the similarity is L / (n + m - L); from ``MIN_SIMILARITY`` on the two are linked.  Pairs already in one class are
skipped, which changes no class.

Scale.  Copies (equal word sequences) are merged first, by a digest.  Candidate groups come from a hub for each sketch
value (a combined minimum) and ``components``; no pairs are listed.  Chance agreements chain unlike texts, so that the largest of these groups grows faster than the corpus; one above
``BLOCK_DOCS`` texts or ``BLOCK_WORDS`` words is taken apart into its hubs' groups, a hub and all texts that have one of its values: any two texts that agree in a sketch are together in one.
Each text goes to its first hub's group, and groups above these bounds are dealt to blocks: each block is searched by itself and against the group's block 0, so a text is sent
twice; this joins a group of near copies to one class.  Only what it leaves apart is compared on: of the hubs' groups that hold several classes, texts outside the largest
one, by pairs of blocks, with each other and with that class; groups of more than two blocks by bands of length, as texts two bands apart differ too much to link.  A task returns a spanning forest of
its links, not the links, and counts pairs by tiles of ``TILE`` texts, so its memory is bounded by two blocks.

Cases.  Null text or white space: no words, its own class.  Text of signs only: copies are classes, nothing else links.
Null doc_id: its own class (class_id null, kept).  Repeated rows: one class; all rows of its smallest id are marked
kept, see ``drop_duplicates``.  One id with several texts: each text is verified and has its class.  Extra columns are ignored.  Empty table: no rows.  Very long texts: linear but for their
alignment, n times the band's bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.components import connected
from strandloom.llm.shared import Sets, by_key, cut, map_texts, orderable, positional
from strandloom.llm.shared import split_words as words

SHINGLE, MIN_SIMILARITY, MIN_SHARED = 5, 0.8, 0.3
SKETCHES, PICKED = 24, 2
BLOCK_DOCS, BLOCK_WORDS = 512, 200_000
#: Sizes of groups of several blocks are broadcast up to this many rows, about 3 MB.
BROADCAST_ROWS = 100_000
#: Texts a side and shingles of a matrix product in ``forest``; pairs between two looks at which classes have met.
TILE, TILE_COLUMNS, PAIRS = 1_024, 4_096, 4_096
#: Pairs of a tile that are aligned without a look at what words they share.
LISTED = 256
BATCH_WORDS = 1 << 18
#: Places of a text whose bits are one integer, for texts of more words than ``WHOLE``.
SEGMENT, WHOLE = 1_024, 1 << 15
#: Words whose digests a worker keeps at hand, about 30 MB.
WORD_CODES = 200_000
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_MAX = np.uint64(2**64 - 1)
_SEEDS = np.random.default_rng(7).integers(0, 2**63, (SKETCHES, 2), dtype=np.uint64) | np.uint64(1)


class _WordCodes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > WORD_CODES:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return code


_codes = _WordCodes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def labelled(documents: list[list[str]], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of ``size`` words of documents that have words, one after the other in text order, and how many each has."""
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    codes = np.fromiter((c for d in documents for c in map(_codes.__getitem__, d)), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = np.maximum(1, sizes - size + 1)
    padded = np.concatenate((codes, np.zeros(size, np.uint64)))
    raw = np.zeros(len(codes), np.uint64)
    for i in range(size):
        raw = raw * _P + padded[i : i + len(codes)]
    for d in np.flatnonzero(sizes < size).tolist():  # a short text is one shingle, told apart by its length
        h = int(sizes[d])
        for c in codes[starts[d] : ends[d]].tolist():
            h = (h * int(_P) + c) & (2**64 - 1)
        raw[starts[d]] = h
    firsts = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(starts - firsts, n)
    shingles = _mix(raw[at])
    owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key = shingles ^ _mix(owner + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    run = np.flatnonzero(new)
    seen = np.empty(len(key), np.uint64)
    seen[order] = (np.arange(len(key)) - np.repeat(run, np.diff(np.append(run, len(key))))).astype(np.uint64)
    return _mix(shingles + seen * _P), n


def sketches(shingles: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Order MinHash sketches: SKETCHES x documents."""
    starts = np.cumsum(n) - n
    out = np.empty((SKETCHES, len(n)), np.uint64)
    two = n > 1
    for j, (a, b) in enumerate(_SEEDS):
        v = (shingles ^ a) * b
        v ^= v >> np.uint64(32)
        least = np.minimum.reduceat(v, starts)
        is_first = v == np.repeat(least, n)
        v[is_first] = _MAX
        second = np.minimum.reduceat(v, starts)
        p1 = np.flatnonzero(is_first)
        p2 = p1.copy()
        p2[two] = np.flatnonzero((v == np.repeat(second, n)) & np.repeat(two, n))
        early, late = shingles[np.minimum(p1, p2)], shingles[np.maximum(p1, p2)]
        out[j] = _mix(early * _P + late * _Q + np.uint64(j + 1))
    return out


def _digest(text: str | None, found: list[str]) -> bytes | None:
    """What copies have in common: the words, or all of a text of signs only; none for a text of nothing."""
    if found:
        return xxhash.xxh3_128_digest(" ".join(found).encode("utf-8", "replace"))
    return xxhash.xxh3_128_digest(b"\0" + text.encode("utf-8", "replace")) if text and text.strip() else None


def _digests(texts: list[str | None]) -> list:
    return [[_digest(t, words(t)) for t in texts]]


def _sketched(texts: list[str | None]) -> list:
    digests, counts = [None] * len(texts), [0] * len(texts)
    columns = [[None] * len(texts) for _ in range(SKETCHES)]
    held: list[list[str]] = []
    owner: list[int] = []

    def flush() -> None:
        if held:
            for column, values in zip(columns, sketches(*labelled(held)).view(np.int64).tolist()):
                for i, x in zip(owner, values):
                    column[i] = x
            held.clear()
            owner.clear()

    size = 0
    for i, text in enumerate(texts):
        found = words(text)
        digests[i] = _digest(text, found)
        if found:
            counts[i] = len(found)
            held.append(found)
            owner.append(i)
            size += len(found)
            if size >= BATCH_WORDS:
                flush()
                size = 0
    flush()
    return [digests, counts, *columns]


def alignment(x: list[str], y: list[str], least: float = MIN_SIMILARITY) -> float:
    """Chained words over all, by banded alignment; right for values of at least ``least``, lower ones may come out lower still.

    A row of the alignment's table is an integer with a bit for each word of ``y`` in the band, 0 where the chain grows
    (Hyyro 2004): bits left of the band have settled, those right of it are still 1.
    """
    n, m = len(x), len(y)
    band = max(n, m) - math.ceil(least * (n + m) / (1 + least) - 1e-9)
    if band < abs(n - m):
        return 0.0
    first, stop = 0, min(n, m)
    while first < stop and x[first] == y[first]:
        first += 1
    last = 0
    while last < stop - first and x[n - 1 - last] == y[m - 1 - last]:
        last += 1
    x, y, chain = x[first : n - last], y[first : m - last], first + last
    if x and y:
        size = SEGMENT if len(y) > WHOLE else len(y)
        wanted, places = set(x), {}
        for j, w in enumerate(y):
            if w in wanted:
                k = w, j // size
                places[k] = places.get(k, 0) | 1 << j % size
        row, low, high = 0, 0, 0
        for i, w in enumerate(x):
            if (end := min(len(y), i + band + 1)) > high:
                row |= (1 << end - low) - (1 << high - low)
                high = end
            if (begin := min(i - band, high)) > low:
                chain += (begin - low) - (row & (1 << begin - low) - 1).bit_count()
                row >>= begin - low
                low = begin
            if low == high:
                break
            if size == len(y):
                hit = places.get((w, 0), 0) >> low
            else:
                hit = 0
                for k in range(low // size, (high - 1) // size + 1):
                    if bits := places.get((w, k)):
                        hit |= bits << k * size - low if k * size >= low else bits >> low - k * size
            if hit := hit & row:
                row = (row + hit | row - hit) & (1 << high - low) - 1
        chain += (high - low) - row.bit_count()
    return chain / (n + m - chain)


def _shared(p: tuple[np.ndarray, ...], q: tuple[np.ndarray, ...], shape: tuple[int, int]) -> np.ndarray:
    """How many labelled shingles each text of one tile shares with each of another; a tile: rows and columns of its shingles, sorted by column, and the distinct columns."""
    columns = p[2] if p is q else np.intersect1d(p[2], q[2], assume_unique=True)
    out = np.zeros(shape, np.float32)
    for first in range(0, len(columns), TILE_COLUMNS):
        some = columns[first : first + TILE_COLUMNS]
        sides = []
        for (rows, held, _), n in zip((p,) if p is q else (p, q), shape):
            lo, hi = np.searchsorted(held, (some[0], some[-1] + 1))
            at = np.searchsorted(some, held[lo:hi])
            has = some[at] == held[lo:hi]
            part = np.zeros((n, len(some)), np.float32)
            part[rows[lo:hi][has], at[has]] = 1
            sides.append(part)
        out += sides[0] @ sides[-1].T
    return out


def forest(texts: list[list[str]], side: list[int], least: float = MIN_SIMILARITY, tile: int | None = None, known: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between texts; with two sides, of those across.  ``known``: classes they are already in.

    Pairs are counted by tiles of ``tile`` x ``tile`` texts, so that memory grows with the texts and not with their square.
    """
    tile = tile or TILE
    length = np.array([len(t) for t in texts])

    def index(size: int) -> tuple[np.ndarray, Callable[[np.ndarray], tuple]]:
        """How many labelled shingles of ``size`` words the texts have, and what ``_shared`` takes of some of them."""
        shingles, n = labelled(texts, size)
        owner = np.repeat(np.arange(len(n)), n)
        _, column, times = np.unique(shingles, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], column[shared]
        firsts = np.searchsorted(owner, np.arange(len(n) + 1))

        def held_by(part: np.ndarray) -> tuple:
            sizes = firsts[part + 1] - firsts[part]
            at = np.arange(sizes.sum()) + np.repeat(firsts[part] - np.cumsum(sizes) + sizes, sizes)
            order = np.argsort(column[at], kind="stable")
            held = column[at][order]
            return np.repeat(np.arange(len(part)), sizes)[order], held, np.unique(held)

        return n, held_by

    n, shingles_of = index(SHINGLE)
    words_of = None

    def tiles(members: np.ndarray) -> list[tuple]:
        return [(part, shingles_of(part)) for part in (members[i : i + tile] for i in range(0, len(members), tile))]

    sides = np.array(side)
    groups = [tiles(np.flatnonzero(sides == s)) for s in sorted(set(side))]
    if len(groups) > 1:
        pairs = [(p, q) for p in groups[0] for q in groups[1]]
    else:
        pairs = [(p, q) for i, q in enumerate(groups[0]) for p in groups[0][: i + 1]]
    sets, out = Sets(len(n)), []
    if known is not None:
        member: dict[int, int] = {}
        for i, k in enumerate(known):
            sets.join(i, member.setdefault(k, i))

    def roots(members: np.ndarray) -> np.ndarray:
        return np.fromiter(map(sets.find, members.tolist()), np.int64, len(members))

    for (p, left), (q, right) in pairs:
        p_root, q_root = roots(p), roots(q)
        if (p_root == p_root[0]).all() and (q_root == p_root[0]).all():
            continue
        common = _shared(left, right, (len(p), len(q)))
        bound = common / (n[p][:, None] + n[q][None, :] - common)
        a, b = length[p][:, None], length[q][None, :]
        wanted = (bound >= MIN_SHARED - 1e-6) & (np.minimum(a, b) >= least * np.maximum(a, b) - 1e-6)
        x, y = np.nonzero(np.triu(wanted, 1) if p is q else wanted)
        best = np.argsort(-bound[x, y], kind="stable")
        x, y = x[best], y[best]
        first = True
        while len(x):
            apart = roots(p)[x] != roots(q)[y]
            x, y = x[apart], y[apart]
            if first and len(x) > LISTED:  # a chain has no more words than both texts have, in whatever order
                words_of = words_of or index(1)[1]
                one = words_of(p)
                both = _shared(one, one if p is q else words_of(q), (len(p), len(q)))[x, y]
                may = both >= least * (length[p][x] + length[q][y] - both) - 1e-3
                x, y = x[may], y[may]
            first = False
            for a, b in zip(p[x[:PAIRS]].tolist(), q[y[:PAIRS]].tolist()):
                if sets.find(a) != sets.find(b) and alignment(texts[a], texts[b], least) >= least:
                    sets.join(a, b)
                    out.append((a, b))
            x, y = x[PAIRS:], y[PAIRS:]
    return out


def _verified(tasks: DataFrame) -> DataFrame:
    """a, b: links found by the tasks; ``tasks``: grp, low, high (blocks), side (0: of block low), node, known (class), text."""
    tasks = tasks.select("grp", "low", "high", "side", "node", "known", "text").repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, 3):
            if rows.num_rows > 1:
                ids = rows["node"].to_pylist()
                found = forest([words(t) for t in rows["text"].to_pylist()], rows["side"].to_pylist(), known=rows["known"].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a, _ in found], pa.int64()), pa.array([ids[b] for _, b in found], pa.int64())], names=["a", "b"])

    return tasks.mapInArrow(run, "a bigint, b bigint")


def _blocks(n: str, w: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / BLOCK_DOCS), F.ceil(F.col(w) / BLOCK_WORDS)).cast("int")


def _task(low: Column, high: Column, side: int | Column) -> Column:
    return F.struct(low.alias("low"), high.alias("high"), (F.lit(side) if isinstance(side, int) else side).alias("side"))


def _small(sizes: DataFrame) -> DataFrame:
    """Written, and broadcast if it is no larger than ``BROADCAST_ROWS``; else a plain join, whose hot keys can be split."""
    sizes = cut(sizes, "near-sizes")
    return F.broadcast(sizes) if sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else sizes


def _members(grouped: DataFrame, met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """grp, node, n_words: the texts of each candidate group, by the component where that fits a block, else by the first hub of each text; and hub, node, n_words: all hubs' groups of the latter.

    ``grouped``: id, component, n_words; ``met``: node, hub.
    """
    large = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w")).where(_blocks("n", "w") > 1).select("component")
    large = _small(large)
    nodes = grouped.withColumnRenamed("id", "node")
    whole = nodes.join(large, "component", "left_anti").select(F.col("component").alias("grp"), "node", "n_words")
    parted = cut(nodes.join(large, "component", "left_semi").join(met, "node").select("hub", "node", "n_words"), "near-parted")
    homes = parted.groupBy("node").agg(F.min("hub").alias("grp"), F.first("n_words").alias("n_words")).select("grp", "node", "n_words")
    heads = parted.where("hub = node").join(homes.select(F.col("grp").alias("hub")).distinct(), "hub", "left_semi").select(F.col("hub").alias("grp"), "node", "n_words")
    return cut(whole.unionByName(homes.unionByName(heads).distinct()), "near-members"), parted


def _linked(members: DataFrame, parted: DataFrame, with_text: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, component of the texts that have links.  ``members``, ``parted``: see ``_members``; ``with_text`` adds ``text`` to nodes."""
    texts = cut(with_text(members.select("node").distinct()).select("node", "text"), "near-texts")  # read twice, and a share of the corpus
    counted = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w")).select("grp", "n", _blocks("n", "w").alias("blocks"))
    sizes = _small(counted.where("blocks > 1").select("grp", "blocks"))
    dealt = members.join(sizes, "grp", "left").withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(0).cast("int"))
    zero, block = F.lit(0), F.col("block")
    own = F.array(_task(block, block, 0))
    others = F.transform(F.sequence(F.lit(1), F.col("blocks") - 1), lambda o: _task(zero, o, 0))
    tasks = F.when(F.col("blocks").isNull(), own).when(block > 0, F.concat(own, F.array(_task(zero, block, 1)))).otherwise(F.concat(own, others))
    dealt = dealt.join(texts.hint("merge"), "node").withColumn("t", F.explode(tasks)).select("grp", "t.*", "node", F.col("node").alias("known"), "text")
    links = cut(_verified(dealt), "near-links")
    classes = connected(links)

    # Hubs' groups with texts of several classes, but for those that were searched whole just now.
    rows = parted.join(classes.select(F.col("id").alias("node"), F.col("component").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
    rows = cut(rows, "near-apart")
    found = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("m"), F.sum("n_words").alias("w"), (F.min("class") < F.max("class")).alias("apart")).where("apart")
    found = found.join(counted.where("blocks = 1").select(F.col("grp").alias("hub"), "n"), "hub", "left").where("n is null or n < m")
    found = _small(found.select("hub", _blocks("m", "w").alias("blocks")))
    if not found.take(1):
        return classes.withColumnRenamed("id", "node")
    band = F.floor(F.log("n_words") / math.log(1.01 / MIN_SIMILARITY)).cast("int")  # texts of bands that are not next to each other differ too much in length
    rows = rows.join(found, "hub").withColumn("band", F.explode(F.when(F.col("blocks") > 2, F.array(band - 1, band)).otherwise(F.array(zero))))
    rows = rows.withColumn("grp", F.concat_ws(":", "hub", "band")).select("grp", "node", "n_words", "class")
    parts = rows.groupBy("grp", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"))
    most = F.max(F.struct("n", "class", "w")).alias("most")
    plan = parts.groupBy("grp").agg(most, F.sum("n").alias("n"), F.sum("w").alias("w")).where("n > most.n")
    plan = plan.select("grp", F.col("most.class").alias("main"), F.col("most.n").alias("mn"), F.col("most.w").alias("mw"), (F.col("n") - F.col("most.n")).alias("rn"), (F.col("w") - F.col("most.w")).alias("rw"), _blocks("n", "w").alias("every"))
    plan = _small(plan.select("grp", "main", "every", _blocks("rn", "rw").alias("rest"), (_blocks("rn", "rw") + _blocks("mn", "mw")).alias("all")))
    rows = rows.join(plan, "grp")
    is_rest = F.col("class") != F.col("main")
    hashed = F.xxhash64("node")
    block = F.when(is_rest, F.pmod(hashed, F.col("rest"))).otherwise(F.col("rest") + F.pmod(hashed, F.col("all") - F.col("rest"))).cast("int")
    rows = rows.withColumn("block", F.when(F.col("every") > 1, block).otherwise(0))
    block = F.col("block")
    against = F.transform(F.sequence(zero, F.when(is_rest, F.col("all")).otherwise(F.col("rest")) - 1), lambda o: _task(F.least(block, o), F.greatest(block, o), F.when(block > o, 1).otherwise(0)))
    against = F.when(F.col("every") > 1, against).otherwise(F.array(_task(zero, zero, 0)))
    dealt = rows.join(texts.hint("merge"), "node").withColumn("t", F.explode(against)).select("grp", "t.*", "node", F.col("class").alias("known"), "text")
    links = links.unionByName(cut(_verified(dealt), "near-links"))
    return connected(links).withColumnRenamed("id", "node")


def _classes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, bool]:
    """doc_id, digest, class_id and stays (its text is the one that stands for the class) of every document; whether some id stands in several rows.

    A node is a text, whatever rows have it: named by its smallest id, or by a number where ids are not of one row.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = [f"s{j}" for j in range(SKETCHES)]
    added = "digest binary, n_words bigint, " + ", ".join(f"{s} bigint" for s in names)
    seen = cut(map_texts(slim, "text", ("doc_id",), _sketched, added), "near-sketches")
    repeats = _repeats(seen)
    copies = seen.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_words").alias("n_words"), *[F.min(s).alias(s) for s in names])
    # The table is written, and so the numbers stay.
    copies = cut(copies.withColumn("node", F.monotonically_increasing_id() if repeats else F.col("rep")), "near-copies")

    values = copies.where("n_words > 0").select("node", F.explode(F.array(*names)).alias("s"))
    hubs = values.groupBy("s").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("s", "hub")
    met = cut(values.join(hubs, "s").select("node", "hub").distinct(), "near-hubs")
    grouped = connected(met.where("node <> hub"), "node", "hub")
    grouped = cut(grouped.join(copies.select(F.col("node").alias("id"), "n_words"), "id"), "near-groups")
    members, parted = _members(grouped, met)
    # By shuffle at every size: how many texts are candidates grows with the corpus, and so would a broadcast.
    if repeats:
        texts = map_texts(slim.where("doc_id is not null"), "text", ("doc_id", "text"), _digests, "digest binary").dropDuplicates(["doc_id", "digest"])
        named = copies.select("node", F.col("rep").alias("doc_id"), "digest")
        classes = _linked(members, parted, lambda nodes: nodes.join(named, "node").join(texts.hint("merge"), ["doc_id", "digest"]))
    else:
        classes = _linked(members, parted, lambda nodes: nodes.join(slim.withColumnRenamed("doc_id", "node").hint("merge"), "node"))

    reps = copies.select("digest", "rep", "node").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if repeats:
        least = reps.groupBy("component").agg(F.min(F.struct("rep", "digest")).alias("least"))
        reps = reps.join(least, "component").select("digest", F.col("least.rep").alias("class_id"), F.col("least.digest").alias("stands"))
    else:
        reps = reps.select("digest", F.col("component").alias("class_id"), F.when(F.col("component") == F.col("rep"), F.col("digest")).alias("stands"))
    out = seen.select("doc_id", "digest").join(reps, "digest", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    stays = class_id.eqNullSafe(F.col("doc_id")) & F.col("digest").eqNullSafe(F.col("stands"))
    return out.select("doc_id", "digest", class_id.alias("class_id"), stays.alias("stays")), repeats


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept (doc_id = class_id) of every document."""
    found, _ = _classes(docs, doc_id, text)
    return found.select("doc_id", "class_id", F.col("class_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def _repeats(seen: DataFrame) -> bool:
    """Whether some id stands in several rows."""
    return bool(seen.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1))


def drop_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one for each class stays, that with the smallest id; rows without an id stay.

    A row is known by its id and its text: of rows that are equal in these but for case and signs, the least stays, and an id with several texts
    stays with each of them that stands for a class.  All columns of a row that stays come out as they are, whatever their names.
    """
    columns = docs.columns
    docs, names = positional(docs)
    doc_id, text = names[doc_id], names[text]
    found, repeats = _classes(docs, doc_id, text)
    found = cut(found, "near-classes")
    kept = found.where("stays and doc_id is not null").select(F.col("doc_id").alias("__kept"), F.col("digest").alias("__as"))
    same = F.col(doc_id).cast("long") == F.col("__kept")
    if repeats:
        told = map_texts(docs, text, docs.columns, _digests, "__digest binary")
        out = told.join(kept, same & F.col("__digest").eqNullSafe(F.col("__as")), "left_semi")
        # the least row of an id and digest, combined before the shuffle
        least = F.min_by(F.struct(*docs.columns), F.struct(text, *orderable(docs))).alias("row")
        out = out.groupBy(F.col(doc_id).cast("long").alias("__id"), "__digest").agg(least).select("row.*")
    else:
        out = docs.join(kept.select("__kept"), same, "left_semi")
    if found.where("doc_id is null").take(1):
        out = out.unionByName(docs.where(F.col(doc_id).isNull()))
    return out.toDF(*columns)
