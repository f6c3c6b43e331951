"""Z-curve vectors: phase-specific sums of Z steps after 0, 1, 2 (or 3) preceding bases, divided by a third of the length.

Layout: 9 values (phase, axis), then 36 (phase, base, axis), 144 (phase, base, base, axis) and, if asked for, 576; bases
in the order A, G, C, T.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import codes

SIZES = (9, 36, 144, 576)
DIM = sum(SIZES[:3])
#: Bases that are counted in one numpy pass.
PASS_BASES = 1 << 20
#: Bases whose contexts a worker counts at a time.
CONTEXT_BASES = 1 << 20


@lru_cache(maxsize=2)
def _tables(compat: bool) -> tuple[np.ndarray, np.ndarray]:
    hot, step = np.zeros((256, 4)), np.zeros((256, 3))
    for s in codes.MEANS:
        for c in (s, s.lower()):
            hot[ord(c)] = list(codes.one_hot(s).values())
            step[ord(c)] = codes.z_coordinates(s, compat)
    return hot, step


def encode(seq: str, orders: int = 3, compat: bool = False) -> np.ndarray:
    """The vector of one sequence: mononucleotides, then up to ``orders`` - 1 preceding bases."""
    hot, step = _tables(compat)
    raw = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)
    n = len(raw)
    out = []
    weights = np.ones((n, 1))
    for order in range(orders):
        m = n - order
        if order and m > 0:
            weights = (weights[:m, :, None] * hot[raw[order - 1 : order - 1 + m]][:, None, :]).reshape(m, -1)
        block = np.zeros((3, 4**order, 3))
        if m > 0:
            steps = step[raw[order : order + m]]
            for phase in range(3):
                block[phase] = weights[phase:m:3].T @ steps[phase::3]
        out.append(block.ravel())
    return np.concatenate(out) * (3.0 / n if n else 0.0)


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Place in A, G, C, T of each byte, 4 for other symbols."""
    out = np.full(256, 4, np.uint8)
    for i, letters in enumerate(("Aa", "Gg", "Cc", "TtUu")):
        for c in letters:
            out[ord(c)] = i
    return out


def _counted(raw: np.ndarray, sizes: np.ndarray, orders: int) -> np.ndarray:
    """Vectors of sequences without ambiguous symbols, given as places in A, G, C, T one after the other.

    The longest k-mers are counted, all at once; shorter ones are their sums over the last base and the k-mer that ends the sequence.
    """
    n, ends = len(sizes), np.cumsum(sizes)
    begins = ends - sizes
    top = orders - 1
    raw = raw.astype(np.int32)
    total = len(raw) - top
    cells = np.zeros((n, 3 * 4**orders), np.int64)
    if total > 0:
        key = (np.arange(len(raw), dtype=np.int32) - np.repeat(begins.astype(np.int32), sizes))[:total] % 3
        key += np.repeat(np.arange(0, 3 * n, 3, dtype=np.int32), sizes)[:total]
        for i in range(orders):
            key = key * 4 + raw[i : i + total]
        whole = np.ones(len(raw), bool)
        for back in range(1, top + 1):
            whole[(ends - back)[sizes >= back]] = False
        cells = np.bincount(key[whole[:total]], minlength=cells.size).reshape(cells.shape)
    step = np.array([[1 if b in axis else -1 for axis in codes.Z_AXES.values()] for b in "AGCT"], float)
    blocks = []
    for order in range(top, -1, -1):
        if order < top:
            cells = cells.reshape(n, -1, 4)
            cells = cells[:, :, 0] + cells[:, :, 1] + cells[:, :, 2] + cells[:, :, 3]
            some = np.flatnonzero(sizes > order)
            place = sizes[some] - 1 - order
            last = place % 3
            for i in range(order + 1):
                last = last * 4 + raw[begins[some] + place + i]
            cells[some, last] += 1
        blocks.append((cells.reshape(-1, 4).astype(float) @ step).reshape(n, -1))
    return np.concatenate(blocks[::-1], axis=1) * (3.0 / np.maximum(sizes, 1))[:, None]


def encode_many(seqs: list[str], orders: int = 3, compat: bool = False) -> np.ndarray:
    """The vectors of sequences; those with ambiguous symbols are taken one by one."""
    out = np.zeros((len(seqs), sum(SIZES[:orders])))
    sizes = np.fromiter((len(s) if s else 0 for s in seqs), np.int64, len(seqs))
    part = (np.cumsum(sizes) - sizes) // PASS_BASES
    cuts = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), len(seqs)] if len(seqs) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        raw = _codes()[np.frombuffer("".join(s or "" for s in seqs[a:b]).encode("latin-1", "replace"), np.uint8)]
        size = sizes[a:b]
        odd = np.flatnonzero(raw == 4)
        mixed = np.zeros(b - a, bool)
        if len(odd):
            owner = np.repeat(np.arange(b - a), size)
            mixed[owner[odd]] = True
            raw = raw[~mixed[owner]]
            for i in np.flatnonzero(mixed).tolist():
                out[a + i] = encode(seqs[a + i], orders, compat)
        some = np.flatnonzero(~mixed & (size > 0))
        if len(some):
            out[a + some] = _counted(raw, size[some], orders)
    return out


def _totals(seqs: list[str], order: int) -> np.ndarray:
    """Integer sums of Z steps after ``order`` bases over all sequences, rows by phase and context; sequences with ambiguous symbols are taken one by one."""
    first, cells = sum(SIZES[:order]), np.zeros(3 * 4 ** (order + 1), np.int64)
    table, held, size, odd = _codes(), [], 0, np.zeros((3 * 4**order, 3))
    for i, s in enumerate([*seqs, None]):
        if size and (i == len(seqs) or size > PASS_BASES):
            raw, sizes = np.concatenate(held).astype(np.int64), np.fromiter(map(len, held), np.int64, len(held))
            ends = np.cumsum(sizes)
            place = np.arange(len(raw)) - np.repeat(ends - sizes, sizes)
            key = place % 3
            for o in range(order + 1):
                key = key[: len(raw) - o] * 4 + raw[o:]
            cells += np.bincount(key[(place + order < np.repeat(sizes, sizes))[: len(key)]], minlength=len(cells))
            held, size = [], 0
        if s:
            raw = table[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
            if raw.max() < 4:
                held.append(raw)
                size += len(raw)
            else:
                odd += np.round(encode(s, order + 1)[first : first + SIZES[order]] * len(s) / 3).reshape(-1, 3)
    step = np.array([[1 if b in axis else -1 for axis in codes.Z_AXES.values()] for b in "AGCT"])
    return cells.reshape(-1, 4) @ step + odd.astype(np.int64)


def context_parts(seqs: DataFrame, order: int, seq: str = "seq") -> DataFrame:
    """frame, context (``order`` bases), zx, zy, zz: integer sums of each task's sequences; a task without any has no row."""
    names = [""]
    for _ in range(order):
        names = [c + b for c in names for b in "AGCT"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = (0 if total is None else total) + _totals(batch.column(0).to_pylist(), order)
        if total is not None:
            frames = np.repeat(np.arange(3, dtype=np.int32), len(names))
            yield pa.RecordBatch.from_arrays([pa.array(frames), pa.array(names * 3), *[pa.array(total[:, i]) for i in range(3)]], names=["frame", "context", "zx", "zy", "zz"])

    return seqs.select(seq).mapInArrow(run, "frame int, context string, zx bigint, zy bigint, zz bigint")


def context_totals(seqs: DataFrame, order: int, seq: str = "seq") -> DataFrame:
    """``context_parts`` added up."""
    return context_parts(seqs, order, seq).groupBy("frame", "context").agg(*[F.sum(f"z{axis}").alias(f"z{axis}") for axis in "xyz"])


def zcurve(orders: int = 3, compat: bool = False):
    """A pandas UDF from sequence to vector."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vector(seq: pd.Series) -> pd.Series:
        return pd.Series(list(encode_many(seq.tolist(), orders, compat)))

    return vector


def _axis_sign(base: Column, axis: str) -> Column:
    return F.when(base.isin(*codes.Z_AXES[axis]), 1).when(base.isin("A", "C", "G", "T"), -1).otherwise(0)


def mono_sums(seqs: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """keys, len and the nine integer sums zx0, zy0, zz0, zx1, ... of A, C, G, T sequences, by built-in expressions only."""
    out = seqs.select(*keys, F.length(seq).alias("len"), F.posexplode(F.split(F.col(seq), "")).alias("i", "b"))
    cells = [F.sum(F.when(F.col("i") % 3 == phase, _axis_sign(F.col("b"), axis)).otherwise(0)).alias(f"z{axis}{phase}") for phase in range(3) for axis in "xyz"]
    return out.groupBy(*keys, "len").agg(*cells)


def _contexts(texts: list[str], order: int) -> tuple:
    """Row, frame, context, zx, zy, zz of the contexts that each text has."""
    letters, code = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32), return_inverse=True)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(code)) - (ends - sizes)[row]
    good = np.flatnonzero(place + order < sizes[row])
    key = row[good] * 3 + place[good] % 3
    for o in range(order):
        key = key * len(letters) + code[good + o]
    has, cell = np.unique(key, return_inverse=True)
    step = np.array([[0 if chr(x) not in "ACGT" else 1 if chr(x) in axis else -1 for axis in codes.Z_AXES.values()] for x in letters.tolist()])
    sums = [np.bincount(cell, step[code[good + order], k], len(has)).astype(np.int64) for k in range(3)]
    context, rest = [""] * len(has), has
    for _ in range(order):
        context = [chr(letters[x]) + c for x, c in zip((rest % len(letters)).tolist(), context)]
        rest = rest // len(letters)
    return rest // 3, (rest % 3).astype(np.int32), context, *sums


def context_sums(seqs: DataFrame, keys: list[str], order: int, seq: str = "seq") -> DataFrame:
    """keys, len, frame, context (``order`` bases), zx, zy, zz: integer sums of A, C, G, T sequences in long form."""
    rows = seqs.where(F.length(seq) > order).select(*keys, F.length(seq).alias("len"), F.col(seq).alias("seq"))
    fields = rows.drop("seq").schema.fields
    schema = T.StructType([*fields, *T._parse_datatype_string("frame int, context string, zx bigint, zy bigint, zz bigint").fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(fields)).to_pylist()
            part = np.cumsum([0, *map(len, texts)])[:-1] // CONTEXT_BASES
            cuts = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), len(texts)] if texts else []
            for i, j in zip(cuts[:-1], cuts[1:]):
                at, *found = _contexts(texts[i:j], order)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at + i)) for c in batch.columns[: len(fields)]), *map(pa.array, found)], names=names)

    found = rows.mapInArrow(run, schema)
    return found.groupBy(*keys, "len", "frame", "context").agg(*[F.sum(f"z{axis}").alias(f"z{axis}") for axis in "xyz"])
