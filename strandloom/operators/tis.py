"""Translation start sites: position-specific Markov profiles of true, downstream-false and upstream-false starts.

A profile has, for each of 65 places around a start (50 upstream, 15 on), the conditional log-probability of a base after
``order`` bases.  Training is a count over windows, added up by each task before it is shuffled; scoring is a narrow pass over frames: a candidate's window is
summed up in the profiles (at most 65 x 65 numbers each, sent with the function), and the best candidate is an arg-max of the frame's list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import codes
from strandloom.functions import sequence as S

UP, DOWN = 50, 15
SAMPLE_LENGTH = 300
SEED_SCORE, SEED_LENGTH = 0.6, 300
FALSE_REACH = 150
PROFILES = ("T", "D", "U")
LOGS = "profile string, row int, kmer string, cnt long, logp double, prior double"
#: Windows that are scored in one numpy pass.
PASS_WINDOWS = 4_000
#: Where a model can't be trained: expected numbers of false starts and candidates (fixed values).
DEFAULT_FU, DEFAULT_FD, DEFAULT_ALTER = 0.83118, 5.16882, 7


@dataclass(frozen=True)
class AlterParams:
    """How many candidate starts are looked at, and how many false ones are expected upstream and downstream of a true one."""

    max_alter: int
    false_up: float
    false_down: float


def _bases(begin: Column, n: int) -> Column:
    """Bases of the strand from a place on, out of the context."""
    return S.slice_bytes(F.col("ctx"), begin - F.col("ctx_off"), F.lit(n))


def with_windows(orfs: DataFrame, starts: tuple[str, ...], keep: list[str]) -> DataFrame:
    """keep, ``found``: a list of profile, start and window, the 65 bases around sampled starts, for long frames, else null; ``orfs`` has ctx and ctx_off (see ``with_context``), starts, t_start, len, host_len."""
    low, high = F.greatest(F.lit(UP), F.col("t_start") - FALSE_REACH), F.least(F.col("t_start") - 3, F.col("host_len") - DOWN)
    rows = orfs.select("len", "host_len", "ctx", "ctx_off", "t_start", "starts", low.alias("low"), high.alias("high"), *[c for c in keep if c not in ("len", "host_len", "t_start", "starts")])
    # the windows are cut before they become rows, so that no row carries its whole context
    near = F.when(F.col("low") < F.col("high"), _bases(F.col("low") - UP, F.col("high") - F.col("low") - 1 + UP + DOWN))
    rows = rows.withColumn("near", near)
    own = F.filter("starts", lambda s: (s >= F.col("t_start")) & (s + DOWN <= F.col("host_len")) & (s >= UP))
    own = F.transform(own, lambda s: F.struct(F.when(s == F.col("t_start"), "T").otherwise("D").alias("profile"), s.cast("int").alias("start"), S.slice_bytes(F.col("ctx"), s - UP - F.col("ctx_off"), F.lit(UP + DOWN)).alias("window")))
    false = list(dict.fromkeys([*starts, "CTG"]))
    up = F.filter(F.sequence(F.lit(0), F.col("high") - F.col("low") - 1), lambda k: F.substring(F.col("near"), k + UP + 1, F.lit(3)).isin(false))
    up = F.transform(up, lambda k: F.struct(F.lit("U").alias("profile"), (F.col("low") + k).cast("int").alias("start"), F.substring(F.col("near"), k + 1, F.lit(UP + DOWN)).alias("window")))
    found = F.when(F.col("near").isNotNull(), F.concat(own, up)).otherwise(own)
    return rows.select(*keep, F.when(F.col("len") > SAMPLE_LENGTH, found).alias("found"))


def windows(orfs: DataFrame, starts: tuple[str, ...], keys: list[str]) -> DataFrame:
    """keys, profile, start, window: those of ``with_windows`` as rows."""
    rows = with_windows(orfs.where(F.col("len") > SAMPLE_LENGTH), starts, keys)
    return rows.select(*keys, F.explode("found").alias("w")).select(*keys, "w.profile", "w.start", "w.window")


def _places(order: int) -> int:
    return UP + DOWN - order


def _cells(order: int) -> int:
    """Cells of the three profiles of an order: by profile, place and k-mer."""
    return len(PROFILES) * _places(order) * 4 ** (order + 1)


def _codes(windows: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Base-4 numbers of the k-mers at each place of each window, and which of them hold an ambiguous base."""
    raw = np.frombuffer("".join(windows).encode("latin-1", "replace"), np.uint8).reshape(-1, UP + DOWN)
    base = np.full(256, 4, np.int64)
    base[np.frombuffer(b"ACGT", np.uint8)] = range(4)
    digit, places = base[raw], _places(order)
    code, mixed = np.zeros((len(raw), places), np.int64), np.zeros((len(raw), places), bool)
    for i in range(order + 1):
        part = digit[:, i : i + places]
        code, mixed = code * 4 + part, mixed | (part > 3)
    return code, mixed


def cell_counts(rows: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    """cell, n: k-mers of unambiguous bases in the lists ``found`` by profile, place and k-mer, for one order after the other; behind
    these, in two cells, how many rows have ``flag`` and how many there are.

    A task adds its rows up, so that the shuffle has as many rows a task as there are cells.
    """
    total = sum(map(_cells, orders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total + 2, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten()
            for at in range(0, len(flat), PASS_WINDOWS):
                part = flat.slice(at, PASS_WINDOWS)
                profile = np.array([PROFILES.index(p) for p in part.field("profile").to_pylist()])[:, None]
                cut_out = [w.ljust(UP + DOWN) for w in part.field("window").to_pylist()]
                first = 0
                for order in orders:
                    code, mixed = _codes(cut_out, order)
                    cell = first + (profile * _places(order) + np.arange(_places(order))) * 4 ** (order + 1) + code
                    sums += np.bincount(cell[~mixed], minlength=total + 2)
                    first += _cells(order)
            sums[total] += sum(map(bool, batch.column(1).to_pylist()))
            sums[total + 1] += batch.num_rows
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], names=["cell", "n"])

    listed = F.transform("found", lambda w: F.struct(w["profile"].alias("profile"), w["window"].alias("window")))
    partial = rows.select(listed.alias("found"), F.col("flag").cast("boolean").alias("flag")).mapInArrow(run, "cell bigint, n bigint")
    return partial.groupBy("cell").agg(F.sum("n").alias("n"))


def profile_counts(found: DataFrame, order: int) -> DataFrame:
    """profile, row, kmer, cnt: counts plus one, for every cell; ``found`` has the rows of ``windows`` or the lists of ``with_windows``."""
    lists = F.col("found") if "found" in found.columns else F.array(F.struct("profile", "window"))
    listed = found.select(lists.alias("found"), F.lit(False).alias("flag"))
    size, places = 4 ** (order + 1), _places(order)
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    part = lambda over, count: F.floor(F.col("cell") / over) % count
    kmer = F.concat(*[pick("ACGT", part(4 ** (order - i), 4)) for i in range(order + 1)])
    grid = found.sparkSession.range(_cells(order)).withColumnRenamed("id", "cell")
    grid = grid.select("cell", pick(PROFILES, part(places * size, len(PROFILES))).alias("profile"), part(size, places).cast("int").alias("row"), kmer.alias("kmer"))
    return grid.join(cell_counts(listed, (order,)), "cell", "left").select("profile", "row", "kmer", (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("cnt"))


def profile_logs(counts: DataFrame, order: int) -> DataFrame:
    """Adds ``logp``, the log of the last base's share after the k-mer's prefix, and ``prior``, the log share of the prefix in the row."""
    prefix = F.substring("kmer", 1, order) if order else F.lit("")
    same, row = Window.partitionBy("profile", "row", prefix), Window.partitionBy("profile", "row")
    total = F.sum("cnt").over(same)
    return counts.withColumn("logp", F.log(F.col("cnt") / total)).withColumn("prior", F.log(total / F.sum("cnt").over(row)))


def default_logs(order: int = 2) -> list[dict]:
    """A profile by rule, as ``profile_logs`` has them, for genomes without enough seeds: a ribosome binding site (A and G, most of all
    5 to 12 bases ahead) and ATG for true starts, a third-base bias around starts within a gene, and even bases upstream."""

    def share(profile: str, at: int) -> list[float]:
        if UP <= at < UP + 3:
            first = {"T": (0.8, 0.02, 0.13, 0.05), "D": (0.4, 0.02, 0.38, 0.2), "U": (0.34, 0.2, 0.23, 0.23)}[profile]
            return list((first, (0.01, 0.01, 0.01, 0.97), (0.01, 0.01, 0.97, 0.01))[at - UP])
        if profile == "T" and UP - 12 <= at < UP - 4:
            return [0.4, 0.1, 0.4, 0.1]
        if profile == "T" and at < UP:
            return [0.32, 0.18, 0.2, 0.3]
        if profile == "D" or profile == "T":
            return [[0.27, 0.23, 0.33, 0.17], [0.3, 0.23, 0.18, 0.29], [0.22, 0.29, 0.25, 0.24]][(at - UP) % 3]
        return [0.25] * 4

    rows = []
    for profile in PROFILES:
        places = [dict(zip("ACGT", share(profile, at))) for at in range(UP + DOWN)]
        for row in range(UP + DOWN - order):
            for kmer in map("".join, product("ACGT", repeat=order + 1)):
                prior = math.fsum(math.log(places[row + i][b]) for i, b in enumerate(kmer[:-1]))
                rows.append({"profile": profile, "row": row, "kmer": kmer, "logp": math.log(places[row + order][kmer[-1]]), "prior": prior})
    return rows


def background(found: DataFrame) -> DataFrame:
    """base, cnt over upstream-false windows."""
    rows = found.where("profile = 'U'").select(F.explode(F.split("window", "")).alias("base"))
    return rows.where(F.col("base").isin(*"ACGT")).groupBy("base").agg(F.count(F.lit(1)).alias("cnt"))


def alter_params(bases: dict[str, int], table: int = 11) -> AlterParams:
    """From background counts: candidates as trials that end at a stop, geometric, until 99 % are covered."""
    total = sum(bases.values())
    share = {b: bases.get(b, 0) / total if total else 0.0 for b in "ACGT"}
    odds = lambda names: sum(math.prod(share[b] for b in c) for c in names)
    start, stop = odds(codes.starts(table)), odds(codes.stops(table))
    if start + stop <= 0 or stop <= 0:
        return AlterParams(DEFAULT_ALTER, DEFAULT_FU, DEFAULT_FD)
    p, q = start / (start + stop), stop / (start + stop)
    covered = up = 0.0
    n = 0
    while True:
        covered += q * p**n
        if covered > 0.99:
            return AlterParams(n + 1, up, n - up)
        up += n * q * p**n
        n += 1


@dataclass(frozen=True)
class Profiles:
    """Log-probabilities of the profiles by place and k-mer, that of the first prefix in place 0; the last column, of zeros, is for ambiguous k-mers."""

    order: int
    table: np.ndarray

    @classmethod
    def of(cls, logs: list, order: int) -> Profiles:
        """From the rows of ``profile_logs``, a table of fixed size."""
        out = np.zeros((len(PROFILES), UP + DOWN - order, 4 ** (order + 1) + 1))
        for r in logs:
            code = 0
            for b in r["kmer"]:
                code = code * 4 + "ACGT".index(b)
            out[PROFILES.index(r["profile"]), r["row"], code] = r["logp"] + (r["prior"] if order and r["row"] == 0 else 0.0)
        return cls(order, out)

    @classmethod
    def fit(cls, counts: np.ndarray, order: int) -> Profiles:
        """From counts plus one by profile, place and k-mer, as ``profile_logs`` and ``of`` make them of a table."""
        out = np.zeros((*counts.shape[:2], counts.shape[2] + 1))
        logs, prior = _logs(counts)
        out[:, :, :-1] = logs
        if order:
            out[:, 0, :-1] += prior[:, 0]
        return cls(order, out)

    def scores(self, windows: list[str], params: AlterParams) -> np.ndarray:
        """The probability that each window's start is the true one."""
        code, mixed = _codes(windows, self.order)
        code[mixed] = self.table.shape[2] - 1
        code += np.arange(_places(self.order)) * self.table.shape[2]
        t, d, u = (part.ravel().take(code).sum(axis=1) for part in self.table)
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(d - t) * params.false_down + np.exp(u - t) * params.false_up)


def _logs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """logp and prior by profile, place and k-mer."""
    by_prefix = counts.reshape(*counts.shape[:2], -1, 4)
    total = by_prefix.sum(axis=3, keepdims=True)
    prior = np.log(total / counts.sum(axis=2)[:, :, None, None])
    return np.log(by_prefix / total).reshape(counts.shape), np.broadcast_to(prior, by_prefix.shape).reshape(counts.shape)


def scored(orfs: DataFrame, profiles: Profiles, params: AlterParams, min_length: int) -> DataFrame:
    """Adds ``cands``, start and score of the first ``max_alter`` starts whose window fits and whose gene stays long enough: a narrow pass, no row for a candidate."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(windows: pd.Series) -> pd.Series:
        sizes = [len(w) for w in windows]
        flat = [x for w in windows for x in w]
        found = np.concatenate([profiles.scores(flat[i : i + PASS_WINDOWS], params) for i in range(0, len(flat), PASS_WINDOWS)]) if flat else np.empty(0)
        return pd.Series(np.split(found, np.cumsum(sizes)[:-1]) if len(sizes) else [])

    fits = lambda s: (s + DOWN <= F.col("host_len")) & (s >= UP) & (F.col("end") - s >= min_length)
    listed = F.coalesce(F.filter(F.slice("starts", 1, params.max_alter), fits), F.slice(F.array(F.lit(0)), 1, 0))
    rows = orfs.withColumn("__s", listed)
    rows = rows.withColumn("__p", score(F.transform("__s", lambda s: S.slice_bytes(F.col("ctx"), s - UP - F.col("ctx_off"), F.lit(UP + DOWN)))))
    return rows.withColumn("cands", F.arrays_zip(F.col("__s").alias("start"), F.col("__p").alias("score"))).drop("__s", "__p")


def best_start(cands: Column) -> Column:
    """The start of the best-scored candidate, the first of equals; null where there are none."""
    return -F.array_max(F.transform(cands, lambda c: F.struct(c["score"].alias("score"), (-c["start"]).alias("back"))))["back"]


def best_starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start: the best of candidates that are rows (start, score), the first of equals."""
    return rows.groupBy(*keys).agg(best_start(F.collect_list(F.struct("start", "score"))).alias("start"))


def _with_best(orfs: DataFrame, profiles: Profiles, params: AlterParams, min_length: int, name: str) -> DataFrame:
    return scored(orfs, profiles, params, min_length).withColumn(name, best_start(F.col("cands"))).drop("cands")


def _moved(orfs: DataFrame, name: str) -> DataFrame:
    """t_start and len moved to the start ``name``, where that is not null."""
    to = F.coalesce(F.col(name), F.col("t_start"))
    return orfs.withColumns({"len": (F.col("len") - (to - F.col("t_start"))).cast("int"), "t_start": to.cast("int")})


def revise(orfs: DataFrame, profiles: Profiles, params: AlterParams, min_length: int) -> DataFrame:
    """Moves t_start and len of frames that have candidates to the best of them."""
    return _moved(_with_best(orfs, profiles, params, min_length, "__best"), "__best").drop("__best")


def train(seeds: DataFrame, starts: tuple[str, ...], table: int, min_length: int, max_iter: int) -> tuple[list, AlterParams]:
    """Rows of ``profile_logs`` of order 2 and the parameters, by alternating training and revision for orders 0, 1, 2 until 99 % of the starts stay.

    Revised starts follow from the seeds, a written table, and the profiles, so no round writes any.  A round is one job: it revises the starts, tells how many stay,
    and counts the next round's windows, of this order and, should this be its last round, of the next one.  The driver sees counts of fixed size.
    """

    def count(rows: DataFrame, orders: tuple[int, ...]) -> tuple[dict[int, np.ndarray], float | None]:
        sums = np.zeros(sum(map(_cells, orders)) + 2, np.int64)
        found = cell_counts(with_windows(rows, starts, ["flag"]), orders).toPandas()
        sums[found["cell"]] = found["n"]
        parts = np.split(sums, np.cumsum([_cells(o) for o in orders]))
        counts = {o: part.reshape(len(PROFILES), _places(o), -1) + 1 for o, part in zip(orders, parts)}
        return counts, int(sums[-2]) / int(sums[-1]) if sums[-1] else None

    counts, _ = count(seeds.withColumn("flag", F.lit(False)), (0,))
    before, fitted, params = None, None, AlterParams(DEFAULT_ALTER, DEFAULT_FU, DEFAULT_FD)
    for order in range(3):
        for _ in range(max_iter):
            fitted = counts[order]
            bases = (fitted[PROFILES.index("U")] - 1).reshape(_places(order), 4, -1).sum(axis=(0, 2))
            params = alter_params(dict(zip("ACGT", bases.tolist())), table)
            profiles = Profiles.fit(fitted, order)
            rows = _with_best(seeds, *before, min_length, "__was") if before else seeds.withColumn("__was", F.col("t_start"))
            rows = _with_best(rows, profiles, params, min_length, "__best")
            stays = F.col("__best").isNull() | (F.col("__best") == F.coalesce("__was", "t_start"))
            counts, stay = count(_moved(rows.withColumn("flag", stays), "__best"), (order, order + 1) if order < 2 else (order,))
            before = profiles, params
            if stay is None or stay > 0.99:
                break
    logs, prior = _logs(fitted)
    cells = product(enumerate(PROFILES), range(_places(2)), enumerate(map("".join, product("ACGT", repeat=3))))
    return [{"profile": p, "row": row, "kmer": kmer, "cnt": int(fitted[i, row, k]), "logp": float(logs[i, row, k]), "prior": float(prior[i, row, k])} for (i, p), row, (k, kmer) in cells], params
