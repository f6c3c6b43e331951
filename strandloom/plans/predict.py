"""Gene prediction: from scaffolds to genes, in single-genome or metagenome mode.

The driver decides on totals only (table, seeds, class counts) and holds models of fixed size; every step on
sequences and frames is a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions import codes, zcurve
from strandloom.functions import sequence as S
from strandloom.operators import gcbins, genes, kmeans, models, orfs, overlap, svm, tis
from strandloom.plans.bank import default_bank, load_bank
from strandloom.session import cut, discard, exists

THRESHOLD = 0.499
UP_SCORE, LOW_SCORE, LEAST_SCORE = 0.6, 0.05, 1e-6
MIN_SEEDS = 3
# The codes that "auto" compares, in order of preference, and their stop codons.
AUTO_STOPS = {11: ("TAA", "TAG", "TGA"), 4: ("TAA", "TAG"), 16: ("TAA", "TGA")}
AUTO_MIN_LENGTH = 75
ID = ["scaffold_id", "strand", "phase", "end"]


@dataclass
class Options:
    """The parameters of a prediction; see the command line's help."""

    table: int | str = 11
    min_length: int = orfs.MIN_LENGTH
    circular: bool = False
    mode: str = "single"
    threshold: float = THRESHOLD
    revise_tis: bool = True
    max_iter: int = 20
    min_overlap: int = overlap.MIN_OVERLAP
    min_ratio: float = overlap.MIN_RATIO
    tis_model: str | None = None
    cds_model: str | None = None
    models: str | None = None

    def check(self) -> None:
        if self.min_length < 30:
            raise ValueError("the least length is 30")
        if not 0 <= self.min_ratio <= 1:
            raise ValueError("the overlap ratio lies between 0 and 1")
        if self.table != "auto":
            codes.check_table(int(self.table))


def summary(scaffolds: DataFrame) -> DataFrame:
    """One row: scaffolds, size, gc."""
    seq = F.col("sequence")
    return scaffolds.agg(F.count(F.lit(1)).alias("scaffolds"), F.sum(F.length(seq)).alias("size"), F.round(F.sum(S.gc_count(seq)) / F.sum(F.length(seq)), 6).alias("gc"))


def report(scaffolds: DataFrame, options: Options) -> DataFrame:
    """``summary`` and the number of reading frames; the code must be settled."""
    frames = orfs.find_orfs(usable(scaffolds, options.min_length), int(options.table), options.min_length, options.circular)
    return summary(scaffolds).crossJoin(frames.agg(F.count(F.lit(1)).alias("frames")))  # one row each


def with_vectors(rows: DataFrame, orders: int = 3) -> DataFrame:
    """Adds ``z``, the Z-curve vector of ``seq``."""
    return rows.withColumn("z", zcurve.zcurve(orders)(F.col("seq")))


def on_bases(function: Callable[[np.ndarray], np.ndarray], seq: Column) -> Column:
    """A column of ``function``, from a matrix to a vector of numbers, on the vectors of ``seq``, which stay in the worker."""

    @F.pandas_udf(T.DoubleType())
    def run(rows: pd.Series) -> pd.Series:
        found = [function(zcurve.encode_many(rows.iloc[i : i + svm.SLICE].tolist())) for i in range(0, len(rows), svm.SLICE)]
        return pd.Series(np.concatenate(found) if found else [], dtype="float64")

    return run(seq)


def heuristic_scores(rows: DataFrame, scorers: dict[int, models.Perceptron]) -> DataFrame:
    """Adds ``i_score``: the vector of each frame's ``seq`` scored by the model of its ``bin``, 0 where the bin has none.  Vectors stay in the worker."""
    held = rows.sparkSession.sparkContext.broadcast(scorers)  # fixed size

    @F.pandas_udf(T.DoubleType())
    def score(seq: pd.Series, b: pd.Series) -> pd.Series:
        out, bins = np.zeros(len(seq)), b.to_numpy()
        order = np.argsort(bins, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1):
            if len(at) and bins[at[0]] in held.value:
                for i in range(0, len(at), svm.SLICE):
                    some = at[i : i + svm.SLICE]
                    out[some] = held.value[bins[some[0]]].score(zcurve.encode_many(seq.iloc[some].tolist()))
        return pd.Series(out)

    return rows.withColumn("i_score", score(F.col("seq"), F.col("bin")))


def scored_frames(found: DataFrame, scaffolds: DataFrame, scorers: dict[int, models.Perceptron] | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Frames with gc, bin and i_score; those of each value of ``within`` are binned by themselves."""
    if "ctx" in found.columns:  # binned by columns that are read without the bases
        binned = gcbins.assign_bins(found, "gc", tuple(ID), within)
        return heuristic_scores(binned.withColumn("seq", orfs.in_context()), scorers or default_bank(scaffolds.sparkSession)).drop("seq")
    found = orfs.with_sequence(cut(found, "frames"), scaffolds)  # read for short and for long scaffolds
    found = found.withColumn("gc", F.coalesce(S.gc_fraction(F.col("seq")), F.lit(0.0)))
    binned = gcbins.assign_bins(cut(found, "orfs"), "gc", tuple(ID), within)  # bases are written, not vectors, which are ten times as large
    return heuristic_scores(binned, scorers or default_bank(scaffolds.sparkSession)).drop("seq")


def scored_orfs(scaffolds: DataFrame, table: int, min_length: int, circular: bool, scorers=None, **options) -> DataFrame:
    """Frames with starts, gc, bin and i_score; those of linear scaffolds also with ctx and ctx_off, and with ``options`` of ``orfs.find_orfs_with_context``."""
    if circular:
        return scored_frames(orfs.find_orfs(scaffolds, table, min_length, True, with_starts=True), scaffolds, scorers)
    return scored_frames(orfs.find_orfs_with_context(scaffolds, table, min_length, **options), scaffolds, scorers)


def with_context(found: DataFrame, scaffolds: DataFrame) -> DataFrame:
    return found if "ctx" in found.columns else orfs.with_context(found, scaffolds)


def with_bases(found: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """Adds ``seq``, and drops the context."""
    return found.withColumn("seq", orfs.in_context()).drop("ctx", "ctx_off") if "ctx" in found.columns else orfs.with_sequence(found, scaffolds)


def code_scores(scaffolds: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None, scorers=None) -> DataFrame:
    """code, score: the share of the bases of ATG frames that lie in frames scored above 0.6, for the codes that "auto" compares; null without frames.

    The frames of all codes come from one scan and have a column ``code``.  ``score`` adds ``s`` to them; by default, the heuristic score.
    """
    found = orfs.find_orfs_by_code(scaffolds, {code: (("ATG",), stops) for code, stops in AUTO_STOPS.items()}, AUTO_MIN_LENGTH)
    found = score(found) if score else scored_frames(found, scaffolds, scorers, ("code",)).withColumnRenamed("i_score", "s")
    shares = found.groupBy("code").agg((F.sum(F.when(F.col("s") > UP_SCORE, F.col("len")).otherwise(0)) / F.sum("len")).alias("score"))
    every = scaffolds.sparkSession.createDataFrame([(code,) for code in AUTO_STOPS], "code int")
    return every.join(F.broadcast(shares), "code", "left")  # a row a code


def choose_table(scaffolds: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None, scorers=None) -> int:
    """The code of the best score (see ``code_scores``); the first of equals, and 11 if none has frames."""
    best = 11, 0.0
    for r in sorted(code_scores(scaffolds, score, scorers).collect(), key=lambda r: list(AUTO_STOPS).index(r.code)):
        if r.score is not None and r.score > best[1]:
            best = r.code, r.score
    return best[0]


def train_labels(rows: DataFrame, score: str = "i_score") -> DataFrame:
    """Adds ``label``: 1 above 0.6, -1 below 0.05 (but not 0), else null."""
    s = F.col(score)
    return rows.withColumn("label", F.when(s > UP_SCORE, 1).when((s < LOW_SCORE) & (s > LEAST_SCORE), -1))


def train_classifier(rows: DataFrame) -> tuple[models.MinMax, models.SVM | svm.Fourier, float] | None:
    """Scaler, classifier and score weight from ``z`` and ``i_score`` of all labelled frames; None if a class has too few."""
    labelled = train_labels(rows).where("label is not null").select("label", "z")
    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(-1, 0)
    if not models.trainable(n_pos, n_neg):
        return None
    return *svm.fit(labelled), models.class_weight(n_pos, n_neg)


def save_classifier(spark, path: str, scale: models.MinMax, machine: models.SVM | svm.Fourier) -> None:
    """A row; random features are saved without support vectors, as gamma and weights."""
    exact = isinstance(machine, models.SVM)
    row = (scale.low.tolist(), scale.high.tolist(), float(machine.gamma), float(machine.offset) if exact else 0.0, machine.vectors.tolist() if exact else [], machine.weights.tolist())
    spark.createDataFrame([row], "mins array<double>, maxs array<double>, gamma double, rho double, sv array<array<double>>, coef array<double>").write.mode("overwrite").parquet(path)


def load_classifier(spark, path: str) -> tuple[models.MinMax, models.SVM | svm.Fourier]:
    r = spark.read.parquet(path).first()
    machine = models.SVM(np.array(r.sv), np.array(r.coef), r.rho, r.gamma) if r.sv else svm.Fourier(r.gamma, np.array(r.coef))
    return models.MinMax(np.array(r.mins), np.array(r.maxs)), machine


def save_starts(logs: DataFrame, params: tis.AlterParams, path: str) -> None:
    """``logs``: of order 2, as ``tis.profile_logs`` has them."""
    extra = [F.lit(params.max_alter).alias("max_alter"), F.lit(params.false_up).alias("false_up"), F.lit(params.false_down).alias("false_down")]
    logs.select("profile", "row", "kmer", "logp", "prior", *extra).write.mode("overwrite").parquet(path)


def load_starts(spark, path: str) -> tuple[list, tis.AlterParams]:
    logs = spark.read.parquet(path).collect()  # a table of fixed size
    return logs, tis.AlterParams(logs[0].max_alter, logs[0].false_up, logs[0].false_down)


def seeds_of(found: DataFrame) -> DataFrame:
    """The frames that start-site training begins with."""
    return found.where((F.col("i_score") >= tis.SEED_SCORE) & (F.col("len") >= tis.SEED_LENGTH))


def revise_starts(found: DataFrame, scaffolds: DataFrame, table: int, options: Options) -> DataFrame:
    """Frames with revised starts; by the model that is given, one trained on the seeds, or, where these are too few, the default one.  Frames that have a context keep it."""
    spark = found.sparkSession
    seeds = seeds_of(found)
    if exists(spark, options.tis_model):
        logs, params = load_starts(spark, options.tis_model)
    elif seeds.limit(MIN_SEEDS).count() < MIN_SEEDS:
        logs, params = tis.default_logs(), tis.AlterParams(tis.DEFAULT_ALTER, tis.DEFAULT_FU, tis.DEFAULT_FD)
    else:
        known = [c for c in ("ctx", "ctx_off") if c in found.columns]
        context = cut(with_context(seeds.select(*ID, "host_len", "t_start", "len", "starts", *known), scaffolds), "seeds")
        logs, params = tis.train(context, codes.starts(table), table, options.min_length, options.max_iter)
        discard(context)
        if options.tis_model:
            save_starts(spark.createDataFrame(logs, tis.LOGS), params, options.tis_model)
    context = with_context(found, scaffolds)
    return tis.revise(context, tis.Profiles.of(logs, 2), params, options.min_length).select(*found.columns)


def usable(scaffolds: DataFrame, min_length: int) -> DataFrame:
    """Scaffolds that can hold a frame."""
    return scaffolds.where((F.col("length") if "length" in scaffolds.columns else F.length("sequence")) >= min_length)


def predict(scaffolds: DataFrame, options: Options | None = None, scorers: dict[int, models.Perceptron] | None = None) -> DataFrame:
    """Genes: scaffold_id, name, host_len, strand, t_start, end, len, partial5, partial3, i_score, d_score, score, start, stop.

    ``scaffolds``: scaffold_id, name, sequence; those below the least length yield none.  They are read several times, so their ids must
    be values of a table and not made by the plan; ``read_sequences`` returns such.  ``scorers``: by default, those of ``options.models``
    or the default bank.
    """
    options = options or Options()
    options.check()
    spark = scaffolds.sparkSession
    hosts = usable(scaffolds, options.min_length)
    scorers = scorers or (load_bank(spark, options.models) if options.models else default_bank(spark))
    table = choose_table(hosts, scorers=scorers) if options.table == "auto" else int(options.table)
    parts: list[DataFrame] = []  # written tables that the frames are read from

    def settled(rows: DataFrame, name: str) -> DataFrame:
        out = cut(rows, name)
        discard(*parts)
        parts[:] = [out]
        return out

    reach = {} if options.revise_tis else {"upstream": 0, "downstream": 0}
    found = scored_orfs(hosts, table, options.min_length, options.circular, scorers, **reach, parts=parts)
    # frames that are read once are not written: where a model is loaded, scores and starts follow from the scan's table in one pass
    if options.circular or (options.revise_tis and not exists(spark, options.tis_model)):
        found = settled(found, "scored")
    if options.revise_tis:
        found = revise_starts(found, hosts, table, options)
        if options.circular:
            found = settled(found, "revised")
    if options.mode == "meta":
        found = found.withColumn("d_score", F.lit(0.0))
        weight = models.class_weight(0, 0, meta=True)
    else:
        based = with_bases(found, hosts)
        trained, weight = None, 1.0
        if exists(spark, options.cds_model):
            trained = load_classifier(spark, options.cds_model)  # reads the bases once, so they are not written
        else:
            based = settled(based, "bases")  # not vectors, which are ten times as large
            if fitted := train_classifier(with_vectors(based)):
                *trained, weight = fitted
                if options.cds_model:
                    save_classifier(spark, options.cds_model, *trained)
        if trained:
            scale, machine = trained
            found = based.withColumn("d_score", on_bases(lambda x: machine.probability(scale.apply(x)), F.col("seq"))).drop("seq")
        else:
            found = based.drop("seq").withColumn("d_score", F.lit(0.0))
    found = settled(found.drop("ctx", "ctx_off", "starts", "types"), "scored")
    found = found.withColumn("score", S.blend(F.col("i_score"), F.lit(float(weight)), F.col("d_score"))).where(F.col("score") > options.threshold)
    named = found.join(scaffolds.select("scaffold_id", "name"), "scaffold_id")
    return genes.with_coordinates(named).select("scaffold_id", "name", "host_len", "strand", "phase", "t_start", "end", "len", "partial5", "partial3", "i_score", "d_score", "score", "start", "stop")


def kmeans_labels(rows: DataFrame, k: int = 3) -> DataFrame:
    """Adds ``cluster`` of the min-max scaled vectors, and ``positive``: whether it is the cluster of the longest mean length."""
    data = cut(rows, "kmeans")
    fitted = kmeans.fit(data, k, tuple(ID))
    if fitted is None:
        return data.withColumn("cluster", F.lit(0)).withColumn("positive", F.lit(False))
    out = data.withColumn("cluster", kmeans.assigned(F.col("z"), *fitted))
    means = out.groupBy("cluster").agg(F.avg("len").alias("m")).collect()  # k rows
    best = max(means, key=lambda r: (r.m, -r.cluster)).cluster
    return out.withColumn("positive", F.col("cluster") == best)


def principal_components(rows: DataFrame, k: int = 2) -> DataFrame:
    """Adds ``pc``, the first principal components of the centred vectors ``z``.  Of the two signs of a component, that which makes its largest entry positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.withColumn("v", array_to_vector("z"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(data).transform(data)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    axes = model.pc.toArray()  # as many rows as a vector has entries
    signs = F.array(*[F.lit(1.0 if axis[np.abs(axis).argmax()] >= 0 else -1.0) for axis in axes.T])
    return model.transform(centred).withColumn("pc", F.zip_with(vector_to_array("p"), signs, lambda x, sign: x * sign)).drop("v", "c", "p")


def self_train(rows: DataFrame, max_iter: int = 20, high: float = 0.7, low: float = 0.31, ratio: float = 8.0) -> tuple[models.Standard, models.SVM | svm.Fourier]:
    """Scaler and classifier trained again and again on its own labels of all rows.

    rows: ``z`` and ``positive``, the first labels.  A round trains on the labelled rows, scores all rows in a narrow pass and writes their new labels: 1 above ``high``,
    -1 up to ``low``.  It ends when negatives outnumber positives ``ratio`` to one, or a class is gone.
    """
    state = cut(rows.select(F.when(F.col("positive"), 1).otherwise(-1).alias("label"), "z"), "self-labels")
    found = None
    for k in range(max_iter + 1):
        fitted = svm.fit(state, scale="standard", cost=1.0 if k else 10.0, balanced=k > 0, gamma="scale")
        if fitted is None:
            break
        found = scale, machine = fitted
        score = models.applied(lambda x, s=scale, m=machine: m.probability(s.apply(x)), F.col("z"))
        old, state = state, cut(state.select(score.alias("s"), "z").select(F.when(F.col("s") > high, 1).when(F.col("s") <= low, -1).alias("label"), "z"), "self-labels")
        discard(old)
        n = {r.label: r["count"] for r in state.groupBy("label").count().collect()}
        if not n.get(1) or not n.get(-1) or (k and n[-1] / n[1] >= ratio):
            break
    discard(state)
    return found


def toy_centres(n: int, dim: int) -> np.ndarray:
    """Fixed support vectors for the kernel query: a wave for each."""
    i, j = np.meshgrid(np.arange(n), np.arange(dim), indexing="ij")
    return np.round(np.sin(0.7 * (i + 1) * (j + 1)) / np.sqrt(dim), 6)


def toy_weights(n: int) -> np.ndarray:
    return np.array([1.0 if i % 2 == 0 else -0.8 for i in range(n)])
