"""Modelling tables, validation, nulls and maps (MOD1 to MOD19).

All taxa, folds, arms, candidates and null draws are rows of one table.  A model is a group of it (a taxon's sites, at most the
background cap and its detections) and is fitted in a task by a learner of ``plans.learners``: one Spark job for all of a study's models.
"""

from __future__ import annotations

import json
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rangeflow.functions.scalars import map_grade, skill
from rangeflow.functions.scalars import tier as tier_of

from rangeflow.operators.aggs import paired_arms, pass_rates
from rangeflow.operators.lineage import cut
from rangeflow.operators.joins import accessible_sites, held_out_distances, nearest, nearest_in_space, squares, within
from rangeflow.operators.topk import background_sample, hash_order, shifted_null, sweep_sample, unit_hash
from rangeflow.operators.windows import auc, boyce, quantile_gap, sequential_p
from rangeflow.plans.learners import Learner, area, boyce_index, design, label_of, nothing, ridge_logistic, scale_of, small_fit

BACKGROUND, FOLDS, BLOCK_KM, NULLS, STOP_AFTER = 10_000, 5, 200, 99, 5
BLOCK_FLOOR_KM, BLOCK_CEILING_KM = 50, 300
MAX_CORRELATION = 0.7
RIDGE = 0.01

INNER_FOLDS, DRAW_BATCH = 3, 10
#: Rows of a square's part, and distances held at a time, in the kernel baseline.
KERNEL_ROWS, KERNEL_CELLS = 16_384, 1 << 21
#: Sites of a part, and distances held at a time, in the mean of all pairs.
PAIR_ROWS, PAIR_CELLS = 8_192, 1 << 16
#: Partitions a core that models are dealt to, so that few of them share a task.
TASKS_A_CORE = 16

#: Columns that a learner may read beside the bands.
_CARRIED = ("x", "y", "effort")


# ---- tables -------------------------------------------------------------------


def training_table(points: DataFrame, sites: DataFrame, bands: list[str], n_background: int = BACKGROUND, buffer_km: float = 500, seed: int = 1) -> DataFrame:
    """MOD1: detections and non-detections of every taxon at site level.

    points: taxon, site; sites: site, x, y, records and the bands.  ``effort`` = log(records - own + 1); rows without all bands
    are dropped.  One table for all taxa.
    """
    own = points.groupBy("taxon", "site").agg(F.count("*").alias("own"))
    seen = own.join(sites, "site")
    reach = accessible_sites(sites.select("site", "x", "y"), seen.select("taxon", "x", "y"), buffer_km).select("taxon", "site")
    pool = reach.join(own.select("taxon", "site"), ["taxon", "site"], "left_anti")
    background = background_sample(pool, n_background, seed, ("taxon",), "site").select("taxon", "site", F.lit(0).alias("presence"), F.lit(0).alias("own"))
    rows = own.select("taxon", "site", F.lit(1).alias("presence"), "own").unionByName(background).join(sites, "site")
    effort = F.log(F.col("records") - F.col("own") + 1)
    return rows.withColumn("effort", effort).dropna(subset=bands).select("taxon", "site", "presence", "x", "y", "effort", "records", *bands)


def design_rows(training: DataFrame, design: str = "sites", cap: int = 25, seed: int = 1) -> DataFrame:
    """MOD2: rows as sites, without effort, or one per record up to a cap of repeats."""
    if design == "sites":
        return training
    if design == "no-effort":
        return training.withColumn("effort", F.lit(0.0))
    if design == "per-record":
        return training.withColumn("_r", F.explode(F.sequence(F.lit(1), F.least(F.lit(cap), F.greatest(F.lit(1), F.col("records").cast("int")))))).drop("_r")
    raise ValueError(design)


def balanced_weights(training: DataFrame, by: list[str], label: str = "presence") -> DataFrame:
    """MOD2: weights under which both classes of a group count the same."""
    n = training.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("_n1"), F.count("*").alias("_n"))
    w = F.when(F.col(label) == 1, F.col("_n") / (2.0 * F.col("_n1"))).otherwise(F.col("_n") / (2.0 * (F.col("_n") - F.col("_n1"))))
    return training.join(n, by).withColumn("weight", w).drop("_n1", "_n")


def effort_mode(training: DataFrame, mode: str, by: tuple[str, ...] = ("taxon",)) -> DataFrame:
    """MOD2: effort as nothing, a covariate, weights, or an offset."""
    if mode in ("none", "covariate", "offset"):
        return training.withColumn("effort_term", F.col("effort") if mode != "none" else F.lit(0.0))
    if mode == "weights":
        mean = training.groupBy(*by).agg(F.avg(F.exp("effort")).alias("_m"))
        return training.join(mean, list(by)).withColumn("weight", F.exp("effort") / F.col("_m")).drop("_m")
    raise ValueError(mode)


def effort_level(training: DataFrame, by: tuple[str, ...] = ("taxon",)) -> DataFrame:
    """MOD2: the detections' median effort, at which scores are read."""
    return training.where("presence = 1").groupBy(*by).agg(F.percentile("effort", 0.5).alias("effort_at"))


def variogram(sites: DataFrame, value: str, bin_km: float = 25, max_km: float = 400, sample: int = 400, seed: int = 1) -> DataFrame:
    """MOD3: binned semivariance of a value per taxon over pairs of sampled sites within a distance."""
    s = background_sample(sites, sample, seed, ("taxon",), "site").select("taxon", "site", "x", "y", F.col(value).alias("v"))
    met = within(s, s, max_km * 1000.0, ["taxon"]).where("site < r_site")
    bin_ = (F.floor(F.sqrt("d2") / (bin_km * 1000.0)) * bin_km + bin_km).cast("double")
    return met.groupBy("taxon", bin_.alias("km")).agg((F.avg(F.pow(F.col("v") - F.col("r_v"), 2)) / 2).alias("gamma"), F.count("*").alias("pairs"))


def block_size(bins: DataFrame, step: float = 5) -> DataFrame:
    """MOD3: the first bin at 95 % of the sill, rounded to 5 km and held in 50..300."""
    sill = F.max("gamma").over(Window.partitionBy("taxon"))
    first = bins.withColumn("sill", sill).groupBy("taxon").agg(F.min(F.when(F.col("gamma") >= 0.95 * F.col("sill"), F.col("km"))).alias("km"))
    return first.select("taxon", F.least(F.lit(float(BLOCK_CEILING_KM)), F.greatest(F.lit(float(BLOCK_FLOOR_KM)), F.bround(F.col("km") / step) * step)).alias("block_km"))


def spatial_folds(sites: DataFrame, k: int = FOLDS, block_km: float = BLOCK_KM, seed: int | Column = 1, by: tuple[str, ...] = ("taxon",)) -> DataFrame:
    """MOD3: folds 1..k of square blocks: blocks with detections, busiest first, to the fold with the fewest; others to the fold with the fewest blocks.

    Ties go by a hash of seed and block (``seed`` may be a column).  The deal is an ordered fold over the group's blocks (a small array for each).
    """
    size = block_km * 1000.0
    block = F.concat_ws(":", F.floor(F.col("x") / size).cast("string"), F.floor(F.col("y") / size).cast("string"))
    rows = cut(sites.withColumn("block", block))
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    blocks = rows.groupBy(*by, "block").agg(F.count_if(F.col("presence") == 1).cast("int").alias("found"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("found")).alias("minus"), F.col("o"), "block", "found")))
    listed = blocks.withColumn("o", hash_order(seed, F.col("block"))).groupBy(*by).agg(order.alias("blocks"))
    zero = F.struct(
        F.array_repeat(F.lit(0), k).alias("found"), F.array_repeat(F.lit(0), k).alias("sizes"),
        F.array().cast("array<struct<block:string,fold:int>>").alias("out"),
    )

    def deal(state: Column, b: Column) -> Column:
        load = F.when(b["found"] > 0, state["found"]).otherwise(state["sizes"])
        fold = F.array_position(load, F.array_min(load)).cast("int")
        add = lambda a, n: F.transform(a, lambda v, i: F.when(i == fold - 1, v + n).otherwise(v))
        return F.struct(
            add(state["found"], b["found"]).alias("found"), add(state["sizes"], F.lit(1)).alias("sizes"),
            F.concat(state["out"], F.array(F.struct(b["block"].alias("block"), fold.alias("fold")))).alias("out"),
        )

    dealt = listed.select(*by, F.explode(F.aggregate("blocks", zero, deal, lambda s: s["out"])).alias("d")).select(*by, "d.block", "d.fold")
    return cut(rows.join(dealt, [*by, "block"]))


def random_folds(rows: DataFrame, k: int = FOLDS, seed: int = 1, key: str = "site") -> DataFrame:
    """MOD3: folds by a hash."""
    return rows.withColumn("fold", (F.floor(unit_hash(F.lit(seed), F.col(key)) * k) + 1).cast("int"))


def drop_constant(training: DataFrame, bands: list[str]) -> list[str]:
    """MOD4: bands that vary (one pass; a few numbers to the driver)."""
    sd = training.agg(*[F.stddev(b).alias(b) for b in bands]).first()
    return [b for b in bands if sd[b] is not None and sd[b] > 0]


def prune_correlated(training: DataFrame, bands: list[str], limit: float = MAX_CORRELATION, most: int | None = None) -> list[str]:
    """MOD4: greedy keep in the given order while correlations stay under the limit (one pass; the matrix is bands x bands)."""
    bands = drop_constant(training, bands)
    if not bands:
        return []
    vectors = VectorAssembler(inputCols=bands, outputCol="_v", handleInvalid="skip").transform(training).select("_v")
    m = np.abs(Correlation.corr(vectors, "_v").first()[0].toArray())
    kept: list[int] = []
    for k in range(len(bands)):
        if all(m[k, j] < limit for j in kept) and (most is None or len(kept) < most):
            kept.append(k)
    return [bands[k] for k in kept]


def prune_by_taxon(training: DataFrame, bands: list[str], limit: float = MAX_CORRELATION, per_presence: float = 4) -> DataFrame:
    """MOD4: (taxon, kept): each taxon's bands that vary and stay under the limit, in the given order, as many as its detections allow.

    One band for ``per_presence`` detections, five at least; all for 0.

    One aggregation with partial sums gives all correlations; the greedy keep folds over a taxon's bands x bands array.
    """
    pair = {(a, b): F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)) for a, b in combinations(bands, 2)}  # null beside a constant
    matrix = [pair.get((a, b), pair.get((b, a), F.lit(1.0))) for a in bands for b in bands]
    spread = F.array(*[F.stddev_pop(b) for b in bands])
    stats = training.groupBy("taxon").agg(F.array(*matrix).alias("_m"), spread.alias("_sd"), F.count_if(F.col("presence") == 1).alias("_n"))
    most = F.greatest(F.lit(5), F.floor(F.col("_n") / per_presence).cast("int")) if per_presence else F.lit(len(bands))

    def keep(kept: Column, k: Column) -> Column:
        apart = F.forall(kept, lambda j: F.coalesce(F.abs(F.get("_m", k * len(bands) + j)) < limit, F.lit(False)))
        return F.when((F.get("_sd", k) > 0) & apart & (F.size(kept) < most), F.concat(kept, F.array(k))).otherwise(kept)

    kept = F.aggregate(F.sequence(F.lit(0), F.lit(len(bands) - 1)), F.array().cast("array<int>"), keep)
    return stats.select("taxon", F.transform(kept, lambda k: F.get(F.array(*map(F.lit, bands)), k)).alias("kept"))


def predictor_cap(presences: int) -> int:
    """MOD4: predictors a model of n detections can have."""
    return max(5, presences // 4)


def limit_hosts(bands: list[str], means: dict[str, float], cap: int, share: float = 1 / 5, pinned: tuple[str, ...] = ("host_conifer",)) -> list[str]:
    """MOD4: at most a share of the cap for host trees, pinned ones first, then by mean abundance."""
    hosts = sorted((b for b in bands if b.startswith("host_")), key=lambda b: (b not in pinned, -means.get(b, 0.0), b))
    kept = set(hosts[: round(cap * share)])
    return [b for b in bands if not b.startswith("host_") or b in kept]


# ---- fits of all groups in one job --------------------------------------------------


def _fitted(train: pd.DataFrame, bands: list[str], learner: Learner | None, settings: dict | None, ridge: float, pairs: bool, fold: str, null: bool, seed: int):
    """(scorer, settings) of one model; a scorer of NaN where the rows have fewer than two detections or nothing else."""
    n1 = int(train["presence"].sum())
    if learner is None:
        return small_fit(train, bands, ridge, pairs, fold), {"ridge": ridge}
    settings = settings or (learner.at_null if null else learner.default)(n1, len(bands))
    return (learner.fit(train, bands, settings, seed) if 2 <= n1 < len(train) else nothing), settings


def _apart(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows dealt by group to many partitions of a fixed number: adaptive execution joins small partitions, and a task would fit many groups' models one after another."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism), *by)


def _no_rows(columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _at_effort(rows: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
    """Rows with the effort of the group's median detection, at which scores are read."""
    if "effort" not in rows:
        return rows
    level = group.loc[group["presence"] == 1, "effort"].median()
    return rows.assign(effort=0.0 if pd.isna(level) else level)


def _held_scores(
    training: DataFrame, bands: list[str], by: list[str], ridge: float = RIDGE, pairs: bool = False, fold: str = "fold", learner: Learner | None = None,
    chosen: DataFrame | None = None, null: bool = False, seed: int = 1,
) -> DataFrame:
    carried = [c for c in _CARRIED if c in training.columns and c not in bands]
    own = ["kept"] if "kept" in training.columns else []
    folds = training.select(*by, F.col(fold).alias("held")).distinct()
    folds = folds.withColumn("settings", F.lit(None).cast("string")) if chosen is None else folds.join(chosen.select(*by, "held", "settings"), [*by, "held"], "left")
    rows = training.select(*by, "site", "presence", fold, *bands, *carried, *own).join(folds, by)
    kinds = dict(training.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("site", kind="stable")
        test, train = pdf[pdf[fold] == pdf["held"]], pdf[pdf[fold] != pdf["held"]]
        used = list(pdf["kept"].iloc[0]) if own else bands
        given = pdf["settings"].iloc[0]
        score, settings = _fitted(train, used, learner, json.loads(given) if given else None, ridge, pairs, fold, null, seed)
        return test[[*by, fold, "site", "presence"]].assign(score=score(_at_effort(test, pdf)), params=label_of(settings))

    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], f"{fold} {kinds[fold]}", f"site {kinds['site']}", "presence int", "score double", "params string"])
    return rows.groupBy(*by, "held").applyInPandas(run, schema)


def cross_validated_scores(training: DataFrame, bands: list[str], by: list[str], **how) -> DataFrame:
    """MOD8, MOD11: held-out scores of every row, each fold fitted on the others: (by..., fold, site, presence, score).

    ``how``: ridge and pairs (the ridge model and its ensemble of pairs), or ``learner``; ``chosen`` gives settings by group and held
    fold, ``null`` takes those of the null test.  One grouped-map job over (group, held fold): the rows of the other folds are copied to each
    held fold, so a task holds one model's rows.  A column ``kept`` names each group's own bands.  Scores are read at the median
    effort of the group's detections.
    """
    return _held_scores(training, bands, by, **how).drop("params")


def cross_validate(training: DataFrame, bands: list[str], by: list[str], min_presences: int = 2, **how) -> DataFrame:
    """MOD11: per group the mean over folds of AUC and Boyce, folds with too few detections apart, and how many were scored."""
    held = cut(cross_validated_scores(training, bands, by, **how))
    enough = held.groupBy(*by, "fold").agg(F.count_if(F.col("presence") == 1).alias("n1")).where(F.col("n1") >= min_presences).drop("n1")
    held = held.join(enough, [*by, "fold"])
    a, b = auc(held, [*by, "fold"], few=True), boyce(held, [*by, "fold"])
    return a.join(b, [*by, "fold"], "left").groupBy(*by).agg(F.avg("auc").alias("auc"), F.avg("boyce").alias("boyce"), F.count("auc").alias("folds_scored"))


def nested_cross_validate(training: DataFrame, bands: list[str], by: list[str], learner: Learner, block_km: float = BLOCK_KM, inner_folds: int = INNER_FOLDS, seed: int = 1) -> DataFrame:
    """MOD11: every fold scored by a model whose settings were chosen without it: by..., fold, presences, auc, boyce, params.

    The rows beyond each outer fold are dealt to inner folds of their own (rows of one table, seed plus fold), the settings are
    chosen there, and the outer fit takes them.  A fold with fewer than one detection or three other rows has no score.
    """
    outer = training.select(*by, F.col("fold").alias("held")).distinct()
    rows = training.drop("block").join(outer, by).where("fold <> held").drop("fold")
    inner = spatial_folds(rows, inner_folds, block_km, F.lit(seed) + F.col("held"), tuple([*by, "held"]))
    chosen = cut(tuned_settings(inner, bands, [*by, "held"], learner, seed))
    held = cut(_held_scores(training, bands, by, learner=learner, chosen=chosen, seed=seed))
    n1, n0 = F.count_if(F.col("presence") == 1), F.count_if(F.col("presence") == 0)
    folds = held.groupBy(*by, "fold").agg(n1.alias("presences"), n0.alias("n0"), F.first("params").alias("params"))
    fine = held.join(folds.where("presences >= 1 and n0 >= 3").select(*by, "fold"), [*by, "fold"], "left_semi")
    a, b = auc(fine, [*by, "fold"], few=True), boyce(fine, [*by, "fold"])
    return folds.drop("n0").join(a, [*by, "fold"], "left").join(b, [*by, "fold"], "left").select(*by, "fold", "presences", "auc", "boyce", "params")


def tuned_settings(training: DataFrame, bands: list[str], by: list[str], learner: Learner, seed: int = 1) -> DataFrame:
    """MOD12: each group's settings of the best mean blocked area, the earlier on ties: by..., settings (JSON), auc; no row where none can be scored.

    A group of the job is one candidate and held fold of one group of the table; where the learner searches over all folds at once, one candidate.
    Groups are dealt apart, so that their fits run beside each other.
    """
    carried = [c for c in _CARRIED if c in training.columns and c not in bands]
    own = ["kept"] if "kept" in training.columns else []
    most = max(len(learner.grid(1 << 30, p)) for p in range(1, len(bands) + 1))
    kinds = dict(training.dtypes)
    each = learner.search is None
    held = ["_held"] if each else []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("site", kind="stable")
        used, y, fold = (list(pdf["kept"].iloc[0]) if own else bands), pdf["presence"].to_numpy(float), pdf["fold"].to_numpy()
        grid, k = learner.grid(int(y.sum()), len(used)), int(pdf["_k"].iloc[0])
        found = None
        if k < len(grid) and not each:
            found = learner.search(_at_effort(pdf, pdf) if "effort" not in used else pdf, used, fold, grid[k], seed)
        elif k < len(grid):
            out = fold == pdf["_held"].iloc[0]
            if y[~out].sum() >= 2 and y[out].sum() >= 1 and (~y[out].astype(bool)).sum() >= 3:
                found = area(learner.fit(pdf[~out], used, grid[k], seed)(_at_effort(pdf[out], pdf)), y[out]), grid[k]
        if found is None or not np.isfinite(found[0]):
            return _no_rows([*by, "_k", *held, "auc", "settings"])
        return pd.DataFrame([(*[pdf[b].iloc[0] for b in [*by, "_k", *held]], found[0], json.dumps(found[1]))], columns=[*by, "_k", *held, "auc", "settings"])

    rows = training.select(*by, "site", "presence", "fold", *bands, *carried, *own).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], "_k int", *[f"{h} {kinds['fold']}" for h in held], "auc double", "settings string"])
    if each:
        rows = rows.join(training.select(*by, F.col("fold").alias("_held")).distinct(), by)
    tried = _apart(rows, [*by, "_k", *held]).groupBy(*by, "_k", *held).applyInPandas(run, schema)
    if each:  # summed in the folds' order, so that equal candidates stay equal
        areas = F.array_sort(F.collect_list(F.struct("_held", "auc")))
        mean = F.aggregate(areas, F.lit(0.0), lambda total, a: total + a["auc"]) / F.count("*")
        tried = tried.groupBy(*by, "_k").agg(mean.alias("auc"), F.first("settings").alias("settings"))
    return tried.groupBy(*by).agg(F.max_by(F.struct("settings", "auc"), F.struct("auc", -F.col("_k"))).alias("b")).select(*by, "b.settings", "b.auc")


def pooled_boyce(held: DataFrame, by: list[str]) -> DataFrame:
    """MOD11: one Boyce index over all held-out scores of a group."""
    return boyce(held, by)


def tune(training: DataFrame, bands: list[str], by: list[str], ridges: list[float] | None = None, learners: dict[str, Learner] | None = None) -> DataFrame:
    """MOD12: per group the candidate with the best mean blocked AUC, the first on ties.

    Candidates are penalties of the ridge model (column ``ridge``) or whole learners at their untuned settings (``candidate``);
    ``tuned_settings`` searches one learner's grid.
    """
    tried = [(r, {"ridge": r}) for r in map(float, ridges or [])] if learners is None else [(name, {"learner": m}) for name, m in learners.items()]
    what, out = "ridge" if learners is None else "candidate", None
    for k, (name, how) in enumerate(tried):
        one = cut(cross_validate(training, bands, by, **how)).select(*by, F.lit(k).alias("_k"), F.lit(name).alias(what), "auc")
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*by).agg(F.max_by(F.struct(what, "auc"), F.struct("auc", -F.col("_k"))).alias("b")).select(*by, f"b.{what}", "b.auc")


def fit_small_ensemble(training: DataFrame, bands: list[str], by: list[str] | None = None, ridge: float = RIDGE) -> DataFrame:
    """MOD8: held-out scores of the ensemble of small models over at most ten predictors."""
    return cross_validated_scores(training, bands[:10], by or ["taxon"], ridge=ridge, pairs=True)


# ---- baselines, nulls, importance, applicability ------------------------------------


def _kernel_sums(key: str, h: float, reach: float):
    """Per query row of a square the squared distance to its nearest detection within reach and its kernels' sum, relative to that one."""

    def run(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        x, y, u, v = (c.to_numpy(dtype=float) for c in (queries["x"], queries["y"], found["x"], found["y"]))
        near, total = np.full(len(x), np.inf), np.zeros(len(x))
        step = max(1, KERNEL_CELLS // max(1, len(u)))
        for k in range(0, len(x) if len(u) else 0, step):
            at = slice(k, k + step)
            d2 = (x[at, None] - u) ** 2 + (y[at, None] - v) ** 2
            d2[~(d2 <= reach * reach)] = np.inf
            near[at] = d2.min(axis=1)
            met = np.isfinite(near[at])
            total[at][met] = np.exp((near[at][met, None] - d2[met]) / (2 * h * h)).sum(axis=1)
        return queries.drop(columns=["x", "y", "_i", "_j", "_a", "_b"]).assign(near=near, total=total)[np.isfinite(near)]

    return run


def _dealt(left: DataFrame, found: DataFrame, reach: float, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Query rows by square and detections by square within reach; a full square is dealt to parts of both sides, every part of one meets every part of the other."""
    names = [*by, "_i", "_j"]
    q, d = squares(left, "x", "y", reach, False).where("_i is not null and _j is not null"), squares(found, "x", "y", reach, True)
    parts = lambda df, most, out: df.groupBy(*names).agg(F.ceil(F.count("*") / most).cast("int").alias(out))
    dealt = parts(q, KERNEL_ROWS, "_na").join(parts(d, KERNEL_ROWS, "_nb"), names)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.withColumn("_at", F.monotonically_increasing_id()).join(dealt, names)
    d = d.withColumn("_at", F.monotonically_increasing_id()).join(dealt, names)
    part = lambda n: F.pmod(F.xxhash64("_at"), F.col(n)).cast("int")
    q = q.withColumn("_a", part("_na")).withColumn("_b", each("_nb")).drop("_at", "_na", "_nb")
    d = d.withColumn("_b", part("_nb")).withColumn("_a", each("_na")).drop("_at", "_na", "_nb")
    # both sides may come from one table; new columns keep them apart
    return tuple(df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (q, d))


def kernel_scores(queries: DataFrame, detections: DataFrame, bandwidth_km: float, by: list[str], key: str = "site") -> DataFrame:
    """MOD10: log sum of Gaussian kernels over a group's detections, shifted by the nearest one, so that far sites never tie.

    Rings of squares, each twice as wide: a row is settled once all detections that could add 1e-10 of its sum (squared
    distance up to 46 squared bandwidths beyond the nearest) lie within the ring.  Null in a group without detections.
    Rows and detections of a square meet in a task as arrays, and only sums by row leave it: no pairs are stored.
    """
    h = bandwidth_km * 1000.0
    left, out, reach = cut(queries.select(*by, key, "x", "y")), None, 10 * h
    found = cut(detections.select(*by, "x", "y"))
    names = [*by, "_i", "_j", "_a", "_b"]
    schema = StructType([*[left.schema[c] for c in (*by, key)], StructField("near", DoubleType()), StructField("total", DoubleType())])
    for _ in range(40):
        q, d = _dealt(left, found, reach, by)
        sums = cut(q.groupBy(*names).cogroup(d.groupBy(*names)).applyInPandas(_kernel_sums(key, h, reach), schema))
        near = sums.groupBy(*by, key).agg(F.min("near").alias("least"))
        settled = near.where(F.col("least") + 46 * h * h <= reach * reach) if reach < 4e7 else near
        total = F.sum(F.col("total") * F.exp((F.col("least") - F.col("near")) / (2 * h * h)))
        one = sums.join(settled, [*by, key]).groupBy(*by, key).agg((F.log(total) - F.first("least") / (2 * h * h)).alias("score"))
        one = cut(one)
        out = one if out is None else out.unionByName(one)
        left = cut(left.join(one, [*by, key], "left_anti"))
        if left.isEmpty() or reach >= 4e7:
            break
        reach *= 2
    return queries.join(out, [*by, key], "left")


def choose_bandwidth(training: DataFrame, bandwidths: list[float], by: list[str]) -> DataFrame:
    """MOD10: the bandwidth with the best blocked AUC, the smaller on ties."""
    folds = training.select(*by, F.col("fold").alias("held")).distinct()
    train = training.where("presence = 1").join(folds, by).where("fold <> held").select(*by, F.col("held").alias("fold"), "x", "y")
    out = None
    for h in bandwidths:
        scored = cut(kernel_scores(training, train, h, [*by, "fold"]))
        one = auc(scored, [*by, "fold"]).groupBy(*by).agg(F.avg("auc").alias("auc")).withColumn("bandwidth_km", F.lit(float(h)))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*by).agg(F.max_by("bandwidth_km", F.struct("auc", -F.col("bandwidth_km"))).alias("bandwidth_km"), F.max("auc").alias("auc"))


def null_tables(training: DataFrame, draws: int, design: str = "scatter", seed: int = 1, first: int = 1) -> DataFrame:
    """MOD13: the training table with null detections for each draw from the first on, scattered by records or shifted as a cluster.

    design: scatter, shift, or shift-effort (shifted points choose among near sites by records).  Shifted tables also tell the share of points that
    landed far from a site and whether every try was rejected (far_share, best_effort).
    """
    reps = training.withColumn("draw", F.explode(F.sequence(F.lit(first), F.lit(first + draws - 1))))
    if design == "scatter":
        e = -F.log(unit_hash(F.lit(seed), F.col("draw"), F.col("taxon"), F.col("site"))) / F.greatest(F.col("records").cast("double"), F.lit(1.0))
        w = Window.partitionBy("taxon", "draw").orderBy("_e", "site")
        n = F.count_if(F.col("presence") == 1).over(Window.partitionBy("taxon", "draw"))  # of the draw's own copy: no join draws a taxon's rows to one task
        drawn = reps.withColumn("_e", e).withColumns({"_k": F.row_number().over(w), "_n": n}).where("_n > 0")
        return drawn.withColumn("presence", (F.col("_k") <= F.col("_n")).cast("int")).drop("_e", "_k", "_n")
    found = training.where("presence = 1").select("taxon", "site", "x", "y")
    if design not in ("shift", "shift-effort"):
        raise ValueError(f"unknown null design {design!r}")
    busy = [c for c in ("records",) if c in training.columns]
    sites = training.groupBy("taxon", "site").agg(*[F.first(c).alias(c) for c in ("x", "y", *busy)])
    picked = shifted_null(found, sites, draws, seed, effort=design == "shift-effort", first_draw=first)
    picked = cut(picked.select("taxon", "draw", "site", "far", "best_effort"))
    told = picked.groupBy("taxon", "draw").agg(F.avg(F.col("far").cast("double")).alias("far_share"), F.first("best_effort").alias("best_effort"))
    rows = reps.join(picked.select("taxon", "draw", "site", F.lit(1).alias("_p")), ["taxon", "draw", "site"], "left").withColumn("presence", F.coalesce("_p", F.lit(0))).drop("_p")
    return rows.join(told, ["taxon", "draw"], "left")


def null_test(
    training: DataFrame, bands: list[str], draws: int = NULLS, design: str = "scatter", stop_after: int = STOP_AFTER, seed: int = 1, batch: int = DRAW_BATCH, **how
) -> DataFrame:
    """MOD13: per taxon the observed score, its nulls' mean and spread, and the sequential p-value.

    Draws come in batches, each twice as large as the one before; all draws of a batch and all open taxa are groups of one job.  A taxon is open until
    ``stop_after`` of its nulls score as well as it does, or ``draws`` are scored, and gets no further draws afterwards.  A batch is no larger than what the
    open taxa still need, but ``batch`` draws where that is less.  A draw is scored in one task, which gives a row.  Nulls that cannot be
    scored are replaced, up to twice the draws.  Everything is read off the draws in order up to the stop, so the batches decide only how many
    are fitted in vain.  Columns: observed, boyce, auc_mean, auc_sd, reps, p, draws, boyce_mean, stopped_early, drawn, far_share, best_effort, design.
    """
    observed = cut(cross_validate(training, bands, ["taxon"], null=True, **how).select("taxon", F.col("auc").alias("observed"), "boyce"))
    still = cut(observed.where("observed is not null"))
    rows, drawn, size, parts = training, 0, batch, []
    needed = draws
    while drawn < 2 * draws:
        take = min(size, 2 * draws - drawn, max(needed, batch))
        rows = rows.join(still.select("taxon"), "taxon", "left_semi")
        parts.append(cut(_null_scores(null_tables(rows, take, design, seed, drawn + 1), bands, **how)))
        drawn, size = drawn + take, 2 * size
        met = _until_stop(_all_of(parts), observed, draws, stop_after)
        still = cut(met.groupBy("taxon").agg(F.count("null_score").alias("n"), F.max("_above").alias("above")).where((F.col("n") < draws) & (F.col("above") < stop_after)))
        least = still.agg(F.min("n").alias("n")).first()["n"]
        if least is None:
            break
        needed = draws - least
    out = observed.where("observed is null").select("taxon", "observed", "boyce")
    if not parts:
        return out.withColumns({"auc_mean": F.lit(None).cast("double"), "auc_sd": F.lit(None).cast("double"), "reps": F.lit(0).cast("long"), "p": F.lit(None).cast("double"), "draws": F.lit(0).cast("long"), "design": F.lit(design)})
    met = cut(_until_stop(_all_of(parts), observed, draws, stop_after))
    scored = F.col("null_score").isNotNull()
    spread = met.groupBy("taxon").agg(
        F.avg("null_score").alias("auc_mean"), F.stddev_samp("null_score").alias("auc_sd"), F.count("null_score").alias("reps"),
        F.avg(F.when(scored, F.col("null_boyce"))).alias("boyce_mean"), (F.max("_above") >= stop_after).alias("stopped_early"), F.max("draw").alias("drawn"),
        *([F.avg("far_share").alias("far_share"), F.count_if("best_effort").alias("best_effort")] if "far_share" in met.columns else []),
    )
    p = sequential_p(met.select("taxon", "draw", "null_score", "observed"), ["taxon"], stop_after)
    return observed.join(spread, "taxon", "left").na.fill(0, ["reps"]).join(p, "taxon", "left").withColumn("design", F.lit(design))


def _null_scores(tables: DataFrame, bands: list[str], ridge: float = RIDGE, pairs: bool = False, learner: Learner | None = None, seed: int = 1) -> DataFrame:
    """Of each taxon and draw the mean area of its folds and the pooled Boyce index: (taxon, draw, null_score, null_boyce), with ``far_share`` and ``best_effort`` where told.

    Same models and scores as ``cross_validated_scores``; all folds of a draw are fitted in the task that its rows came to, so they are neither copied to
    the folds nor written.
    """
    carried = [c for c in _CARRIED if c in tables.columns and c not in bands]
    own = ["kept"] if "kept" in tables.columns else []
    placed = [c for c in ("far_share", "best_effort") if c in tables.columns]
    kinds = dict(tables.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("site", kind="stable")
        used, fold, y = (list(pdf["kept"].iloc[0]) if own else bands), pdf["fold"].to_numpy(), pdf["presence"].to_numpy(float)
        score, areas = np.full(len(pdf), np.nan), []
        at = _at_effort(pdf, pdf)
        for f in np.unique(fold):
            out = fold == f
            score[out] = _fitted(pdf[~out], used, learner, None, ridge, pairs, "fold", True, seed)[0](at[out])
            known = out & ~np.isnan(score)
            areas.append(area(score[known], y[known]) if y[out].sum() >= 2 and known.any() else np.nan)
        found = {"null_score": np.nanmean(areas) if np.isfinite(areas).any() else None, "null_boyce": boyce_index(score, y)}
        return pd.DataFrame({"taxon": [pdf["taxon"].iloc[0]], "draw": [pdf["draw"].iloc[0]], **{k: pd.Series([v], dtype=object) for k, v in found.items()}, **{c: [pdf[c].iloc[0]] for c in placed}})

    schema = ", ".join([f"taxon {kinds['taxon']}, draw {kinds['draw']}, null_score double, null_boyce double", *[f"{c} {kinds[c]}" for c in placed]])
    rows = tables.select("taxon", "draw", "site", "presence", "fold", *bands, *carried, *own, *placed)
    return rows.groupBy("taxon", "draw").applyInPandas(run, schema)


def _all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


def _until_stop(nulls: DataFrame, observed: DataFrame, draws: int, stop_after: int) -> DataFrame:
    """The draws of each taxon in order, up to the one that stops its test, and how many scored ones so far are as good (_above)."""
    w = Window.partitionBy("taxon").orderBy("draw")
    met = nulls.join(observed.select("taxon", "observed"), "taxon").withColumn("_hit", F.coalesce((F.col("null_score") >= F.col("observed")).cast("int"), F.lit(0)))
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    before = met.withColumns({"_above0": F.coalesce(F.sum("_hit").over(so_far), F.lit(0)), "_n0": F.coalesce(F.count("null_score").over(so_far), F.lit(0))})
    return before.where((F.col("_above0") < stop_after) & (F.col("_n0") < draws)).withColumn("_above", F.col("_above0") + F.col("_hit")).drop("_above0", "_n0", "_hit")


def permutation_importance(training: DataFrame, bands: list[str], by: list[str], repeats: int = 5, seed: int = 1, groups: dict[str, list[str]] | None = None, ridge: float = RIDGE, learner: Learner | None = None) -> DataFrame:
    """MOD14: mean fall of the held-out AUC when a predictor, or all of a layer, is shuffled among a fold's rows.

    Every fold is fitted once and scores its rows as they are and under each shuffle, in one task; ``learner`` as in ``cross_validated_scores``.
    """
    shuffled = {**{f"predictor:{b}": [b] for b in bands}, **{f"layer:{g}": m for g, m in (groups or {}).items()}}
    carried = [c for c in _CARRIED if c in training.columns and c not in bands]
    folds = training.select(*by, F.col("fold").alias("held")).distinct()
    rows = training.select(*by, "site", "presence", "fold", *bands, *carried).join(folds, by)
    kinds = dict(training.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("site", kind="stable")
        test, train = _at_effort(pdf[pdf["fold"] == pdf["held"]], pdf), pdf[pdf["fold"] != pdf["held"]]
        y, scores = test["presence"].to_numpy(float), _fitted(train, bands, learner, None, ridge, False, "fold", False, seed)[0]
        base, rng, out = area(scores(test), y), np.random.default_rng(seed), []
        if np.isnan(base):
            return _no_rows([*by, "name", "fall"])
        for name, columns in shuffled.items():
            falls = []
            for _ in range(repeats):
                changed = test.copy()
                changed[columns] = test[columns].to_numpy()[rng.permutation(len(test))]
                falls.append(base - area(scores(changed), y))
            out.append((*[pdf[b].iloc[0] for b in by], name, float(np.mean(falls))))
        return pd.DataFrame(out, columns=[*by, "name", "fall"])

    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], "name string", "fall double"])
    return rows.groupBy(*by, "held").applyInPandas(run, schema).groupBy(*by, "name").agg(F.avg("fall").alias("fall"))


def applicability_weights(falls: DataFrame, bands: list[str]) -> DataFrame:
    """MOD14: each taxon's weights of its predictors (taxon, w_<band>...): the mean fall, never below 0; all equal where none is above."""
    fall = {b: F.greatest(F.coalesce(F.avg(F.when(F.col("name") == f"predictor:{b}", F.col("fall"))), F.lit(0.0)), F.lit(0.0)).alias(f"w_{b}") for b in bands}
    rows = falls.groupBy("taxon").agg(*fall.values())
    some = sum((F.col(f"w_{b}") for b in bands), F.lit(0.0)) > 0
    return rows.select("taxon", *[F.when(some, F.col(f"w_{b}")).otherwise(1.0).alias(f"w_{b}") for b in bands])


def _pair_means(rows: DataFrame, bands: list[str]) -> DataFrame:
    """Mean distance of all pairs of a taxon's whole rows: (taxon, mean); 1 where no two differ.  rows: taxon, site, the bands, and the taxon's number of parts.

    Any two parts of a taxon meet in a task, as arrays; only their sum leaves it.  Sums are added in the order of the parts.
    """
    part, other = F.pmod(F.xxhash64("site"), F.col("_parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    met = rows.dropna(subset=bands).withColumn("_part", part).withColumn("_other", other).drop("_parts")
    met = met.withColumns({"_i": F.least("_part", "_other"), "_j": F.greatest("_part", "_other")}).drop("_other")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("site", kind="stable")
        i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        a, b = (np.asfortranarray(pdf.loc[pdf["_part"] == k, bands].to_numpy(float)) for k in (i, j))
        total, step = 0.0, max(1, PAIR_CELLS // max(1, len(b)))
        room = np.empty((2, step, len(b)))
        for k in range(0, len(a), step):
            d2, apart = room[:, : len(a) - k]
            d2[:] = 0.0
            for c in range(len(bands)):
                np.subtract(a[k : k + step, c, None], b[:, c], out=apart)
                d2 += np.square(apart, out=apart)
            total += float(np.sqrt(d2, out=d2).sum())
        total, n = (total / 2, len(a) * (len(a) - 1) // 2) if i == j else (total, len(a) * len(b))
        return pd.DataFrame({"taxon": [pdf["taxon"].iloc[0]], "_i": [i], "_j": [j], "total": [total], "n": [n]})

    key = ["taxon", "_i", "_j"]
    sums = _apart(met, key).groupBy(*key).applyInPandas(run, f"taxon {dict(rows.dtypes)['taxon']}, _i int, _j int, total double, n long")
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_j", "total")))
    whole = sums.groupBy("taxon").agg(F.aggregate(ordered, F.lit(0.0), lambda t, s: t + s["total"]).alias("total"), F.sum("n").alias("n"))
    return whole.select("taxon", F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(1.0).alias("mean"))


def applicability(training: DataFrame, cells: DataFrame, bands: list[str], weights: DataFrame | None = None) -> DataFrame:
    """MOD15: every taxon's area of applicability in one plan: the cells' (taxon, cell, bands) columns with ``index``, ``inside`` and the taxon's ``threshold``.

    training: taxon, site, fold and the bands; weights: ``applicability_weights`` (equal where left out).  Distances are in weighted standard
    deviations, over the mean distance of all pairs of training sites; the threshold is the upper whisker of the index of every site against the other
    folds' (Tukey hinges).  Cells with a null band have no index.
    """
    parts = F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("_parts")
    stats = training.groupBy("taxon").agg(parts, *[e for b in bands for e in (F.avg(b).alias(f"m_{b}"), F.stddev_samp(b).alias(f"s_{b}"))])
    stats = stats.join(weights, "taxon", "left") if weights is not None else stats.withColumns({f"w_{b}": F.lit(1.0) for b in bands})
    spread = lambda b: F.when(F.col(f"s_{b}") > 0, F.col(f"s_{b}")).otherwise(1.0)
    stats = cut(stats.select("taxon", "_parts", *[c for b in bands for c in (f"m_{b}", (F.coalesce(F.col(f"w_{b}"), F.lit(1.0)) / spread(b)).alias(f"k_{b}"))]))
    scaled = lambda df, *more: df.join(stats, "taxon").withColumns({b: (F.col(b) - F.col(f"m_{b}")) * F.col(f"k_{b}") for b in bands}).select(*df.columns, *more)
    train = cut(scaled(training.select("taxon", "site", "fold", *bands), "_parts"))
    mean = cut(_pair_means(train.select("taxon", "site", "_parts", *bands), bands))
    train = train.drop("_parts")
    held = train.select("taxon", F.col("fold").alias("held")).distinct()
    others = train.join(held, "taxon").where("fold <> held").select("taxon", F.col("held").alias("fold"), *bands)
    cv = nearest_in_space(train.withColumnRenamed("site", "q"), others, bands, by=["taxon", "fold"])
    index = cut(cv.where("distance is not null").join(mean, "taxon").select("taxon", (F.col("distance") / F.col("mean")).alias("i")))
    n, k = F.count("*").over(Window.partitionBy("taxon")), F.row_number().over(Window.partitionBy("taxon").orderBy("i"))
    order = index.withColumns({"n": n, "k": k})
    half = F.expr("(n + 1) div 2")
    hinge = order.groupBy("taxon").agg(F.percentile(F.when(F.col("k") <= half, F.col("i")), 0.5).alias("q1"), F.percentile(F.when(F.col("k") > F.col("n") - half, F.col("i")), 0.5).alias("q3"))
    whisker = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    threshold = index.join(hinge, "taxon").where(F.col("i") <= whisker).groupBy("taxon").agg(F.max("i").alias("threshold"))
    found = nearest_in_space(scaled(cells.select("taxon", "cell", *bands)).withColumnRenamed("cell", "q"), train, bands, by=["taxon"])
    found = found.join(mean, "taxon").select("taxon", F.col("q").alias("cell"), (F.col("distance") / F.col("mean")).alias("index"))
    out = cells.join(found, ["taxon", "cell"], "left").join(threshold, "taxon", "left")
    return out.withColumn("inside", F.col("index") <= F.col("threshold"))


# ---- studies ------------------------------------------------------------------------


def run_arms(training: DataFrame, arms: dict[str, dict]) -> DataFrame:
    """MOD16: many arms over the same rows: one row per taxon and arm.

    An arm: bands, ridge, pairs, learner, design; ``layers`` leaves out bands of other layers (a band's layer is its name up to the first ``_``);
    ``per_presence`` prunes each taxon's bands, one for so many detections at most (0: as many as stay uncorrelated); ``block_km`` deals folds of its own.
    """
    out = None
    for name, arm in arms.items():
        bands = [b for b in arm["bands"] if "layers" not in arm or b.split("_")[0] in arm["layers"]]
        rows = design_rows(training, arm.get("design", "sites"))
        if "block_km" in arm:
            rows = spatial_folds(rows.drop("block", "fold"), FOLDS, arm["block_km"])
        if "per_presence" in arm:
            rows = rows.drop("kept").join(cut(prune_by_taxon(rows, bands, per_presence=arm["per_presence"])), "taxon")
        arm = {**arm, "bands": bands}
        one = cross_validate(rows, arm["bands"], ["taxon"], **{k: v for k, v in arm.items() if k in ("ridge", "pairs", "learner")})
        one = cut(one.select("taxon", F.lit(name).alias("arm"), "auc", "boyce", "folds_scored"))
        out = one if out is None else out.unionByName(one)
    return out


def block_study(training: DataFrame, area: DataFrame, bands: list[str], sizes: tuple[float, ...] = (50, 100, 200, 300), near_km: float = 100, min_blocks: int = 5, **how) -> DataFrame:
    """MOD16: every taxon under folds of several block sizes: (taxon, block_km, blocks, scorable, gap_all, gap_near, auc, boyce, folds_scored).

    area: taxon, cell, x, y of the cells to predict.  The gaps are mean differences of the quantiles of two sets of distances (km): of held-out sites to
    the nearest other fold's, and of the area's cells to the nearest site (all, or those within ``near_km``); the best size has the smallest.
    """
    own = cut(nearest(area.select("taxon", F.col("cell").alias("q"), "x", "y"), training.select("taxon", "x", "y"), ["taxon"]).select("taxon", (F.col("distance") / 1000).alias("km"), F.lit(False).alias("side")))
    out = None
    for size in map(float, sizes):
        rows = spatial_folds(training.drop("block", "fold"), FOLDS, size)
        blocks = rows.where("presence = 1").groupBy("taxon").agg(F.count_distinct("block").alias("blocks"))
        apart = cut(held_out_distances(rows).where("distance is not null").select("taxon", (F.col("distance") / 1000).alias("km"), F.lit(True).alias("side")))
        gaps = [quantile_gap(apart.unionByName(o), ["taxon"], "km", "side").withColumnRenamed("gap", n) for o, n in ((own, "gap_all"), (own.where(F.col("km") <= near_km), "gap_near"))]
        one = blocks.join(gaps[0], "taxon", "left").join(gaps[1], "taxon", "left").join(cross_validate(rows, bands, ["taxon"], **how), "taxon", "left")
        one = cut(one.select("taxon", F.lit(size).alias("block_km"), "blocks", (F.col("blocks") >= min_blocks).alias("scorable"), "gap_all", "gap_near", "auc", "boyce", "folds_scored"))
        out = one if out is None else out.unionByName(one)
    return out


def run_study(candidates: DataFrame, training: DataFrame, arms: dict[str, dict], baseline: str, per_band: int = 10, seed: int = 1, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """MOD17: sampled taxa under every arm, without rows already there, and the paired summary: (rows, summary).

    candidates: taxon, cells.
    """
    sample = sweep_sample(candidates, per_band, seed).select("taxon", F.col("stratum").alias("band"))
    todo = sample if done is None else sample.join(done.select("taxon").distinct(), "taxon", "left_anti")
    rows = run_arms(training.join(todo.select("taxon"), "taxon", "left_semi"), arms).join(sample, "taxon")
    rows = rows if done is None else rows.unionByName(done.select(*rows.columns))
    return rows, paired_arms(rows, baseline)


def read_rates(rates: DataFrame, limit: float = 0.05, least: float = 0.20) -> DataFrame:
    """MOD18: decisions over rate tables: false passes whose interval is above the limit, power below the least (rates: kind, passed, n)."""
    r = pass_rates(rates, ["kind", "band"])
    decision = F.when((F.col("kind") == "null") & (F.col("low") > limit), "too many false passes").when((F.col("kind") != "null") & (F.col("rate") < least), "too little power").otherwise("as wanted")
    return r.withColumn("decision", decision)


def pass_model(rows: DataFrame, terms: list[str]) -> DataFrame:
    """MOD18: binomial regression of passing on the terms: (term, coefficient), the intercept among them."""
    glr = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_f", labelCol="passed", regParam=1e-6)
    m = glr.fit(VectorAssembler(inputCols=terms, outputCol="_f", handleInvalid="skip").transform(rows.withColumn("passed", F.col("passed").cast("double"))))
    return rows.sparkSession.createDataFrame([("intercept", float(m.intercept)), *zip(terms, map(float, m.coefficients), strict=True)], "term string, coefficient double")


def settings_hash(**settings) -> Column:
    """MOD19: one hash of a fit's settings."""
    return F.sha2(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted(settings.items())])), 256)


def fit_taxa(training: DataFrame, bands: list[str], low: int = 20, draws: int = 19, design: str = "scatter", min_blocks: int = 5, block_km: float = BLOCK_KM, seed: int = 1, prune: bool = True, learner: Learner | None = None) -> DataFrame:
    """MOD19: every taxon through pruning, folds, cross-validation, nulls and grading: one row per taxon, refusals with a reason.

    training: taxon, site, presence, x, y, records and the bands.  Too few detections or blocks refuse a taxon; a model that cannot
    be scored has failed.  ``kept`` are the bands that each taxon's model uses; ``final_models`` takes them from there.
    """
    folded = spatial_folds(training, FOLDS, block_km, seed)
    found = folded.where("presence = 1").groupBy("taxon").agg(F.count("*").alias("presences"), F.count_distinct("block").alias("blocks"))
    kept = prune_by_taxon(folded, bands) if prune else training.select("taxon", F.array(*map(F.lit, bands)).alias("kept")).distinct()
    gate = F.when(F.col("presences") < low, "too few sites").when(F.col("blocks") < min_blocks, "too few blocks")
    taxa = training.select("taxon").distinct().join(found, "taxon", "left").na.fill(0, ["presences", "blocks"]).join(kept, "taxon", "left")
    taxa = cut(taxa.withColumn("reason", gate))
    fit = folded.join(taxa.where("reason is null").select("taxon", "kept"), "taxon")
    tested = null_test(fit, bands, draws, design, seed=seed, learner=learner)
    out = taxa.join(tested, "taxon", "left")
    status = F.when(F.col("reason").isNotNull(), "refused").when(F.col("observed").isNull(), "failed").otherwise("fitted")
    out = out.withColumn("status", status).withColumn("skill", F.when(F.col("status") == "fitted", skill(F.col("p"), F.col("reps"), F.col("boyce"))))
    grade = F.when(F.col("status") == "fitted", map_grade(F.col("skill"), F.col("design"), F.col("observed"), F.col("boyce")))
    tier = F.when(F.col("status") == "fitted", tier_of(F.col("p"), F.col("reps"), F.col("observed"), F.col("boyce"), F.col("design")))
    return out.withColumns({"grade": grade, "tier": tier, "settings": settings_hash(draws=draws, design=design, block_km=block_km, seed=seed)})


def final_models(training: DataFrame, taxa: DataFrame, bands: list[str]) -> DataFrame:
    """MOD19: the ridge model of every taxon on all its rows: (taxon, bands, mean, sd, low, high, beta).

    taxa: taxon, kept and ridge (``tune``; the default where null).  One grouped-map job; a task holds a taxon's sites.  Taxa
    without both classes or bands have no model.
    """
    rows = training.select("taxon", "site", "presence", *bands).join(taxa.select("taxon", "kept", F.coalesce("ridge", F.lit(RIDGE)).alias("ridge")), "taxon")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("site")
        y, used = pdf["presence"].to_numpy(float), list(pdf["kept"].iloc[0])
        if y.sum() in (0, len(y)) or not used:
            return _no_rows(["taxon", "bands", "mean", "sd", "low", "high", "beta"])
        x = pdf[used].to_numpy(float)
        mean, sd = scale_of(x)
        z = (x - mean) / sd
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
        beta = ridge_logistic(design(z, True), y, w, pdf["ridge"].iloc[0])
        return pd.DataFrame([(pdf["taxon"].iloc[0], used, mean, sd, z.min(axis=0), z.max(axis=0), beta)], columns=["taxon", "bands", "mean", "sd", "low", "high", "beta"])

    numbers = ", ".join(f"{c} array<double>" for c in ("mean", "sd", "low", "high", "beta"))
    return rows.groupBy("taxon").applyInPandas(run, f"taxon {dict(training.dtypes)['taxon']}, bands array<string>, {numbers}")


def map_scores(models: DataFrame, cells: DataFrame, bands: list[str]) -> DataFrame:
    """MOD19: each model's score at the cells: (taxon, cell, score); null where a band it uses is missing.

    cells: taxon, cell and the bands (the cells of the taxon's accessible area).  A join and column arithmetic: the cells stay spread.
    """
    values = F.create_map(*[v for b in bands for v in (F.lit(b), F.col(b).cast("double"))])
    met = cells.select("taxon", "cell", values.alias("_v")).join(models, "taxon")
    raw = F.transform("bands", lambda b, i: (F.element_at("_v", b) - F.get("mean", i)) / F.get("sd", i))
    z = F.transform(raw, lambda v, i: F.when(v.isNotNull(), F.least(F.get("high", i), F.greatest(F.get("low", i), v))))
    k = F.size("bands")
    term = lambda acc, i: acc + F.get("beta", i + 1) * F.get("_z", i) + F.get("beta", i + 1 + k) * F.pow(F.get("_z", i), 2)
    line = F.aggregate(F.sequence(F.lit(0), k - 1), F.get("beta", F.lit(0)), term)
    score = F.when(line.isNotNull(), 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), line)))))
    return met.withColumn("_z", z).select("taxon", "cell", score.alias("score"))


def learner_models(training: DataFrame, bands: list[str], learner: Learner, settings: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """MOD19: any learner's model of every taxon on all its rows: (taxon, model), the scorer in bytes.

    settings: taxon and settings (``tuned_settings``); the learner's own where left out.  A column ``kept`` names a taxon's bands.
    """
    carried = [c for c in _CARRIED if c in training.columns and c not in bands]
    own = ["kept"] if "kept" in training.columns else []
    rows = training.select("taxon", "site", "presence", *bands, *carried, *own)
    rows = rows.withColumn("settings", F.lit(None).cast("string")) if settings is None else rows.join(settings.select("taxon", "settings"), "taxon", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("site", kind="stable")
        used, given = (list(pdf["kept"].iloc[0]) if own else bands), pdf["settings"].iloc[0]
        score, _ = _fitted(pdf, used, learner, json.loads(given) if given else None, RIDGE, False, "fold", False, seed)
        level = pdf.loc[pdf["presence"] == 1, "effort"].median() if "effort" in pdf else 0.0
        return pd.DataFrame({"taxon": [pdf["taxon"].iloc[0]], "model": [cloudpickle.dumps((score, 0.0 if pd.isna(level) else float(level)))]})

    return rows.groupBy("taxon").applyInPandas(run, f"taxon {dict(training.dtypes)['taxon']}, model binary")


def learner_map(models: DataFrame, cells: DataFrame, bands: list[str], part_cells: int = 50_000) -> DataFrame:
    """MOD19: each taxon's model at its cells, at its detections' median effort: (taxon, cell, score); null where a band is missing.

    A taxon's cells are dealt to parts of about ``part_cells``; a task gets one part and the model.
    """
    parts = cells.groupBy("taxon").agg(F.ceil(F.count("*") / part_cells).cast("int").alias("_parts"))
    rows = cells.select("taxon", "cell", *bands).join(parts, "taxon").withColumn("part", F.pmod(F.xxhash64("cell"), F.col("_parts")).cast("int")).drop("_parts")
    sent = models.join(parts, "taxon").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select("taxon", "part", "model")
    kinds = dict(cells.dtypes)

    def run(model: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if not len(model) or not len(at):
            return _no_rows(["taxon", "cell", "score"])
        score, level = cloudpickle.loads(model["model"].iloc[0])
        whole = at[bands].notna().all(axis=1).to_numpy()
        out = np.full(len(at), np.nan)
        if whole.any():
            out[whole] = score(at[whole].assign(**({} if "effort" in bands else {"effort": level})))
        return at[["taxon", "cell"]].assign(score=pd.Series(out, index=at.index).astype(object).where(~np.isnan(out), None))

    return sent.groupBy("taxon", "part").cogroup(rows.groupBy("taxon", "part")).applyInPandas(run, f"taxon {kinds['taxon']}, cell {kinds['cell']}, score double")


def map_taxa(training: DataFrame, sites: DataFrame, taxa: DataFrame, bands: list[str], ridges: tuple[float, ...] = (RIDGE,), buffer_km: float = 500, block_km: float = BLOCK_KM, seed: int = 1, learner: Learner | None = None) -> DataFrame:
    """MOD19: tuning, final fit and map of the fitted taxa: (taxon, cell, score) over the cells of each accessible area.

    taxa: the result of ``fit_taxa``; sites: cell, x, y and the bands.  The ridge model is a join and column arithmetic; a ``learner`` is tuned
    on its grid, fitted and sent to its taxon's cells.
    """
    fitted = taxa.where("status = 'fitted'").select("taxon", "kept")
    rows = cut(training.join(fitted, "taxon"))
    reach = accessible_sites(sites.select("cell", "x", "y"), rows.where("presence = 1").select("taxon", "x", "y"), buffer_km).select("taxon", "cell")
    cells = reach.join(sites.select("cell", *bands), "cell")
    if learner is not None:
        settings = cut(tuned_settings(spatial_folds(rows, FOLDS, block_km, seed), bands, ["taxon"], learner, seed))
        return learner_map(cut(learner_models(rows, bands, learner, settings, seed)), cells, bands)
    tuned = tune(spatial_folds(rows, FOLDS, block_km, seed), bands, ["taxon"], list(ridges)) if len(ridges) > 1 else fitted.select("taxon", F.lit(float(ridges[0])).alias("ridge"))
    models = cut(final_models(rows.drop("kept"), fitted.join(tuned.select("taxon", "ridge"), "taxon", "left"), bands))
    return map_scores(models, cells, bands)
