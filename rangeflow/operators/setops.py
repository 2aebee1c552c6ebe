"""Set operations (SET1 to SET7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeflow.operators.joins import staleness


def union_distinct(*arms: DataFrame) -> DataFrame:
    """SET1: distinct rows of all arms, columns by name."""
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    return out.distinct()


def gained_lost(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """SET2: names only in the second (gained) or only in the first (lost)."""
    a, b = first.select(column).distinct(), second.select(column).distinct()
    return b.subtract(a).withColumn("change", F.lit("gained")).unionByName(a.subtract(b).withColumn("change", F.lit("lost")))


def changed_in_both(first: DataFrame, second: DataFrame, name: str, record: str) -> DataFrame:
    """SET3: names under both labellings whose sets of records differ."""
    both = first.select(name).intersect(second.select(name))
    a, b = first.select(name, record).distinct(), second.select(name, record).distinct()
    moved = a.join(b, [name, record], "left_anti").union(b.join(a, [name, record], "left_anti")).select(name).distinct()
    return both.join(moved, name, "left_semi")


def replace_rows(base: DataFrame, new: DataFrame, keys: list[str], retired: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """SET4: a snapshot with new rows in place of old ones, retired ones gone, and rows of failed refits kept with a mark."""
    kept = base.join(new.select(*keys), keys, "left_anti")
    if retired is not None:
        kept = kept.join(retired.select(*keys), keys, "left_anti")
    marked = kept.withColumn("refit_failed", F.lit(False)) if failed is None else kept.join(failed.select(*keys).distinct().withColumn("_f", F.lit(True)), keys, "left").withColumn("refit_failed", F.coalesce("_f", F.lit(False))).drop("_f")
    return marked.unionByName(new.withColumn("refit_failed", F.lit(False)))


def check_pool(shards: DataFrame, total: int, settings: str = "settings", shard: str = "shard") -> DataFrame:
    """SET5: one row on whether shard files agree on settings and cover 1..n once each."""
    present = shards.groupBy(shard).agg(F.count_distinct("file").alias("files"))
    cover = shards.sparkSession.range(1, total + 1).select(F.col("id").cast(dict(shards.dtypes)[shard]).alias(shard)).join(present, shard, "full_outer")
    return cover.agg(F.count_if(F.col("files").isNull()).alias("missing"), F.count_if(F.col("files") > 1).alias("doubled")).crossJoin(
        shards.agg((F.count_distinct(settings) <= 1).alias("agree"), F.count("*").alias("rows"))
    )


def split_agreement(train: DataFrame, expected: DataFrame, test: DataFrame, key: str = "record") -> DataFrame:
    """SET6: keys that break a split: missing or extra in training, or in both training and test."""
    t, e, s = (d.select(key).distinct() for d in (train, expected, test))
    parts = [(e.subtract(t), "missing"), (t.subtract(e), "extra"), (t.intersect(s), "leaked")]
    out = None
    for rows, why in parts:
        rows = rows.withColumn("problem", F.lit(why))
        out = rows if out is None else out.unionByName(rows)
    return out


def refit_plan(candidates: DataFrame, index: DataFrame, failed: DataFrame | None = None, touched: DataFrame | None = None, seconds: DataFrame | None = None) -> DataFrame:
    """SET7: the task list: changed and new models, and models of touched names, with reasons and expected seconds; known failures left out."""
    tasks = staleness(candidates, index, failed).select("taxon", "algorithm", "fingerprint", "settings", "sites", F.col("state").alias("reason"))
    due = tasks.where(F.col("reason").isin("new", "changed"))
    if touched is not None:
        names = touched.select("taxon", F.col("reason").alias("why"))
        more = tasks.where("reason = 'current'").join(names, "taxon").withColumn("reason", F.col("why")).drop("why")
        due = due.unionByName(more)
    if seconds is not None:
        due = due.join(seconds, "algorithm", "left")
    return due


def retired_models(candidates: DataFrame, index: DataFrame) -> DataFrame:
    """SET7: models whose taxon is no candidate any more."""
    return index.select("taxon", "algorithm").join(candidates.select("taxon", "algorithm"), ["taxon", "algorithm"], "left_anti")
