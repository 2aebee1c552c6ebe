"""Versioned snapshots: publish, promote, roll back, sync (SRC10 to SRC12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeflow.functions.scalars import rows_hash

SEPARATOR = "\x1f"


def row_hash(df: DataFrame, columns: list[str] | None = None):
    """A row's hash over its columns as text, nulls apart from empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in (columns or df.columns)]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def table_hash(df: DataFrame) -> DataFrame:
    """SRC10: one hash of a table, the same in any row order, with its row count; a few partial sums are all that is shuffled."""
    return df.select(row_hash(df).alias("_h")).agg(rows_hash(F.col("_h")).alias("hash"), F.count("*").alias("rows"))


def manifest(items: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """SRC10: path -> content hash of the published items."""
    return items.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("string").cast("binary"), 256).alias("hash"))


def publish_snapshot(df: DataFrame, path: str, release_id: str, current_hash: str | None = None) -> str | None:
    """SRC10: writes the table as a new release unless it equals the current one; returns its hash, or None when skipped."""
    new = table_hash(df).first()["hash"]
    if new == current_hash:
        return None
    df.withColumn("release_id", F.lit(release_id)).write.mode("append").partitionBy("release_id").parquet(path)
    return new


def promotion_history(promotions: DataFrame) -> DataFrame:
    """SRC11: promotions in order, each with the release it replaced."""
    order = Window.partitionBy("grid").orderBy("promoted_at", "release")
    return promotions.withColumn("replaced", F.lag("release").over(order))


def current_release(promotions: DataFrame) -> DataFrame:
    """SRC11: the release promoted last, by grid; a rollback is the promotion of an older one."""
    return promotions.groupBy("grid").agg(F.max_by("release", F.struct("promoted_at", "release")).alias("release"), F.max("promoted_at").alias("promoted_at"))


def sync_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """SRC12: what a pull does to each path: added, changed, removed, same."""
    both = local.select("path", F.col("hash").alias("local_hash")).join(remote.select("path", F.col("hash").alias("remote_hash")), "path", "full_outer")
    action = (
        F.when(F.col("local_hash").isNull(), "added").when(F.col("remote_hash").isNull(), "removed")
        .when(F.col("local_hash") != F.col("remote_hash"), "changed").otherwise("same")
    )
    return both.withColumn("action", action)
