"""Shards along a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to bins of about equal counts and walked along a Hilbert curve, so that rows near in all
dimensions lie near in the order; the order is cut in runs of equal row counts.  Files of such runs have narrow ranges in
every dimension, which lets readers skip them by any of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeflow.llm.store import Scratch

#: Bits of each dimension's bins.
BITS = 4
#: Totals of sorted partitions are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_PARTITIONS = 1 << 18


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once: a lambda over an array of one element."""
    return F.element_at(F.transform(F.array(value), lambda p: f(p)), 1)


def hilbert_index(dimensions: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a point of non-negative integers below 2^bits (Skilling's transform as columns)."""
    n = len(dimensions)
    point = F.array(*[d.cast("int") for d in dimensions])

    def untangle(q: int) -> Callable[[Column], Column]:
        def f(p: Column) -> Column:
            first, rest = p[0], [p[k] for k in range(n)]
            for k in range(n):
                on = rest[k].bitwiseAND(F.lit(q)) != 0
                swap = first.bitwiseXOR(rest[k]).bitwiseAND(F.lit(q - 1))
                turned = F.when(on, first.bitwiseXOR(F.lit(q - 1))).otherwise(first.bitwiseXOR(swap))
                if k:
                    rest[k] = F.when(on, rest[k]).otherwise(rest[k].bitwiseXOR(swap))
                first = turned
            return F.array(first, *rest[1:])

        return f

    def gray(p: Column) -> Column:
        x = [p[k] for k in range(n)]
        for k in range(1, n):
            x[k] = x[k].bitwiseXOR(x[k - 1])
        turn = F.lit(0)
        for plane in range(bits - 1, 0, -1):
            q = 1 << plane
            turn = turn.bitwiseXOR(F.when(x[n - 1].bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
        return F.array(*[v.bitwiseXOR(turn) for v in x])

    def interleave(p: Column) -> Column:
        planes = [
            F.shiftleft(F.shiftright(p[k], plane).bitwiseAND(F.lit(1)).cast("long"), plane * n + n - 1 - k) for plane in range(bits) for k in range(n)
        ]
        return reduce(lambda a, b: a + b, planes)

    for plane in range(bits - 1, 0, -1):
        point = _bind(point, untangle(1 << plane))
    return _bind(_bind(point, gray), interleave)


def _placed(ordered: DataFrame, scratch: Scratch, weight: str | None = None) -> tuple[DataFrame, int]:
    """Rows of a table sorted by ranges with ``before``, the rows (or the weight) ahead of each; and the total.

    Running numbers within each partition, on top of the partitions' totals: one small row per partition.
    """
    at = F.monotonically_increasing_id()
    parted = scratch.write(ordered.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), f"ordered_{weight or 'rows'}_{uuid.uuid4().hex[:8]}")
    parts = parted.groupBy("part").agg(F.count("*").alias("n") if weight is None else F.sum(weight).alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.write(parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"), "n"), f"parts_{uuid.uuid4().hex[:8]}")
    known = parts.agg(F.sum("n"), F.count("*")).first()
    side = F.broadcast(parts.select("part", "base")) if known[1] <= BROADCAST_PARTITIONS else parts.select("part", "base")
    own = F.col("place")
    if weight is not None:
        own = F.coalesce(F.sum(weight).over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("own", own).join(side, "part").withColumn("before", F.col("base") + F.col("own")).drop("own", "base", "place"), int(known[0] or 0)


def bins(df: DataFrame, name: str, scratch: Scratch, bits: int = BITS) -> Column:
    """Bin of a column's value, in order and of about equal counts; null is in the first bin.

    Texts are cut at the values where the running count of the sorted distinct values passes a bin's share: 2^bits values at
    most come to the driver, however many there are.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        cuts = df.select(F.percentile_approx(name, [k / (1 << bits) for k in range(1, 1 << bits)], 10_000)).first()[0] or []
        below = [F.when(F.col(name) > F.lit(c), 1).otherwise(0) for c in sorted(set(cuts))]
        return reduce(lambda a, b: a + b, below, F.lit(0))
    text = F.col(name).cast("string")
    counts = df.groupBy(text.alias("value")).agg(F.count("*").alias("n")).where("value is not null")
    placed, total = _placed(counts.repartitionByRange("value").sortWithinPartitions("value"), scratch, "n")
    bin_ = F.expr(f"cast(before * {1 << bits} div {max(total, 1)} as int)")
    starts = placed.groupBy(bin_.alias("bin")).agg(F.min("value").alias("value")).collect()
    below = [F.when(text >= F.lit(r["value"]), F.lit(r["bin"])).otherwise(F.lit(0)) for r in starts]
    return F.coalesce(F.greatest(F.lit(0), F.lit(0), *below), F.lit(0))


def hilbert_shards(
    docs: DataFrame,
    shards: int = 8,
    dimensions: tuple[str, ...] = ("lang", "source", "size"),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, size, text_crc32, law ``rows``, shard, slot (gapless from 0), grown_shard (null under this law).

    Rows lie by curve position, then by the text's checksum, so equal texts of one place are neighbours, then by id.  Shards
    are runs of that order whose row counts differ by one at most; a hot place or text is cut like any other run.  ``size``
    is the text's UTF-8 bytes plus 1 (null: none).  Dimensions other than ``size`` that the table lacks are left out.
    """
    scratch = Scratch(docs.sparkSession)
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    checksum = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    others = [d for d in dimensions if d != "size" and d in docs.columns]
    narrow = docs.select(F.col(id_col).alias("id"), size.alias("size"), checksum.alias("text_crc32"), *[F.col(d).alias(f"by_{d}") for d in others])
    narrow = scratch.write(narrow, "narrow")
    named = [f"by_{d}" for d in others] + (["size"] if "size" in dimensions else [])
    placed = narrow.select("id", "size", "text_crc32", hilbert_index([bins(narrow, d, scratch) for d in named]).alias("curve"))
    order = ["curve", "text_crc32", "id", "size"]
    rank, total = _placed(placed.repartitionByRange(*order).sortWithinPartitions(*order), scratch)
    rank = rank.withColumnRenamed("before", "rank")
    shard = F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)")
    ranked = rank.withColumn("shard", shard)
    return ranked.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"rank - (shard * {total}L + {shards - 1}) div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Files of whole rows, one folder per shard, in slot order (ids are taken to be unique)."""
    both = docs.join(placed.select(id_col, "shard", "slot"), id_col)
    both.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
