"""Ranks, order statistics and windows (WIN1 to WIN13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups' totals that are sent to every task.
BROADCAST_TOTALS = 100_000


def _below(counts: DataFrame, by: list[str], few: bool = False) -> DataFrame:
    """Distinct values (by..., _v) and their counts (_c), with the counts of smaller values of the group (_below) and of all (_all).

    Rows are dealt to ranges of (group, value), as many as the session's shuffles have, and kept there.  A window runs in each group's part of
    a range, which adds the totals of the parts before it, so that no task orders a whole group and ranges grow in number with the cluster.
    ``few``: groups are of a bounded number of values, one window each.
    """
    from rangeflow.operators.lineage import cut

    group = Window.partitionBy(*by)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if few:
        return counts.select(*by, "_v", "_c", before("_c", group.orderBy("_v")).alias("_below"), F.sum("_c").over(group).alias("_all"))
    ranged = cut(counts.select(*by, "_v", "_c").repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_range").agg(F.sum("_c").alias("_t"))
    totals = totals.select(*by, "_range", before("_t", group.orderBy("_range")).alias("_before"), F.sum("_t").over(group).alias("_all"))
    inside = ranged.withColumn("_in", before("_c", Window.partitionBy(*by, "_range").orderBy("_v")))
    return inside.join(totals, [*by, "_range"]).select(*by, "_v", "_c", (F.col("_before") + F.col("_in")).alias("_below"), "_all")


def beside(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the columns of a table of few rows for each key; it goes to every task up to ``BROADCAST_TOTALS`` rows, so that few keys do not draw all rows to few tasks."""
    from rangeflow.operators.lineage import cut

    small = cut(small)
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_TOTALS else small, on)


def placed(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """Rows with the places, from 0, of the first and the last row of their value in their group (``{out}_from``, ``{out}_to``) and the group's number of values (``{out}_n``).

    Null values have no place, NaN is the largest; rows of a null group are left out.  Rows are ordered once, by ranges of (group, value), and carry their
    other columns along: nothing is counted apart and joined back.  Rows of one value meet in a task, where they pass one after another.
    """
    from rangeflow.operators.lineage import cut

    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.where(F.col(value).isNotNull()).repartitionByRange(*by, value).sortWithinPartitions(*by, value)
    rows = rows.select("*", F.spark_partition_id().alias("_part"), at.alias("_at"))
    same, group = Window.partitionBy(*by, value), Window.partitionBy(*by)
    rows = cut(rows.select("*", F.min("_at").over(same).alias("_from"), F.max("_at").over(same).alias("_to")).drop("_at"))
    totals = rows.groupBy(*by, "_part").agg(F.count("*").alias("_t"), F.min("_from").alias("_start"))
    before = F.coalesce(F.sum("_t").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = beside(rows, totals.select(*by, "_part", (before - F.col("_start")).alias("_shift"), F.sum("_t").over(group).alias(f"{out}_n")), [*by, "_part"])
    met = met.select(*df.columns, *[(F.col(c) + F.col("_shift")).alias(f"{out}{c}") for c in ("_from", "_to")], f"{out}_n")
    return met.unionByName(df.where(F.col(value).isNull()), allowMissingColumns=True)


def placed_rank(value: str, out: str) -> Column:
    """The average-tie rank of a row with places, null for NaN."""
    return F.when(~F.isnan(F.col(value).cast("double")), (F.col(f"{out}_from") + F.col(f"{out}_to")) / 2 + 1)


def placed_quantile(value: str, out: str, share: float) -> Column:
    """A group's quantile, between the values at the two places beside it."""
    at = F.lit(share) * (F.max(f"{out}_n") - 1)
    spot = F.lit(share) * (F.col(f"{out}_n") - 1)
    low, high = (F.max(F.when((f(spot) >= F.col(f"{out}_from")) & (f(spot) <= F.col(f"{out}_to")), F.col(value).cast("double"))) for f in (F.floor, F.ceil))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def average_rank(df: DataFrame, value: str, by: list[str], out: str, few: bool = False) -> DataFrame:
    """Average-tie ranks of a column within groups, nulls and NaN apart; values are counted before they are ordered by ranges."""
    fine = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    counts = df.select(*by, fine.alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    ranks = _below(counts, by, few).select(*by, "_v", (F.col("_below") + (F.col("_c") + 1) / 2).alias(out))
    return df.withColumn("_v", fine).join(ranks, [*by, "_v"], "left").drop("_v")


def rank_scale(df: DataFrame, value: str, by: list[str], out: str = "rank") -> DataFrame:
    """WIN1: percentile rank with average ties, (rank - 1) / (n - 1); 1 for a single value."""
    n = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = average_rank(df, value, by, "_r").join(n, by, "left")
    scaled = F.when(F.col("_r").isNotNull(), F.when(F.col("_n") == 1, 1.0).otherwise((F.col("_r") - 1) / (F.col("_n") - 1)))
    return ranked.withColumn(out, scaled).drop("_r", "_n")


def percentile_in(queries: DataFrame, reference: DataFrame, by: list[str], value: str = "value", out: str = "percentile") -> DataFrame:
    """WIN2: a value's place among a reference: its own rank where equal, midway between neighbours, clamped to 0..1."""
    q = queries.select(*by, F.col(value).alias("_v")).where("_v is not null").distinct().select("*", F.lit(0).alias("_ref"), F.lit(0).alias("_c"))
    r = reference.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c")).select(*by, "_v", F.lit(1).alias("_ref"), "_c")
    both = q.unionByName(r).groupBy(*by, "_v").agg(F.sum("_c").alias("_c"))
    placed = _below(both, by).withColumnRenamed("_all", "_n")
    position = F.when(F.col("_c") > 0, F.col("_below") + (F.col("_c") - 1) / 2).otherwise(F.col("_below") - 0.5)
    score = F.when(F.col("_n") == 1, 1.0).when(F.col("_n") > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), position / (F.col("_n") - 1))))
    placed = placed.select(*by, F.col("_v"), score.alias(out))
    return queries.withColumn("_v", F.col(value)).join(placed, [*by, "_v"], "left").drop("_v")


def share_outranked(finds: DataFrame, others: DataFrame, by: list[str], value: str = "rank", out: str = "share") -> DataFrame:
    """WIN3: for each find the share of other rows of its map that its rank beats, ties half."""
    q = finds.select(*by, F.col(value).alias("_v")).distinct().select("*", F.lit(0).alias("_c"))
    r = others.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    both = q.unionByName(r).where("_v is not null").groupBy(*by, "_v").agg(F.sum("_c").alias("_c"))
    beaten = (F.col("_below") + F.col("_c") / 2) / F.nullif(F.col("_all"), F.lit(0))
    placed = _below(both, by).select(*by, "_v", beaten.alias(out))
    return finds.withColumn("_v", F.col(value)).join(placed, [*by, "_v"], "left").drop("_v")


def rank_histogram(rows: DataFrame, by: list[str], rank: str = "rank", bins: int = 100) -> DataFrame:
    """WIN3: rows by group and hundredth of the rank; the last bin holds rank 1."""
    b = F.least(F.lit(bins), F.floor(F.col(rank) * bins) + 1).cast("int")
    return rows.where(F.col(rank).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


def first_of_group(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """WIN4: the first row of each group in a given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WIN5: the last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def auc(df: DataFrame, by: list[str], score: str = "score", label: str = "presence", few: bool = False) -> DataFrame:
    """WIN6: area under the curve from average ranks; null where a class is empty.  ``few``: groups of a bounded number of rows."""
    known = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    ranked = average_rank(known, score, by, "_r", few)
    n1, n0 = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    total = F.sum(F.when(F.col(label) == 1, F.col("_r")))
    return ranked.groupBy(*by).agg(F.when((n1 > 0) & (n0 > 0), (total - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def sequential_p(draws: DataFrame, by: list[str], stop_after: int = 5, draw: str = "draw") -> DataFrame:
    """WIN7: early-stopped p-value: k / draws at the k-th null at or above the observed score, else (1 + above) / (1 + n).

    draws: by..., draw, null_score, observed.
    """
    w = Window.partitionBy(*by).orderBy(draw).rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("null_score") >= F.col("observed")).cast("int")
    seen = draws.where("null_score is not null").withColumns({"_above": F.sum(hit).over(w), "_at": F.row_number().over(Window.partitionBy(*by).orderBy(draw))})
    sums = seen.groupBy(*by).agg(F.min(F.when(F.col("_above") >= stop_after, F.col("_at"))).alias("stop"), F.max("_above").alias("above"), F.count("*").alias("n"))
    p = F.when(F.col("stop").isNotNull(), F.lit(float(stop_after)) / F.col("stop")).otherwise((1 + F.col("above")) / (1 + F.col("n")))
    return sums.select(*by, p.alias("p"), F.coalesce("stop", "n").cast("long").alias("draws"))


def q_values(df: DataFrame, by: list[str], p: str = "p", out: str = "q") -> DataFrame:
    """WIN8: Benjamini-Hochberg; null p-values apart."""
    n = F.count(p).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by, F.col(p).isNull()).orderBy(p))
    later = Window.partitionBy(*by, F.col(p).isNull()).orderBy(F.col(p).desc(), F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumns({"_n": n, "_r": rank})
    low = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(later))
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), low)).drop("_n", "_r")


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """WIN9: correlation of average ranks over rows with both values."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_rank(average_rank(known, a, by, "_ra"), b, by, "_rb")
    return ranked.groupBy(*by).agg(F.corr("_ra", "_rb").alias("spearman"))


def boyce(df: DataFrame, by: list[str], score: str = "score", label: str = "presence", windows: int = 100, width: float = 0.1) -> DataFrame:
    """WIN10: continuous Boyce index: Spearman of the windows' middles and their presence-to-background ratios.

    Scores are counted by value first and every value meets the windows it lies in, about ``windows * width`` of them.
    """
    known = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    n1, n0 = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    ends = known.groupBy(*by).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), n1.alias("n1"), n0.alias("n0")).where("n1 >= 3 and n0 >= 3 and hi > lo")
    span = F.lit(width) * (F.col("hi") - F.col("lo"))
    begin = F.col("lo") + (F.col("hi") - span - F.col("lo")) * F.col("w") / (windows - 1)
    values = known.groupBy(*by, F.col(score).alias("v")).agg(n1.alias("p"), n0.alias("b")).join(ends, by)
    # the windows that can hold a value, by arithmetic and one to each side; the comparison below decides
    step = (F.col("hi") - F.col("lo")) * (1 - width) / (windows - 1)
    since = F.greatest(F.lit(0), F.floor((F.col("v") - span - F.col("lo")) / step) - 1).cast("int")
    until = F.least(F.lit(windows - 1), F.ceil((F.col("v") - F.col("lo")) / step) + 1).cast("int")
    met = values.select("*", F.explode(F.sequence(since, until)).alias("w")).withColumns({"begin": begin, "span": span})
    met = met.where((F.col("v") >= F.col("begin")) & (F.col("v") <= F.col("begin") + F.col("span")))
    ratio = (F.sum("p") / F.first("n1")) / F.nullif(F.sum("b") / F.first("n0"), F.lit(0.0))
    bins = met.groupBy(*by, "w").agg(ratio.alias("ratio"), F.first(F.col("begin") + F.col("span") / 2).alias("middle")).where("ratio is not null")
    ranked = average_rank(average_rank(bins, "middle", by, "rm", few=True), "ratio", by, "rr", few=True)
    return ranked.groupBy(*by).agg(F.when(F.count("*") >= 3, F.corr("rm", "rr")).alias("boyce"))


def boyce_of_ranks(histogram: DataFrame, by: list[str], expected: DataFrame | None = None) -> DataFrame:
    """WIN10: the index over 91 windows of ten of the hundred rank bins; uniform expectation, or a histogram's (by..., bin, e)."""
    keys = histogram.select(*by).distinct()
    grid = keys.select(*by, F.explode(F.sequence(F.lit(1), F.lit(100))).alias("bin")).join(histogram, [*by, "bin"], "left")
    grid = grid.withColumn("e", F.lit(1.0)) if expected is None else grid.join(expected, [*by, "bin"], "left")
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(0, 9)
    every = Window.partitionBy(*by)
    o = F.sum(F.coalesce("n", F.lit(0))).over(w) / F.sum("n").over(every)
    e = F.sum(F.coalesce("e", F.lit(0.0))).over(w) / F.sum("e").over(every)
    rows = grid.withColumns({"o_": o, "e_": e}).where("bin <= 91").withColumn("ratio", F.when(F.col("e_") > 0, F.col("o_") / F.col("e_"))).where("ratio is not null")
    ranked = average_rank(rows, "ratio", by, "rr", few=True)
    enough = (F.count("*") >= 3) & (F.stddev_samp("ratio") > 0)
    return ranked.groupBy(*by).agg(F.when(enough, F.bround(F.corr("rr", "bin"), 3)).alias("boyce"))


def quantile_gap(df: DataFrame, by: list[str], value: str, side: str, n: int = 1000) -> DataFrame:
    """WIN11: mean absolute difference of n quantiles of two samples (``side`` true and false), null where a sample is empty.

    Values are counted and ordered by ranges; of them only those at the places beside a quantile's go on, two for each.
    """
    known = df.where(F.col(value).isNotNull() & F.col(side).isNotNull())
    counts = known.groupBy(F.struct(*by, F.col(side).alias("_side")).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    last, k = F.col("_all") - 1, F.col("_k")
    at = F.lit(1.0) * last * ((k + 0.5) / n)
    # the quantiles that can need a value, by arithmetic and one to each side; the comparison below decides
    edge = lambda place: place * n / F.greatest(last, F.lit(1)) - 0.5
    since = F.greatest(F.lit(0), F.floor(edge(F.col("_below") - 1)) - 1).cast("int")
    until = F.least(F.lit(n - 1), F.when(last < 1, n - 1).otherwise(F.ceil(edge(F.col("_below") + F.col("_c"))) + 1)).cast("int")
    near = _below(counts, ["_g"]).where(since <= until).select("*", F.explode(F.sequence(since, until)).alias("_k"))
    holds = lambda place: (place >= F.col("_below")) & (place < F.col("_below") + F.col("_c"))
    near = near.withColumns({"_at": at, "_low": F.floor(at), "_high": F.ceil(at)}).where(holds(F.col("_low")) | holds(F.col("_high")))
    low, high = (F.max(F.when(holds(F.col(c)), F.col("_v"))) for c in ("_low", "_high"))
    ends = near.groupBy("_g", "_k", "_at", "_low", "_high").agg(low.alias("_lo"), high.alias("_hi"))
    between = (F.col("_high") - F.col("_at")) * F.col("_lo") + (F.col("_at") - F.col("_low")) * F.col("_hi")
    q = ends.select(*[F.col(f"_g.{c}").alias(c) for c in by], F.col("_g._side").alias("_side"), "_k", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias("_q"))
    sides = [F.max(F.when(F.col("_side") == s, F.col("_q"))) for s in (True, False)]
    gaps = q.groupBy(*by, "_k").agg(F.abs(sides[0] - sides[1]).alias("_d"))
    rows = gaps.unionByName(df.select(*by, F.lit(None).cast("int").alias("_k"), F.lit(None).cast("double").alias("_d")).distinct())
    found = F.transform(F.array_sort(F.collect_list(F.when(F.col("_d").isNotNull(), F.struct("_k", "_d")))), lambda x: x["_d"])
    total = F.aggregate(found, F.lit(0.0), lambda t, x: t + x) / n
    return rows.groupBy(*by).agg(F.when(F.count("_d") == n, total).alias("gap"))


def keyset_windows(bounds: DataFrame, bound: str = "bound") -> DataFrame:
    """WIN12: (after, through] windows from page ends, the last one open; ends are numbered by ranges and meet the one before."""
    from rangeflow.operators.lineage import cut, numbered

    rows = cut(numbered(bounds.select(F.col(bound).alias("through")), ["through"], "_k"))
    before = rows.select((F.col("_k") + 1).alias("_k"), F.col("through").alias("_before"))
    closed = rows.join(before, "_k", "left").select(F.coalesce("_before", F.lit(0)).alias("after"), "through")
    last = bounds.agg(F.max(bound).alias("after")).select("after", F.lit(None).cast("long").alias("through"))
    return closed.unionByName(last)


def retraction_state(ledger: DataFrame, occurrences: DataFrame, today: str) -> DataFrame:
    """WIN13: ledger rows against the newest pull: gone, renamed, moved, or still there; the first day of a retraction is kept.

    ledger: record, taxon, cell, retracted_on; occurrences: record, taxon, cell.
    """
    now = occurrences.select("record", F.col("taxon").alias("_t"), F.col("cell").alias("_c"))
    both = ledger.drop("reason").join(now, "record", "left")
    reason = F.when(F.col("_t").isNull(), "gone").when(F.col("_t") != F.col("taxon"), "renamed").when(~F.col("_c").eqNullSafe(F.col("cell")), "moved")
    out = both.withColumn("reason", reason)
    return out.withColumn("retracted_on", F.when(F.col("reason").isNotNull(), F.coalesce("retracted_on", F.lit(today).cast("date")))).drop("_t", "_c")
