"""Aggregations (AGG1 to AGG38)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeflow.functions.scalars import coarser_cell, degree_centre, degree_key, map_grade, map_strength, place_band, rows_hash, wilson
from rangeflow.functions.text import any_of, name_key, record_key
from rangeflow.operators.joins import LABEL_DISAGREE, LABEL_NONE, LABEL_SAME, LABEL_SEQUENCE_GENUS
from rangeflow.operators.lineage import cut
from rangeflow.operators.predicates import modelled_name, not_species

FINGERPRINT_FIELDS = ("source", "observation_id", "scientific_name", "latitude", "longitude")
CLIMATE_START = 1991
IMPORTANCE_FLOOR = 0.002
MIN_PLACES = 30
#: Species that are sent to every task with their groups.
BROADCAST_SPECIES = 50_000
_US = "\x1f"


# ---- records and names --------------------------------------------------------


def group_fingerprint(df: DataFrame, by: list[str], fields: tuple[str, ...] = FINGERPRINT_FIELDS) -> DataFrame:
    """AGG1: a hash of each group's rows that is the same in any order, with its row count."""
    row = F.concat_ws(_US, *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    return df.select(*by, F.sha2(row, 256).alias("_h")).groupBy(*by).agg(rows_hash(F.col("_h")).alias("fingerprint"), F.count("*").alias("records"))


def taxon_fingerprints(df: DataFrame, fields: tuple[str, ...] = FINGERPRINT_FIELDS) -> DataFrame:
    """AGG1: per taxon records, distinct localities and fingerprint."""
    places = df.groupBy("scientific_name").agg(F.count_distinct(degree_key("latitude", "longitude")).alias("localities"))
    return group_fingerprint(df, ["scientific_name"], fields).join(places, "scientific_name")


def sites_per_taxon(taxa: DataFrame, points: DataFrame, taxon: str = "taxon", site: str = "site") -> DataFrame:
    """AGG2: distinct sites of every taxon, 0 for those without points."""
    n = points.groupBy(taxon).agg(F.count_distinct(site).alias("sites"))
    return taxa.select(taxon).distinct().join(n, taxon, "left").select(taxon, F.coalesce("sites", F.lit(0)).alias("sites"))


def batch_candidates(points: DataFrame, low: int = 20, high: int | None = None, limit: int | None = None, taxon: str = "taxon", site: str = "site") -> DataFrame:
    """AGG3: taxa within a range of sites, richest first."""
    n = points.groupBy(taxon).agg(F.count_distinct(site).alias("sites")).where(F.col("sites") >= low)
    n = n if high is None else n.where(F.col("sites") <= high)
    out = n.orderBy(F.desc("sites"), taxon)
    return out if limit is None else out.limit(limit)


def canonical_names(df: DataFrame, name: str = "scientific_name") -> DataFrame:
    """AGG4: (name, canonical): each key's commonest spelling, the first in order on ties."""
    counts = df.groupBy(name).agg(F.count("*").alias("n")).withColumn("key", name_key(name))
    best = counts.groupBy("key").agg(F.min_by(name, F.struct(-F.col("n"), F.col(name))).alias("canonical"))
    return counts.join(best, "key").select(F.col(name).alias("name"), "canonical")


def canonicalise(df: DataFrame, name: str = "scientific_name") -> DataFrame:
    """AGG4: the pull under canonical spellings; ``original_name`` keeps the record's where it differs."""
    m = canonical_names(df, name).withColumnRenamed("name", name)
    out = df.join(m, name)
    return out.withColumn("original_name", F.when(F.col(name) != F.col("canonical"), F.col(name))).withColumn(name, F.col("canonical")).drop("canonical")


def name_merges(df: DataFrame, name: str = "scientific_name") -> DataFrame:
    """AGG4: the report of spellings merged into another."""
    counts = df.groupBy(name).agg(F.count("*").alias("records")).withColumnRenamed(name, "name")
    return canonical_names(df, name).where("name <> canonical").join(counts, "name").select("name", "canonical", "records")


def detect_renames(previous: DataFrame, current: DataFrame, id_col: str = "id", name: str = "scientific_name") -> DataFrame:
    """AGG5: names gone from the current pull whose records mostly carry one other name now."""
    old = previous.select(id_col, F.col(name).alias("old_name"))
    gone = old.join(current.select(F.col(name).alias("old_name")).distinct(), "old_name", "left_anti")
    moved = gone.join(current.select(id_col, F.col(name).alias("new_name")), id_col, "left")
    total = Window.partitionBy("old_name")
    counts = moved.groupBy("old_name", "new_name").agg(F.count("*").alias("moved")).withColumn("total", F.sum("moved").over(total))
    return counts.where("new_name is not null and moved * 2 > total").select("old_name", "new_name", "moved", "total")


def public_cells(df: DataFrame, hidden: DataFrame | None = None, degrees: float = 0.1) -> DataFrame:
    """AGG6: records per taxon and coarse cell, with the cell's centre; hidden records left out."""
    if hidden is not None:
        keys = hidden.select(record_key("source", "observation_id").alias("_k")).distinct()
        df = df.withColumn("_k", record_key("source", "observation_id")).join(keys, "_k", "left_anti")
    i, j = F.floor(F.col("latitude") / degrees), F.floor(F.col("longitude") / degrees)
    n = df.groupBy(F.col("scientific_name").alias("taxon"), i.alias("i"), j.alias("j")).agg(F.count("*").alias("records"))
    return n.select("taxon", degree_centre("i", degrees).alias("lat"), degree_centre("j", degrees).alias("lng"), "records")


def region_table(df: DataFrame) -> DataFrame:
    """AGG7: records and distinct localities per taxon and region (after ``region_of``)."""
    by = [F.col("scientific_name").alias("taxon"), "country", "country_code", "region", "code"]
    return df.groupBy(*by).agg(F.count("*").alias("records"), F.count_distinct(degree_key("latitude", "longitude")).alias("localities"))


def regions_summary(table: DataFrame) -> DataFrame:
    """AGG8: per region taxa recorded, records, and taxa likely or possible without records."""
    without = F.col("records") == 0
    return table.groupBy("country_code", "code").agg(
        F.count_if(F.col("records") > 0).alias("taxa"), F.sum("records").cast("long").alias("records"),
        F.count_if(without & (F.col("model") == "likely")).alias("likely"), F.count_if(without & (F.col("model") == "possible")).alias("possible"),
    )


def region_predictions(rows: DataFrame) -> DataFrame:
    """AGG9: over a taxon's maps: best reach share, mean suitable share (a map without the region counts 0), best suitable share.

    rows: taxon, model, code, cells, reach, suitable.
    """
    maps = rows.groupBy("taxon").agg(F.count_distinct("model").alias("maps"))
    shares = rows.select("taxon", "code", (F.col("reach") / F.col("cells")).alias("r"), (F.col("suitable") / F.col("cells")).alias("s"))
    got = shares.groupBy("taxon", "code").agg(F.max("r").alias("reach_share"), F.sum("s").alias("total"), F.max("s").alias("best_share"))
    return got.join(maps, "taxon").select("taxon", "code", "reach_share", (F.col("total") / F.col("maps")).alias("suitable_share"), "best_share")


def label_audit(df: DataFrame) -> DataFrame:
    """AGG10: records by naming status, and by status and source (``source`` null: all)."""
    return df.groupingSets([["name_status"], ["name_status", "source"]], "name_status", "source").agg(F.count("*").alias("records"))


def name_changes(df: DataFrame, top: int = 50) -> DataFrame:
    """AGG10: the commonest changes from a record's name to its sequences' name."""
    rows = df.where(F.col("scientific_name").isNotNull() & (F.col("name_status") != LABEL_SAME))
    return rows.groupBy("record_name", "scientific_name", "name_status").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "record_name", "scientific_name").limit(top)


def waterfall_reason(name: str = "scientific_name", status: str = "name_status") -> Column:
    """AGG11: why a record with a place does not count, null where it does."""
    return (
        F.when(F.col(status) == LABEL_NONE, "no sequence name").when(F.col(status) == LABEL_DISAGREE, "sequences disagree")
        .when(F.col(status) == LABEL_SEQUENCE_GENUS, "sequence names a genus").when(~modelled_name(name), F.coalesce(not_species(name), F.lit("not a species")))
    )


def waterfall(df: DataFrame, steps: list[tuple[str, Column]], by: str = "source") -> DataFrame:
    """AGG11, AGG12: one pass over the records: at each step the rows that passed it and all before, by source and in all (null).

    ``total`` are all rows, ``used`` those that pass every step, ``removed`` the rest.
    """
    passed, columns = F.lit(True), []
    for name, condition in steps:
        passed = passed & F.coalesce(condition, F.lit(False))
        columns.append(F.count_if(passed).alias(name))
    out = df.rollup(by).agg(F.count("*").alias("total"), *columns)
    return out.withColumn("used", F.col(steps[-1][0])).withColumn("removed", F.col("total") - F.col("used"))


def waterfall_adds_up(table: DataFrame, steps: list[str], total: str = "total") -> DataFrame:
    """AGG11: whether each row falls step by step from its total."""
    fine = F.lit(True)
    for before, after in zip([total, *steps], steps):
        fine = fine & (F.col(before) >= F.col(after))
    return table.withColumn("adds_up", fine & (F.col("total") - F.col("removed") == F.col("used")))


def left_out_counts(df: DataFrame, flags: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """AGG12: rows for each flag in one pass."""
    return df.groupBy(*(by or [])).agg(*[F.count_if(c).alias(n) for n, c in flags.items()])


def year_span(points: DataFrame, taxon: str = "taxon", year: str = "year") -> DataFrame:
    """AGG13: records, dated ones, first, median and last year, and the share before the climate period."""
    return points.groupBy(taxon).agg(
        F.count("*").alias("records"), F.count(year).alias("dated"), F.min(year).alias("first"), F.bround(F.percentile(year, 0.5)).cast("int").alias("median"),
        F.max(year).alias("last"), F.bround(F.avg((F.col(year) < CLIMATE_START).cast("double")), 3).alias("before_climate_period"),
    )


# ---- maps -------------------------------------------------------------------------


def cell_mean_ranks(ranked: DataFrame, cell_km: float = 5, to_km: float = 20) -> DataFrame:
    """AGG14: a model's fine ranks inside its area averaged to coarse cells in whole percent, with the mean index.

    ranked: model, cell, rank (0..1), inside, index.
    """
    coarse = ranked.where("rank is not null").withColumn("coarse", coarser_cell("cell", cell_km, to_km))
    mean = F.bround(100 * F.avg(F.when(F.col("inside"), F.col("rank")))).cast("int")
    return coarse.groupBy("model", F.col("coarse").alias("cell")).agg(mean.alias("rank"), F.avg("index").alias("index")).where("rank is not null")


def prior_ranks(parts: DataFrame) -> DataFrame:
    """AGG15: per taxon and cell the mean rank of its models, how many there are, and their spread (two or more).

    parts: taxon, model, cell, rank.
    """
    spread = F.bround(F.stddev_samp("rank")).cast("int")
    return parts.groupBy("taxon", "cell").agg(F.bround(F.avg("rank")).cast("int").alias("rank"), F.count("*").alias("models"), spread.alias("sd"))


def prior_taxa(parts: DataFrame) -> DataFrame:
    """AGG15: one row per taxon of the prior."""
    return parts.groupBy("taxon").agg(F.count_distinct("model").alias("models"), F.count_distinct("cell").alias("cells"))


def continent_combine(parts: DataFrame) -> DataFrame:
    """AGG16: as the prior, with the lowest ratio of index to threshold in whole percent, 255 at most (parts: + ratio)."""
    ratio = F.least(F.lit(255), F.bround(100 * F.min(F.when(~F.isnan("ratio"), F.col("ratio")))).cast("int"))
    return parts.groupBy("taxon", "cell").agg(F.bround(F.avg("rank")).cast("int").alias("rank"), F.count("*").alias("models"), ratio.alias("ratio"))


def weighted_strength(rows: DataFrame, by: str = "taxon") -> DataFrame:
    """AGG17: mean strength weighted by AUC over a half; the plain mean without weight."""
    w = F.greatest(F.lit(0.0), F.col("auc") - 0.5)
    mean = F.coalesce(F.sum(w * F.col("strength")) / F.nullif(F.sum(w), F.lit(0.0)), F.avg("strength"))
    return rows.groupBy(by).agg(mean.alias("strength"))


def ensemble_members(models: DataFrame, low: int = 2) -> DataFrame:
    """AGG18: strong models of taxa that have at least two, with their weight and the members' hash."""
    strong = models.where("grade = 'strong'").withColumn("weight", F.greatest(F.lit(0.0), F.col("auc") - 0.5))
    n = strong.groupBy("taxon").agg(
        F.count("*").alias("members"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "algorithm", "fingerprint"))), ","), 256).alias("members_hash")
    )
    return strong.join(n.where(F.col("members") >= low), "taxon")


def ensemble(rows: DataFrame) -> DataFrame:
    """AGG18: per taxon and cell the weighted mean rank, weighted population spread, and share of weight that knows the cell.

    rows: taxon, cell, member, rank, weight.
    """
    totals = rows.select("taxon", "member", "weight").distinct().groupBy("taxon").agg(F.sum("weight").alias("all_weight"))
    known = rows.where("rank is not null")
    w, r = F.col("weight"), F.col("rank")
    sums = known.groupBy("taxon", "cell").agg(F.sum(w).alias("w"), F.sum(w * r).alias("wr"), F.sum(w * r * r).alias("wrr"))
    mean = F.col("wr") / F.col("w")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("wrr") / F.col("w") - mean * mean))
    return sums.join(totals, "taxon").select("taxon", "cell", mean.alias("rank"), spread.alias("spread"), (F.col("w") / F.col("all_weight")).alias("known"))


def group_sums(values: DataFrame, groups: DataFrame, names: list[str], total: str = "total") -> DataFrame:
    """AGG19: species values per cell summed to their groups (values: cell, species, value; groups: species, group), with the total.

    Each species has one row that counts its groups, so all sums of a cell are one aggregation, and up to ``BROADCAST_SPECIES`` species go to
    every task: a join on few species would shuffle the values to a task a species.
    """
    counted = cut(groups.groupBy("species").agg(*[F.count_if(F.col("group") == n).alias(f"_n{k}") for k, n in enumerate(names)], F.lit(True).alias("_known")))
    met = values.join(F.broadcast(counted) if counted.count() <= BROADCAST_SPECIES else counted, "species", "left")
    part = lambda k: F.sum(F.when(F.col(f"_n{k}") > 0, F.col("value") * F.col(f"_n{k}")))
    sums = met.groupBy("cell").agg(*[part(k).alias(n) for k, n in enumerate(names)], F.sum("value").alias(total), F.max("_known").alias("_known"))
    return sums.where("_known").drop("_known").na.fill(0.0, names)


def group_shares(sums: DataFrame, names: list[str], total: str = "total") -> DataFrame:
    """AGG19: each group's share of the cell's total."""
    from rangeflow.functions.scalars import share

    return sums.withColumns({n: share(n, total) for n in names})


def paired_arms(rows: DataFrame, baseline: str, metrics: tuple[str, ...] = ("auc", "boyce")) -> DataFrame:
    """AGG20: per band and in all (null band): arms' taxa, means, paired difference from the baseline with its error, share of taxa where it is best.

    rows: taxon, band, arm, auc, boyce.
    """
    b = rows.where(F.col("arm") == baseline).select("taxon", *[F.col(m).alias(f"base_{m}") for m in metrics])
    best = F.max(metrics[0]).over(Window.partitionBy("taxon"))
    met = rows.withColumn("best", (F.col(metrics[0]) == best).cast("double")).join(b, "taxon", "left")
    columns = [F.count("*").alias("n")]
    for m in metrics:
        d = F.col(m) - F.col(f"base_{m}")
        columns += [F.avg(m).alias(m), F.avg(d).alias(f"{m}_delta"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias(f"{m}_se")]
    return met.groupingSets([["arm", "band"], ["arm"]], "arm", "band").agg(*columns, F.avg("best").alias("best_share"))


def importance_summary(rows: DataFrame) -> DataFrame:
    """AGG21: mean fall of the score by arm, kind and name, for all taxa and by guild (rows: taxon, guild, arm, kind, name, fall)."""
    return rows.groupingSets([["arm", "kind", "name"], ["arm", "kind", "name", "guild"]], "arm", "kind", "name", "guild").agg(
        F.count("*").alias("taxa"), F.avg("fall").alias("fall"), (F.stddev_samp("fall") / F.sqrt(F.count("fall"))).alias("se"),
        F.avg((F.col("fall") > IMPORTANCE_FLOOR).cast("double")).alias("share_over"),
    )


def importance_table(rows: DataFrame, layers: DataFrame) -> DataFrame:
    """AGG21: per model its predictors nested under their layers (rows: model, name, fall; layers: band, layer)."""
    named = rows.join(layers.withColumnRenamed("band", "name"), "name", "left")
    bands = named.groupBy("model", "layer").agg(F.sum("fall").alias("layer_fall"), F.array_sort(F.collect_list(F.struct((-F.col("fall")).alias("o"), "name", "fall"))).alias("b"))
    bands = bands.withColumn("b", F.transform("b", lambda x: F.struct(x["name"].alias("name"), x["fall"].alias("fall"))))
    order = F.array_sort(F.collect_list(F.struct((-F.col("layer_fall")).alias("o"), "layer", "layer_fall", F.col("b").alias("bands"))))
    return bands.groupBy("model").agg(order.alias("layers"))


def block_size_summary(rows: DataFrame) -> DataFrame:
    """AGG22: per block size: taxa for which its gap is the least, mean gap, scorable share, by band and in all (rows: taxon, band, km, gap, scorable)."""
    least = F.min("gap").over(Window.partitionBy("taxon"))
    met = rows.withColumn("best", F.col("gap") == least)
    return met.groupingSets([["km", "band"], ["km"]], "km", "band").agg(F.count_if("best").alias("best"), F.avg("gap").alias("gap"), F.avg(F.col("scorable").cast("double")).alias("scorable"))


def pass_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """AGG23: passes, n, rate and its interval by group (rows: verdict text)."""
    scored = rows.where("verdict is not null")
    n = scored.groupBy(*by).agg(F.count_if(F.col("verdict") == "passed").alias("passed"), F.count("*").alias("n"))
    w = wilson("passed", "n")
    return n.withColumn("rate", F.col("passed") / F.col("n")).withColumns({"low": w["low"], "high": w["high"]})


def unnest_verdicts(rows: DataFrame, arms: str = "arms") -> DataFrame:
    """AGG23: one row per arm of nested study rows."""
    return rows.select(*[c for c in rows.columns if c != arms], F.explode(arms).alias("a")).select(*[c for c in rows.columns if c != arms], "a.*")


#: Coefficients of a rational approximation of the normal tail (relative error below 1.2e-7), from the last power down.
_TAIL = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def upper_tail(z: Column | str) -> Column:
    """One-sided normal tail, in column arithmetic."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    power = F.lit(_TAIL[0])
    for c in _TAIL[1:]:
        power = power * t + c
    tail = t * F.exp(-x * x + power) / 2
    return F.when(z >= 0, tail).when(z < 0, 1 - tail)


def rate_trend(rows: DataFrame, by: list[str], k: str = "passed", n: str = "n", score: str = "score") -> DataFrame:
    """AGG24: Cochran-Armitage trend of ordered rates: z and one-sided p."""
    kc, nc, sc = F.col(k).cast("double"), F.col(n).cast("double"), F.col(score).cast("double")
    sums = rows.groupBy(*by).agg(
        F.sum(kc).alias("kk"), F.sum(nc).alias("nn"), F.sum(kc * sc).alias("ks"), F.sum(nc * sc).alias("ns"), F.sum(nc * sc * sc).alias("nss")
    )
    p = F.col("kk") / F.col("nn")
    var = p * (1 - p) * (F.col("nss") - F.col("ns") * F.col("ns") / F.col("nn"))
    z = (F.col("ks") - p * F.col("ns")) / F.sqrt(F.nullif(var, F.lit(0.0)))
    return sums.select(*by, z.alias("z")).withColumn("p", upper_tail("z"))


def truth_summary(cells: DataFrame, by: list[str], top: float = 0.9) -> DataFrame:
    """AGG25: Spearman of prediction and truth, and the share of the true top tenth that the predicted top tenth holds."""
    from rangeflow.operators.windows import beside, placed, placed_quantile, placed_rank

    cut_of = lambda rows, value, out, name: beside(rows, rows.groupBy(*by).agg(placed_quantile(value, out, top).alias(name)), by)
    rows = cut_of(placed(cut(cells.select(*by, "predicted", "truth")), "predicted", by, "p"), "predicted", "p", "cp")
    rows = rows.select(*by, "truth", placed_rank("predicted", "p").alias("rp"), (F.col("predicted") >= F.col("cp")).alias("top"))
    met = cut_of(placed(rows, "truth", by, "t"), "truth", "t", "ct").withColumn("rt", placed_rank("truth", "t"))
    true_top = F.col("truth") >= F.col("ct")
    return met.groupBy(*by).agg(F.corr("rp", "rt").alias("spearman"), (F.count_if(true_top & F.col("top")) / F.count_if(true_top)).alias("top_share"))


def compare_maps(first: DataFrame, second: DataFrame, by: list[str], value: str = "value", cell: str = "cell") -> DataFrame:
    """AGG26: over cells both maps know: how many, Spearman, and Schoener's D."""
    from rangeflow.operators.windows import average_rank

    both = first.select(*by, cell, F.col(value).alias("a")).join(second.select(*by, cell, F.col(value).alias("b")), [*by, cell]).where("a is not null and b is not null")
    ranked = average_rank(average_rank(both, "a", by, "ra"), "b", by, "rb")
    sums = both.groupBy(*by).agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    met = ranked.join(sums, by)
    d = 1 - 0.5 * F.sum(F.abs(F.col("a") / F.col("sa") - F.col("b") / F.col("sb")))
    return met.groupBy(*by).agg(F.count("*").alias("cells"), F.corr("ra", "rb").alias("spearman"), d.alias("schoener_d"))


def taxon_changes(aligned: DataFrame) -> DataFrame:
    """AGG27: names that split or merge between two namings (aligned: dna, record)."""
    rows = aligned.where("record is not null and dna is not null")
    split = rows.groupBy("record").agg(F.count_distinct("dna").alias("n")).where("n > 1").select(F.lit("split").alias("change"), F.col("record").alias("name"), "n")
    merged = rows.groupBy("dna").agg(F.count_distinct("record").alias("n")).where("n > 1").select(F.lit("merged").alias("change"), F.col("dna").alias("name"), "n")
    return split.unionByName(merged)


def record_gains(aligned: DataFrame) -> DataFrame:
    """AGG27: records of each name under either naming."""
    a = aligned.groupBy(F.col("dna").alias("name")).agg(F.count("*").alias("dna_records")).where("name is not null")
    b = aligned.groupBy(F.col("record").alias("name")).agg(F.count("*").alias("record_records")).where("name is not null")
    both = a.join(b, "name", "full_outer").na.fill(0)
    return both.withColumn("gain", F.col("dna_records") - F.col("record_records"))


def grade_changes(first: DataFrame, second: DataFrame, grades: list[str]) -> DataFrame:
    """AGG27: a crosstab of models' grades before and after."""
    both = first.select("taxon", "algorithm", F.col("grade").alias("was")).join(second.select("taxon", "algorithm", F.col("grade").alias("now")), ["taxon", "algorithm"])
    return both.groupBy("was").pivot("now", grades).count().na.fill(0)


# ---- evaluation -----------------------------------------------------------------------


def place_metrics(scored: DataFrame, groups: list[str], min_places: int = MIN_PLACES, all_rows: bool = True) -> DataFrame:
    """AGG28: shares of places in the top half and top tenth, mean rank, share that beats effort; nulls below ``min_places``.

    scored: rank, effort_rank and the group columns; each group column alone, and all rows (all nulls).
    """
    ranked = F.count("rank")
    show = lambda c: F.when(ranked >= min_places, c)
    share = lambda c: show(F.avg(F.when(F.col("rank").isNotNull(), c.cast("double"))))
    sets = [[g] for g in groups] + ([[]] if all_rows else [])
    return scored.groupingSets(sets, *groups).agg(
        F.count("*").alias("places"), ranked.alias("ranked"), share(F.col("rank") >= 0.5).alias("top_half"), share(F.col("rank") >= 0.9).alias("top_tenth"),
        show(F.avg("rank")).alias("mean_rank"), show(F.avg((F.col("rank") > F.col("effort_rank")).cast("double"))).alias("beats_effort"),
    )


def tracker_summary(finds: DataFrame, min_share: int = 30) -> DataFrame:
    """AGG29: of all finds, and by channel and band: places, finds, ranked, shares with intervals; small counts withheld.

    finds: release, taxon, cell, find, channel, band, rank.  A place is the first find of a taxon in a cell and release.
    """
    order = Window.partitionBy("release", "taxon", "cell", "subset", "value").orderBy("find")
    subsets = F.array(*[F.struct(F.lit(s).alias("subset"), c.alias("value")) for s, c in (("all", F.lit("all")), ("channel", F.col("channel")), ("band", F.col("band")))])
    rows = finds.select("*", F.explode(subsets).alias("g")).select(*finds.columns, "g.subset", "g.value").withColumn("_n", F.row_number().over(order))
    unit = F.col("_n") == 1
    k = F.count_if(unit & F.col("rank").isNotNull())
    half, tenth = F.count_if(unit & (F.col("rank") >= 0.5)), F.count_if(unit & (F.col("rank") >= 0.9))
    out = rows.groupBy("subset", "value").agg(F.count_if(unit).alias("places"), F.count("*").alias("finds"), k.alias("ranked"), half.alias("_h"), tenth.alias("_t"))
    shown = F.col("ranked") >= min_share
    for name, c in (("top_half", "_h"), ("top_tenth", "_t")):
        w = wilson(c, "ranked")
        out = out.withColumns({name: F.when(shown, F.bround(F.col(c) / F.col("ranked"), 3)), f"{name}_low": F.when(shown, w["low"]), f"{name}_high": F.when(shown, w["high"])})
    return out.drop("_h", "_t")


#: Stop rules of the quality report.
QA_STOPS = {"no_place_share": 0.02, "uncached_share": 0.05, "source_change": 0.5, "source_floor": 100, "newest_days": 30, "kingdom_records": 50}


def qa_report(df: DataFrame, previous: DataFrame, kingdoms: DataFrame, listed: DataFrame, drops: DataFrame, today: str) -> DataFrame:
    """AGG30: checks of a pull against thresholds and the last report: (check, detail, value, previous, stop).

    previous: check, detail, value.
    """
    from rangeflow.operators.predicates import kingdom_counts

    value = lambda c, d, v: F.struct(F.lit(c).alias("check"), d.alias("detail"), v.cast("double").alias("value"))
    none = F.lit("")
    whole = df.agg(
        F.array(
            value("keys", none, F.count("*") - F.count_distinct(record_key("source", "observation_id"))),
            value("place_centres", none, F.avg((F.col("latitude") % 1 == 0).cast("double"))),
            value("uncached", none, F.avg(F.col("updated_at").isNull().cast("double"))),
            value("newest_green", none, F.datediff(F.lit(today).cast("date"), F.max(F.col("first_green_on").cast("date")))),
            value("naming", none, F.avg((F.col("name_status") == LABEL_DISAGREE).cast("double"))),
        ).alias("v")
    ).select(F.explode("v").alias("v")).select("v.*")
    sources = df.groupBy("source").agg(F.count("*").alias("n")).select(value("sources", F.col("source"), F.col("n")).alias("v")).select("v.*")
    kingdom = kingdom_counts(df, kingdoms)
    left_out = kingdom.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).select(value("kingdom_left_out", none, F.col("n")).alias("v")).select("v.*")
    one_name = kingdom.agg(F.coalesce(F.max("records"), F.lit(0)).alias("n")).select(value("kingdom", none, F.col("n")).alias("v")).select("v.*")
    listed_n = listed.agg(F.count("*").alias("n")).select(value("privacy_list", none, F.col("n")).alias("v")).select("v.*")
    drops_n = drops.agg(F.count("*").alias("n")).select(value("drop_list", none, F.col("n")).alias("v")).select("v.*")
    shared = df.groupBy("observation_id").agg(F.count_distinct("source").alias("s")).agg(F.count_if(F.col("s") > 1).alias("n"))
    shared = shared.select(value("keys", F.lit("numbers shared across sources"), F.col("n")).alias("v")).select("v.*")
    rows = whole.unionByName(sources).unionByName(left_out).unionByName(one_name).unionByName(listed_n).unionByName(drops_n).unionByName(shared)
    out = rows.join(previous.select("check", "detail", F.col("value").alias("previous")), ["check", "detail"], "left")
    v, p, q = F.col("value"), F.col("previous"), QA_STOPS
    check = F.col("check")
    stop = (
        F.when(check == "keys", (F.col("detail") == "") & (v > 0)).when(check == "place_centres", v > q["no_place_share"]).when(check == "uncached", v > q["uncached_share"])
        .when(check == "newest_green", v > q["newest_days"]).when(check == "privacy_list", v < p).when(check == "naming", v > 1.5 * p)
        .when(check.startswith("kingdom"), v > q["kingdom_records"])
        .when(check == "sources", (p >= q["source_floor"]) & (F.abs(v - p) > q["source_change"] * p)).otherwise(False)
    )
    return out.withColumn("stop", F.coalesce(stop, F.lit(False)))


def qa_gate(report: DataFrame, accept: tuple[str, ...] = ()) -> DataFrame:
    """AGG30: the checks that stop the pull, but for those accepted by name."""
    stops = report.where("stop")
    return stops.where(~F.col("check").isin(*accept)) if accept else stops


def outcome_counts(rows: DataFrame, by: list[str] | None = None, limit: float = 0.05) -> DataFrame:
    """AGG31: rows by status, each status's share of its group, and whether failures stop the batch."""
    total = F.sum("n").over(Window.partitionBy(*(by or [])))
    n = rows.groupBy(*(by or []), "status").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)
    return n.withColumn("stop", (F.col("status") == "failed") & (F.col("share") > limit))


def timing(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """AGG32: mean seconds by algorithm and machine type, hours and cost (rows: algorithm, machine, seconds; prices: machine, per_hour)."""
    t = rows.groupBy("algorithm", "machine").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_seconds"), (F.sum("seconds") / 3600.0).alias("hours"))
    return t.join(prices, "machine").withColumn("cost", F.col("hours") * F.col("per_hour")).drop("per_hour")


def layer_coverage(sites: DataFrame, bands: list[str], base: list[str], records: str = "records") -> DataFrame:
    """AGG33: per new band, records that the base layers describe and it does not."""
    complete = ~any_of([F.col(b).isNull() for b in base])
    counts = F.array(*[F.struct(F.lit(b).alias("band"), F.sum(F.when(complete & F.col(b).isNull(), F.col(records)).otherwise(0)).cast("long").alias("lost")) for b in bands])
    return sites.agg(F.sum(F.when(complete, F.col(records)).otherwise(0)).cast("long").alias("described"), counts.alias("b")).select("described", F.explode("b").alias("b")).select("b.band", "b.lost", "described")


def layer_overview(layers: DataFrame) -> DataFrame:
    """AGG33: layers with their bands."""
    return layers.groupBy("layer").agg(F.count("*").alias("bands"), F.array_sort(F.collect_list("band")).alias("names"))


METRICS_SCHEMA = (
    "skill string, auc_mean double, boyce double, built_at string, sites int, fingerprint string, "
    "null struct<design:string,auc_p:double,reps:int,observed_auc:double,auc_mean:double,auc_sd:double>"
)


def model_index(metrics: DataFrame, text: str = "metrics") -> DataFrame:
    """AGG34: one row per model of nested metrics (JSON text): grade, scores, strength."""
    m = metrics.select("taxon", "algorithm", F.from_json(text, METRICS_SCHEMA).alias("m"))
    n = F.col("m.null")
    grade = map_grade(F.col("m.skill"), n["design"], F.col("m.auc_mean"), F.col("m.boyce"))
    out = m.select("taxon", "algorithm", grade.alias("grade"), F.col("m.auc_mean").alias("auc"), "m.boyce", "m.sites", "m.built_at", "m.fingerprint", "m.skill", n.alias("n"))
    return out.withColumn("strength", map_strength(F.col("skill"), F.col("grade"), F.col("n.observed_auc"), F.col("n.auc_mean"), F.col("n.auc_sd"))).drop("n", "skill")


def strong_models(index: DataFrame) -> DataFrame:
    """AGG34: the listing's strong models."""
    return index.where("grade = 'strong'")


def best_maps(index: DataFrame, ensembles: DataFrame, show_weak: bool = False) -> DataFrame:
    """AGG35: each taxon's map: its ensemble where two members are still strong, else its strongest model by strength, AUC, name; or why none.

    ensembles: taxon, algorithm (members).
    """
    strong = index.where("grade = 'strong'").select("taxon", "algorithm")
    live = ensembles.join(strong, ["taxon", "algorithm"], "left_semi").groupBy("taxon").agg(F.count("*").alias("members")).where("members >= 2")
    shown = F.col("grade").isin("strong", *(["weak"] if show_weak else []))
    order = Window.partitionBy("taxon").orderBy(shown.desc(), (F.col("grade") == "strong").desc(), F.desc("strength"), F.desc("auc"), "algorithm")
    first = index.withColumn("_n", F.row_number().over(order)).where("_n = 1").withColumn("shown", shown)
    out = first.join(live, "taxon", "left")
    kind = F.when(F.col("members").isNotNull(), "ensemble").when(F.col("shown"), F.col("algorithm"))
    reason = F.when(kind.isNotNull(), None).when(F.col("grade") == "untested", "not tested").when(F.col("grade") == "weak", "weak only").otherwise("no model passed")
    return out.select("taxon", kind.alias("map"), F.when(kind.isNotNull(), F.col("strength")).alias("strength"), reason.alias("reason"))


def realised_breadth(cells: DataFrame, by: list[str], habitat: str = "habitat", floor: float = 0.5) -> DataFrame:
    """AGG36: share of sites at or above the habitat's floor."""
    return cells.groupBy(*by).agg(F.avg((F.col(habitat) >= floor).cast("double")).alias("breadth"))


def mapped_taxa(index: DataFrame) -> DataFrame:
    """AGG37: taxa with a strong map: newest build, algorithms."""
    rows = index.where("grade = 'strong'").groupBy("taxon")
    return rows.agg(F.max("built_at").alias("built_at"), F.array_join(F.array_sort(F.collect_set("algorithm")), ",").alias("algorithms"))


def compare_results(first: DataFrame, second: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """AGG38: which values of the same model differ between two runs, and by how much at most."""
    both = first.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values]).join(second.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values]), keys)
    gap = {v: F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) for v in values}
    off = {v: F.coalesce(gap[v] > tolerance, ~F.col(f"a_{v}").eqNullSafe(F.col(f"b_{v}"))) for v in values}
    names = F.array_compact(F.array(*[F.when(off[v], F.lit(v)) for v in values]))
    return both.select(*keys, F.array_join(names, ",").alias("differ"), F.greatest(*[F.coalesce(g, F.lit(0.0)) for g in gap.values()], F.lit(0.0)).alias("largest"))


def band_counts(rows: DataFrame, km: str = "km") -> DataFrame:
    """AGG31: rows by distance band."""
    return rows.groupBy(place_band(km).alias("band")).agg(F.count("*").alias("n"))


