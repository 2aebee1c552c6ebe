"""Registered queries of the aggregations, with the same question as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


from rangeflow.operators import aggs as A
from rangeflow.operators import joins as J
from rangeflow.plans.queries import _CANON, _GRADE, _KINGDOM, _LOCALITY, _METRICS, _REGION_OF, _SKILL, _kingdoms, _metrics, _regions, query, r
from rangeflow.plans.queries_joins import _DNA, _SEQ, aligned, labelled
from rangeflow.plans.stand_ins import MAP_SQL, WITH_OCC, WITH_POINTS, map_values, occurrences, points, rows_hash_sql, table


@query(
    "agg1_group_fingerprint",
    f"SELECT l_suppkey, {rows_hash_sql('h')} AS fingerprint, count(*) AS records FROM (SELECT l_suppkey, sha256(concat_ws(chr(31), l_orderkey, l_linenumber, l_partkey)) AS h FROM lineitem) GROUP BY 1",
)
def agg1(spark, d):
    return A.group_fingerprint(table(spark, d, "lineitem"), ["l_suppkey"], ("l_orderkey", "l_linenumber", "l_partkey"))


@query(
    "agg1_taxon_fingerprints",
    f"""{WITH_OCC} SELECT scientific_name, {rows_hash_sql('h')} AS fingerprint, count(*) AS records, count(DISTINCT loc) AS localities
 FROM (SELECT scientific_name, sha256(concat_ws(chr(31), source, observation_id, scientific_name, id)) AS h, {_LOCALITY} AS loc FROM occ) GROUP BY 1""",
)
def agg1_taxa(spark, d):
    return A.taxon_fingerprints(occurrences(spark, d), ("source", "observation_id", "scientific_name", "id"))


@query("agg2_sites_per_taxon", f"{WITH_POINTS} SELECT scientific_name AS taxon, count(DISTINCT cell20) AS sites FROM pts GROUP BY 1")
def agg2(spark, d):
    p = points(spark, d).select(F.col("scientific_name").alias("taxon"), F.col("cell20").alias("site"))
    return A.sites_per_taxon(p, p)


@query("agg3_batch_candidates", f"{WITH_POINTS} SELECT scientific_name AS taxon, count(DISTINCT cell20) AS sites FROM pts GROUP BY 1 HAVING count(DISTINCT cell20) BETWEEN 5 AND 60 ORDER BY sites DESC, taxon LIMIT 50")
def agg3(spark, d):
    p = points(spark, d).select(F.col("scientific_name").alias("taxon"), F.col("cell20").alias("site"))
    return A.batch_candidates(p, 5, 60, 50)


@query("agg4_canonical_names", f"{WITH_OCC}, {_CANON} SELECT scientific_name AS name, canonical FROM cnt JOIN canon USING (key)")
def agg4(spark, d):
    return A.canonical_names(occurrences(spark, d))


@query("agg4_name_merges", f"{WITH_OCC}, {_CANON} SELECT scientific_name AS name, canonical, n AS records FROM cnt JOIN canon USING (key) WHERE scientific_name <> canonical")
def agg4_merges(spark, d):
    return A.name_merges(occurrences(spark, d))


@query(
    "agg5_detect_renames",
    """WITH old AS (SELECT p_partkey AS id, p_name AS old_name FROM part), cur AS (SELECT p_partkey AS id, CASE WHEN ascii(p_name) % 2 = 0 AND p_partkey % 5 <> 0 THEN concat('new ', p_name) WHEN ascii(p_name) % 2 = 0 THEN p_type ELSE p_name END AS new_name FROM part),
 m AS (SELECT old_name, new_name, count(*) AS moved FROM old JOIN cur USING (id) WHERE old_name NOT IN (SELECT new_name FROM cur) GROUP BY ALL), t AS (SELECT *, CAST(sum(moved) OVER (PARTITION BY old_name) AS BIGINT) AS total FROM m) SELECT * FROM t WHERE moved * 2 > total""",
)
def agg5(spark, d):
    p = table(spark, d, "part")
    even = F.ascii("p_name") % 2 == 0
    new = F.when(even & (F.col("p_partkey") % 5 != 0), F.concat(F.lit("new "), "p_name")).when(even, F.col("p_type")).otherwise(F.col("p_name"))
    return A.detect_renames(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("scientific_name")), p.select(F.col("p_partkey").alias("id"), new.alias("scientific_name")))


@query(
    "agg6_public_cells",
    f"{WITH_OCC} SELECT scientific_name AS taxon, (CAST(floor(latitude / 0.1::DOUBLE) AS BIGINT) + 0.5::DOUBLE) * 0.1::DOUBLE AS lat, (CAST(floor(longitude / 0.1::DOUBLE) AS BIGINT) + 0.5::DOUBLE) * 0.1::DOUBLE AS lng, count(*) AS records FROM occ WHERE concat(source, ':', observation_id) NOT IN (SELECT concat(source, ':', observation_id) FROM occ WHERE id % 23 = 0) GROUP BY ALL",
)
def agg6(spark, d):
    o = occurrences(spark, d)
    return A.public_cells(o, o.where("id % 23 = 0").select("source", "observation_id"))


_TABLE = f"{_REGION_OF}, tab AS (SELECT scientific_name AS taxon, country_code, region, code, count(*) AS records, count(DISTINCT {_LOCALITY}) AS localities FROM rr GROUP BY ALL)"


@query("agg7_region_table", f"{WITH_OCC}, {_TABLE} SELECT * FROM tab")
def agg7(spark, d):
    """The checklist: records and localities per taxon and region."""
    return A.region_table(J.region_of(occurrences(spark, d), _regions(spark))).drop("country")


@query(
    "agg8_regions_summary",
    f"{WITH_OCC}, {_TABLE}, m AS (SELECT *, CASE WHEN ascii(taxon) % 3 = 0 THEN 'likely' WHEN ascii(taxon) % 3 = 1 THEN 'possible' ELSE 'unlikely' END AS model, CASE WHEN records % 2 = 0 THEN 0 ELSE records END AS rec FROM tab) SELECT country_code, code, count(*) FILTER (WHERE rec > 0) AS taxa, CAST(sum(rec) AS BIGINT) AS records, count(*) FILTER (WHERE rec = 0 AND model = 'likely') AS likely, count(*) FILTER (WHERE rec = 0 AND model = 'possible') AS possible FROM m GROUP BY 1, 2",
)
def agg8(spark, d):
    k = F.ascii("taxon") % 3
    t = agg7(spark, d).withColumn("model", F.when(k == 0, "likely").when(k == 1, "possible").otherwise("unlikely"))
    return A.regions_summary(t.withColumn("records", F.when(F.col("records") % 2 == 0, 0).otherwise(F.col("records"))))


@query(
    "agg9_region_predictions",
    f"""WITH v AS ({MAP_SQL}), q AS (SELECT taxon, model, CAST(cell % 6 AS VARCHAR) AS code, count(*) AS reach, count(*) FILTER (WHERE value > 50000) AS suitable FROM v WHERE (model + cell) % 7 <> 0 GROUP BY ALL HAVING (any_value(model) + any_value(cell % 6)) % 5 <> 0),
 n AS (SELECT taxon, count(DISTINCT model) AS maps FROM q GROUP BY 1) SELECT q.taxon, code, round(max(reach / 1000.0::DOUBLE), 6) AS reach_share, round(sum(suitable / 1000.0::DOUBLE) / any_value(maps), 6) AS suitable_share, round(max(suitable / 1000.0::DOUBLE), 6) AS best_share FROM q JOIN n USING (taxon) GROUP BY ALL""",
)
def agg9(spark, d):
    v = map_values(spark, d).where((F.col("model") + F.col("cell")) % 7 != 0)
    k = F.col("cell") % 6
    q = v.groupBy("taxon", "model", k.alias("k")).agg(F.count("*").alias("reach"), F.count_if(F.col("value") > 50000).alias("suitable")).where((F.col("model") + F.col("k")) % 5 != 0)
    out = A.region_predictions(q.select("taxon", "model", F.col("k").cast("string").alias("code"), F.lit(1000.0).alias("cells"), "reach", "suitable"))
    return out.withColumns({c: r(c) for c in ("reach_share", "suitable_share", "best_share")})


@query("agg10_label_audit", f"{WITH_OCC}, {_SEQ}, {_DNA} SELECT name_status, source, count(*) AS records FROM lab GROUP BY GROUPING SETS ((name_status), (name_status, source))")
def agg10(spark, d):
    return A.label_audit(labelled(spark, d))


@query("agg10_name_changes", f"{WITH_OCC}, {_SEQ}, {_DNA} SELECT record_name, nm AS scientific_name, name_status, count(*) AS records FROM lab WHERE name_status NOT IN ('sequences disagree (left out)', 'sequence name is one word (left out)', 'no approved named sequence', 'sequence name is the record name') GROUP BY ALL ORDER BY records DESC, record_name, scientific_name LIMIT 50")
def agg10_changes(spark, d):
    return A.name_changes(labelled(spark, d))


@query(
    "agg11_waterfall",
    f"{WITH_OCC} SELECT source, count(*) AS total, count(*) FILTER (WHERE first_green_on IS NOT NULL) AS validated, count(*) FILTER (WHERE first_green_on IS NOT NULL AND country IN ('US', 'CA', 'MX')) AS covered, count(*) FILTER (WHERE first_green_on IS NOT NULL AND country IN ('US', 'CA', 'MX') AND scientific_name LIKE '% %') AS named FROM occ GROUP BY ROLLUP (source)",
)
def agg11(spark, d):
    steps = [("validated", F.col("first_green_on").isNotNull()), ("covered", F.col("country").isin("US", "CA", "MX")), ("named", F.col("scientific_name").contains(" "))]
    return A.waterfall(occurrences(spark, d), steps).drop("used", "removed")


@query("agg12_left_out_counts", f"{WITH_OCC} SELECT source, count(*) FILTER (WHERE price > 300000) AS coarse, count(*) FILTER (WHERE first_green_on IS NULL) AS undated FROM occ GROUP BY 1")
def agg12(spark, d):
    return A.left_out_counts(occurrences(spark, d), {"coarse": F.col("price") > 300000, "undated": F.col("first_green_on").isNull()}, ["source"])


@query("agg13_year_span", "SELECT o_orderpriority AS taxon, count(*) AS records, count(y) AS dated, min(y) AS first, CAST(round_even(quantile_cont(y, 0.5), 0) AS INT) AS median, max(y) AS last, 0.0::DOUBLE AS before_climate_period FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(year(o_orderdate) AS INT) END AS y FROM orders) GROUP BY 1")
def agg13(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("taxon"), F.when(F.col("o_orderkey") % 5 != 0, F.year("o_orderdate")).alias("year"))
    return A.year_span(o)


@query(
    "agg14_cell_means",
    f"""WITH v AS ({MAP_SQL}), c AS (SELECT model, cell, value / 110000 AS rank, cell % 4 <> 0 AS inside, value / 50000 AS idx, (4740000 - (floor((cell * 1000 - 1) / 2436) + 0.5::DOUBLE) * 5000) AS y, (-7445000 + ((cell * 1000 - 1) % 2436 + 0.5::DOUBLE) * 5000) AS x FROM v)
 SELECT model, CAST(floor((4740000 - y) / 20000) * 609 + floor((x + 7445000) / 20000) + 1 AS BIGINT) AS cell, CAST(round_even(100 * avg(CASE WHEN inside THEN rank END), 0) AS INT) AS rank, round(avg(idx), 6) AS index FROM c GROUP BY 1, 2 HAVING avg(CASE WHEN inside THEN rank END) IS NOT NULL""",
)
def agg14(spark, d):
    v = map_values(spark, d).select("model", (F.col("cell") * 1000).alias("cell"), (F.col("value") / 110000).alias("rank"), (F.col("cell") % 4 != 0).alias("inside"), (F.col("value") / 50000).alias("index"))
    return A.cell_mean_ranks(v).withColumn("index", r("index"))


_PARTS = f"parts AS (SELECT taxon, model, cell, CAST(floor(value) AS BIGINT) % 101 AS rank, value / 40000 AS ratio FROM ({MAP_SQL}))"


def _parts(spark, d):
    return map_values(spark, d).select("taxon", "model", "cell", (F.col("value").cast("bigint") % 101).alias("rank"), (F.col("value") / 40000).alias("ratio"))


@query("agg15_prior_ranks", f"WITH {_PARTS} SELECT taxon, cell, CAST(round_even(avg(rank), 0) AS INT) AS rank, count(*) AS models, stddev_samp(rank) IS NOT NULL AS has_sd FROM parts GROUP BY 1, 2")
def agg15(spark, d):
    return A.prior_ranks(_parts(spark, d)).select("taxon", "cell", "rank", "models", F.col("sd").isNotNull().alias("has_sd"))


@query("agg16_continent", f"WITH {_PARTS} SELECT taxon, cell, CAST(round_even(avg(rank), 0) AS INT) AS rank, count(*) AS models, least(255, CAST(round_even(100 * min(ratio), 0) AS INT)) AS ratio FROM parts GROUP BY 1, 2")
def agg16(spark, d):
    return A.continent_combine(_parts(spark, d))


@query("agg17_weighted_strength", f"SELECT design, round(coalesce(sum(greatest(0.0, auc - 0.5) * boyce) / nullif(sum(greatest(0.0, auc - 0.5)), 0), avg(boyce)), 6) AS strength FROM ({_METRICS}) GROUP BY 1")
def agg17(spark, d):
    return A.weighted_strength(_metrics(spark, d).withColumnRenamed("boyce", "strength"), "design").withColumn("strength", r("strength"))


@query(
    "agg18_ensemble",
    f"""WITH v AS (SELECT taxon, cell, model, CASE WHEN cell % 5 <> 0 THEN sqrt(value) END AS rank, (model % 7 + 1) / 10.0::DOUBLE AS w FROM ({MAP_SQL})), t AS (SELECT taxon, sum(w) AS aw FROM (SELECT DISTINCT taxon, model, w FROM v) GROUP BY 1)
 SELECT v.taxon, cell, round(sum(w * rank) / sum(w), 5) AS rank, round(sqrt(greatest(0.0, sum(w * rank * rank) / sum(w) - pow(sum(w * rank) / sum(w), 2))), 3) AS spread, round(sum(w) / any_value(aw), 6) AS known FROM v JOIN t USING (taxon) WHERE rank IS NOT NULL GROUP BY 1, 2""",
)
def agg18(spark, d):
    v = map_values(spark, d).select("taxon", "cell", F.col("model").alias("member"), F.when(F.col("cell") % 5 != 0, F.sqrt("value")).alias("rank"), ((F.col("model") % 7 + 1) / 10.0).alias("weight"))
    out = A.ensemble(v)
    return out.select("taxon", "cell", r("rank", 5).alias("rank"), r("spread", 3).alias("spread"), r("known").alias("known"))


@query(
    "agg19_group_shares",
    "SELECT l_orderkey AS cell, round(least(1.0, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) / sum(l_quantity)), 6) AS a, round(least(1.0, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) / sum(l_quantity)), 6) AS n FROM lineitem GROUP BY 1",
)
def agg19(spark, d):
    values = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_returnflag").alias("species"), F.col("l_quantity").alias("value"))
    groups = values.select("species").distinct().withColumn("group", F.lower("species"))
    out = A.group_shares(A.group_sums(values, groups, ["a", "n"]), ["a", "n"])
    return out.select("cell", r("a").alias("a"), r("n").alias("n"))


_ARMS = "arms AS (SELECT CAST(o_custkey AS VARCHAR) AS taxon, CAST(o_custkey % 3 AS VARCHAR) AS band, o_orderpriority AS arm, avg(o_totalprice) AS auc, max(o_totalprice) AS boyce FROM orders GROUP BY ALL)"


def _arms(spark, d):
    k = F.col("o_custkey")
    return table(spark, d, "orders").groupBy(k.cast("string").alias("taxon"), (k % 3).cast("string").alias("band"), F.col("o_orderpriority").alias("arm")).agg(F.avg("o_totalprice").alias("auc"), F.max("o_totalprice").alias("boyce"))


@query(
    "agg20_paired_arms",
    f"""WITH {_ARMS}, b AS (SELECT taxon, auc AS ba, boyce AS bb FROM arms WHERE arm = '1-URGENT'), m AS (SELECT a.*, ba, bb, CAST(a.auc = max(a.auc) OVER (PARTITION BY a.taxon) AS INT)::DOUBLE AS best FROM arms a LEFT JOIN b USING (taxon))
 SELECT arm, band, count(*) AS n, round(avg(auc), 3) AS auc, round(avg(auc - ba), 3) AS auc_delta, round(stddev_samp(auc - ba) / sqrt(count(auc - ba)), 3) AS auc_se, round(avg(boyce), 3) AS boyce, round(avg(boyce - bb), 3) AS boyce_delta, round(stddev_samp(boyce - bb) / sqrt(count(boyce - bb)), 3) AS boyce_se, round(avg(best), 6) AS best_share FROM m GROUP BY GROUPING SETS ((arm, band), (arm))""",
)
def agg20(spark, d):
    out = A.paired_arms(_arms(spark, d), "1-URGENT")
    return out.withColumns({c: r(c, 3) for c in ("auc", "auc_delta", "auc_se", "boyce", "boyce_delta", "boyce_se")} | {"best_share": r("best_share")})


@query(
    "agg21_importance",
    "SELECT o_orderstatus AS arm, 'predictor' AS kind, o_orderpriority AS name, guild, count(*) AS taxa, round(avg(fall), 6) AS fall, round(stddev_samp(fall) / sqrt(count(fall)), 6) AS se, round(avg(CAST(fall > 0.002 AS INT)), 6) AS share_over FROM (SELECT *, CAST(o_custkey % 3 AS VARCHAR) AS guild, (o_totalprice - 100000) / 1000000 AS fall FROM orders) GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus, o_orderpriority, guild))",
)
def agg21(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("arm"), F.lit("predictor").alias("kind"), F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 3).cast("string").alias("guild"), ((F.col("o_totalprice") - 100000) / 1000000).alias("fall")
    )
    out = A.importance_summary(rows)
    return out.withColumns({c: r(c) for c in ("fall", "se", "share_over")})


@query(
    "agg22_block_sizes",
    "WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS taxon, CAST(o_custkey % 2 AS VARCHAR) AS band, o_orderpriority AS km, min(o_totalprice) AS gap, bool_or(o_orderstatus = 'F') AS scorable FROM orders GROUP BY ALL) SELECT km, band, count(*) FILTER (WHERE best) AS best, round(avg(gap), 3) AS gap, round(avg(CAST(scorable AS INT)), 6) AS scorable FROM (SELECT *, gap = min(gap) OVER (PARTITION BY taxon) AS best FROM g) GROUP BY GROUPING SETS ((km, band), (km))",
)
def agg22(spark, d):
    k = F.col("o_custkey")
    g = table(spark, d, "orders").groupBy(k.cast("string").alias("taxon"), (k % 2).cast("string").alias("band"), F.col("o_orderpriority").alias("km")).agg(F.min("o_totalprice").alias("gap"), F.bool_or(F.col("o_orderstatus") == "F").alias("scorable"))
    out = A.block_size_summary(g)
    return out.withColumns({"gap": r("gap", 3), "scorable": r("scorable")})


_RATES = "SELECT o_orderpriority AS kind, CAST(o_custkey % 4 AS BIGINT) AS band, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 150000) AS passed FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY ALL"
_W = "(1.96::DOUBLE)"


def _verdicts(spark, d):
    o = table(spark, d, "orders")
    verdict = F.when(F.col("o_orderkey") % 6 != 0, F.when(F.col("o_totalprice") > 150000, "passed").otherwise("failed"))
    return o.select(F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % 4).alias("band"), verdict.alias("verdict"))


_LOW = f"round_even(greatest(0.0, (p + {_W}*{_W}/(2*n)) / (1 + {_W}*{_W}/n) - {_W} * sqrt(p*(1-p)/n + {_W}*{_W}/(4*n*n)) / (1 + {_W}*{_W}/n)), 3)::DOUBLE"
_HIGH = f"round_even(least(1.0, (p + {_W}*{_W}/(2*n)) / (1 + {_W}*{_W}/n) + {_W} * sqrt(p*(1-p)/n + {_W}*{_W}/(4*n*n)) / (1 + {_W}*{_W}/n)), 3)::DOUBLE"


@query("agg23_pass_rates", f"SELECT kind, band, passed, n, p AS rate, {_LOW} AS low, {_HIGH} AS high FROM (SELECT *, passed / n::DOUBLE AS p FROM ({_RATES}))")
def agg23(spark, d):
    return A.pass_rates(_verdicts(spark, d), ["kind", "band"])


@query(
    "agg24_rate_trend",
    f"SELECT kind, round((ks - kk / nn * ns) / sqrt(kk / nn * (1 - kk / nn) * (nss - ns * ns / nn)), 6) AS z FROM (SELECT kind, sum(passed)::DOUBLE AS kk, sum(n)::DOUBLE AS nn, sum(passed * band)::DOUBLE AS ks, sum(n * band)::DOUBLE AS ns, sum(n * band * band)::DOUBLE AS nss FROM ({_RATES}) GROUP BY 1)",
)
def agg24(spark, d):
    rates = A.pass_rates(_verdicts(spark, d), ["kind", "band"]).withColumnRenamed("band", "score")
    return A.rate_trend(rates, ["kind"]).select("kind", r("z").alias("z"))


def _avg_rank(value: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0::DOUBLE)"


_TRUTH = f"t AS (SELECT taxon, model, cell, value AS predicted, (CAST(floor(value) AS BIGINT) * 7919) % 10007 + value / 10 AS truth FROM ({MAP_SQL}))"


def _truth(spark, d):
    v = F.col("value")
    return map_values(spark, d).select("taxon", "model", "cell", v.alias("predicted"), ((v.cast("bigint") * 7919) % 10007 + v / 10).alias("truth"))


@query(
    "agg25_truth_summary",
    f"""WITH {_TRUTH}, k AS (SELECT *, {_avg_rank('predicted', 'taxon')} AS rp, {_avg_rank('truth', 'taxon')} AS rt FROM t), c AS (SELECT taxon, quantile_cont(predicted, 0.9) AS cp, quantile_cont(truth, 0.9) AS ct FROM t GROUP BY 1)
 SELECT taxon, round(corr(rp, rt), 6) AS spearman, round(count(*) FILTER (WHERE truth >= ct AND predicted >= cp) / count(*) FILTER (WHERE truth >= ct)::DOUBLE, 6) AS top_share FROM k JOIN c USING (taxon) GROUP BY 1""",
)
def agg25(spark, d):
    out = A.truth_summary(_truth(spark, d), ["taxon"])
    return out.select("taxon", r("spearman").alias("spearman"), r("top_share").alias("top_share"))


@query(
    "agg26_compare_maps",
    f"""WITH {_TRUTH}, b AS (SELECT model, cell, predicted AS a, truth AS b FROM t WHERE cell % 4 <> 0), k AS (SELECT *, {_avg_rank('a', 'model')} AS ra, {_avg_rank('b', 'model')} AS rb, sum(a) OVER (PARTITION BY model) AS sa, sum(b) OVER (PARTITION BY model) AS sb FROM b)
 SELECT model, count(*) AS cells, round(corr(ra, rb), 6) AS spearman, round(1 - 0.5 * sum(abs(a / sa - b / sb)), 6) AS schoener_d FROM k GROUP BY 1""",
)
def agg26(spark, d):
    t = _truth(spark, d)
    out = A.compare_maps(t.select("model", "cell", F.col("predicted").alias("value")), t.where("cell % 4 <> 0").select("model", "cell", F.col("truth").alias("value")), ["model"])
    return out.select("model", "cells", r("spearman").alias("spearman"), r("schoener_d").alias("schoener_d"))


_ALIGNED = "al AS (SELECT scientific_name AS dna, CASE WHEN id % 17 <> 0 THEN CASE WHEN id % 6 = 0 THEN replace(scientific_name, ' ssp. ', ' subsp. ') WHEN id % 6 = 1 THEN concat(regexp_extract(scientific_name, '^[A-Z][a-z]+'), ' changed') WHEN id % 6 = 2 THEN 'Other name' ELSE scientific_name END END AS record FROM occ)"


@query("agg27_taxon_changes", f"{WITH_OCC}, {_ALIGNED} SELECT 'split' AS change, record AS name, count(DISTINCT dna) AS n FROM al WHERE record IS NOT NULL GROUP BY 2 HAVING count(DISTINCT dna) > 1 UNION ALL SELECT 'merged', dna, count(DISTINCT record) FROM al WHERE record IS NOT NULL GROUP BY 2 HAVING count(DISTINCT record) > 1")
def agg27(spark, d):
    return A.taxon_changes(aligned(spark, d))


@query("agg27_record_gains", f"{WITH_OCC}, {_ALIGNED} SELECT coalesce(a.name, b.name) AS name, coalesce(n1, 0) AS dna_records, coalesce(n2, 0) AS record_records, coalesce(n1, 0) - coalesce(n2, 0) AS gain FROM (SELECT dna AS name, count(*) AS n1 FROM al GROUP BY 1) a FULL JOIN (SELECT record AS name, count(*) AS n2 FROM al WHERE record IS NOT NULL GROUP BY 1) b ON a.name = b.name")
def agg27_gains(spark, d):
    return A.record_gains(aligned(spark, d))


_SCORED = "sp AS (SELECT o_orderpriority AS grade, o_orderstatus AS tier, CASE WHEN o_orderkey % 8 <> 0 THEN (o_custkey % 100) / 99.0::DOUBLE END AS rank, (o_custkey % 37) / 36.0::DOUBLE AS effort_rank FROM orders)"


def _scored_places(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("grade"), F.col("o_orderstatus").alias("tier"), F.when(k % 8 != 0, (c % 100) / 99.0).alias("rank"), ((c % 37) / 36.0).alias("effort_rank"))


@query(
    "agg28_place_metrics",
    f"WITH {_SCORED} SELECT grade, tier, count(*) AS places, count(rank) AS ranked, round(avg(CAST(rank >= 0.5 AS INT)), 6) AS top_half, round(avg(CAST(rank >= 0.9 AS INT)), 6) AS top_tenth, round(avg(rank), 6) AS mean_rank, round(avg(CAST(rank > effort_rank AS INT)), 6) AS beats_effort FROM sp GROUP BY GROUPING SETS ((grade), (tier), ())",
)
def agg28(spark, d):
    out = A.place_metrics(_scored_places(spark, d), ["grade", "tier"])
    return out.withColumns({c: r(c) for c in ("top_half", "top_tenth", "mean_rank", "beats_effort")})


_TRACK = "SELECT o_orderstatus AS release, CAST(o_custkey % 50 AS VARCHAR) AS taxon, o_custkey % 13 AS cell, o_orderkey AS find, o_orderpriority AS channel, CASE WHEN o_custkey % 3 = 0 THEN 'under_100' ELSE '100_500' END AS band, CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey % 100) / 99.0::DOUBLE END AS rank FROM orders"


@query(
    "agg29_tracker_summary",
    f"""WITH f AS ({_TRACK}), g AS (SELECT *, 'all' AS subset, 'all' AS value FROM f UNION ALL SELECT *, 'channel', channel FROM f UNION ALL SELECT *, 'band', band FROM f),
 u AS (SELECT *, row_number() OVER (PARTITION BY release, taxon, cell, subset, value ORDER BY find) = 1 AS unit FROM g),
 s AS (SELECT subset, value, count(*) FILTER (WHERE unit) AS places, count(*) AS finds, count(*) FILTER (WHERE unit AND rank IS NOT NULL) AS ranked, count(*) FILTER (WHERE unit AND rank >= 0.5) AS h FROM u GROUP BY 1, 2)
 SELECT subset, value, places, finds, ranked, CASE WHEN ranked >= 30 THEN round_even(h / ranked::DOUBLE, 3) END::DOUBLE AS top_half FROM s""",
)
def agg29(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    finds = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("release"), (c % 50).cast("string").alias("taxon"), (c % 13).alias("cell"), k.alias("find"), F.col("o_orderpriority").alias("channel"),
        F.when(c % 3 == 0, "under_100").otherwise("100_500").alias("band"), F.when(k % 8 != 0, (k % 100) / 99.0).alias("rank"),
    )
    return A.tracker_summary(finds).select("subset", "value", "places", "finds", "ranked", "top_half")


@query(
    "agg30_qa_report",
    f"""{WITH_OCC}, n AS (SELECT source AS detail, count(*)::DOUBLE AS value FROM occ GROUP BY 1), kd AS (SELECT scientific_name, count(*) AS c FROM occ WHERE {_KINGDOM} GROUP BY 1),
 q AS (SELECT 'sources' AS "check", detail, value FROM n UNION ALL SELECT 'keys', '', count(*) - count(DISTINCT concat(source, ':', observation_id)) FROM occ UNION ALL SELECT 'keys', 'numbers shared across sources', count(*) FILTER (WHERE s > 1) FROM (SELECT count(DISTINCT source) AS s FROM occ GROUP BY observation_id)
 UNION ALL SELECT 'place_centres', '', avg(CAST(latitude % 1 = 0 AS INT)) FROM occ UNION ALL SELECT 'uncached', '', 0 UNION ALL SELECT 'newest_green', '', date_diff('day', max(first_green_on), DATE '2002-01-01') FROM occ UNION ALL SELECT 'naming', '', 0
 UNION ALL SELECT 'kingdom_left_out', '', coalesce(sum(c), 0) FROM kd UNION ALL SELECT 'kingdom', '', coalesce(max(c), 0) FROM kd UNION ALL SELECT 'privacy_list', '', count(*) FROM occ WHERE id % 30 = 0 UNION ALL SELECT 'drop_list', '', count(*) FROM occ WHERE id % 31 = 0)
 SELECT "check", detail, round(value, 6) AS value, CASE WHEN "check" = 'sources' THEN value * 3 END::DOUBLE AS previous FROM q""",
)
def agg30(spark, d):
    o = occurrences(spark, d).withColumn("name_status", F.lit("same"))
    previous = o.groupBy(F.col("source").alias("detail")).agg((F.count("*") * 3).cast("double").alias("value")).withColumn("check", F.lit("sources"))
    out = A.qa_report(o, previous, _kingdoms(spark, d), o.where("id % 30 = 0"), o.where("id % 31 = 0"), "2002-01-01")
    return out.select("check", "detail", r("value").alias("value"), "previous")


@query("agg31_outcome_counts", "SELECT o_orderpriority AS band, o_orderstatus AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY 1, 2")
def agg31(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("band"), F.col("o_orderstatus").alias("status"))
    return A.outcome_counts(o, ["band"]).select("band", "status", "n", r("share").alias("share"))


@query("agg32_timing", "SELECT o_orderstatus AS algorithm, o_orderpriority AS machine, count(*) AS n, round(avg(o_totalprice), 3) AS mean_seconds, round(sum(o_totalprice) / 3600, 3) AS hours, round(sum(o_totalprice) / 3600 * 0.5, 3) AS cost FROM orders GROUP BY 1, 2")
def agg32(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("algorithm"), F.col("o_orderpriority").alias("machine"), F.col("o_totalprice").alias("seconds"))
    out = A.timing(o, o.select("machine").distinct().withColumn("per_hour", F.lit(0.5)))
    return out.select("algorithm", "machine", "n", r("mean_seconds", 3).alias("mean_seconds"), r("hours", 3).alias("hours"), r("cost", 3).alias("cost"))


@query("agg33_layer_coverage", "WITH s AS (SELECT l_partkey AS cell, count(*) AS records, max(CASE WHEN l_quantity > 10 THEN l_quantity END) AS base, max(CASE WHEN l_quantity > 45 THEN 1 END) AS n1, max(CASE WHEN l_discount > 0.08 THEN 1 END) AS n2 FROM lineitem GROUP BY 1) SELECT 'n1' AS band, CAST(sum(records) FILTER (WHERE base IS NOT NULL AND n1 IS NULL) AS BIGINT) AS lost, CAST(sum(records) FILTER (WHERE base IS NOT NULL) AS BIGINT) AS described FROM s UNION ALL SELECT 'n2', CAST(coalesce(sum(records) FILTER (WHERE base IS NOT NULL AND n2 IS NULL), 0) AS BIGINT), CAST(sum(records) FILTER (WHERE base IS NOT NULL) AS BIGINT) FROM s")
def agg33(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cell")).agg(
        F.count("*").alias("records"), F.max(F.when(F.col("l_quantity") > 10, F.col("l_quantity"))).alias("base"), F.max(F.when(F.col("l_quantity") > 45, 1)).alias("n1"), F.max(F.when(F.col("l_discount") > 0.08, 1)).alias("n2")
    )
    return A.layer_coverage(s, ["n1", "n2"], ["base"])


def model_listing(spark, d):
    """Models from suppliers: metrics as JSON text, read back into the listing."""
    from rangeflow.functions.scalars import skill

    m = _metrics(spark, d)
    sk = skill(F.col("p"), F.col("reps"), F.col("boyce"))
    null = F.struct("design", F.col("p").alias("auc_p"), "reps", F.col("auc").alias("observed_auc"), F.lit(0.5).alias("auc_mean"), F.lit(0.05).alias("auc_sd"))
    text = F.to_json(F.struct(sk.alias("skill"), F.col("auc").alias("auc_mean"), "boyce", F.concat(F.lit("d"), F.col("s_suppkey").cast("string")).alias("built_at"), F.lit(20).alias("sites"), F.lit("f").alias("fingerprint"), null.alias("null")))
    rows = m.select((F.col("s_suppkey") % 25).cast("string").alias("taxon"), F.concat(F.lit("a"), F.floor(F.col("s_suppkey") / 25).cast("string")).alias("algorithm"), text.alias("metrics"))
    return A.model_index(rows)


_LISTING = f"ix AS (SELECT CAST(s_suppkey % 25 AS VARCHAR) AS taxon, concat('a', s_suppkey // 25) AS algorithm, {_GRADE} AS grade, auc, boyce, concat('d', s_suppkey) AS built_at, CASE WHEN {_SKILL} = 'failed' THEN 0 WHEN {_SKILL} = 'untested' THEN 0.5 WHEN {_GRADE} <> 'strong' THEN 0 ELSE round_even(0.4 + 0.6 * least(1.0, greatest(0.0, ((auc - 0.5) / 0.05 - 1.6448536269514722) / (5 - 1.6448536269514722))), 3) END::DOUBLE AS strength FROM ({_METRICS}))"


@query("agg34_model_index", f"WITH {_LISTING} SELECT taxon, algorithm, grade, auc, boyce, built_at, strength FROM ix")
def agg34(spark, d):
    return model_listing(spark, d).drop("sites", "fingerprint")


@query(
    "agg35_best_maps",
    f"""WITH {_LISTING}, en AS (SELECT taxon, count(*) AS m FROM ix WHERE grade = 'strong' AND algorithm <> 'a0' GROUP BY 1 HAVING count(*) >= 2), f AS (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY (grade = 'strong') DESC, strength DESC, auc DESC, algorithm) AS k FROM ix)
 SELECT f.taxon, CASE WHEN m IS NOT NULL THEN 'ensemble' WHEN grade = 'strong' THEN algorithm END AS map, CASE WHEN m IS NOT NULL OR grade = 'strong' THEN strength END AS strength, CASE WHEN m IS NOT NULL OR grade = 'strong' THEN NULL WHEN grade = 'untested' THEN 'not tested' WHEN grade = 'weak' THEN 'weak only' ELSE 'no model passed' END AS reason FROM f LEFT JOIN en USING (taxon) WHERE k = 1""",
)
def agg35(spark, d):
    ix = model_listing(spark, d)
    return A.best_maps(ix, ix.where("algorithm <> 'a0'").select("taxon", "algorithm"))


@query("agg36_breadth", f"SELECT model, round(avg(CAST(value / 110000 >= 0.5 AS INT)), 6) AS breadth FROM ({MAP_SQL}) GROUP BY 1")
def agg36(spark, d):
    return A.realised_breadth(map_values(spark, d).withColumn("habitat", F.col("value") / 110000), ["model"]).withColumn("breadth", r("breadth"))


@query("agg37_mapped_taxa", f"WITH {_LISTING} SELECT taxon, max(built_at) AS built_at, string_agg(DISTINCT algorithm, ',' ORDER BY algorithm) AS algorithms FROM ix WHERE grade = 'strong' GROUP BY 1")
def agg37(spark, d):
    return A.mapped_taxa(model_listing(spark, d))


@query("agg38_compare_results", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN 'a' END, CASE WHEN o_orderkey % 5 = 0 THEN 'b' END) AS differ, greatest(CASE WHEN o_orderkey % 7 = 0 THEN 2.0 ELSE 0 END, CASE WHEN o_orderkey % 5 = 0 THEN 3.0 ELSE 0 END)::DOUBLE AS largest FROM orders")
def agg38(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("a"), F.col("o_custkey").cast("double").alias("b"))
    k = F.col("o_orderkey")
    other = o.withColumns({"a": F.when(k % 7 == 0, F.col("a") + 2).otherwise(F.col("a")), "b": F.when(k % 5 == 0, F.col("b") - 3).otherwise(F.col("b"))})
    return A.compare_results(o, other, ["o_orderkey"], ["a", "b"])


