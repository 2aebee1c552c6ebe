"""Registered queries of windows, sampling, set and cell operators, learners and streams."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from rangeflow.functions import text as X
from rangeflow.operators import cells as C
from rangeflow.operators import setops as SO
from rangeflow.operators import topk as K
from rangeflow.operators import windows as W
from rangeflow.operators.lineage import checkpoint_folder, cut
from rangeflow.plans import learners as L
from rangeflow.plans import model as M
from rangeflow.plans.queries import _TAXA, _taxa, query, r
from rangeflow.plans.queries_aggs import _avg_rank
from rangeflow.plans.queries_joins import _CAND, _INDEX, _STATE, candidates
from rangeflow.plans.stand_ins import MAP_SQL, SCORED_SQL, WITH_OCC, WITH_POINTS, map_values, occurrences, points, scored_documents, table
from rangeflow.sources import tables as IO
from rangeflow.streaming import streams as T

# ---- windows ------------------------------------------------------------------


@query("win1_rank_scale", f"WITH v AS ({MAP_SQL}) SELECT model, cell, round(CASE WHEN n = 1 THEN 1 ELSE (ar - 1) / (n - 1) END::DOUBLE, 6) AS rank FROM (SELECT *, {_avg_rank('floor(value / 1000)', 'model')} AS ar, count(*) OVER (PARTITION BY model) AS n FROM v)")
def win1(spark, d):
    v = map_values(spark, d).withColumn("value", F.floor(F.col("value") / 1000))
    return W.rank_scale(v, "value", ["model"]).select("model", "cell", r("rank").alias("rank"))


_REFS = f"v AS (SELECT taxon, cell, CAST(floor(value / 500) AS BIGINT) AS value FROM ({MAP_SQL}))"


@query(
    "win2_percentile_in",
    f"""WITH {_REFS}, q AS (SELECT DISTINCT taxon, value FROM v WHERE cell % 2 = 0), rf AS (SELECT taxon, value, count(*) AS c FROM v WHERE cell % 2 = 1 GROUP BY 1, 2),
 p AS (SELECT q.taxon, q.value, coalesce(sum(c) FILTER (WHERE rf.value < q.value), 0) AS below, coalesce(sum(c) FILTER (WHERE rf.value = q.value), 0) AS eq, sum(c) AS n FROM q JOIN rf USING (taxon) GROUP BY 1, 2)
 SELECT taxon, value, round(least(1.0, greatest(0.0, (CASE WHEN eq > 0 THEN below + (eq - 1) / 2.0 ELSE below - 0.5 END) / (n - 1)))::DOUBLE, 6) AS percentile FROM p""".replace("q JOIN rf USING (taxon)", "q JOIN rf ON rf.taxon = q.taxon"),
)
def win2(spark, d):
    v = map_values(spark, d).select("taxon", "cell", F.floor(F.col("value") / 500).alias("value"))
    out = W.percentile_in(v.where("cell % 2 = 0").select("taxon", "value").distinct(), v.where("cell % 2 = 1"), ["taxon"])
    return out.select("taxon", "value", r("percentile").alias("percentile"))


@query(
    "win3_share_outranked",
    f"WITH {_REFS} SELECT q.taxon, q.value AS rank, round((coalesce(sum(c) FILTER (WHERE rf.value < q.value), 0) + coalesce(sum(c) FILTER (WHERE rf.value = q.value), 0) / 2.0) / sum(c), 6)::DOUBLE AS share FROM (SELECT DISTINCT taxon, value FROM v WHERE cell % 2 = 0) q JOIN (SELECT taxon, value, count(*) AS c FROM v WHERE cell % 2 = 1 GROUP BY 1, 2) rf ON rf.taxon = q.taxon GROUP BY 1, 2",
)
def win3(spark, d):
    v = map_values(spark, d).select("taxon", "cell", F.floor(F.col("value") / 500).alias("rank"))
    out = W.share_outranked(v.where("cell % 2 = 0").select("taxon", "rank").distinct(), v.where("cell % 2 = 1"), ["taxon"])
    return out.select("taxon", "rank", r("share").alias("share"))


@query("win3_histogram", f"SELECT taxon, CAST(least(100, floor(value / 105000 * 100) + 1) AS INT) AS bin, count(*) AS n FROM ({MAP_SQL}) GROUP BY 1, 2")
def win3_histogram(spark, d):
    return W.rank_histogram(map_values(spark, d).withColumn("rank", F.col("value") / 105000), ["taxon"])


@query("win4_first_of_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def win4(spark, d):
    return W.first_of_group(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("win5_latest_per_key", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def win5(spark, d):
    return W.latest_per_key(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("win6_auc", f"WITH s AS ({SCORED_SQL}) SELECT lang, round((sum(ar) FILTER (WHERE presence = 1) - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0), 6)::DOUBLE AS auc FROM (SELECT *, {_avg_rank('score', 'lang')} AS ar, count(*) FILTER (WHERE presence = 1) OVER (PARTITION BY lang) AS n1, count(*) FILTER (WHERE presence = 0) OVER (PARTITION BY lang) AS n0 FROM s) GROUP BY lang, n1, n0")
def win6(spark, d):
    return W.auc(scored_documents(spark, d), ["lang"]).withColumn("auc", r("auc"))


@query(
    "win7_sequential_p",
    """WITH n AS (SELECT o_custkey AS taxon, o_orderkey AS draw, o_totalprice AS null_score, 180000 + (o_custkey % 10) * 10000.0::DOUBLE AS observed FROM orders),
 s AS (SELECT *, sum(CAST(null_score >= observed AS INT)) OVER w AS above, row_number() OVER w AS k FROM n WINDOW w AS (PARTITION BY taxon ORDER BY draw)), g AS (SELECT taxon, min(k) FILTER (WHERE above >= 3) AS stop, max(above) AS above, count(*) AS n FROM s GROUP BY 1)
 SELECT taxon, round(CASE WHEN stop IS NOT NULL THEN 3.0 / stop ELSE (1 + above) / (1 + n)::DOUBLE END, 6)::DOUBLE AS p, coalesce(stop, n) AS draws FROM g""",
)
def win7(spark, d):
    n = table(spark, d, "orders").select(F.col("o_custkey").alias("taxon"), F.col("o_orderkey").alias("draw"), F.col("o_totalprice").alias("null_score"), (180000 + (F.col("o_custkey") % 10) * 10000.0).alias("observed"))
    return W.sequential_p(n, ["taxon"], 3).withColumn("p", r("p"))


@query(
    "win8_q_values",
    "WITH p AS (SELECT p_brand AS family, p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN (p_partkey * 37 % 997) / 1000.0::DOUBLE END AS p FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p) AS rk, count(p) OVER (PARTITION BY family) AS n FROM p) SELECT family, p_partkey, CASE WHEN p IS NOT NULL THEN round(least(1.0, min(p * n / rk) OVER (PARTITION BY family, p IS NULL ORDER BY rk DESC)), 6) END::DOUBLE AS q FROM k",
)
def win8(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(F.col("p_brand").alias("family"), "p_partkey", F.when(k % 10 != 0, (k * 37 % 997) / 1000.0).alias("p"))
    return W.q_values(p, ["family"]).select("family", "p_partkey", r("q").alias("q"))


@query("win9_spearman", f"SELECT l_returnflag, round(corr(ra, rb), 6) AS spearman FROM (SELECT l_returnflag, {_avg_rank('l_quantity', 'l_returnflag')} AS ra, {_avg_rank('l_discount', 'l_returnflag')} AS rb FROM lineitem) GROUP BY 1")
def win9(spark, d):
    return W.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount").withColumn("spearman", r("spearman"))


@query(
    "win10_boyce",
    f"""WITH s AS (SELECT lang, presence, ln(score + 1) AS score FROM ({SCORED_SQL})), e AS (SELECT lang, min(score) AS lo, max(score) AS hi, count(*) FILTER (WHERE presence = 1) AS n1, count(*) FILTER (WHERE presence = 0) AS n0 FROM s GROUP BY 1),
 w AS (SELECT e.*, range AS w, lo + (hi - 0.1::DOUBLE * (hi - lo) - lo) * range / 99 AS b, 0.1::DOUBLE * (hi - lo) AS sp FROM e, range(100)),
 k AS (SELECT w.lang, w.w, any_value(b + sp / 2) AS middle, (count(*) FILTER (WHERE presence = 1) / any_value(n1)::DOUBLE) / nullif(count(*) FILTER (WHERE presence = 0) / any_value(n0)::DOUBLE, 0) AS ratio FROM w JOIN s ON s.lang = w.lang AND score >= b AND score <= b + sp GROUP BY 1, 2)
 SELECT lang, round(corr(ra, rb), 4) AS boyce FROM (SELECT lang, {_avg_rank('middle', 'lang')} AS ra, {_avg_rank('ratio', 'lang')} AS rb FROM k WHERE ratio IS NOT NULL) GROUP BY 1""",
)
def win10(spark, d):
    s = scored_documents(spark, d).withColumn("score", F.log(F.col("score") + 1))
    return W.boyce(s, ["lang"]).withColumn("boyce", r("boyce", 4))


@query(
    "win10_boyce_of_ranks",
    f"""WITH h AS (SELECT taxon, CAST(least(100, floor(value / 105000 * 100) + 1) AS INT) AS bin, count(*) AS n FROM ({MAP_SQL}) GROUP BY 1, 2), t AS (SELECT taxon, sum(n) AS n FROM h GROUP BY 1),
 k AS (SELECT t.taxon, g.range AS bin, coalesce(sum(h.n), 0) / any_value(t.n) / 0.1::DOUBLE AS ratio FROM t CROSS JOIN range(1, 92) g LEFT JOIN h ON h.taxon = t.taxon AND h.bin BETWEEN g.range AND g.range + 9 GROUP BY 1, 2)
 SELECT taxon, round_even(corr(rr, bin), 3)::DOUBLE AS boyce FROM (SELECT *, {_avg_rank('round(ratio, 9)', 'taxon')} AS rr FROM k) GROUP BY 1""",
)
def win10_ranks(spark, d):
    return W.boyce_of_ranks(W.rank_histogram(map_values(spark, d).withColumn("rank", F.col("value") / 105000), ["taxon"]), ["taxon"])


@query("win11_quantile_gap", "SELECT l_returnflag, round(list_avg([abs(a[i] - b[i]) FOR i IN range(1, 1001)]), 4) AS gap FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, [(k + 0.5) / 1000 FOR k IN range(1000)]) FILTER (WHERE l_linestatus = 'F') AS a, quantile_cont(l_extendedprice, [(k + 0.5) / 1000 FOR k IN range(1000)]) FILTER (WHERE l_linestatus <> 'F') AS b FROM lineitem GROUP BY 1)")
def win11(spark, d):
    l = table(spark, d, "lineitem").withColumn("side", F.col("l_linestatus") == "F")
    return W.quantile_gap(l, ["l_returnflag"], "l_extendedprice", "side").withColumn("gap", r("gap", 4))


@query("win12_keyset_windows", "WITH b AS (SELECT CAST(max(o_orderkey) AS BIGINT) AS bound FROM orders GROUP BY o_orderkey // 1000) SELECT coalesce(lag(bound) OVER (ORDER BY bound), 0) AS after, bound AS through FROM b UNION ALL SELECT max(bound), NULL FROM b")
def win12(spark, d):
    b = table(spark, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("page")).agg(F.max("o_orderkey").alias("bound")).select("bound")
    return W.keyset_windows(b)


def _ledger(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    ledger = o.where("o_orderkey % 3 = 0").select(k.alias("record"), F.col("o_orderpriority").alias("taxon"), (F.col("o_custkey") % 100).alias("cell"), F.when(k % 11 == 0, F.lit("1999-01-01").cast("date")).alias("retracted_on"))
    now = o.where("o_orderkey % 5 <> 0").select(k.alias("record"), F.when(k % 4 == 0, "renamed").otherwise(F.col("o_orderpriority")).alias("taxon"), (F.col("o_custkey") % 100 + F.when(k % 9 == 0, 1).otherwise(0)).alias("cell"))
    return ledger, now


_LEDGER = "SELECT o_orderkey AS record, CASE WHEN o_orderkey % 5 = 0 THEN 'gone' WHEN o_orderkey % 4 = 0 THEN 'renamed' WHEN o_orderkey % 9 = 0 THEN 'moved' END AS reason, CASE WHEN o_orderkey % 11 = 0 THEN '1999-01-01' ELSE '2000-01-01' END AS day FROM orders WHERE o_orderkey % 3 = 0"


@query("win13_retraction", f"SELECT record, reason, CASE WHEN reason IS NOT NULL THEN day END AS retracted_on FROM ({_LEDGER})")
def win13(spark, d):
    ledger, now = _ledger(spark, d)
    return W.retraction_state(ledger, now, "2000-01-01").select("record", "reason", F.col("retracted_on").cast("string").alias("retracted_on"))


# ---- sampling and top-k -----------------------------------------------------------


@query(
    "top1_search",
    f"""{WITH_OCC}, t AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(scientific_name), '[^a-z0-9]+', ' ', 'g'), ' (ssp|sp) ', ' ', 'g'), ' +', ' ', 'g')) AS key FROM ({_TAXA})),
 k AS (SELECT *, CASE WHEN key = 'amycota a' THEN 1 WHEN starts_with(key, 'amycota a') THEN 2 WHEN len(list_filter(string_split(key, ' '), lambda x: starts_with(x, 'amycota'))) > 0 AND len(list_filter(string_split(key, ' '), lambda x: starts_with(x, 'a'))) > 0 THEN 3 WHEN contains(key, 'amycota a') THEN 4 END AS tier, len(string_split(key, ' ')) - 2 AS extra FROM t)
 SELECT scientific_name, records, localities, ['exact', 'prefix', 'words', 'contains'][tier] AS match FROM k WHERE tier IS NOT NULL ORDER BY tier, NOT starts_with(key, 'amycota'), extra, localities DESC, scientific_name LIMIT 10""",
)
def top1(spark, d):
    return K.search(_taxa(spark, d), "Amycota a")


@query("top1_search_genera", f"{WITH_OCC} SELECT regexp_extract(scientific_name, '^[A-Za-z]+') AS genus, count(*) AS taxa, CAST(sum(records) AS BIGINT) AS records FROM ({_TAXA}) WHERE starts_with(lower(scientific_name), 'bmy') GROUP BY 1")
def top1_genera(spark, d):
    return K.search_genera(_taxa(spark, d), "bmy")


@query("top2_per_point", "SELECT l_suppkey, l_partkey, p, CAST(place AS INT) AS place FROM (SELECT l_suppkey, l_partkey, max(l_extendedprice) AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS place FROM lineitem GROUP BY 1, 2) WHERE place <= 5")
def top2(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("p"))
    return K.top_per_point(g, 5, ["l_suppkey"], [F.desc("p"), F.asc("l_partkey")])


@query("top3_stratified_sample", "SELECT c_custkey, c_mktsegment AS stratum, n / least(n, 7)::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat('1:', c_custkey)), c_custkey) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE k <= 7")
def top3(spark, d):
    return K.stratified_sample(table(spark, d, "customer"), 7, 1, F.col("c_mktsegment"), "c_custkey").select("c_custkey", "stratum", "weight")


@query(
    "top4_weighted_sample",
    "WITH s AS (SELECT c_mktsegment AS taxon, c_custkey AS site, 1 + c_custkey % 9 AS w, (CAST(concat('0x', substr(sha256(concat('1:', c_mktsegment, ':', c_custkey)), 1, 12)) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM customer) SELECT taxon, site FROM s QUALIFY row_number() OVER (PARTITION BY taxon ORDER BY -ln(u) / w, site) <= 10",
)
def top4(spark, d):
    s = table(spark, d, "customer").select(F.col("c_mktsegment").alias("taxon"), F.col("c_custkey").alias("site"), (1 + F.col("c_custkey") % 9).alias("w"))
    return K.weighted_sample(s, 10, 1, ["taxon"], "site", "w").select("taxon", "site")


@query("top5_background_sample", "SELECT c_mktsegment AS taxon, c_custkey AS cell FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat('3:', c_custkey)), c_custkey) <= 20")
def top5(spark, d):
    return K.background_sample(table(spark, d, "customer").select(F.col("c_mktsegment").alias("taxon"), F.col("c_custkey").alias("cell")), 20, 3)


def _sites(spark, d):
    p = points(spark, d).where("cell20 is not null").groupBy(F.col("cell20").alias("site"))
    return p.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("records"))


def _found(spark, d):
    """Sites with records, those of a square of 300 km as one taxon."""
    square = F.concat_ws(":", F.floor(F.col("x") / 3e5), F.floor(F.col("y") / 3e5))
    return _sites(spark, d).select(square.alias("taxon"), "site", "x", "y")


_FOUND = f"""{WITH_POINTS}, si AS (SELECT cell20 AS site, avg(x) AS x, avg(y) AS y FROM pts WHERE cell20 IS NOT NULL GROUP BY 1),
 fo AS (SELECT concat_ws(':', CAST(floor(x / 3e5) AS BIGINT), CAST(floor(y / 3e5) AS BIGINT)) AS taxon, site, x, y FROM si)"""


@query(
    "top6_snap_to_sites",
    f"""{_FOUND.replace("WITH ", "WITH RECURSIVE ", 1)}, mo AS (SELECT taxon, site AS from_site, x + 41000 AS x, y - 37000 AS y,
  row_number() OVER (PARTITION BY taxon ORDER BY substr(sha256(concat_ws(':', taxon, site, 'order')), 1, 12)) AS k FROM fo),
 wa AS (SELECT DISTINCT taxon, 0::BIGINT AS k, NULL::BIGINT AS from_site, NULL::BIGINT AS site, 0.0::DOUBLE AS d2, []::BIGINT[] AS used FROM mo
  UNION ALL SELECT taxon, k, any_value(from_site), arg_min(site, (d2, site)), min(d2), list_append(any_value(used), arg_min(site, (d2, site))) FROM (
   SELECT w.taxon, m.k, m.from_site, s.site, pow(s.x - m.x, 2) + pow(s.y - m.y, 2) AS d2, w.used FROM wa w JOIN mo m ON m.taxon = w.taxon AND m.k = w.k + 1
    JOIN fo s ON s.taxon = w.taxon AND NOT list_contains(w.used, s.site)) GROUP BY taxon, k)
 SELECT taxon, from_site, site, d2 > 625000000.0::DOUBLE AS far FROM wa WHERE k > 0""",
)
def top6_snap(spark, d):
    """Every taxon's sites, moved aside, snapped back to its sites one to one in turn."""
    found = _found(spark, d)
    moved = found.select("taxon", F.col("site").alias("from_site"), (F.col("x") + 41000).alias("x"), (F.col("y") - 37000).alias("y"))
    return K.snap_to_sites(moved, cut(found.withColumn("weight", F.lit(1))), ["taxon"], ["taxon"]).select("taxon", "from_site", "site", "far")


@query("top6_shifted_null")
def top6(spark, d):
    sites = _sites(spark, d)
    return K.shifted_null(_found(spark, d), sites, 3)


@query("top6_shifted_null_effort")
def top6_effort(spark, d):
    return K.shifted_null(_found(spark, d), _sites(spark, d), 3, effort=True)


@query(
    "top7_bootstrap",
    """WITH s AS (SELECT p_brand AS taxon, count(*) AS c, sum(p_retailprice) AS v FROM part GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY taxon) AS i, count(*) OVER () AS n FROM s),
 sl AS (SELECT rep.range AS rep, slot.range AS slot FROM range(1, 201) rep, range(1, (SELECT count(*) + 1 FROM s)) slot),
 dr AS (SELECT rep, CAST(floor((CAST(concat('0x', substr(sha256(concat('1:', rep, ':', slot)), 1, 12)) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE * (SELECT max(n) FROM k)) + 1 AS BIGINT) AS i FROM sl),
 m AS (SELECT rep, sum(v) / sum(c) AS v FROM dr JOIN k USING (i) GROUP BY 1) SELECT 'p_retailprice' AS value, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.975), 4) AS high, quantile_cont(v, 0.025) > 0 AS above_zero FROM m""",
)
def top7(spark, d):
    out = K.cluster_bootstrap(table(spark, d, "part"), "p_brand", ["p_retailprice"], 200)
    return out.select("value", r("mean", 4).alias("mean"), r("low", 4).alias("low"), r("high", 4).alias("high"), "above_zero")


# ---- sets -------------------------------------------------------------------------


@query("set1_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set1(spark, d):
    return SO.union_distinct(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("set2_gained_lost", "(SELECT DISTINCT p_partkey % 100 AS k, 'gained' AS change FROM part WHERE p_size < 3 AND p_partkey % 100 NOT IN (SELECT p_partkey % 100 FROM part WHERE p_size > 48)) UNION ALL (SELECT DISTINCT p_partkey % 100, 'lost' FROM part WHERE p_size > 48 AND p_partkey % 100 NOT IN (SELECT p_partkey % 100 FROM part WHERE p_size < 3))")
def set2(spark, d):
    p = table(spark, d, "part").withColumn("k", F.col("p_partkey") % 100)
    return SO.gained_lost(p.where("p_size > 48"), p.where("p_size < 3"), "k")


@query("set3_changed_in_both", "WITH a AS (SELECT DISTINCT p_brand AS name, p_partkey AS rec FROM part WHERE p_size < 40), b AS (SELECT DISTINCT p_brand AS name, p_partkey AS rec FROM part WHERE p_size > 5) SELECT DISTINCT name FROM (SELECT * FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a))) WHERE name IN (SELECT name FROM a) AND name IN (SELECT name FROM b)")
def set3(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("rec"), "p_size")
    return SO.changed_in_both(p.where("p_size < 40"), p.where("p_size > 5"), "name", "rec")


@query(
    "set4_replace_rows",
    f"WITH cand AS ({_CAND}), idx AS ({_INDEX}) SELECT taxon, fingerprint, false AS refit_failed FROM cand WHERE CAST(taxon AS BIGINT) % 6 = 1 UNION ALL SELECT taxon, fingerprint, CAST(taxon AS BIGINT) % 8 = 0 FROM idx WHERE taxon NOT IN (SELECT taxon FROM cand WHERE CAST(taxon AS BIGINT) % 6 = 1) AND CAST(taxon AS BIGINT) % 10 <> 0",
)
def set4(spark, d):
    cand, index, _ = candidates(spark, d)
    k = F.col("taxon").cast("bigint")
    cols = ["taxon", "algorithm", "fingerprint", "settings"]
    out = SO.replace_rows(index, cand.where(k % 6 == 1).select(*cols), ["taxon", "algorithm"], index.where(k % 10 == 0), index.where(k % 8 == 0))
    return out.select("taxon", "fingerprint", "refit_failed")


@query("set5_pool_check", "SELECT (SELECT 40 - count(DISTINCT o_custkey % 40 + 1) FROM orders WHERE o_custkey % 40 <> 7) AS missing, (SELECT count(*) FROM (SELECT o_custkey % 40 FROM orders WHERE o_custkey % 40 <> 7 GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)) AS doubled, true AS agree, count(*) AS rows FROM orders WHERE o_custkey % 40 <> 7")
def set5(spark, d):
    o = table(spark, d, "orders").where("o_custkey % 40 <> 7").select((F.col("o_custkey") % 40 + 1).alias("shard"), F.col("o_orderstatus").alias("file"), F.lit("s").alias("settings"))
    return SO.check_pool(o, 40)


@query("set6_split_agreement", "SELECT o_orderkey AS record, 'missing' AS problem FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 31 = 0 UNION ALL SELECT o_orderkey, 'extra' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 37 = 0 UNION ALL SELECT o_orderkey, 'leaked' FROM orders WHERE (o_orderkey % 2 = 0 AND o_orderkey % 31 <> 0 OR o_orderkey % 2 = 1 AND o_orderkey % 37 = 0) AND o_orderkey % 41 = 0")
def set6(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "record")
    train = o.where("record % 2 = 0 and record % 31 <> 0 or record % 2 = 1 and record % 37 = 0")
    return SO.split_agreement(train, o.where("record % 2 = 0"), o.where("record % 41 = 0"))


@query("set7_refit_plan", f"WITH cand AS ({_CAND}), idx AS ({_INDEX}), {_STATE} SELECT taxon, state AS reason FROM st WHERE state IN ('new', 'changed') UNION ALL SELECT taxon, 'touched' FROM st WHERE state = 'current' AND CAST(taxon AS BIGINT) % 16 = 1")
def set7(spark, d):
    cand, index, failed = candidates(spark, d)
    touched = cand.where(F.col("taxon").cast("bigint") % 16 == 1).select("taxon", F.lit("touched").alias("reason"))
    return SO.refit_plan(cand, index, failed, touched).select("taxon", "reason")


@query("set7_retired", f"WITH cand AS ({_CAND}), idx AS ({_INDEX}) SELECT taxon FROM idx WHERE taxon NOT IN (SELECT taxon FROM cand)")
def set7_retired(spark, d):
    cand, index, _ = candidates(spark, d)
    return SO.retired_models(cand, index).select("taxon")


# ---- cells --------------------------------------------------------------------------


_GRID = "gr AS (SELECT CAST(p_partkey // 50 AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS elevation, p_size FROM part)"


def _grid(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), F.when(k % 7 != 0, F.col("p_retailprice")).alias("elevation"), "p_size")


@query("cel1_coarsen", f"WITH {_GRID} SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round(avg(elevation), 4) AS elevation FROM gr GROUP BY 1, 2")
def cel1(spark, d):
    return C.coarsen(_grid(spark, d), 4, ["elevation"]).select("row", "col", r("elevation", 4).alias("elevation"))


@query("cel1_class_shares", f"WITH {_GRID} SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round(avg(CAST(p_size IN (1, 2, 3, 4, 5) AS INT)), 6) AS small, round(avg(CAST(p_size IN (46, 47, 48, 49, 50) AS INT)), 6) AS large FROM gr GROUP BY 1, 2")
def cel1_classes(spark, d):
    out = C.class_shares(_grid(spark, d), 4, "p_size", {"small": [1, 2, 3, 4, 5], "large": [46, 47, 48, 49, 50]})
    return out.select("row", "col", r("small").alias("small"), r("large").alias("large"))


@query("cel2_crop", f"{WITH_POINTS} SELECT id FROM pts WHERE x BETWEEN -1000000 AND 505000 AND y BETWEEN 0 AND 1000000")
def cel2(spark, d):
    return C.crop(points(spark, d), (-998_000, 501_000), (1_000, 999_000), 5_000).select("id")


_TWO = "WITH a AS (SELECT p_partkey AS cell, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS v FROM part), b AS (SELECT p_partkey AS cell, CASE WHEN p_partkey % 6 <> 0 THEN p_size * 1.0::DOUBLE END AS v FROM part WHERE p_partkey % 5 <> 0)"


def _two(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    a = p.select(k.alias("cell"), F.when(k % 3 != 0, F.col("p_retailprice")).alias("v"))
    return a, p.where(k % 5 != 0).select(k.alias("cell"), F.when(k % 6 != 0, F.col("p_size").cast("double")).alias("v"))


@query("cel3_supplement", f"{_TWO} SELECT a.cell, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 0 END AS known FROM a LEFT JOIN b USING (cell)")
def cel3(spark, d):
    return C.supplement(*_two(spark, d), ["v"])


@query("cel4_fill_near", f"WITH {_GRID}, nb AS (SELECT a.row, a.col, avg(b.elevation) AS m FROM gr a JOIN gr b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND NOT (a.row = b.row AND a.col = b.col) GROUP BY 1, 2) SELECT gr.row, gr.col, round(coalesce(elevation, CASE WHEN p_size > 10 THEN m END), 4) AS elevation FROM gr LEFT JOIN nb ON nb.row = gr.row AND nb.col = gr.col")
def cel4(spark, d):
    g = _grid(spark, d).withColumn("land", F.col("p_size") > 10)
    return C.fill_near(g, "elevation", 1).select("row", "col", r("elevation", 4).alias("elevation"))


@query("cel5_fill_outside", "SELECT p_partkey AS cell, CASE WHEN p_size > 10 THEN CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice ELSE 0 END END::DOUBLE AS v, CASE WHEN p_size > 10 THEN CAST(p_partkey % 3 <> 0 AS INT) END AS known FROM part")
def cel5(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("cell"), F.col("p_retailprice").alias("v"), (k % 3 != 0).alias("described"), (F.col("p_size") > 10).alias("land"))
    return C.fill_outside(p, ["v"]).select("cell", "v", "known")


@query("cel6_mosaic", f"{_TWO} SELECT coalesce(a.cell, b.cell) AS cell, CASE WHEN a.cell IS NOT NULL AND (b.cell IS NULL OR a.cell % 2 = 0) THEN a.v ELSE b.v END AS v FROM (SELECT * FROM a WHERE cell % 4 <> 1) a FULL JOIN b ON a.cell = b.cell")
def cel6(spark, d):
    a, b = _two(spark, d)
    return C.mosaic(a.where("cell % 4 <> 1"), b, ["v"], F.col("cell") % 2 == 0)


def _z(i: int, j: int) -> str:
    return f"coalesce((SELECT coalesce(elevation, 0) FROM gr n WHERE n.row = gr.row + ({i}) AND n.col = gr.col + ({j})), 0)"


_DX = f"((({_z(-1, 1)}) + 2 * ({_z(0, 1)}) + ({_z(1, 1)})) - (({_z(-1, -1)}) + 2 * ({_z(0, -1)}) + ({_z(1, -1)}))) / 8000"
_DY = f"((({_z(1, -1)}) + 2 * ({_z(1, 0)}) + ({_z(1, 1)})) - (({_z(-1, -1)}) + 2 * ({_z(-1, 0)}) + ({_z(-1, 1)}))) / 8000"
_ROUGH = " + ".join(f"abs({_z(i, j)} - elevation)" for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)


@query("cel7_terrain", f"WITH {_GRID} SELECT row, col, CASE WHEN elevation IS NOT NULL THEN round(degrees(atan(sqrt(pow({_DX}, 2) + pow({_DY}, 2)))), 5) END AS slope, CASE WHEN elevation IS NOT NULL THEN round(({_ROUGH}) / 8, 4) END AS roughness FROM gr")
def cel7(spark, d):
    out = C.terrain(_grid(spark, d))
    return out.select("row", "col", r("slope", 5).alias("slope"), r("roughness", 4).alias("roughness"))


@query(
    "cel8_mask_to_area",
    f"""{WITH_POINTS}, s AS (SELECT cell20 AS cell, avg(x) AS x, avg(y) AS y FROM pts WHERE cell20 IS NOT NULL GROUP BY 1),
 det AS (SELECT DISTINCT regexp_extract(scientific_name, '^[A-Z][a-z]+') AS taxon, x, y FROM pts WHERE cell20 IS NOT NULL)
 SELECT DISTINCT d.taxon, s.cell FROM det d JOIN s ON pow(d.x - s.x, 2) + pow(d.y - s.y, 2) <= 60000.0::DOUBLE * 60000""",
)
def cel8(spark, d):
    """All cells, masked to 60 km around all records of each genus."""
    s = _sites(spark, d).select(F.col("site").alias("cell"), "x", "y")
    found = points(spark, d).where("cell20 is not null").select(X.taxon_genus("scientific_name").alias("taxon"), "x", "y")
    return C.mask_to_area(s, found, 60).select("taxon", "cell")


@query(
    "cel8_full_extent",
    f"{WITH_POINTS}, s AS (SELECT cell20 AS cell, avg(x) AS x, avg(y) AS y FROM pts WHERE cell20 IS NOT NULL GROUP BY 1), t AS (SELECT CAST(cell % 3 AS VARCHAR) AS taxon, * FROM s)"
    " SELECT DISTINCT t.taxon, a.cell FROM s a JOIN t ON pow(a.x - t.x, 2) + pow(a.y - t.y, 2) <= 200000.0::DOUBLE * 200000 WHERE NOT (CAST(a.cell % 3 AS VARCHAR) = t.taxon AND a.cell % 2 = 0)",
)
def cel8_rest(spark, d):
    """Cells near three taxa's sites; a taxon's own even cells are scored already."""
    s = _sites(spark, d).select(F.col("site").alias("cell"), "x", "y")
    found = s.withColumn("taxon", (F.col("cell") % 3).cast("string"))
    return C.full_extent(found.where("cell % 2 = 0"), s, found, 200).select("taxon", "cell")


@query("cel9_manifest", "SELECT p_brand AS layer, CASE WHEN p_brand < 'Brand#3' THEN 'new' ELSE max(p_type) END AS build FROM part GROUP BY 1")
def cel9(spark, d):
    m = table(spark, d, "part").groupBy(F.col("p_brand").alias("layer")).agg(F.max("p_type").alias("build"))
    return C.upsert_manifest(m, m.where("layer < 'Brand#3'").withColumn("build", F.lit("new")))


@query("cel9_layers_key", "SELECT sha256(string_agg(concat(layer, '=', build), ';' ORDER BY concat(layer, '=', build))) AS key FROM (SELECT p_brand AS layer, max(p_type) AS build FROM part GROUP BY 1)")
def cel9_key(spark, d):
    return C.layers_key(table(spark, d, "part").groupBy(F.col("p_brand").alias("layer")).agg(F.max("p_type").alias("build")))


# ---- learners -------------------------------------------------------------------------

BANDS = ["b1", "b2", "b3"]


def training(spark, d):
    """Sites with bands that depend on their place, and detections of three taxa."""
    p = points(spark, d).where("cell20 is not null")
    sites = p.groupBy(F.col("cell20").alias("site")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("records"), F.avg("price").alias("b3"))
    sites = sites.withColumns({"b1": F.col("x") / 1e6, "b2": F.col("y") / 1e6 + F.col("b3") / 1e6})
    found = p.join(sites.select("site", "b1"), F.col("site") == F.col("cell20"))
    taxon = F.element_at(F.array(F.lit("east"), F.lit("west"), F.lit("any")), (F.col("id") % 3 + 1).cast("int"))
    seen = (taxon == "any") | ((taxon == "east") & (F.col("b1") > 0)) | ((taxon == "west") & (F.col("b1") < -1))
    pts = found.withColumn("taxon", taxon).where(seen).select("taxon", "site")
    return cut(M.training_table(pts, cut(sites), BANDS))


#: The training table as SQL, the same as ``training``.  The equality in ``reach`` always holds: DuckDB's join without one fails now and then.
_SITES_T = """pp AS MATERIALIZED (SELECT id, x, y, price, cell20 FROM pts WHERE cell20 IS NOT NULL),
 st AS (SELECT site, x, y, records, x / 1e6 AS b1, y / 1e6 + b3 / 1e6 AS b2, b3 FROM (SELECT cell20 AS site, avg(x) AS x, avg(y) AS y, count(*) AS records, avg(price) AS b3
 FROM pp GROUP BY 1))"""
_TRAIN = f"""{WITH_POINTS}, {_SITES_T},
 own AS (SELECT tx, site, count(*) AS own FROM (SELECT id % 3 AS tx, site, b1 FROM pp JOIN st ON site = cell20)
  WHERE tx = 2 OR (tx = 0 AND b1 > 0) OR (tx = 1 AND b1 < -1) GROUP BY ALL),
 reach AS (SELECT DISTINCT o.tx, a.site FROM own o JOIN st s ON s.site = o.site JOIN st a ON (a.records > 0) = (s.records > 0) AND pow(a.x - s.x, 2) + pow(a.y - s.y, 2) <= 500000.0::DOUBLE * 500000),
 bg AS (SELECT tx, site, row_number() OVER (PARTITION BY tx ORDER BY md5(concat('1:', site)), site) AS k FROM reach ANTI JOIN own USING (tx, site)),
 tr AS (SELECT CASE tx WHEN 0 THEN 'east' WHEN 1 THEN 'west' ELSE 'any' END AS taxon, site, presence, x, y, ln(records - own + 1) AS effort, records, b1, b2, b3
  FROM (SELECT tx, site, 1 AS presence, own FROM own UNION ALL SELECT tx, site, 0, 0 FROM bg WHERE k <= 10000) JOIN st USING (site))"""


@query("mod1_training_table", f"{_TRAIN} SELECT taxon, site, presence, records, round(x, 2) AS x, round(y, 2) AS y, round(effort, 6) AS effort, round(b1, 6) AS b1, round(b2, 6) AS b2, round(b3 * records, 2) AS b3_total FROM tr")
def mod1(spark, d):
    rounded = [r(c, n).alias(c) for c, n in (("x", 2), ("y", 2), ("effort", 6), ("b1", 6), ("b2", 6))]
    return training(spark, d).select("taxon", "site", "presence", "records", *rounded, r(F.col("b3") * F.col("records"), 2).alias("b3_total"))


@query(
    "mod2_effort_designs",
    f"""{_TRAIN}, m AS (SELECT taxon, presence, sum(least(25, greatest(1, records))) AS rows FROM tr GROUP BY ALL)
 SELECT taxon, presence, CAST(rows AS BIGINT) AS rows, round(sum(rows) OVER (PARTITION BY taxon) / 2.0::DOUBLE, 3) AS weight FROM m""",
)
def mod2(spark, d):
    t = training(spark, d)
    return M.balanced_weights(M.effort_mode(M.design_rows(t, "per-record"), "covariate"), ["taxon"]).groupBy("taxon", "presence").agg(F.count("*").alias("rows"), r(F.sum("weight"), 3).alias("weight"))


#: The deal of blocks to folds as a walk over each taxon's blocks, with the folds' loads as lists.
_FOLDS = """bl AS (SELECT *, concat(CAST(floor(x / 200000.0) AS BIGINT), ':', CAST(floor(y / 200000.0) AS BIGINT)) AS block FROM tr),
 bn AS (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY -found, md5(concat('1:', block)), block) AS n FROM (SELECT taxon, block, CAST(sum(presence) AS INT) AS found FROM bl GROUP BY ALL)),
 deal(taxon, n, block, fold, loads, sizes) AS (SELECT DISTINCT taxon, 0::BIGINT, ''::VARCHAR, 0::INT, [0, 0, 0, 0, 0]::INT[], [0, 0, 0, 0, 0]::INT[] FROM bn
  UNION ALL SELECT taxon, n, block, fold, list_transform(loads, lambda v, i: CASE WHEN i = fold THEN v + found ELSE v END), list_transform(sizes, lambda v, i: CASE WHEN i = fold THEN v + 1 ELSE v END)
   FROM (SELECT b.taxon, b.n, b.block, b.found, loads, sizes, CAST(CASE WHEN b.found > 0 THEN list_position(loads, list_min(loads)) ELSE list_position(sizes, list_min(sizes)) END AS INT) AS fold
    FROM deal q JOIN bn b ON b.taxon = q.taxon AND b.n = q.n + 1)),
 fo AS (SELECT bl.*, deal.fold FROM bl JOIN deal ON deal.taxon = bl.taxon AND deal.block = bl.block AND deal.n > 0)"""
_TRAIN_FOLDS = f"{_TRAIN.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_FOLDS}"


@query("mod3_spatial_folds", f"{_TRAIN_FOLDS} SELECT taxon, site, block, fold FROM fo")
def mod3(spark, d):
    return M.spatial_folds(training(spark, d)).select("taxon", "site", "block", "fold")


@query(
    "mod3_block_size",
    f"""{_TRAIN}, sa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY md5(concat('1:', site)), site) AS k FROM tr) WHERE k <= 400),
 vg AS (SELECT taxon, floor(sqrt(d2) / 25000.0) * 25.0 + 25.0 AS km, avg(pow(v - w, 2)) / 2 AS gamma FROM (SELECT a.taxon, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS d2, a.b2 AS v, b.b2 AS w FROM sa a JOIN sa b ON a.taxon = b.taxon AND a.site < b.site)
  WHERE d2 <= 400000.0::DOUBLE * 400000 GROUP BY 1, 2)
 SELECT taxon, CAST(least(300.0, greatest(50.0, round_even(min(km) FILTER (WHERE gamma >= 0.95 * sill) / 5, 0) * 5)) AS DOUBLE) AS block_km FROM (SELECT *, max(gamma) OVER (PARTITION BY taxon) AS sill FROM vg) GROUP BY 1""",
)
def mod3_block(spark, d):
    return M.block_size(M.variogram(training(spark, d), "b2"))


_FIVE = [*BANDS, "b4", "b5"]


def _keep_sql(most: str) -> str:
    """The greedy keep of five bands, one common table per band."""
    stats = ", ".join([*[f"coalesce(stddev_samp({b}), 0) AS s_{b}" for b in _FIVE], *[f"abs(corr({a}, {b})) AS c_{a}_{b}" for k, b in enumerate(_FIVE) for a in _FIVE[:k]]])
    sql, last = f"k0 AS (SELECT taxon, count(*) FILTER (WHERE presence = 1) AS found, {stats} FROM t5 GROUP BY 1)", "k0"
    for k, b in enumerate(_FIVE):
        apart = "".join(f" AND NOT (k_{a} AND NOT coalesce(c_{a}_{b} < 0.7, false))" for a in _FIVE[:k])
        n = " + ".join([f"k_{a}::INT" for a in _FIVE[:k]] or ["0"])
        sql += f", k{k + 1} AS (SELECT *, s_{b} > 0 AND {n} < {most}{apart} AS k_{b} FROM {last})"
        last = f"k{k + 1}"
    return sql + ", kept AS (" + " UNION ALL ".join(f"SELECT taxon, '{b}' AS band FROM {last} WHERE k_{b}" for b in _FIVE) + ")"


@query("mod4_pruned_predictors", f"{_TRAIN}, t5 AS (SELECT 'all' AS taxon, presence, b1, b2, b3, b1 * 2 AS b4, 1.0 AS b5 FROM tr), {_keep_sql('99')} SELECT band FROM kept")
def mod4(spark, d):
    t = training(spark, d).withColumns({"b4": F.col("b1") * 2, "b5": F.lit(1.0)})
    return spark.createDataFrame([(b,) for b in M.prune_correlated(t, _FIVE)], "band string")


@query("mod4_pruned_by_taxon", f"{_TRAIN}, t5 AS (SELECT taxon, presence, b1, b2, b3, b1 * 2 AS b4, 1.0 AS b5 FROM tr), {_keep_sql('greatest(5, found // 4)')} SELECT taxon, band FROM kept")
def mod4_taxa(spark, d):
    t = training(spark, d).withColumns({"b4": F.col("b1") * 2, "b5": F.lit(1.0)})
    return M.prune_by_taxon(t, _FIVE).select("taxon", F.explode("kept").alias("band"))


def _scored(spark, d, learner, bands=BANDS):
    """Held-out scores of every site of every taxon by a learner at its untuned settings."""
    return M.cross_validated_scores(M.spatial_folds(training(spark, d)), bands, ["taxon"], learner=learner).select("taxon", "fold", "site", "presence", "score")


def _one(spark, d):
    return training(spark, d).where("taxon = 'east'")


@query("mod5_presence_model")
def mod5(spark, d):
    return _scored(spark, d, L.PRESENCE)


@query("mod6_boosted_trees")
def mod6(spark, d):
    return _scored(spark, d, L.BOOSTED, [*BANDS, "effort"])


@query("mod7_forest")
def mod7(spark, d):
    return _scored(spark, d, L.FOREST, [*BANDS, "effort"])


@query("mod8_small_ensemble")
def mod8(spark, d):
    return M.fit_small_ensemble(M.spatial_folds(training(spark, d)), BANDS)


@query("mod9_detection_model")
def mod9(spark, d):
    return _scored(spark, d, L.DETECTION)


@query(
    "mod10_kernel_baseline",
    f"""{_TRAIN_FOLDS}, ne AS (SELECT q.taxon, q.fold, q.site, q.presence, h, pow(q.x - p.x, 2) + pow(q.y - p.y, 2) AS d2 FROM fo q JOIN fo p ON p.taxon = q.taxon AND p.fold <> q.fold AND p.presence = 1 CROSS JOIN (VALUES (100.0::DOUBLE), (200.0)) v(h)),
 nm AS (SELECT *, min(d2) OVER (PARTITION BY taxon, site, h) AS near FROM ne),
 sc AS (SELECT taxon, fold, site, h, any_value(presence) AS presence, ln(sum(exp((near - d2) / (2e6 * h * h)))) - any_value(near) / (2e6 * h * h) AS score FROM nm GROUP BY taxon, fold, site, h),
 rk AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY taxon, fold, h, score) - 1) / 2.0::DOUBLE AS rk FROM sc WINDOW w AS (PARTITION BY taxon, fold, h ORDER BY score)),
 au AS (SELECT taxon, h, avg(auc) AS auc FROM (SELECT taxon, fold, h, (sum(rk) FILTER (WHERE presence = 1) - sum(presence) * (sum(presence) + 1) / 2) / nullif(sum(presence) * (count(*) - sum(presence)), 0) AS auc FROM rk GROUP BY ALL) GROUP BY ALL)
 SELECT taxon, CAST(arg_max(h, (auc, -h)) AS DOUBLE) AS bandwidth_km, round(max(auc), 6) AS auc FROM au GROUP BY 1""",
)
def mod10(spark, d):
    out = M.choose_bandwidth(M.spatial_folds(training(spark, d)), [100.0, 200.0], ["taxon"])
    return out.select("taxon", "bandwidth_km", r("auc", 6).alias("auc"))


@query("mod11_cross_validation")
def mod11(spark, d):
    return M.cross_validate(M.spatial_folds(training(spark, d)), BANDS, ["taxon"])


@query("mod12_learners")
def mod12_learners(spark, d):
    """Every learner over the same folds, the best of each taxon."""
    return M.tune(M.spatial_folds(training(spark, d)), BANDS, ["taxon"], learners=L.LEARNERS)


@query("mod12_settings")
def mod12_settings(spark, d):
    """The forest's settings of each taxon."""
    return M.tuned_settings(M.spatial_folds(training(spark, d)), [*BANDS, "effort"], ["taxon"], L.FOREST)


@query("mod11_nested")
def mod11_nested(spark, d):
    """Boosted trees with depth and rounds chosen inside every outer fold."""
    return M.nested_cross_validate(M.spatial_folds(training(spark, d)), [*BANDS, "effort"], ["taxon"], L.BOOSTED)


@query("mod14_presence_importance")
def mod14_presence(spark, d):
    return M.permutation_importance(M.spatial_folds(training(spark, d)), BANDS, ["taxon"], learner=L.PRESENCE)


@query("mod12_tuning")
def mod12(spark, d):
    return M.tune(M.spatial_folds(training(spark, d)), BANDS, ["taxon"], [0.001, 0.1])


@query("mod13_null_test")
def mod13(spark, d):
    return M.null_test(M.spatial_folds(training(spark, d)), BANDS)


@query("mod13_boosted_null")
def mod13_boosted(spark, d):
    return M.null_test(M.spatial_folds(training(spark, d)), BANDS, 19, learner=L.BOOSTED)


@query("mod14_importance")
def mod14(spark, d):
    return M.permutation_importance(M.spatial_folds(training(spark, d)), BANDS, ["taxon"], groups={"place": ["b1", "b2"]})


_SCALED = ", ".join(f"({b} - m_{b}) / s_{b} AS {b}" for b in BANDS)
_APART = "sqrt(" + " + ".join(f"pow(q.{b} - p.{b}, 2)" for b in BANDS) + ")"


@query(
    "mod15_applicability",
    f"""{_TRAIN_FOLDS}, ms AS (SELECT taxon AS t, {", ".join(f"avg({b}) AS m_{b}, CASE WHEN stddev_samp({b}) > 0 THEN stddev_samp({b}) ELSE 1.0 END AS s_{b}" for b in BANDS)} FROM fo GROUP BY 1),
 z AS (SELECT taxon, site, fold, {_SCALED} FROM fo JOIN ms ON t = taxon),
 sh AS (SELECT taxon, site, {_SCALED} FROM (SELECT taxon, site, b1 + 0.05 AS b1, b2 - 0.05 AS b2, b3 * 1.02 AS b3 FROM fo) JOIN ms ON t = taxon),
 mp AS (SELECT q.taxon, avg({_APART}) AS mean FROM z q JOIN z p ON p.taxon = q.taxon AND p.site < q.site GROUP BY 1),
 cv AS (SELECT q.taxon, q.site, min({_APART}) / any_value(mean) AS i FROM z q JOIN z p ON p.taxon = q.taxon AND p.fold <> q.fold JOIN mp ON mp.taxon = q.taxon GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY taxon ORDER BY i) AS k, count(*) OVER (PARTITION BY taxon) AS n FROM cv),
 hi AS (SELECT taxon, quantile_cont(i, 0.5) FILTER (WHERE k <= (n + 1) // 2) AS q1, quantile_cont(i, 0.5) FILTER (WHERE k > n - (n + 1) // 2) AS q3 FROM rk GROUP BY 1),
 th AS (SELECT cv.taxon, max(i) AS threshold FROM cv JOIN hi ON hi.taxon = cv.taxon AND i <= q3 + 1.5 * (q3 - q1) GROUP BY 1),
 ix AS (SELECT q.taxon, q.site, min({_APART}) / any_value(mean) AS i FROM sh q JOIN z p ON p.taxon = q.taxon JOIN mp ON mp.taxon = q.taxon GROUP BY ALL)
 SELECT ix.taxon, site AS cell, round(i, 6) AS index, i <= threshold AS inside, round(threshold, 6) AS threshold FROM ix JOIN th ON th.taxon = ix.taxon""",
)
def mod15(spark, d):
    """Every taxon's sites under a shifted climate against its training sites."""
    t = M.spatial_folds(training(spark, d))
    cells = t.select("taxon", F.col("site").alias("cell"), (F.col("b1") + 0.05).alias("b1"), (F.col("b2") - 0.05).alias("b2"), (F.col("b3") * 1.02).alias("b3"))
    return M.applicability(t, cells, BANDS).select("taxon", "cell", r("index", 6).alias("index"), "inside", r("threshold", 6).alias("threshold"))


@query("mod16_block_study")
def mod16_blocks(spark, d):
    """Block sizes of every taxon over the cells of its accessible area."""
    t = training(spark, d)
    return M.block_study(t, t.select("taxon", F.col("site").alias("cell"), "x", "y"), BANDS)


@query("mod16_ratio_arms")
def mod16_ratios(spark, d):
    """One band for two, four or any number of detections, and blocks of 100 km."""
    arms = {"1 per 2": {"bands": BANDS, "per_presence": 2}, "1 per 4": {"bands": BANDS, "per_presence": 4}, "no cap": {"bands": BANDS, "per_presence": 0}, "100 km": {"bands": BANDS, "block_km": 100}}
    return M.run_arms(M.spatial_folds(training(spark, d)), arms)


_STUDY = {"all": {"bands": BANDS}, "one": {"bands": ["b1"]}, "pairs": {"bands": BANDS, "pairs": True}, "presence": {"bands": BANDS, "learner": L.PRESENCE}}


@query("mod16_arms")
def mod16(spark, d):
    return M.run_arms(M.spatial_folds(training(spark, d)), _STUDY)


@query("mod17_study")
def mod17(spark, d):
    t = M.spatial_folds(training(spark, d))
    return M.run_study(t.groupBy("taxon").agg(F.count_if(F.col("presence") == 1).alias("cells")), t, _STUDY, "all")[1]


@query("mod18_readings", "SELECT kind, band, passed, n, CASE WHEN kind <> 'null' AND passed / n::DOUBLE < 0.2 THEN 'too little power' ELSE 'as wanted' END AS decision FROM (SELECT o_orderpriority AS kind, o_custkey % 4 AS band, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 210000) AS passed FROM orders GROUP BY ALL)")
def mod18(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % 4).alias("band"), F.when(F.col("o_totalprice") > 210000, "passed").otherwise("failed").alias("verdict"))
    return M.read_rates(o).select("kind", "band", "passed", "n", "decision")


@query("mod18_pass_model")
def mod18_model(spark, d):
    """Whether an order is dear, by its customer's band and its year."""
    o = table(spark, d, "orders")
    rows = o.select((F.col("o_totalprice") > 210000).alias("passed"), (F.col("o_custkey") % 4).cast("double").alias("band"), (F.year("o_orderdate") - 1995).cast("double").alias("year"))
    return M.pass_model(rows, ["band", "year"]).select("term", r("coefficient", 4).alias("coefficient"))


@query("mod19_learner_maps")
def mod19_learner_maps(spark, d):
    """Tuned forests of every fitted taxon, mapped."""
    t = training(spark, d)
    cells = t.select(F.col("site").alias("cell"), "x", "y", *BANDS).distinct()
    return M.map_taxa(t, cells, cut(M.fit_taxa(t, BANDS)), BANDS, learner=L.FOREST)


@query("mod19_fit_taxa")
def mod19(spark, d):
    return M.fit_taxa(training(spark, d), BANDS)


@query("mod19_maps")
def mod19_maps(spark, d):
    t = training(spark, d)
    cells = t.select(F.col("site").alias("cell"), "x", "y", *BANDS).distinct()
    return M.map_taxa(t, cells, cut(M.fit_taxa(t, BANDS)), BANDS, (0.001, 0.01, 0.1))


# ---- streams ----------------------------------------------------------------------------


@query("stm1_new_finds", f"{WITH_OCC} SELECT concat(source, ':', observation_id) AS record, id FROM occ WHERE first_green_on >= DATE '1997-06-01' AND concat(source, ':', observation_id) NOT IN (SELECT concat(source, ':', observation_id) FROM occ WHERE id % 7 = 3)")
def stm1(spark, d):
    o = occurrences(spark, d)
    done = o.where("id % 7 = 3").select(X.record_key("source", "observation_id").alias("record"))
    return T.new_finds(o, "1997-06-01", done).select("record", "id")


@query("stm1_streamed_counts", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stm1_stream(spark, d):
    """The events table as a file stream, counted by day; the last batch's counts are files in the shared folder."""
    schema = table(spark, d, "events").schema
    folder = f"{checkpoint_folder(spark)}/rangeflow_{os.urandom(6).hex()}"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    counts = T.windowed_counts(rows, "ts", "event_type")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/counts")
    q = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/counts").select(F.col("day").cast("date").cast("string").alias("day"), "event_type", "n")


_GREEN = "p AS (SELECT concat(source, ':', id) AS record, regexp_extract(scientific_name, '^[A-Z][a-z]+') AS taxon, cell20 AS cell, first_green_on, updated_at FROM pts WHERE first_green_on IS NOT NULL)"


@query(
    "stm1_streamed_scores",
    f"""{WITH_POINTS}, {_GREEN}, old AS (SELECT * FROM p WHERE first_green_on < DATE '1996-01-01'),
 rk AS (SELECT taxon, cell, CAST(count(*) AS DOUBLE) AS rank, cell % 3 <> 0 AS inside FROM old WHERE taxon < 'I' AND cell IS NOT NULL GROUP BY 1, 2),
 f AS (SELECT p.record, p.taxon, p.cell, CASE WHEN inside THEN rank END AS rank, CASE WHEN inside THEN 'inside' WHEN inside IS NOT NULL THEN 'outside_aoa' ELSE 'beyond_reach' END AS place
  FROM p LEFT JOIN rk ON rk.taxon = p.taxon AND rk.cell = p.cell WHERE first_green_on >= DATE '1995-07-01')
 SELECT *, CASE WHEN record IN (SELECT record FROM old) THEN 'trained on' WHEN taxon NOT IN (SELECT taxon FROM rk) THEN 'no map' WHEN rank IS NULL THEN place ELSE 'ranked' END AS status FROM f""",
)
def stm1_scores(spark, d):
    """Finds since July 1995 as a file stream, each record once, scored against maps of what was known before 1996 and appended to a ledger."""
    genus = X.taxon_genus("scientific_name").alias("taxon")
    p = points(spark, d).where("first_green_on is not null").select(X.record_key("source", F.col("id").cast("string")).alias("record"), genus, F.col("cell20").alias("cell"), "first_green_on", "updated_at")
    old = p.where("first_green_on < '1996-01-01'")
    counts = old.where("taxon < 'I' and cell is not null").groupBy("taxon", "cell").agg(F.count("*").cast("double").alias("rank"))
    ranked = cut(counts.withColumn("inside", F.col("cell") % 3 != 0))
    finds = p.where("first_green_on >= '1995-07-01'").drop("first_green_on")
    folder = f"{checkpoint_folder(spark)}/rangeflow_{os.urandom(6).hex()}"
    finds.write.parquet(f"{folder}/finds")
    rows = T.watch_finds(spark, f"{folder}/finds", finds.schema)
    T.stream_scores(rows.drop("updated_at", "_at"), ranked, old.select("taxon", "record"), f"{folder}/ledger", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/ledger").select("record", "taxon", "cell", "rank", "place", "status")


@query("src3_tsv_scan", "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS observation_id, o_orderpriority AS scientific_name FROM orders")
def src3(spark, d):
    """The orders as tab-separated text, written and scanned again by the occurrence schema."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("observation_id"), F.col("o_orderpriority").alias("scientific_name"))
    path = f"{checkpoint_folder(spark)}/rangeflow_{os.urandom(6).hex()}"
    rows = o.select(*[F.col(f.name) if f.name in o.columns else F.lit(None).cast("string").alias(f.name) for f in IO.OCCURRENCE_SCHEMA.fields])
    IO.write_tsv_gz(rows, path)
    return IO.read_tsv(spark, path).select(F.col("id").cast("long").alias("id"), "observation_id", "scientific_name")


@query("src4_json_and_parquet", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS balance FROM customer")
def src4(spark, d):
    """The customers as gzip JSON lines and as compact Parquet, read back; only rows that both hold alike are given."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("balance"))
    path = f"{checkpoint_folder(spark)}/rangeflow_{os.urandom(6).hex()}"
    IO.write_json(c, f"{path}/json")
    IO.write_compact(c, f"{path}/parquet")
    return spark.read.schema(c.schema).json(f"{path}/json").intersect(spark.read.parquet(f"{path}/parquet"))


@query("stm2_retraction", f"SELECT record FROM ({_LEDGER}) WHERE reason = 'moved' OR reason IS NULL AND record % 11 = 0")
def stm2(spark, d):
    return T.retract(*_ledger(spark, d), "2000-01-01")[1]


@query("stm2_stream", f"SELECT record, reason, CASE WHEN reason IS NOT NULL THEN day END AS retracted_on FROM ({_LEDGER})")
def stm2_stream(spark, d):
    """The ledger and a pull as a stream of events; each batch's changes are files in the shared folder, of which the last of a record counts."""
    ledger, now = _ledger(spark, d)
    at = lambda t: F.lit(t).cast("timestamp").alias("at")
    listed = ledger.select("record", F.lit("listed").alias("kind"), "taxon", F.col("cell").cast("long").alias("cell"), "retracted_on", at("1999-12-31 00:00:00"))
    seen = now.select("record", F.lit("seen").alias("kind"), "taxon", F.col("cell").cast("long").alias("cell"), F.lit(None).cast("date").alias("retracted_on"), at("2000-01-01 12:00:00"))
    folder = f"{checkpoint_folder(spark)}/rangeflow_{os.urandom(6).hex()}"
    listed.unionByName(seen).write.parquet(f"{folder}/events")
    events = spark.readStream.schema(listed.schema).parquet(f"{folder}/events")
    keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/changes/batch_id={n}")
    q = T.watch_retractions(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{folder}/changes").groupBy("record").agg(F.max_by(F.struct("reason", "retracted_on"), "batch").alias("s"))
    return last.select("record", "s.reason", F.col("s.retracted_on").cast("string").alias("retracted_on"))


@query("stm3_changes_after", "SELECT event_id AS id, user_id FROM events WHERE event_id > 5000")
def stm3(spark, d):
    return T.changes_after(table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id"), 5000)


@query("stm4_resumable", "SELECT c_custkey AS taxon FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 4 <> 0)")
def stm4(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("taxon"))
    saved = c.where("taxon % 3 = 0").select("taxon", F.lit("s1").alias("settings"), F.when(F.col("taxon") % 4 == 0, "failed").otherwise("fitted").alias("status"))
    return T.resumable(c, saved, "s1")[1]


