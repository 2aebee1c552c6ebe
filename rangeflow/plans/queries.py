"""Registered queries of the engine's operators over the given tables, with the same question as SQL.

Names carry the operator's id in the survey.  Floating-point results are rounded before they are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.functions import scalars as S
from rangeflow.functions import text as X
from rangeflow.operators import aggs as A
from rangeflow.operators import predicates as P
from rangeflow.plans.stand_ins import KEY_SQL, MAP_SQL, OCC_SQL, SCORED_SQL, WITH_OCC, WITH_POINTS, map_values, occurrences, points, rows_hash_sql, scored_documents, table
from rangeflow.sources import snapshots as SN
from rangeflow.sources import tables as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r(column, digits: int = 6):
    return F.round(column, digits)


# ---- sources ------------------------------------------------------------------


@query("src1_occurrence_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def src1(spark, d):
    df = ST.read_occurrences(spark, f"{d}/orders.parquet").where("o_orderstatus = 'F' and o_totalprice > 100000")
    return df.select("o_orderkey", "o_custkey", "o_totalprice")


@query("src1_keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 500")
def src1_page(spark, d):
    return ST.page_after(table(spark, d, "orders"), 100, 500, "o_orderkey").select("o_orderkey", "o_custkey")


@query("src2_incremental_scan", f"{WITH_OCC} SELECT id, CAST(updated_at AS VARCHAR) AS updated_at FROM occ WHERE updated_at >= DATE '1997-01-01'")
def src2(spark, d):
    return ST.updated_since(occurrences(spark, d), "1997-01-01").select("id", F.col("updated_at").cast("string").alias("updated_at"))


@query("src5_reference_table", "SELECT concat(p_brand, '-', p_size) AS genus, min(p_type) AS lifestyle FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1")
def src5(spark, d):
    return ST.guild_table(table(spark, d, "part").withColumn("g", F.concat_ws("-", "p_brand", "p_size")), "g", "p_type")


@query("src6_id_list", "SELECT DISTINCT CAST(trim(x) AS BIGINT) AS id FROM (SELECT unnest(string_split(regexp_replace(concat(o_orderkey, ', ', o_custkey, ' # c'), '#.*$', ''), ',')) AS x FROM orders)")
def src6(spark, d):
    lines = table(spark, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit(" # c")).alias("value"))
    return ST.id_list(lines)


@query("src7_cell_bands", "SELECT p_partkey AS cell, p_size, p_retailprice FROM part")
def src7(spark, d):
    layers = spark.createDataFrame([("p_size", "size"), ("p_retailprice", "price"), ("p_name", "name")], "band string, layer string")
    return ST.cell_bands(table(spark, d, "part").withColumnRenamed("p_partkey", "cell"), layers, ["size", "price"]).select("cell", "p_size", "p_retailprice")


@query(
    "src8_checklist_rows",
    f"{WITH_OCC} SELECT scientific_name AS taxon, CAST(count(*) AS VARCHAR) AS records, concat('https://example.org/taxa/', replace(replace(scientific_name, ' ', '%20'), '''', '%27')) AS page FROM occ GROUP BY scientific_name",
)
def src8(spark, d):
    rows = occurrences(spark, d).groupBy(F.col("scientific_name").alias("taxon")).agg(F.count("*").alias("records"))
    return ST.checklist_rows(rows, "https://example.org/")


@query("src9_place_index", f"SELECT cell, model, CAST(rk AS TINYINT) AS rank FROM (SELECT cell, model, CAST(floor(value) AS BIGINT) % 101 AS rk FROM ({MAP_SQL})) WHERE rk >= 50")
def src9(spark, d):
    return ST.place_index(map_values(spark, d).withColumn("rank", F.col("value").cast("bigint") % 101))


@query(
    "src10_table_hash",
    f"""WITH h AS (SELECT sha256(concat_ws(chr(31), concat('=', n_nationkey), coalesce(concat('=', n_name), '-'), concat('=', n_regionkey))) AS h FROM nation)
 SELECT {rows_hash_sql('h')} AS hash, count(*) AS rows FROM h""",
)
def src10(spark, d):
    return SN.table_hash(table(spark, d, "nation"))


@query(
    "src10_manifest",
    "SELECT CAST(p_partkey AS VARCHAR) AS path, sha256(p_name) AS hash FROM part",
)
def src10_manifest(spark, d):
    return SN.manifest(table(spark, d, "part").withColumn("path", F.col("p_partkey").cast("string")), "path", "p_name")


_PROMOTIONS = "SELECT CAST(user_id % 10 AS VARCHAR) AS grid, CAST(event_id AS VARCHAR) AS release, ts AS promoted_at FROM events WHERE event_type = 'purchase'"


def _promotions(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'")
    return e.select((F.col("user_id") % 10).cast("string").alias("grid"), F.col("event_id").cast("string").alias("release"), F.col("ts").alias("promoted_at"))


@query("src11_promotion_history", f"SELECT grid, release, promoted_at, lag(release) OVER (PARTITION BY grid ORDER BY promoted_at, release) AS replaced FROM ({_PROMOTIONS})")
def src11(spark, d):
    return SN.promotion_history(_promotions(spark, d)).select("grid", "release", "promoted_at", "replaced")


@query("src11_current_release", f"SELECT grid, arg_max(release, (promoted_at, release)) AS release, max(promoted_at) AS promoted_at FROM ({_PROMOTIONS}) GROUP BY grid")
def src11_current(spark, d):
    return SN.current_release(_promotions(spark, d))


@query(
    "src12_sync_plan",
    """WITH a AS (SELECT o_orderkey AS path, md5(CAST(o_custkey AS VARCHAR)) AS hash FROM orders WHERE o_orderkey % 5 <> 0),
 b AS (SELECT o_orderkey AS path, md5(CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END) AS hash FROM orders WHERE o_orderkey % 3 <> 0)
 SELECT coalesce(a.path, b.path) AS path, a.hash AS local_hash, b.hash AS remote_hash,
 CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' WHEN a.hash <> b.hash THEN 'changed' ELSE 'same' END AS action FROM a FULL JOIN b ON a.path = b.path""",
)
def src12(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_custkey").cast("string")
    a = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("path"), F.md5(key.cast("binary")).alias("hash"))
    b = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("path"), F.md5(F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(key).cast("binary")).alias("hash"))
    return SN.sync_plan(a, b)


@query(
    "src13_pull_summary",
    f"""{WITH_OCC}, t AS (SELECT scientific_name, count(*) AS records, count(DISTINCT concat(CAST(floor(latitude / 0.01::DOUBLE) AS BIGINT), ':', CAST(floor(longitude / 0.01::DOUBLE) AS BIGINT))) AS localities FROM occ GROUP BY 1)
 SELECT CAST(sum(records) AS BIGINT) AS records, count(*) AS taxa, CAST(sum(localities) AS BIGINT) AS localities,
 (SELECT count(*) FROM occ) AS total, (SELECT count(*) FILTER (WHERE country = 'US') FROM occ) AS used FROM t""",
)
def src13(spark, d):
    df = occurrences(spark, d)
    falls = A.waterfall(df, [("used_step", F.col("country") == "US")])
    return ST.pull_summary(A.taxon_fingerprints(df), falls)


@query("src14_public_fields", "SELECT o_orderkey, o_totalprice AS price FROM orders")
def src14(spark, d):
    o = table(spark, d, "orders")
    nested = o.select("o_orderkey", F.struct(F.col("o_totalprice").alias("price"), F.lit(1).alias("seed")).alias("inner"), F.lit("x").alias("fingerprint"))
    return ST.public_fields(nested).select("o_orderkey", "inner.*")


@query("src15_served_waterfall", "SELECT o_orderstatus AS status, count(*) AS total, count(*) FILTER (WHERE o_totalprice <= 200000) AS removed, count(*) FILTER (WHERE o_totalprice > 200000) AS used FROM orders GROUP BY 1")
def src15(spark, d):
    big = F.col("o_totalprice") > 200000
    w = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("total"), F.count_if(~big).alias("removed"), F.count_if(big).alias("used"))
    return ST.served_waterfall(w)


# ---- predicates -----------------------------------------------------------------


@query("fil1_any_slot", "SELECT count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'F' OR l_quantity > 45")
def fil1(spark, d):
    yes = lambda c: F.when(c, "yes")
    flags = table(spark, d, "lineitem").withColumns({"s1": yes(F.col("l_returnflag") == "R"), "s2": yes(F.col("l_linestatus") == "F"), "s3": yes(F.col("l_quantity") > 45)})
    return flags.where(P.any_validated("s1", "s2", "s3")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("q"))


@query("fil2_has_place", f"{WITH_POINTS} SELECT id FROM pts WHERE cell5 IS NOT NULL")
def fil2(spark, d):
    return occurrences(spark, d).where(P.has_place()).select("id")


@query("fil3_covered_place", f"{WITH_OCC} SELECT id, country FROM occ WHERE country IN ('US', 'CA', 'MX', 'PR', 'VI') OR state = 'Puerto Rico'")
def fil3(spark, d):
    return occurrences(spark, d).where(P.in_covered_place()).select("id", "country")


_ANSWERS = "SELECT CAST(o_orderkey % 5000 AS VARCHAR) AS number, o_orderkey % 4 = 0 AS obscured, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 100 END AS accuracy_m FROM orders WHERE o_orderkey % 2 = 0"


def _answers(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 2 = 0")
    k = F.col("o_orderkey")
    return o.select((k % 5000).cast("string").alias("number"), (k % 4 == 0).alias("obscured"), F.when(k % 3 != 0, F.col("o_totalprice") / 100).alias("accuracy_m"))


@query("fil4_obscured", f"{WITH_OCC}, ans AS ({_ANSWERS}) SELECT id FROM occ WHERE NOT (source = 'iNaturalist' AND observation_id IN (SELECT number FROM ans WHERE obscured OR accuracy_m > 1000))")
def fil4(spark, d):
    return P.drop_obscured(occurrences(spark, d), _answers(spark, d)).select("id")


_BOXES = """SELECT CAST(o_orderkey % 5000 AS VARCHAR) AS number, CASE WHEN o_orderkey % 5 = 0 THEN 40.0::DOUBLE END AS gps, 40 + CAST(o_custkey % 90 AS DOUBLE) / 1000 AS north, 40.0::DOUBLE AS south,
 -100 + CAST(o_custkey % 70 AS DOUBLE) / 1000 AS east, -100.0::DOUBLE AS west, CASE WHEN o_orderkey % 5 = 0 THEN 40.5::DOUBLE END AS gps_lat, CASE WHEN o_orderkey % 5 = 0 THEN -100.5::DOUBLE END AS gps_lng FROM orders WHERE o_orderkey % 3 = 1"""
_HALF = "sqrt(pow((north - south) * 111.2::DOUBLE, 2) + pow((east - west) * 111.2::DOUBLE * cos(radians((north + south) / 2)), 2)) / 2 * 1000"


def _boxes(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    five = k % 5 == 0
    return table(spark, d, "orders").where("o_orderkey % 3 = 1").select(
        (k % 5000).cast("string").alias("number"), F.when(five, 40.0).alias("gps"), (40 + (c % 90).cast("double") / 1000).alias("north"), F.lit(40.0).alias("south"),
        (-100 + (c % 70).cast("double") / 1000).alias("east"), F.lit(-100.0).alias("west"), F.when(five, 40.5).alias("gps_lat"), F.when(five, -100.5).alias("gps_lng"),
    )


@query(
    "fil5_small_location",
    f"{WITH_OCC}, b AS (SELECT number, bool_or(coalesce(gps IS NOT NULL OR {_HALF} <= 5000, false)) AS small FROM ({_BOXES}) GROUP BY 1) SELECT id FROM occ LEFT JOIN b ON b.number = observation_id AND source = 'MO Observations' WHERE source <> 'MO Observations' OR coalesce(small, false)",
)
def fil5(spark, d):
    return P.small_location(occurrences(spark, d), _boxes(spark, d)).select("id")


@query(
    "fil6_shared_points",
    f"{WITH_OCC} SELECT id FROM occ o WHERE coalesce(price / 50 <= 5000, true) AND NOT EXISTS (SELECT 1 FROM (SELECT latitude, longitude FROM occ GROUP BY 1, 2 HAVING count(DISTINCT coalesce(locality, '')) >= 2) s WHERE s.latitude = o.latitude AND s.longitude = o.longitude)",
)
def fil6(spark, d):
    return P.drop_shared_points(occurrences(spark, d).withColumn("uncertainty_m", F.col("price") / 50)).select("id")


@query("fil7_species_level", f"{WITH_OCC} SELECT id, scientific_name FROM occ WHERE scientific_name LIKE '% %' AND NOT regexp_matches(lower(scientific_name), ' sp[.]?$')")
def fil7(spark, d):
    return occurrences(spark, d).where(P.modelled_name("scientific_name")).select("id", "scientific_name")


def _drops(spark, d):
    o = table(spark, d, "orders")
    by_id = o.where("o_orderkey % 11 = 0").select(F.lit("id").alias("by"), F.col("o_orderkey").cast("string").alias("key"))
    by_key = o.where("o_orderkey % 13 = 0").select(F.lit("source_observation").alias("by"), F.concat(F.lit("iNaturalist:"), (F.col("o_orderkey") % 5000).cast("string")).alias("key"))
    return by_id.unionByName(by_key)


_DROPPED = "SELECT concat('iNaturalist:', o_orderkey % 5000) FROM orders WHERE o_orderkey % 13 = 0"


@query("fil8_drop_list", f"{WITH_OCC} SELECT id FROM occ WHERE id % 11 <> 0 AND concat(source, ':', observation_id) NOT IN ({_DROPPED})")
def fil8(spark, d):
    return P.apply_exclusions(occurrences(spark, d), _drops(spark, d)).select("id")


@query(
    "fil8_drop_report",
    f"{WITH_OCC} SELECT 'id' AS by, count(*) AS listed, count(*) AS removed FROM occ WHERE id % 11 = 0 UNION ALL SELECT 'source_observation', (SELECT count(DISTINCT o_orderkey % 5000) FROM orders WHERE o_orderkey % 13 = 0), count(*) FROM occ WHERE concat(source, ':', observation_id) IN ({_DROPPED})",
)
def fil8_report(spark, d):
    return P.exclusion_report(occurrences(spark, d), _drops(spark, d))


def _kingdoms(spark, d):
    names = occurrences(spark, d).select("scientific_name").distinct()
    code = F.ascii("scientific_name") % 3
    return names.select(F.col("scientific_name").alias("name"), F.when(code == 0, "Plantae").otherwise("Fungi").alias("kingdom"), (F.length("scientific_name") % 2 == 0).alias("exact"))


_KINGDOM = "ascii(scientific_name) % 3 = 0 AND length(scientific_name) % 2 = 0"


@query("fil9_other_kingdom", f"{WITH_OCC} SELECT scientific_name, 'Plantae' AS kingdom, count(*) AS records FROM occ WHERE {_KINGDOM} GROUP BY 1")
def fil9(spark, d):
    return P.kingdom_counts(occurrences(spark, d), _kingdoms(spark, d))


@query("fil10_validated_through", f"{WITH_OCC} SELECT id FROM occ WHERE first_green_on IS NULL OR first_green_on <= DATE '1996-06-30'")
def fil10(spark, d):
    return P.validated_through(occurrences(spark, d), "1996-06-30", True).select("id")


_CANON = f"""cnt AS (SELECT scientific_name, {KEY_SQL} AS key, count(*) AS n FROM occ GROUP BY 1),
 canon AS (SELECT key, arg_min(scientific_name, (-n, scientific_name)) AS canonical FROM cnt GROUP BY key)"""


@query(
    "fil11_record_named",
    f"WITH all_occ AS ({OCC_SQL}), occ AS (SELECT * FROM all_occ WHERE scientific_name LIKE '% %' AND NOT regexp_matches(lower(scientific_name), ' sp[.]?$')), {_CANON} SELECT canonical AS scientific_name, count(*) AS records FROM occ JOIN cnt USING (scientific_name) JOIN canon USING (key) GROUP BY 1",
)
def fil11(spark, d):
    df = P.record_named(occurrences(spark, d).withColumnRenamed("scientific_name", "record_name"))
    return df.groupBy("scientific_name").agg(F.count("*").alias("records"))


def _privacy(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 2 = 0")
    k = F.col("o_orderkey")
    source = F.element_at(F.array(*[F.lit(s) for s in ("iNaturalist", "MO Observations", "MyCoPortal")]), (k % 3 + 1).cast("int"))
    return o.select(source.alias("source"), (k % 5000).cast("string").alias("number"), (k % 8 == 0).alias("hidden"), (k % 20 == 0).alias("deleted"))


_PRIVACY = """ans AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'iNaturalist' WHEN 1 THEN 'MO Observations' ELSE 'MyCoPortal' END AS source, CAST(o_orderkey % 5000 AS VARCHAR) AS number,
 bool_or(o_orderkey % 8 = 0) AS hidden, bool_or(o_orderkey % 20 = 0) AS deleted FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)"""


@query(
    "fil12_private_list",
    f"{WITH_OCC}, {_PRIVACY} SELECT * FROM (SELECT DISTINCT o.source, o.observation_id, CASE WHEN deleted THEN 'deleted' WHEN hidden THEN 'place' WHEN hidden IS NULL THEN 'unknown' END AS privacy FROM occ o LEFT JOIN ans ON ans.source = o.source AND ans.number = o.observation_id) WHERE privacy IS NOT NULL",
)
def fil12(spark, d):
    return P.privacy_list(occurrences(spark, d), _privacy(spark, d))


def _status(spark, d):
    return _privacy(spark, d).withColumn("shown", F.when(F.col("number").cast("int") % 3 != 0, "t").otherwise("f"))


@query(
    "fil13_status_groups",
    f"""{WITH_OCC}, {_PRIVACY}, r AS (SELECT DISTINCT source, observation_id AS number FROM occ)
 SELECT r.source, count(*) AS records, count(*) FILTER (WHERE r.source = 'iNaturalist' AND coalesce(hidden, true)) AS hidden,
 count(*) FILTER (WHERE r.source = 'MO Observations' AND NOT coalesce(hidden IS NOT NULL AND CAST(r.number AS INT) % 3 <> 0, false)) AS not_shown,
 count(*) FILTER (WHERE r.source = 'MO Observations' AND coalesce(deleted, false)) AS deleted FROM r LEFT JOIN ans ON ans.source = r.source AND ans.number = r.number GROUP BY 1""",
)
def fil13(spark, d):
    df = occurrences(spark, d)
    groups = P.status_groups(df, df.select("source", "observation_id").limit(0), _status(spark, d))
    n = lambda c: F.count_if(F.col(c)).alias(c)
    return groups.groupBy("source").agg(F.count("*").alias("records"), n("hidden"), n("not_shown"), n("deleted"))


@query("fil14_row_checks", f"{WITH_OCC} SELECT count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS no_coordinates, count(*) FILTER (WHERE scientific_name IS NULL OR trim(scientific_name) = '') AS no_name, count(id) - count(DISTINCT id) AS repeated_ids FROM occ")
def fil14(spark, d):
    return P.check_rows(occurrences(spark, d))


@query("fil15_complete_cases", "SELECT l_suppkey AS taxon, count(*) FILTER (WHERE l_quantity > 40 OR l_discount < 0.02) AS incomplete FROM lineitem GROUP BY 1")
def fil15(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("taxon"), F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("a"), F.when(F.col("l_discount") >= 0.02, F.col("l_discount")).alias("b"))
    return P.incomplete_count(l, ["a", "b"], ["taxon"])


_TAXA = "SELECT scientific_name, count(*) AS records, count(DISTINCT concat(CAST(floor(latitude / 0.01::DOUBLE) AS BIGINT), ':', CAST(floor(longitude / 0.01::DOUBLE) AS BIGINT))) AS localities FROM occ GROUP BY 1"


def _taxa(spark, d):
    return A.taxon_fingerprints(occurrences(spark, d)).select("scientific_name", "records", "localities")


@query("fil16_taxa_page", f"{WITH_OCC}, t AS (SELECT *, count(*) OVER () AS total FROM ({_TAXA}) WHERE localities >= 5 AND lower(scientific_name) LIKE '%ensis%') SELECT scientific_name, records, localities, total FROM t ORDER BY localities DESC, scientific_name LIMIT 20 OFFSET 10")
def fil16(spark, d):
    return P.taxa_page(_taxa(spark, d), "ensis", 5, 20, 10)


_REGIONS = [("US", f"US-{k:02d}", f"NATION_{k}") for k in range(25)]
_REGION_SQL = """SELECT *, CASE country WHEN 'US' THEN 'United States' WHEN 'CA' THEN 'Canada' WHEN 'MX' THEN 'Mexico' ELSE country END AS cname FROM occ"""


def _regions(spark):
    rows = [("US" if k % 2 else "CA", f"{'US' if k % 2 else 'CA'}-{k:02d}", f"NATION_{k}", [f"Nation {k:02d}"]) for k in range(0, 25) if k % 5 != 4]
    return spark.createDataFrame(rows, "country string, code string, name string, aliases array<string>")


_REGION_OF = """reg AS (SELECT *, CAST(replace(state, 'NATION_', '') AS INT) AS nk FROM occ), rr AS (SELECT *,
 CASE WHEN nk % 5 <> 4 THEN CASE WHEN nk % 2 = 1 THEN 'US' ELSE 'CA' END WHEN country IN ('PR', 'VI') THEN 'US' ELSE country END AS country_code,
 CASE WHEN nk % 5 <> 4 THEN state WHEN country = 'PR' THEN 'Puerto Rico' ELSE state END AS region,
 CASE WHEN nk % 5 <> 4 THEN concat(CASE WHEN nk % 2 = 1 THEN 'US-' ELSE 'CA-' END, lpad(CAST(nk AS VARCHAR), 2, '0')) WHEN country = 'PR' THEN 'US-PR' ELSE '' END AS code FROM reg)"""
_LOCALITY = "concat(CAST(floor(latitude / 0.01::DOUBLE) AS BIGINT), ':', CAST(floor(longitude / 0.01::DOUBLE) AS BIGINT))"


@query("fil17_checklist", f"{WITH_OCC}, {_REGION_OF} SELECT scientific_name AS taxon, code, count(*) AS records FROM rr WHERE code = 'US-01' GROUP BY 1, 2")
def fil17(spark, d):
    from rangeflow.operators.joins import region_of

    t = A.region_table(region_of(occurrences(spark, d), _regions(spark)))
    return P.checklist(t, "us-01").select("taxon", "code", "records")


# ---- names and scalars ---------------------------------------------------------------


@query("txt1_regular_name", f"{WITH_OCC} SELECT id, replace(scientific_name, '  ', ' ') AS regular FROM occ")
def txt1(spark, d):
    return occurrences(spark, d).select("id", X.regular_name("scientific_name").alias("regular"))


@query("txt2_regular_ranks", f"{WITH_OCC} SELECT id, replace(scientific_name, ' ssp. ', ' subsp. ') AS ranked FROM occ")
def txt2(spark, d):
    return occurrences(spark, d).select("id", X.regular_ranks("scientific_name").alias("ranked"))


@query("txt3_strip_authors", f"{WITH_OCC} SELECT id, regexp_replace(scientific_name, ' Fr\\.$', '') AS plain FROM occ")
def txt3(spark, d):
    return occurrences(spark, d).select("id", X.strip_authors("scientific_name").alias("plain"))


@query("txt4_name_key", f"{WITH_OCC} SELECT id, {KEY_SQL} AS key FROM occ")
def txt4(spark, d):
    return occurrences(spark, d).select("id", X.name_key("scientific_name").alias("key"))


@query("txt5_genus", f"{WITH_OCC} SELECT regexp_extract(scientific_name, '^[A-Z][a-z-]+') AS genus, count(*) AS n FROM occ GROUP BY 1")
def txt5(spark, d):
    return occurrences(spark, d).groupBy(X.taxon_genus("scientific_name").alias("genus")).agg(F.count("*").alias("n"))


@query("txt6_provisional", f"{WITH_OCC} SELECT id FROM occ WHERE scientific_name LIKE '% sp. ''%'")
def txt6(spark, d):
    return occurrences(spark, d).where(X.is_provisional_name("scientific_name")).select("id")


@query("txt7_search_key", f"{WITH_OCC} SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(scientific_name), '[^a-z0-9]+', ' ', 'g'), ' (ssp|sp) ', ' ', 'g'), ' +', ' ', 'g')) AS key FROM occ")
def txt7(spark, d):
    return occurrences(spark, d).select("id", X.search_key("scientific_name").alias("key"))


@query("txt8_region_key", "SELECT n_nationkey, trim(regexp_replace(lower(concat('É. ', n_name)), '[^a-z0-9é]+', ' ', 'g')) AS raw, concat('e nation ', n_nationkey) AS key FROM nation")
def txt8(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", F.trim(F.regexp_replace(F.lower(F.concat(F.lit("É. "), "n_name")), "[^a-z0-9é]+", " ")).alias("raw"), X.region_key(F.concat(F.lit("É. "), "n_name")).alias("key"))


@query("txt9_record_key", f"{WITH_OCC} SELECT id, concat(source, ':', observation_id) AS key, CASE source WHEN 'iNaturalist' THEN concat('inat:', observation_id) WHEN 'MO Observations' THEN concat('mo:', observation_id) END AS ref FROM occ")
def txt9(spark, d):
    return occurrences(spark, d).select("id", X.record_key("source", "observation_id").alias("key"), X.record_ref("source", "observation_id").alias("ref"))


@query("txt10_slug", "SELECT p_partkey, trim(regexp_replace(lower(concat(' ', p_name, ' (', p_brand, ')')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def txt10(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slug(F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("txt11_renames", "SELECT p_size AS bio5, p_retailprice AS bio12 FROM part")
def txt11(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("clim_05"), F.col("p_retailprice").alias("clim_12"))
    return X.rename_numbered(p, r"^clim_(\d+)$", "bio")


@query("sca1_validation_date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS a, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS b FROM orders")
def sca1(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.parse_validation_date(F.date_format("o_orderdate", "M/d/yyyy 'x'")).cast("string").alias("a"), S.parse_validation_date(F.date_format("o_orderdate", "yyyy-MM-dd HH")).cast("string").alias("b"))


@query("sca2_record_year", "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1")
def sca2(spark, d):
    return table(spark, d, "orders").groupBy(S.record_year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@query("sca3_albers", f"{WITH_POINTS} SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM pts")
def sca3(spark, d):
    x, y = S.albers("latitude", "longitude")
    return occurrences(spark, d).select("id", r(x, 3).alias("x"), r(y, 3).alias("y"))


@query("sca4_grid_cell", f"{WITH_POINTS} SELECT id, cell5, cell20 FROM pts")
def sca4(spark, d):
    return points(spark, d).select("id", "cell5", "cell20")


@query("sca4_cell_centre", f"{WITH_POINTS} SELECT DISTINCT cell20, -7445000 + ((cell20 - 1) % 609 + 0.5) * 20000.0 AS cx, 4740000 - (floor((cell20 - 1) / 609) + 0.5) * 20000.0 AS cy FROM pts WHERE cell20 IS NOT NULL".replace("0.5)", "0.5::DOUBLE)").replace("20000.0", "20000.0::DOUBLE"))
def sca4_centre(spark, d):
    cx, cy = S.cell_centre("cell20", 20)
    return points(spark, d).where("cell20 is not null").select("cell20", cx.alias("cx"), cy.alias("cy")).distinct()


@query("sca5_degree_keys", f"{WITH_OCC} SELECT id, {_LOCALITY} AS key, (CAST(floor(latitude / 0.1::DOUBLE) AS BIGINT) + 0.5::DOUBLE) * 0.1::DOUBLE AS lat FROM occ")
def sca5(spark, d):
    return occurrences(spark, d).select("id", S.degree_key("latitude", "longitude").alias("key"), S.degree_centre(F.floor(F.col("latitude") / 0.1)).alias("lat"))


@query("sca6_squares", f"{WITH_POINTS} SELECT id, concat(CAST(floor(x / 5000) AS BIGINT), ':', CAST(floor(y / 5000) AS BIGINT)) AS square, concat(CAST(floor(x / 200000) AS BIGINT), ':', CAST(floor(y / 200000) AS BIGINT)) AS block FROM pts")
def sca6(spark, d):
    return points(spark, d).select("id", S.square_label("x", "y").alias("square"), S.square_label("x", "y", 200).alias("block"))


_KM = "2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians(45.0::DOUBLE) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(45.0::DOUBLE)) * pow(sin(radians(-100.0::DOUBLE - longitude) / 2), 2))))"


@query("sca7_distance", f"{WITH_OCC} SELECT id, round({_KM}, 4) AS km FROM occ")
def sca7(spark, d):
    return occurrences(spark, d).select("id", r(S.km_between("latitude", "longitude", F.lit(45.0), F.lit(-100.0)), 4).alias("km"))


@query(
    "sca8_bands",
    "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN q < 20 THEN '<20' WHEN q < 30 THEN '20-29' WHEN q < 50 THEN '30-49' WHEN q < 100 THEN '50-99' WHEN q < 200 THEN '100-199' ELSE '200+' END AS band, CASE WHEN q <= 5 THEN '0-5' WHEN q <= 25 THEN '5-25' WHEN q <= 100 THEN '25-100' WHEN q <= 500 THEN '100-500' ELSE '500+' END AS place_band, CASE WHEN q < 100 THEN 'under_100' WHEN q < 500 THEN '100_500' ELSE '500_plus' END AS tracker_band FROM (SELECT *, l_quantity * 12 AS q FROM lineitem)",
)
def sca8(spark, d):
    l = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity") * 12)
    return l.select("l_orderkey", "l_linenumber", "l_quantity", S.count_band("q").alias("band"), S.place_band("q").alias("place_band"), S.tracker_band("q").alias("tracker_band"))


@query("sca9_share", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN least(1.0::DOUBLE, (o_custkey % 10) / (o_orderkey % 3)::DOUBLE / 4) ELSE 0.0::DOUBLE END AS share FROM orders")
def sca9(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.share((F.col("o_custkey") % 10).cast("double"), (F.col("o_orderkey") % 3 * 4).cast("double")).alias("share"))


_METRICS = "SELECT s_suppkey, (s_suppkey % 20) / 20.0::DOUBLE AS p, CAST(s_suppkey % 40 AS INT) AS reps, 0.4 + (s_suppkey % 60) / 100.0::DOUBLE AS auc, (s_suppkey % 7 - 2) / 5.0::DOUBLE AS boyce, CASE WHEN s_suppkey % 3 = 0 THEN 'scatter' ELSE 'shift' END AS design FROM supplier"


def _metrics(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        "s_suppkey", ((k % 20) / 20.0).alias("p"), (k % 40).cast("int").alias("reps"), (0.4 + (k % 60) / 100.0).alias("auc"), ((k % 7 - 2) / 5.0).alias("boyce"),
        F.when(k % 3 == 0, "scatter").otherwise("shift").alias("design"),
    )


_SKILL = "CASE WHEN reps <= 0 THEN 'untested' WHEN p <= 0.05 AND boyce > 0 THEN 'passed' ELSE 'failed' END"
_GRADE = f"CASE {_SKILL} WHEN 'untested' THEN 'untested' WHEN 'passed' THEN CASE WHEN design = 'shift' THEN 'strong' ELSE 'weak' END ELSE CASE WHEN auc > 0.5 AND boyce > 0 THEN 'weak' ELSE 'failed' END END"
_TIER = "CASE WHEN p <= 0.05 AND boyce > 0 THEN 'strong' WHEN p <= 0.2 AND reps >= 25 AND auc > 0.5 AND boyce > 0 AND design = 'shift' THEN 'moderate' WHEN auc > 0.5 AND boyce > 0 THEN 'indicative' ELSE 'failed' END"
_Z = "(auc - 0.5) / 0.05"


@query("sca10_map_strength", f"SELECT s_suppkey, CASE WHEN {_SKILL} = 'failed' THEN 0 WHEN {_SKILL} = 'untested' THEN 0.5 WHEN {_GRADE} <> 'strong' THEN 0 ELSE round_even(0.4 + 0.6 * least(1.0, greatest(0.0, ({_Z} - 1.6448536269514722) / (5 - 1.6448536269514722))), 3) END::DOUBLE AS strength FROM ({_METRICS})")
def sca10(spark, d):
    m = _metrics(spark, d)
    sk = S.skill(F.col("p"), F.col("reps"), F.col("boyce"))
    gr = S.map_grade(sk, F.col("design"), F.col("auc"), F.col("boyce"))
    return m.select("s_suppkey", S.map_strength(sk, gr, F.col("auc"), F.lit(0.5), F.lit(0.05)).alias("strength"))


@query("sca11_grades", f"SELECT s_suppkey, {_SKILL} AS skill, {_GRADE} AS grade, {_TIER} AS tier FROM ({_METRICS})")
def sca11(spark, d):
    m = _metrics(spark, d)
    sk = S.skill(F.col("p"), F.col("reps"), F.col("boyce"))
    tier = S.tier(F.col("p"), F.col("reps"), F.col("auc"), F.col("boyce"), F.col("design"))
    return m.select("s_suppkey", sk.alias("skill"), S.map_grade(sk, F.col("design"), F.col("auc"), F.col("boyce")).alias("grade"), tier.alias("tier"))


@query("sca12_region_verdict", "SELECT o_orderkey, CASE WHEN s IS NULL THEN 'no map' WHEN s >= 0.1 - 1e-9 THEN 'likely' WHEN b >= 0.1 - 1e-9 THEN 'possible' WHEN rch < 0.1 - 1e-9 THEN 'beyond reach' ELSE 'unlikely' END AS verdict FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 20) / 100.0::DOUBLE END AS s, (o_custkey % 15) / 100.0::DOUBLE AS b, (o_custkey % 40) / 100.0::DOUBLE AS rch FROM orders)")
def sca12(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", S.region_verdict((c % 40) / 100.0, F.when(k % 9 != 0, (k % 20) / 100.0), (c % 15) / 100.0).alias("verdict"))


@query("sca13_score_z", f"SELECT s_suppkey, CASE WHEN design = 'shift' THEN round({_Z}, 6) END AS z FROM ({_METRICS})")
def sca13(spark, d):
    return _metrics(spark, d).select("s_suppkey", r(S.score_z(F.col("auc"), F.lit(0.5), F.lit(0.05), F.col("design"))).alias("z"))


_WILSON = """(SELECT *, k / n::DOUBLE AS p, 1.96::DOUBLE AS z FROM (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS k FROM orders GROUP BY 1))"""


@query("sca14_wilson", f"SELECT o_orderpriority, round_even(greatest(0.0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 3)::DOUBLE AS low, round_even(least(1.0, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 3)::DOUBLE AS high FROM {_WILSON}")
def sca14(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    w = S.wilson("k", "n")
    return g.select("o_orderpriority", w["low"].alias("low"), w["high"].alias("high"))


@query("sca15_seed", "SELECT p_partkey, CAST(CAST(concat('0x', substr(sha256(p_name), 1, 7)) AS BIGINT) AS INT) AS seed FROM part")
def sca15(spark, d):
    return table(spark, d, "part").select("p_partkey", S.seed_of(F.sha2("p_name", 256)).alias("seed"))
