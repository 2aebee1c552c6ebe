"""Registered queries of the joins, with the same question as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rangeflow.functions import text as X
from rangeflow.functions.scalars import albers
from rangeflow.operators import joins as J
from rangeflow.operators.lineage import cut
from rangeflow.plans.queries import _BOXES, _HALF, _REGION_OF, _regions, query, r
from rangeflow.plans.stand_ins import KEY_SQL, MAP_SQL, WITH_OCC, WITH_POINTS, X_SQL, Y_SQL, map_values, occurrences, points, table


def _sequences(spark, d):
    """Sequences of records: every other order names a species, some with a contaminant flag."""
    o = occurrences(spark, d).where("id % 2 = 0")
    n = F.when(F.col("id") % 12 == 0, F.lit("Xenus otherensis")).otherwise(F.regexp_replace("scientific_name", " Fr\\.$", ""))
    flags = F.when(F.col("id") % 14 == 0, '{"contaminant": true}').otherwise('{"x": 1}')
    return o.select(F.coalesce(X.record_ref("source", "observation_id"), F.concat(F.lit("mycoportal:"), "observation_id")).alias("ref"), n.alias("species_name"), F.lit(True).alias("approved"), flags.alias("flags"))


_REF = "CASE source WHEN 'iNaturalist' THEN concat('inat:', observation_id) WHEN 'MO Observations' THEN concat('mo:', observation_id) ELSE concat('mycoportal:', observation_id) END"
_SEQ = f"""seqs AS (SELECT {_REF} AS ref, trim(CASE WHEN id % 12 = 0 THEN 'Xenus otherensis' ELSE regexp_replace(scientific_name, ' Fr\\.$', '') END) AS species_name FROM occ WHERE id % 2 = 0 AND id % 14 <> 0),
 refs AS (SELECT id, {_REF} AS ref FROM occ UNION ALL SELECT id, concat('mo:', observation_id) FROM occ WHERE source = 'iNaturalist'),
 sn AS (SELECT DISTINCT id, species_name FROM refs JOIN seqs USING (ref))"""


def _links(spark, d):
    return occurrences(spark, d).where("source = 'iNaturalist'").select(F.concat(F.lit("inat:"), "observation_id").alias("ref"), F.concat(F.lit("mo:"), "observation_id").alias("other_ref")).distinct()


def _names(spark, d):
    return J.sequence_names(occurrences(spark, d), _sequences(spark, d), _links(spark, d))


@query("joi1_sequence_names", f"{WITH_OCC}, {_SEQ} SELECT id, species_name FROM sn")
def joi1(spark, d):
    return _names(spark, d)


_DNA = f"""keyed AS (SELECT id, species_name AS n, {KEY_SQL.replace('scientific_name', 'species_name')} AS k FROM sn),
 sets AS (SELECT id, list_sort(list(DISTINCT n)) AS seqs, count(DISTINCT k) AS kinds FROM keyed GROUP BY 1),
 named AS (SELECT o.id, o.source, scientific_name AS record_name, seqs, kinds, CASE WHEN list_contains(seqs, trim(scientific_name)) THEN trim(scientific_name) ELSE seqs[1] END AS nm FROM occ o LEFT JOIN sets USING (id)),
 lab AS (SELECT *, CASE WHEN seqs IS NULL THEN 'no approved named sequence' WHEN kinds > 1 THEN 'sequences disagree (left out)' WHEN nm NOT LIKE '% %' THEN 'sequence name is one word (left out)'
 WHEN record_name NOT LIKE '% %' THEN 'record name is one word, the sequence names a species' WHEN trim(record_name) = nm THEN 'sequence name is the record name'
 WHEN {KEY_SQL.replace('scientific_name', 'record_name')} = {KEY_SQL.replace('scientific_name', 'nm')} THEN 'record name differs in writing only'
 WHEN lower(regexp_replace(record_name, ' .*$', '')) <> lower(regexp_replace(nm, ' .*$', '')) THEN 'record name is in another genus' ELSE 'record name is another species of the genus' END AS name_status FROM named)"""


def labelled(spark, d):
    return J.sequenced_records(occurrences(spark, d), _sequences(spark, d), _links(spark, d))


@query("joi2_dna_names", f"{WITH_OCC}, {_SEQ}, {_DNA} SELECT id, name_status, CASE WHEN name_status NOT IN ('sequences disagree (left out)', 'sequence name is one word (left out)', 'no approved named sequence') THEN nm END AS scientific_name FROM lab")
def joi2(spark, d):
    return labelled(spark, d).select("id", "name_status", "scientific_name")


@query(
    "joi3_first_validated",
    f"""{WITH_OCC}, s AS (SELECT concat(source, ':', observation_id) AS key, CASE WHEN id % 3 = 0 THEN observed_on END AS a, CASE WHEN id % 4 = 1 THEN updated_at END AS b FROM occ)
 SELECT key, CAST(min(least(coalesce(a, b), coalesce(b, a))) AS VARCHAR) AS first_green_on FROM s WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 1""",
)
def joi3(spark, d):
    o = occurrences(spark, d)
    slots = o.select(
        "source", "observation_id", F.when(F.col("id") % 3 == 0, " YES ").alias("validation_status_1"), F.date_format("observed_on", "M/d/yyyy").alias("validation_date_1"),
        F.when(F.col("id") % 4 == 1, "yes").otherwise("no").alias("validation_status_2"), F.col("updated_at").cast("string").alias("validation_date_2"),
        F.lit(None).cast("string").alias("validation_status_3"), F.lit(None).cast("string").alias("validation_date_3"),
    )
    return J.first_validated(slots).select("key", F.col("first_green_on").cast("string").alias("first_green_on"))


@query(
    "joi4_coordinate_override",
    f"""{WITH_OCC}, b AS (SELECT number, coalesce(gps_lat, CASE WHEN {_HALF} <= 5000 THEN (north + south) / 2 END) AS la, coalesce(gps_lng, CASE WHEN {_HALF} <= 5000 THEN (east + west) / 2 END) AS lo FROM ({_BOXES.replace('o_orderkey % 5000', 'o_orderkey')}))
 SELECT id, round(coalesce(la, latitude), 6) AS latitude, round(coalesce(lo, longitude), 6) AS longitude FROM occ LEFT JOIN b ON source = 'MO Observations' AND number = observation_id""",
)
def joi4(spark, d):
    one = table(spark, d, "orders").where("o_orderkey % 3 = 1")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    five = k % 5 == 0
    boxes = one.select(
        k.cast("string").alias("number"), (40 + (c % 90).cast("double") / 1000).alias("north"), F.lit(40.0).alias("south"), (-100 + (c % 70).cast("double") / 1000).alias("east"),
        F.lit(-100.0).alias("west"), F.when(five, 40.5).alias("gps_lat"), F.when(five, -100.5).alias("gps_lng"),
    )
    out = J.override_coordinates(occurrences(spark, d), boxes)
    return out.select("id", r("latitude").alias("latitude"), r("longitude").alias("longitude"))


@query("joi5_region_of", f"{WITH_OCC}, {_REGION_OF} SELECT id, country_code, region, code FROM rr")
def joi5(spark, d):
    return J.region_of(occurrences(spark, d), _regions(spark)).select("id", "country_code", "region", "code")


def _guilds(spark, d):
    n = occurrences(spark, d).select(X.taxon_genus("scientific_name").alias("genus")).distinct()
    return n.where(F.ascii("genus") % 2 == 0).select("genus", F.when(F.ascii("genus") % 4 == 0, "saprotroph").otherwise("ectomycorrhizal").alias("lifestyle"))


@query("joi6_guilds", f"{WITH_OCC} SELECT id, CASE WHEN ascii(scientific_name) % 4 = 0 THEN 'saprotroph' WHEN ascii(scientific_name) % 2 = 0 THEN 'ectomycorrhizal' ELSE 'unknown' END AS lifestyle FROM occ")
def joi6(spark, d):
    return J.taxon_guild(occurrences(spark, d), _guilds(spark, d)).select("id", "lifestyle")


@query("joi7_bands_at_sites", "SELECT l_partkey AS cell, l_suppkey AS site, p_size, p_retailprice FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) LEFT JOIN part ON p_partkey = l_partkey")
def joi7(spark, d):
    sites = table(spark, d, "lineitem").select(F.col("l_partkey").alias("cell"), F.col("l_suppkey").alias("site")).distinct()
    return J.add_bands(sites, table(spark, d, "part").withColumnRenamed("p_partkey", "cell"), ["p_size", "p_retailprice"])


_CELLS = f"{WITH_POINTS}, busy AS (SELECT cell5 AS cell, min(x) AS x, min(y) AS y, count(*) AS records FROM pts WHERE cell5 IS NOT NULL GROUP BY 1)"


def _busy(spark, d):
    return points(spark, d).where("cell5 is not null").groupBy(F.col("cell5").alias("cell")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.count("*").alias("records"))


#: The busy cells that stand after thinning to 60 km, one after another in SQL.
_THINNED = f"""{_CELLS.replace('WITH ', 'WITH RECURSIVE ', 1)}, nb AS (SELECT *, row_number() OVER (ORDER BY records DESC, cell) AS n FROM busy),
 walk(n, cell, chosen, cs) AS (SELECT 0::BIGINT, 0::BIGINT, false, []::STRUCT(x DOUBLE, y DOUBLE)[]
  UNION ALL SELECT n, cell, chosen, CASE WHEN chosen THEN list_append(cs, {{'x': x, 'y': y}}) ELSE cs END
   FROM (SELECT b.n, b.cell, b.x, b.y, cs, len(list_filter(cs, lambda c: pow(c.x - b.x, 2) + pow(c.y - b.y, 2) < 60000.0::DOUBLE * 60000)) = 0 AS chosen FROM walk w JOIN nb b ON b.n = w.n + 1)),
 ctr AS (SELECT b.cell, b.x, b.y, b.records FROM walk w JOIN nb b ON b.n = w.n WHERE w.chosen)"""


@query(
    "joi8_site_assignment",
    f"""{_THINNED}, near AS (SELECT b.cell, arg_min(c.cell, (round(pow(b.x - c.x, 2) + pow(b.y - c.y, 2), 3), c.cell)) AS site
  FROM busy b JOIN ctr c ON pow(b.x - c.x, 2) + pow(b.y - c.y, 2) <= 60000.0::DOUBLE * 60000 GROUP BY 1)
 SELECT b.cell, coalesce(n.site, b.cell) AS site FROM busy b LEFT JOIN near n ON n.cell = b.cell""",
)
def joi8(spark, d):
    """Every cell at the nearest of the cells that thinning leaves."""
    busy = cut(_busy(spark, d))
    return J.attach_sites(busy, J.thin_by_distance(busy, 60_000.0), 60_000.0).select("cell", "site")


@query("joi9_thinning", f"{_THINNED} SELECT cell, records FROM ctr")
def joi9(spark, d):
    return J.thin_by_distance(_busy(spark, d), 60_000.0).select("cell", "records")


@query(
    "joi10_accessible_area",
    f"{_CELLS}, det AS (SELECT DISTINCT regexp_extract(scientific_name, '^[A-Z][a-z]+') AS taxon, x, y FROM pts WHERE cell5 IS NOT NULL) SELECT DISTINCT d.taxon, b.cell FROM det d JOIN busy b ON pow(d.x - b.x, 2) + pow(d.y - b.y, 2) <= 150000.0::DOUBLE * 150000",
)
def joi10(spark, d):
    det = points(spark, d).where("cell5 is not null").select(X.taxon_genus("scientific_name").alias("taxon"), "x", "y")
    return J.accessible_sites(_busy(spark, d).select("cell", "x", "y"), det, 150).select("taxon", "cell")


@query(
    "joi11_nearest",
    f"""{_CELLS}, asked AS (SELECT c_custkey AS q, {X_SQL} AS ax, {Y_SQL} AS ay FROM
  (SELECT c_custkey, 14 + CAST(c_custkey * 37 % 5800 AS DOUBLE) / 100 AS latitude, -170 + CAST(c_custkey * 91 % 11800 AS DOUBLE) / 100 AS longitude FROM customer))
 SELECT q, round(sqrt(min(pow(ax - x, 2) + pow(ay - y, 2))), 3) AS distance FROM asked, busy GROUP BY 1""",
)
def joi11(spark, d):
    """Every customer's place, with or without records, against all cells with records."""
    k = F.col("c_custkey")
    x, y = albers("latitude", "longitude")
    asked = table(spark, d, "customer").select(k.alias("q"), (14 + (k * 37 % 5800).cast("double") / 100).alias("latitude"), (-170 + (k * 91 % 11800).cast("double") / 100).alias("longitude"))
    return J.nearest(asked.select("q", x.alias("x"), y.alias("y")), _busy(spark, d)).select("q", r("distance", 3).alias("distance"))


@query(
    "joi11_nearest_in_space",
    """WITH e AS (SELECT vec_id, label % 2 AS side, [list_sum(embedding[16 * k + 1:16 * k + 16]::DOUBLE[]) FOR k IN range(4)] AS v FROM embeddings)
 SELECT q.vec_id AS q, round(sqrt(min(pow(q.v[1] - s.v[1], 2) + 2 * pow(q.v[2] - s.v[2], 2) + pow(q.v[3] - s.v[3], 2) + pow(q.v[4] - s.v[4], 2))), 6) AS distance
 FROM e q LEFT JOIN e s ON s.side = 1 - q.side GROUP BY 1""",
)
def joi11_space(spark, d):
    """Every vector's distance to the nearest one of the labels of the other parity, by the sums of its four quarters."""
    part = lambda k: F.aggregate(F.slice("embedding", 16 * k + 1, 16), F.lit(0.0), lambda s, v: s + v)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("q"), (F.col("label") % 2).alias("side"), *[part(k).alias(n) for k, n in enumerate("abcd")])
    other = e.withColumn("side", 1 - F.col("side"))
    return J.nearest_in_space(e, other, ["a", "b", "c", "d"], {"b": 2.0}, by=["side"]).select("q", r("distance").alias("distance"))


@query(
    "joi12_held_out_distance",
    f"{_CELLS}, s AS (SELECT cell, x, y, CAST(cell % 4 AS INT) AS fold FROM busy) SELECT a.cell AS q, a.fold, round(sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 3) AS distance FROM s a JOIN s b ON a.fold <> b.fold GROUP BY 1, 2",
)
def joi12(spark, d):
    s = _busy(spark, d).select(F.col("cell").alias("site"), "x", "y", (F.col("cell") % 4).cast("int").alias("fold"), F.lit("t").alias("taxon"), F.lit(1).alias("presence"))
    return J.held_out_distances(s).select("q", "fold", r("distance", 3).alias("distance"))


_ASK = "SELECT c_custkey AS point, 20 + CAST(c_custkey % 40 AS DOUBLE) AS lat, -150 + CAST(c_custkey % 90 AS DOUBLE) AS lng FROM customer"


def _ask(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("point"), (20 + (k % 40).cast("double")).alias("lat"), (-150 + (k % 90).cast("double")).alias("lng"))


_GENUS_CELLS = "gc AS (SELECT regexp_extract(scientific_name, '^[A-Z][a-z]+') AS taxon, latitude AS lat, longitude AS lng, count(*) AS records FROM occ GROUP BY ALL)"


def _genus_cells(spark, d):
    o = occurrences(spark, d)
    return o.groupBy(X.taxon_genus("scientific_name").alias("taxon"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng")).agg(F.count("*").alias("records"))


_HAV = "2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin((radians(gc.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(gc.lat)) * pow(sin(radians(gc.lng - p.lng) / 2), 2))))"


@query("joi13_recorded_near", f"{WITH_OCC}, {_GENUS_CELLS}, p AS ({_ASK}) SELECT point, taxon, CAST(sum(records) AS BIGINT) AS records FROM p, gc WHERE {_HAV} <= 150 GROUP BY 1, 2")
def joi13(spark, d):
    return J.recorded_near(_ask(spark, d), _genus_cells(spark, d), 150)


@query(
    "joi14_what_grows_here",
    f"""{WITH_POINTS}, idx AS (SELECT DISTINCT cell20 AS cell, id % 30 AS model, CAST(50 + (cell20 + id % 30) % 51 AS TINYINT) AS rank FROM pts WHERE cell20 IS NOT NULL),
 m AS (SELECT range AS model, CAST(range % 12 AS VARCHAR) AS taxon FROM range(30)), f AS (SELECT taxon, count(*) AS fitted FROM m GROUP BY 1),
 p AS (SELECT DISTINCT custkey AS point, cell20 AS cell FROM pts WHERE cell20 IS NOT NULL)
 SELECT point, taxon, round(sum(rank) / (100.0::DOUBLE * any_value(fitted)), 6) AS score, count(*) FILTER (WHERE rank >= 90) AS agree, count(*) AS models FROM p JOIN idx USING (cell) JOIN m USING (model) JOIN f USING (taxon) GROUP BY 1, 2""",
)
def joi14(spark, d):
    p = points(spark, d).where("cell20 is not null")
    idx = p.select(F.col("cell20").alias("cell"), (F.col("id") % 30).alias("model")).distinct().withColumn("rank", (50 + (F.col("cell") + F.col("model")) % 51).cast("tinyint"))
    models = spark.range(30).select(F.col("id").alias("model"), (F.col("id") % 12).cast("string").alias("taxon"))
    ask = p.select(F.col("custkey").alias("point"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng")).distinct()
    return J.what_grows_here(ask, idx, models).withColumn("score", r("score"))


@query("joi14_unmapped_near", f"{WITH_OCC}, {_GENUS_CELLS}, p AS ({_ASK}) SELECT point, taxon, CAST(sum(records) AS BIGINT) AS records FROM p, gc WHERE {_HAV} <= 50 AND taxon > 'D' GROUP BY 1, 2")
def joi14_unmapped(spark, d):
    cells = _genus_cells(spark, d)
    return J.unmapped_near(_ask(spark, d), cells, cells.where("taxon <= 'D'").select("taxon"))


@query(
    "joi15_zonal_counts",
    f"""WITH v AS ({MAP_SQL}), cr AS (SELECT p_partkey AS cell, p_brand AS code FROM part), fl AS (SELECT model, quantile_cont(value, 0.1) AS floor FROM v WHERE cell % 5 = 0 GROUP BY 1), n AS (SELECT code, count(*) AS cells FROM cr GROUP BY 1)
 SELECT model, code, cells, count(*) AS reach, count(*) FILTER (WHERE value >= floor) AS suitable FROM v JOIN cr USING (cell) JOIN fl USING (model) JOIN n USING (code) GROUP BY ALL""",
)
def joi15(spark, d):
    v = map_values(spark, d)
    cr = table(spark, d, "part").select(F.col("p_partkey").alias("cell"), F.col("p_brand").alias("code"))
    return J.region_counts(v, cr, v.where("cell % 5 = 0"))


@query(
    "joi16_region_status",
    """WITH rec AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS taxon, o_orderpriority AS code, count(*) AS records, count(DISTINCT o_custkey) AS localities FROM orders GROUP BY ALL),
 pred AS (SELECT CAST(s_suppkey % 60 AS VARCHAR) AS taxon, o_orderpriority AS code, max((s_suppkey % 30) / 100.0::DOUBLE) AS reach_share, max((s_suppkey % 17) / 100.0::DOUBLE) AS suitable_share, max((s_suppkey % 23) / 100.0::DOUBLE) AS best_share FROM supplier, (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority < '3') GROUP BY ALL),
 b AS (SELECT coalesce(rec.taxon, pred.taxon) AS taxon, coalesce(rec.code, pred.code) AS code, coalesce(records, 0) AS records, coalesce(localities, 0) AS localities, reach_share, suitable_share, best_share, rec.taxon IS NOT NULL AS had FROM rec FULL JOIN pred ON rec.taxon = pred.taxon AND rec.code = pred.code),
 c AS (SELECT taxon, code, records, localities, CASE WHEN taxon IN (SELECT taxon FROM pred) THEN coalesce(reach_share, 0) END AS reach_share, CASE WHEN taxon IN (SELECT taxon FROM pred) THEN coalesce(suitable_share, 0) END AS suitable_share, CASE WHEN taxon IN (SELECT taxon FROM pred) THEN coalesce(best_share, 0) END AS best_share FROM b WHERE had OR best_share >= 0.1 - 1e-9)
 SELECT *, CASE WHEN suitable_share IS NULL THEN 'no map' WHEN suitable_share >= 0.1 - 1e-9 THEN 'likely' WHEN best_share >= 0.1 - 1e-9 THEN 'possible' WHEN reach_share < 0.1 - 1e-9 THEN 'beyond reach' ELSE 'unlikely' END AS model FROM c""",
)
def joi16(spark, d):
    o = table(spark, d, "orders")
    rec = o.groupBy((F.col("o_custkey") % 40).cast("string").alias("taxon"), F.col("o_orderpriority").alias("code")).agg(F.count("*").alias("records"), F.count_distinct("o_custkey").alias("localities"))
    k = F.col("s_suppkey")
    codes = o.where("o_orderpriority < '3'").select(F.col("o_orderpriority").alias("code")).distinct()
    pred = table(spark, d, "supplier").crossJoin(F.broadcast(codes)).groupBy((k % 60).cast("string").alias("taxon"), "code")
    pred = pred.agg(F.max((k % 30) / 100.0).alias("reach_share"), F.max((k % 17) / 100.0).alias("suitable_share"), F.max((k % 23) / 100.0).alias("best_share"))
    return J.region_status(rec, pred)


@query(
    "joi17_resolve_names",
    """WITH RECURSIVE names AS (SELECT CAST(range AS VARCHAR) AS name FROM range(40)), ren AS (SELECT DISTINCT concat('old ', o_custkey % 90) AS a, CASE WHEN o_custkey % 90 < 40 THEN CAST(o_custkey % 90 AS VARCHAR) ELSE concat('old ', o_custkey % 90 - 35) END AS b FROM orders),
 ask AS (SELECT DISTINCT concat('old ', o_custkey % 120) AS name FROM orders UNION SELECT name FROM names),
 w(name, pos, hops) AS (SELECT name, name, 0 FROM ask UNION ALL SELECT w.name, ren.b, hops + 1 FROM w JOIN ren ON ren.a = w.pos WHERE hops < 10 AND w.pos NOT IN (SELECT name FROM names))
 SELECT ask.name, f.found, CASE WHEN f.hops = 0 THEN 'exact' WHEN f.found IS NOT NULL THEN 'renamed' END AS how FROM ask LEFT JOIN (SELECT name, pos AS found, hops FROM w WHERE pos IN (SELECT name FROM names)) f ON f.name = ask.name""",
)
def joi17(spark, d):
    o = table(spark, d, "orders")
    names = spark.range(40).select(F.col("id").cast("string").alias("name"))
    k = F.col("o_custkey") % 90
    new = F.when(k < 40, k.cast("string")).otherwise(F.concat(F.lit("old "), (k - 35).cast("string")))
    ren = o.select(F.concat(F.lit("old "), k.cast("string")).alias("old_name"), new.alias("new_name")).distinct()
    ask = o.select(F.concat(F.lit("old "), (F.col("o_custkey") % 120).cast("string")).alias("name")).union(names).distinct()
    return J.resolve_names(ask, names, ren).select("name", "found", "how")


@query("joi18_folded_counts", f"{WITH_OCC}, t AS (SELECT {KEY_SQL} AS key, min(scientific_name) AS scientific_name FROM occ GROUP BY 1), raw AS (SELECT {KEY_SQL} AS key, count(*) AS n FROM occ GROUP BY 1) SELECT scientific_name, n AS not_yet_validated FROM t JOIN raw USING (key)")
def joi18(spark, d):
    o = occurrences(spark, d)
    raw = o.groupBy(F.col("scientific_name").alias("taxon")).agg(F.count("*").cast("string").alias("not_yet_validated"))
    taxa = o.groupBy(X.name_key("scientific_name").alias("k")).agg(F.min("scientific_name").alias("scientific_name")).drop("k")
    return J.fold_counts(raw, taxa, ["not_yet_validated"])


_CHANGES = "SELECT event_id AS id, concat('name ', user_id) AS old_name, concat('name ', (user_id * 7 + event_id) % 200) AS new_name FROM events WHERE event_type = 'view'"


def _changes(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("name "), F.col("user_id").cast("string")).alias("old_name"), F.concat(F.lit("name "), ((F.col("user_id") * 7 + F.col("event_id")) % 200).cast("string")).alias("new_name"))


@query("joi19_latest_renames", f"SELECT old_name, arg_max(new_name, id) AS new_name, max(id) AS id FROM ({_CHANGES}) WHERE old_name NOT IN (SELECT concat('name ', range) FROM range(20)) GROUP BY 1")
def joi19(spark, d):
    current = spark.range(20).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"))
    return J.latest_renames(_changes(spark, d), current).select("old_name", "new_name", "id")


@query(
    "joi20_change_reasons",
    f"""{WITH_OCC}, ch AS (SELECT DISTINCT concat('inat:', observation_id) AS ref, 'merge of A to B' AS reason FROM occ WHERE id % 50 = 0 AND source = 'iNaturalist') SELECT scientific_name, string_agg(DISTINCT reason, '; ') AS reasons FROM occ JOIN ch ON source = 'iNaturalist' AND ref = concat('inat:', observation_id) GROUP BY 1""",
)
def joi20(spark, d):
    o = occurrences(spark, d)
    refs = o.where("id % 50 = 0 and source = 'iNaturalist'").select(F.lit("merge").alias("kind"), F.lit("A").alias("old_name"), F.lit("B").alias("new_name"), F.array(F.concat(F.lit("inat:"), "observation_id")).alias("refs"))
    return J.change_reasons(refs, o)


#: Finds are users' days with events; every event is also a change, dated up to six days later.
_FINDS = "SELECT DISTINCT user_id AS ref, CAST(ts AS DATE) AS day, concat('n', user_id) AS name FROM events"
_LOG = """SELECT event_id AS id, user_id AS ref, CAST(ts AS DATE) + CAST(event_id % 7 AS INT) AS day, concat('was ', event_id) AS old_name,
 CASE WHEN event_id % 4 = 0 THEN 'merge' ELSE 'rename' END AS kind FROM events"""


@query(
    "joi21_name_as_of",
    f"""WITH f AS ({_FINDS}), c AS ({_LOG}), m AS (SELECT f.*, arg_min(old_name, (c.day, c.id)) FILTER (WHERE c.day > f.day) AS o, arg_min(kind, (c.day, c.id)) FILTER (WHERE c.day > f.day) AS k, bool_or(c.day = f.day) AS same FROM f LEFT JOIN c ON c.ref = f.ref AND c.day >= f.day GROUP BY ALL)
 SELECT ref, CAST(day AS VARCHAR) AS day, name, coalesce(o, name) AS name_then, CASE WHEN same THEN 'same day' WHEN k = 'merge' THEN 'merge' END AS flag FROM m""",
)
def joi21(spark, d):
    e = table(spark, d, "events")
    user, day = F.col("user_id").alias("ref"), F.col("ts").cast("date")
    finds = e.select(user, day.alias("day"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("name")).distinct()
    later, old = F.date_add(day, (F.col("event_id") % 7).cast("int")), F.concat(F.lit("was "), F.col("event_id").cast("string"))
    log = e.select(F.col("event_id").alias("id"), user, later.alias("day"), old.alias("old_name"), F.when(F.col("event_id") % 4 == 0, "merge").otherwise("rename").alias("kind"))
    return J.name_as_of(finds, log).withColumn("day", F.col("day").cast("string"))


@query(
    "joi22_live_at",
    """WITH p AS (SELECT user_id, ts AS promoted_at, event_id AS release FROM events WHERE event_type = 'purchase'), d AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events)
 SELECT user_id, CAST(CAST(day AS DATE) AS VARCHAR) AS day, (SELECT arg_max(release, (promoted_at, release)) FROM p WHERE p.user_id = d.user_id AND promoted_at < day) AS release FROM d""",
)
def joi22(spark, d):
    e = table(spark, d, "events")
    p = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("promoted_at"), F.col("event_id").alias("release"))
    days = e.select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    return J.live_at(days, p, ["user_id"]).select("user_id", F.col("day").cast("date").cast("string").alias("day"), "release")


@query(
    "joi23_rank_at_points",
    f"""WITH v AS ({MAP_SQL}), rk AS (SELECT model, cell, round(value, 2) AS rank, cell % 3 <> 0 AS inside FROM v)
 SELECT v.model, v.cell + 1 AS cell, CASE WHEN inside THEN rank END AS rank, CASE WHEN inside THEN 'inside' WHEN inside IS NOT NULL THEN 'outside_aoa' ELSE 'beyond_reach' END AS place
 FROM v LEFT JOIN rk ON rk.model = v.model AND rk.cell = v.cell + 1""",
)
def joi23(spark, d):
    """The cell after each cell of a map looked up on the same map."""
    v = map_values(spark, d)
    ranked = v.select("model", "cell", F.round("value", 2).alias("rank"), (F.col("cell") % 3 != 0).alias("inside"))
    return J.rank_at(v.select("model", (F.col("cell") + 1).alias("cell")), ranked, ["model", "cell"])


_CAND = "SELECT CAST(c_custkey AS VARCHAR) AS taxon, 'rf' AS algorithm, md5(c_mktsegment) AS fingerprint, 's1' AS settings, c_custkey % 50 AS sites FROM customer WHERE c_custkey % 5 <> 0"
_INDEX = "SELECT CAST(c_custkey AS VARCHAR) AS taxon, 'rf' AS algorithm, CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE md5(c_mktsegment) END AS fingerprint, CASE WHEN c_custkey % 9 = 0 THEN 's0' ELSE 's1' END AS settings FROM customer WHERE c_custkey % 3 <> 0"
_FAILED = "SELECT taxon, algorithm, fingerprint, settings FROM cand WHERE CAST(taxon AS BIGINT) % 7 = 0"
_STATE = """st AS (SELECT coalesce(c.taxon, i.taxon) AS taxon, CASE WHEN c.fingerprint IS NULL THEN 'retired' WHEN sites NOT BETWEEN 20 AND 10000000 THEN 'refused'
 WHEN i.fingerprint IS NULL THEN CASE WHEN CAST(c.taxon AS BIGINT) % 7 = 0 THEN 'known failed' ELSE 'new' END WHEN i.fingerprint = c.fingerprint AND i.settings = c.settings THEN 'current'
 ELSE CASE WHEN CAST(c.taxon AS BIGINT) % 7 = 0 THEN 'known failed' ELSE 'changed' END END AS state, sites FROM cand c FULL JOIN idx i ON c.taxon = i.taxon AND c.algorithm = i.algorithm)"""


def candidates(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    print_ = F.md5(F.col("c_mktsegment").cast("binary"))
    cand = c.where("c_custkey % 5 <> 0").select(k.cast("string").alias("taxon"), F.lit("rf").alias("algorithm"), print_.alias("fingerprint"), F.lit("s1").alias("settings"), (k % 50).alias("sites"))
    index = c.where("c_custkey % 3 <> 0").select(k.cast("string").alias("taxon"), F.lit("rf").alias("algorithm"), F.when(k % 4 == 0, "x").otherwise(print_).alias("fingerprint"), F.when(k % 9 == 0, "s0").otherwise("s1").alias("settings"))
    failed = cand.where("cast(taxon as bigint) % 7 = 0").select("taxon", "algorithm", "fingerprint", "settings")
    return cand, index, failed


@query("joi24_staleness", f"WITH cand AS ({_CAND}), idx AS ({_INDEX}), {_STATE} SELECT taxon, state FROM st")
def joi24(spark, d):
    return J.staleness(*candidates(spark, d)).select("taxon", "state")


@query(
    "joi25_label_alignment",
    f"""{WITH_OCC}, a AS (SELECT id, source, concat(source, ':', id) AS key, scientific_name AS dna, CASE WHEN id % 6 = 0 THEN replace(scientific_name, ' ssp. ', ' subsp. ') WHEN id % 6 = 1 THEN concat(regexp_extract(scientific_name, '^[A-Z][a-z]+'), ' changed') WHEN id % 6 = 2 THEN 'Other name' ELSE scientific_name END AS record FROM occ)
 SELECT source, CASE WHEN id % 17 = 0 THEN 'no_taxon' WHEN dna = record THEN 'same' WHEN {KEY_SQL.replace('scientific_name', 'dna')} = {KEY_SQL.replace('scientific_name', 'record')} THEN 'spelling' WHEN lower(regexp_replace(dna, ' .*$', '')) = lower(regexp_replace(record, ' .*$', '')) THEN 'species' ELSE 'genus' END AS change, count(*) AS n FROM a GROUP BY ALL""",
)
def joi25(spark, d):
    return aligned(spark, d).groupBy("source", "change").agg(F.count("*").alias("n"))


def aligned(spark, d):
    o = occurrences(spark, d).select(F.col("id"), "source", F.col("id").alias("observation_id"), "scientific_name")
    m, n = F.col("id") % 6, F.col("scientific_name")
    other = F.when(m == 0, F.replace(n, F.lit(" ssp. "), F.lit(" subsp. "))).when(m == 1, F.concat(X.taxon_genus(n), F.lit(" changed"))).when(m == 2, "Other name").otherwise(n)
    return J.align_labels(o, o.where("id % 17 <> 0").withColumn("scientific_name", other))


@query("joi26_paired_rows", f"WITH v AS ({MAP_SQL}) SELECT taxon, model AS map, cell AS place, round(value, 2) AS rank, round(value * 2, 2) AS baseline_rank FROM v WHERE cell % 4 <> 0")
def joi26(spark, d):
    v = map_values(spark, d).select("taxon", F.col("model").alias("map"), F.col("cell").alias("place"), F.round("value", 2).alias("rank"))
    b = map_values(spark, d).select("taxon", F.col("model").alias("map"), F.col("cell").alias("place"), F.when(F.col("cell") % 4 != 0, F.round(F.col("value") * 2, 2)).alias("rank"))
    return J.paired_rows(v, b)


@query("joi27_trained_records", f"{WITH_OCC}, t AS (SELECT DISTINCT scientific_name AS taxon, sha256(scientific_name) AS fingerprint FROM occ WHERE ascii(scientific_name) % 3 = 1) SELECT DISTINCT taxon, concat(source, ':', observation_id) AS record FROM occ JOIN t ON scientific_name = taxon")
def joi27(spark, d):
    o = occurrences(spark, d)
    prints = o.select("scientific_name").distinct().withColumn("fingerprint", F.sha2("scientific_name", 256))
    index = prints.where(F.ascii("scientific_name") % 3 == 1).select(F.col("scientific_name").alias("taxon"), "fingerprint")
    return J.trained_records(index, o, prints)


@query(
    "joi28_withheld_finds",
    f"""{WITH_POINTS} SELECT side, CASE WHEN first_green_on IS NULL THEN 'undated' WHEN side = 'test' THEN CASE WHEN cell5 IS NULL THEN 'off_grid' WHEN observed_on <= DATE '1996-06-30' THEN 'observed_before' WHEN concat(source, ':', observation_id) IN (SELECT concat(source, ':', observation_id) FROM occ WHERE id % 19 = 0) THEN 'excluded' END END AS apart, count(*) AS n
 FROM (SELECT *, CASE WHEN first_green_on <= DATE '1996-06-30' THEN 'train' WHEN first_green_on > DATE '1996-06-30' THEN 'test' END AS side FROM pts) GROUP BY ALL""",
)
def joi28(spark, d):
    o = occurrences(spark, d)
    ex = o.where("id % 19 = 0").select(X.record_key("source", "observation_id").alias("record"))
    return J.split_finds(o, "1996-06-30", True, ex).groupBy("side", "apart").agg(F.count("*").alias("n"))


@query("joi29_refit_overlay", f"WITH cand AS ({_CAND}), idx AS ({_INDEX}) SELECT coalesce(c.taxon, i.taxon) AS taxon, c.sites AS new_sites, i.settings AS old_settings, c.taxon IS NOT NULL AS owned FROM cand c FULL JOIN idx i ON c.taxon = i.taxon")
def joi29(spark, d):
    cand, index, _ = candidates(spark, d)
    return J.refit_overlay(cand, index).select("taxon", F.col("refit.sites").alias("new_sites"), F.col("model.settings").alias("old_settings"), "owned")


@query("joi30_occurrence_points", f"{WITH_POINTS} SELECT id, scientific_name AS taxon, cell5 AS cell, -7445000 + ((cell5 - 1) % 2436 + 0.5::DOUBLE) * 5000 AS x, 4740000 - (floor((cell5 - 1) / 2436) + 0.5::DOUBLE) * 5000 AS y, CAST(year(observed_on) AS INT) AS year FROM pts WHERE cell5 IS NOT NULL")
def joi30(spark, d):
    return J.occurrence_points(occurrences(spark, d)).drop("site")


@query(
    "joi31_paired_ground",
    f"""WITH v AS ({MAP_SQL}), g AS (SELECT model AS map, cell, value FROM v WHERE cell % 3 <> 0)
 SELECT map, cell, round(CASE WHEN n = 1 THEN 1 ELSE (rk + (ties - 1) / 2.0 - 1) / (n - 1) END::DOUBLE, 6) AS rank FROM (SELECT *, rank() OVER (PARTITION BY map ORDER BY value) AS rk, count(*) OVER (PARTITION BY map, value) AS ties, count(*) OVER (PARTITION BY map) AS n FROM g)""",
)
def joi31(spark, d):
    v = map_values(spark, d).select(F.col("model").alias("map"), "cell", "value")
    model = v.select("map", "cell", F.when(F.col("cell") % 3 != 0, 1.0).alias("rank"))
    return J.paired_ground(v, model).select("map", "cell", r("rank").alias("rank"))


@query(
    "joi32_block_reuse",
    f"WITH cand AS ({_CAND}), idx AS ({_INDEX}), e AS (SELECT taxon, fingerprint, CASE WHEN CAST(taxon AS BIGINT) % 2 = 0 THEN 'rf' ELSE 'maxnet' END AS algorithm, CAST(taxon AS BIGINT) % 6 * 50 AS block_km FROM idx) SELECT c.taxon, e.block_km FROM cand c LEFT JOIN e ON e.taxon = c.taxon AND e.fingerprint = c.fingerprint",
)
def joi32(spark, d):
    cand, index, _ = candidates(spark, d)
    k = F.col("taxon").cast("bigint")
    earlier = index.select("taxon", F.when(k % 2 == 0, "rf").otherwise("maxnet").alias("algorithm"), "fingerprint", (k % 6 * 50).alias("block_km"), k.alias("seed"))
    return J.reuse_blocks(cand, earlier).select("taxon", "block_km")
