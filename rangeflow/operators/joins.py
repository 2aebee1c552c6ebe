"""Joins (JOI1 to JOI32).

Range and nearest joins are equi-joins on squares: a row meets the rows of its own and the eight squares around it, so a
distance test never needs a cross join.  Small sides that are metadata by nature (regions, guilds, bands) are left to the
optimiser, which broadcasts them by their measured size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from rangeflow.functions.scalars import albers, cell_centre, grid_cell, km_between, on_grid, record_year, region_verdict
from rangeflow.functions.text import REF_PREFIX, name_key, record_key, region_key, taxon_genus
from rangeflow.operators.predicates import MO, asking, half_diagonal_m

#: What a record's name and its sequences' names can be to each other.
LABEL_SAME = "sequence name is the record name"
LABEL_SPELLING = "record name differs in writing only"
LABEL_RECORD_GENUS = "record name is one word, the sequence names a species"
LABEL_OTHER_SPECIES = "record name is another species of the genus"
LABEL_OTHER_GENUS = "record name is in another genus"
LABEL_SEQUENCE_GENUS = "sequence name is one word (left out)"
LABEL_DISAGREE = "sequences disagree (left out)"
LABEL_NONE = "no approved named sequence"
COUNTRY_NAMES = {"US": "United States", "CA": "Canada", "MX": "Mexico"}
#: Pivots of a group in the nearest search of a predictor space.
MOST_PIVOTS = 256
#: Pivots of all groups up to which a group's or a cell's number of parts is sent to every task.
BROADCAST_PIVOTS = 10_000
#: Rows of a part, and distances held at a time, in the nearest search of a predictor space.
NEAR_ROWS, NEAR_PAIRS = 16_384, 1 << 21
#: Spellings that are sent to every task.
BROADCAST_NAMES = 50_000
BUFFER_KM, THIN_KM, NEAR_KM = 500, 5, 50
_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


# ---- names and labels -------------------------------------------------------


def _record_refs(records: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for p in prefixes.items() for x in p]), F.col("source"))
    return records.withColumn("ref", F.concat(F.coalesce(prefix, F.lower("source")), F.lit(":"), F.col("observation_id").cast("string")))


def _ref_names(sequences: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (ref, species_name) of approved sequences, told of a key itself or of one that a link names."""
    fine = F.coalesce(F.get_json_object("flags", "$.contaminant"), F.lit("false")) != "true"
    good = sequences.where(F.col("approved") & fine & (F.trim(F.coalesce("species_name", F.lit(""))) != "")).select("ref", F.trim("species_name").alias("species_name")).distinct()
    linked = links.select(F.col("ref").alias("_own"), F.col("other_ref").alias("ref")).distinct().join(good, "ref").select(F.col("_own").alias("ref"), "species_name")
    return good.union(linked).distinct()


def sequence_names(records: DataFrame, sequences: DataFrame, links: DataFrame, prefixes: dict[str, str] = REF_PREFIX) -> DataFrame:
    """JOI1, SET1: distinct (id, species_name) of each record's approved sequences, directly by key or by one link.

    records: id, source, observation_id; sequences: ref, species_name, approved, flags (JSON); links: ref, other_ref.  Names are
    made distinct by key before they meet the records, so only the rows of an id that stands under several keys are compared again.
    """
    keyed = _record_refs(records, prefixes).groupBy("id").agg(F.collect_set("ref").alias("_refs"))
    keyed = keyed.select("id", F.explode("_refs").alias("ref"), (F.size("_refs") > 1).alias("_many"))
    met = keyed.join(_ref_names(sequences, links), "ref")
    return met.where("not _many").select("id", "species_name").unionByName(met.where("_many").select("id", "species_name").distinct())


def dna_names(records: DataFrame, names: DataFrame, keep_unnamed: bool = False, key: str = "id") -> DataFrame:
    """JOI2: records with ``record_name``, the name their sequences agree on as ``scientific_name`` (null: left out) and ``name_status``.

    names: (key, species_name); the key is the records' own or any other that their sequences are known by.
    """
    from rangeflow.operators.lineage import cut

    cleaned = names.select(key, F.trim("species_name").alias("n")).where("n <> ''").distinct()
    # keys are worked out once per spelling, of which there are few beside the records
    keys = cleaned.select("n").union(records.select(F.trim("scientific_name"))).where("n is not null").distinct()
    keys = cut(keys.withColumn("k", name_key("n")))
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_NAMES else keys
    cleaned = cleaned.join(keys, "n")
    sets = cleaned.groupBy(key).agg(F.array_sort(F.collect_set("n")).alias("_seqs"), F.count_distinct("k").alias("_kinds"))
    record = F.trim(F.col("record_name"))
    own = records.withColumnRenamed("scientific_name", "record_name").join(sets, key, "left")
    own = own.withColumn("_name", F.when(F.array_contains("_seqs", record), record).otherwise(F.col("_seqs")[0])).drop("_seqs")
    own = own.join(keys.select(F.col("n").alias("_name"), F.col("k").alias("_name_key")), "_name", "left")
    own = own.withColumn("_record", record).join(keys.select(F.col("n").alias("_record"), F.col("k").alias("_record_key")), "_record", "left").drop("_record")
    first_word = lambda c: F.lower(F.regexp_replace(c, " .*$", ""))
    status = (
        F.when(F.col("_kinds").isNull(), LABEL_NONE)
        .when(F.col("_kinds") > 1, LABEL_DISAGREE)
        .when(~F.col("_name").contains(" "), LABEL_SEQUENCE_GENUS)
        .when(record.isNull() | ~F.coalesce(record, F.lit("")).contains(" "), LABEL_RECORD_GENUS)
        .when(record == F.col("_name"), LABEL_SAME)
        .when(F.col("_record_key") == F.col("_name_key"), LABEL_SPELLING)
        .when(first_word(record) != first_word(F.col("_name")), LABEL_OTHER_GENUS)
        .otherwise(LABEL_OTHER_SPECIES)
    )
    out = own.withColumn("name_status", status)
    unnamed = F.col("record_name") if keep_unnamed else F.lit(None).cast("string")
    name = F.when(F.col("name_status").isin(LABEL_DISAGREE, LABEL_SEQUENCE_GENUS), None).when(F.col("name_status") == LABEL_NONE, unnamed).otherwise(F.col("_name"))
    return out.withColumn("scientific_name", name).drop("_kinds", "_name", "_name_key", "_record_key")


def sequenced_records(records: DataFrame, sequences: DataFrame, links: DataFrame, keep_unnamed: bool = False, prefixes: dict[str, str] = REF_PREFIX) -> DataFrame:
    """JOI1, JOI2: ``dna_names`` of records with one row per id: names are gathered by the key that records share, never by record."""
    return dna_names(_record_refs(records, prefixes), _ref_names(sequences, links), keep_unnamed, "ref").drop("ref")


def first_validated(slots: DataFrame, n: int = 3) -> DataFrame:
    """JOI3: first date of a 'yes' in any slot, by record key (source, observation_id, validation_status_1.., validation_date_1..)."""
    from rangeflow.functions.scalars import parse_validation_date

    pairs = F.array(*[F.struct(F.lower(F.trim(f"validation_status_{k}")).alias("s"), parse_validation_date(f"validation_date_{k}").alias("d")) for k in range(1, n + 1)])
    long = slots.select(record_key("source", "observation_id").alias("key"), F.explode(pairs).alias("p"))
    return long.where("p.s = 'yes' and p.d is not null").groupBy("key").agg(F.min("p.d").alias("first_green_on"))


def add_first_validated(df: DataFrame, dates: DataFrame) -> DataFrame:
    """JOI3: the pull with its records' first validated dates."""
    return df.withColumn("key", record_key("source", "observation_id")).join(dates, "key", "left").drop("key")


def override_coordinates(df: DataFrame, answers: DataFrame, max_m: float = 5000) -> DataFrame:
    """JOI4: one source's coordinates from its answers: the point, else a small box's centre, else the record's own."""
    small = half_diagonal_m("north", "south", "east", "west") <= max_m
    box = lambda a, b: F.when(small, (F.col(a) + F.col(b)) / 2)
    side = answers.select(asking(F.lit(True), "number").alias("_k"), F.coalesce("gps_lat", box("north", "south")).alias("_lat"), F.coalesce("gps_lng", box("east", "west")).alias("_lng"))
    keyed = df.withColumn("_k", asking(F.col("source") == MO, "observation_id"))
    joined = keyed.join(side.dropDuplicates(["_k"]), "_k", "left")
    return joined.withColumns({"latitude": F.coalesce("_lat", "latitude"), "longitude": F.coalesce("_lng", "longitude")}).select(*df.columns)


def region_lookup(regions: DataFrame) -> DataFrame:
    """JOI5: (key, country, code, region) of every spelling (``regions``: country, code, name, aliases array)."""
    short = F.regexp_replace("code", "^[A-Z]+-", "")
    spellings = F.explode(F.concat(F.array("name", "code", short), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = regions.select(spellings.alias("s"), "country", "code", F.col("name").alias("region"))
    return rows.select(region_key("s").alias("key"), "country", "code", "region").where("key <> ''").distinct()


def region_of(df: DataFrame, regions: DataFrame, country: str = "country", state: str = "state") -> DataFrame:
    """JOI5: country, country_code, region and code of each record; a spelling of two places is settled by the record's country."""
    c, s = F.upper(F.trim(F.coalesce(country, F.lit("")))), F.trim(F.coalesce(state, F.lit("")))
    keyed = df.withColumns({"_c": c, "_s": s})
    pairs = keyed.select("_c", "_s").distinct().withColumn("key", region_key("_s"))
    hits = pairs.join(region_lookup(regions), "key")
    many = hits.withColumn("_n", F.count("*").over(Window.partitionBy("_c", "_s")))
    own = many.where((F.col("_n") == 1) | (F.col("country") == F.col("_c")))
    own = own.groupBy("_c", "_s").agg(F.count("*").alias("_left"), F.first("country").alias("hc"), F.first("region").alias("hr"), F.first("code").alias("hk")).where("_left = 1")
    found = pairs.join(own, ["_c", "_s"], "left")
    pr, vi, hit = F.col("_c").isin("PR", "PU"), F.col("_c") == "VI", F.col("hk").isNotNull()
    code = F.when(hit, F.col("hc")).when(pr | vi, "US").otherwise(F.col("_c"))
    region = F.when(hit, F.col("hr")).when(pr, "Puerto Rico").when(vi, "U.S. Virgin Islands").when(F.col("_s") != "", F.col("_s")).otherwise("Not recorded")
    part = F.when(hit, F.col("hk")).when(pr, "US-PR").when(vi, "US-VI").otherwise("")
    named = F.create_map(*[F.lit(x) for p in COUNTRY_NAMES.items() for x in p])
    found = found.select("_c", "_s", code.alias("country_code"), region.alias("region"), part.alias("code"))
    out = keyed.drop("country", "country_code", "region", "code").join(found, ["_c", "_s"]).drop("_c", "_s")
    return out.withColumn("country", F.coalesce(F.try_element_at(named, F.col("country_code")), "country_code"))


def taxon_guild(df: DataFrame, guilds: DataFrame, name: str = "scientific_name") -> DataFrame:
    """JOI6: each row's lifestyle by its genus, 'unknown' without one."""
    side = guilds.select(F.col("genus").alias("_g"), "lifestyle")
    return df.withColumn("_g", taxon_genus(name)).join(side, "_g", "left").drop("_g").withColumn("lifestyle", F.coalesce("lifestyle", F.lit("unknown")))


def guild_key(guilds: DataFrame) -> DataFrame:
    """JOI6: one hash of the lookup table (a table of genera, small by nature)."""
    rows = F.array_sort(F.collect_list(F.concat_ws("\t", "genus", "lifestyle")))
    return guilds.agg(F.sha2(F.concat_ws("\n", rows), 256).alias("hash"))


# ---- places -----------------------------------------------------------------


def add_bands(sites: DataFrame, cells: DataFrame, bands: list[str], cell: str = "cell") -> DataFrame:
    """JOI7: the bands' values at each site's cell."""
    return sites.join(cells.select(cell, *bands), cell, "left")


def squares(df: DataFrame, x: str, y: str, size: float, around: bool) -> DataFrame:
    i, j = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not around:
        return df.withColumns({"_i": i, "_j": j})
    near = F.explode(F.array(*[F.struct((i + a).alias("i"), (j + b).alias("j")) for a, b in _AROUND]))
    return df.withColumn("_sq", near).withColumns({"_i": F.col("_sq.i"), "_j": F.col("_sq.j")}).drop("_sq")


def within(left: DataFrame, right: DataFrame, distance: float, by: list[str] | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of rows within a distance, as an equi-join on squares; the right side's columns get the prefix ``r_``.

    ``d2`` is the squared distance.  Both sides spread by square; only the right one is copied, to nine squares.
    """
    by = by or []
    r = squares(right, x, y, distance, True)
    r = r.select(*by, "_i", "_j", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    met = squares(left, x, y, distance, False).join(r, [*by, "_i", "_j"])
    d2 = F.pow(F.col(x) - F.col(f"r_{x}"), 2) + F.pow(F.col(y) - F.col(f"r_{y}"), 2)
    return met.withColumn("d2", d2).where(F.col("d2") <= distance * distance).drop("_i", "_j")


def _thin_tile(distance: float):
    """Rows of one tile and its rim after the greedy rule, as far as they are settled; rows that are out go."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["w", "k", "x", "y"], ascending=[False, True, True, True], ignore_index=True)
        state, met = rows["s"].to_numpy().copy(), ({}, {})  # by square: places of open points, of centres
        limit = distance * distance
        for n, (x, y, own) in enumerate(zip(rows["x"].tolist(), rows["y"].tolist(), rows["own"].tolist(), strict=True)):
            i, j = math.floor(x / distance), math.floor(y / distance)

            def near(places: dict) -> bool:
                return any((x - u) ** 2 + (y - v) ** 2 < limit for a, b in _AROUND for u, v in places.get((i + a, j + b), ()))

            if state[n] == 0 and near(met[1]):
                state[n] = 2
                continue
            if state[n] == 0 and own and not near(met[0]):
                state[n] = 1
            met[state[n]].setdefault((i, j), []).append((x, y))
        return rows.assign(s=state)[rows["own"] & (state < 2)][["k", "w", "x", "y", "s"]]

    return run


def thin_by_distance(points: DataFrame, distance: float, key: str = "cell", weight: str = "records", x: str = "x", y: str = "y", tile: int = 8) -> DataFrame:
    """JOI9: the greedy centres, busiest first, ties by key: a point is one if no centre of higher rank is nearer than the distance.

    Same set as the sequential rule: in each round every tile (``tile`` distances wide, seen with a rim of one distance)
    settles the points whose open neighbours of higher rank it can settle, until no point is open.  The first open point of
    all is settled in each round, so it ends; falling chains of neighbours cost a round per tile that they enter.  Rounds are
    checkpointed.  Points without a place have no neighbours; rows without a key are no points.
    """
    from rangeflow.operators.lineage import cut

    base = points.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(weight).alias("w"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    nowhere = F.coalesce(F.isnan("x"), F.lit(True)) | F.coalesce(F.isnan("y"), F.lit(True)) | F.col("x").isNull() | F.col("y").isNull()
    state = cut(base.where(~nowhere).withColumn("s", F.lit(0)))  # 0 open, 1 centre
    size, rim = tile * distance, 1.01 * distance
    at = lambda a, b: F.struct(F.floor((F.col("x") + a) / size).alias("ti"), F.floor((F.col("y") + b) / size).alias("tj"))
    home, seen = at(0, 0), F.array_distinct(F.array(*[at(a * rim, b * rim) for a, b in _AROUND]))
    while not state.where("s = 0").isEmpty():
        tiles = state.select("*", F.explode(seen).alias("t")).select(*state.columns, "t.*", (F.col("t") == home).alias("own"))
        state = cut(tiles.groupBy("ti", "tj").applyInPandas(_thin_tile(distance), state.schema))
    chosen = state.select("k").unionByName(base.where(nowhere).select("k"))
    return points.join(chosen.withColumnRenamed("k", key), key, "left_semi")


def attach_sites(cells: DataFrame, centres: DataFrame, distance: float, key: str = "cell", x: str = "x", y: str = "y") -> DataFrame:
    """JOI8: each cell's nearest centre within the distance, ties to the smaller key (itself, where it is one)."""
    met = within(cells.select(key, x, y), centres.select(key, x, y), distance, x=x, y=y)
    best = met.groupBy(key).agg(F.min_by(f"r_{key}", F.struct("d2", f"r_{key}")).alias("site"))
    return cells.join(best, key, "left").withColumn("site", F.coalesce("site", key))


def site_effort(points: DataFrame, site: str = "site") -> DataFrame:
    """JOI8: records per site."""
    return points.groupBy(site).agg(F.count("*").alias("records"))


def _reached_squares(taxon: str, split: int, block: int):
    """Per taxon and block of squares: its squares within reach of an occupied one, and whether wholly."""
    rim = split + 1
    near = range(-rim, rim + 1)
    least = [(a, b) for a in near for b in near if max(abs(a) - 1, 0) ** 2 + max(abs(b) - 1, 0) ** 2 <= split**2]
    most = [(a, b) for a, b in least if (abs(a) + 1) ** 2 + (abs(b) + 1) ** 2 <= split**2]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low = rows[["_bi", "_bj"]].iloc[0].to_numpy() * block
        occupied = np.zeros((block + 2 * rim, block + 2 * rim), dtype=bool)
        occupied[rows["_i"].to_numpy() - low[0] + rim, rows["_j"].to_numpy() - low[1] + rim] = True
        met = [np.zeros((block, block), dtype=bool) for _ in range(2)]
        for out, steps in zip(met, (least, most)):
            for a, b in steps:
                out |= occupied[rim - a : rim - a + block, rim - b : rim - b + block]
        i, j = met[0].nonzero()
        name = np.full(len(i), None if pd.isna(rows[taxon].iloc[0]) else rows[taxon].iloc[0], dtype=object)
        return pd.DataFrame({taxon: name, "_si": i + low[0], "_sj": j + low[1], "_whole": met[1][i, j]})

    return run


def accessible_sites(sites: DataFrame, detections: DataFrame, buffer_km: float = BUFFER_KM, taxon: str = "taxon", x: str = "x", y: str = "y", split: int = 8, block: int = 64) -> DataFrame:
    """JOI10: (taxon, site...) of the sites within the buffer of any detection of the taxon.

    Detections are reduced to the squares they occupy, a buffer's ``split``-th part wide.  An occupied square goes to the blocks
    of squares that it reaches (``block`` wide, four at most), where the squares around the occupied ones are found as bitmaps.
    Those that lie wholly within the buffer of an occupied one are taken as they are; sites of the squares at the rim are
    compared with the detections that can reach them.  Joins are on (taxon and) square, so they spread with the area; they are
    merged whatever the inputs' size, since the planner does not see how many squares a detection reaches.
    """
    reach = buffer_km * 1000.0
    side, names, rim = reach / split, ["_i", "_j"], split + 1
    block = max(block, 2 * rim)
    place = lambda df, i, j: df.withColumns({i: F.floor(F.col(x) / side), j: F.floor(F.col(y) / side)})
    d = place(detections.select(taxon, x, y).distinct(), *names)
    at = place(sites, "_si", "_sj")
    blocks = lambda c: F.explode(F.array_distinct(F.transform(F.array(F.lit(-rim), F.lit(rim)), lambda s: F.floor((F.col(c) + s) / block))))
    occupied = d.where("_i is not null and _j is not null").select(taxon, *names).distinct().withColumn("_bi", blocks("_i")).withColumn("_bj", blocks("_j"))
    schema = StructType([d.schema[taxon], *[StructField(c, LongType()) for c in ("_si", "_sj")], StructField("_whole", BooleanType())])
    ring = occupied.groupBy(taxon, "_bi", "_bj").applyInPandas(_reached_squares(taxon, split, block), schema)
    met = at.join(ring.hint("merge"), ["_si", "_sj"])
    inside = met.where("_whole").select(taxon, *sites.columns)
    steps = F.explode(F.sequence(F.lit(-rim), F.lit(rim)))
    a, b = (F.greatest(F.abs(c) - 1, F.lit(0)) for c in ("_a", "_b"))
    rest = met.where("not _whole").withColumn("_a", steps).withColumn("_b", steps).where(a * a + b * b <= split * split)
    rest = rest.select(taxon, *sites.columns, (F.col("_si") - F.col("_a")).alias("_i"), (F.col("_sj") - F.col("_b")).alias("_j"))
    d = d.select(F.col(taxon).alias("_taxon"), *names, F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs = rest.join(d.hint("merge"), F.col(taxon).eqNullSafe(F.col("_taxon")) & (rest["_i"] == d["_i"]) & (rest["_j"] == d["_j"]))
    d2 = F.pow(F.col("_x") - F.col(x), 2) + F.pow(F.col("_y") - F.col(y), 2)
    return inside.unionByName(pairs.where(d2 <= reach * reach).select(taxon, *sites.columns)).distinct()


def nearest(queries: DataFrame, references: DataFrame, by: list[str] | None = None, start: float = 50_000.0, x: str = "x", y: str = "y", key: str = "q") -> DataFrame:
    """JOI11: distance of each query row to its nearest reference row (2-D), null without any.

    Rings of squares: rows not met within a distance are tried again at twice the distance; every answer is exact, since a
    ring covers all references within its distance.
    """
    from rangeflow.operators.lineage import cut

    by = by or []
    left, out, size = cut(queries.select(key, *by, x, y)), None, start
    refs = references.select(*by, x, y).distinct()
    for _ in range(24):
        met = within(left, refs, size, by, x, y).groupBy(key, *by).agg(F.sqrt(F.min("d2")).alias("distance"))
        met = cut(met)
        out = met if out is None else out.unionByName(met)
        left = cut(left.join(met, [key, *by], "left_anti"))
        if left.isEmpty() or size > 4e7:
            break
        size *= 4
    return out.unionByName(left.select(key, *by, F.lit(None).cast("double").alias("distance")))


def _apart(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of all rows of one table to all of another, feature by feature."""
    d2 = np.zeros((len(q), len(v)))
    for k in range(q.shape[1]):
        d2 += (q[:, k, None] - v[:, k]) ** 2
    return np.sqrt(d2)


def _to_pivots(keep: list[str], near: bool):
    """Of each row its nearest pivot and the distance to it; without ``near`` every other pivot whose cell can hold a row within ``_bound``."""

    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(pivots):
            v, z, names = np.stack(rows["_v"].to_numpy()), np.stack(pivots["_v"].to_numpy()), pivots["_p"].to_numpy()
            step = max(1, NEAR_PAIRS // len(z))
            for k in range(0, len(v), step):
                one, d = rows.iloc[k : k + step], _apart(v[k : k + step], z)
                if near:
                    i, j = np.arange(len(d)), np.where(np.isnan(d), np.inf, d).argmin(axis=1)
                else:
                    beyond = d - pivots["_radius"].to_numpy() > one["_bound"].to_numpy()[:, None]
                    i, j = np.nonzero(~beyond & (names != one["_home"].to_numpy()[:, None]))
                out.append(one.iloc[i][keep].assign(_p=names[j], _d=d[i, j]))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in [*keep, "_p", "_d"]}, dtype=object)

    return run


def _least_of_cell(keep: list[str]):
    """Of each query row of a cell the distance to the nearest of the cell's references; rows in the order of their distance to the pivot."""

    def run(asked: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(refs):
            asked = asked.sort_values("_d")
            q, v, far, d, bound = (np.stack(c.to_numpy()) for c in (asked["_v"], refs["_v"], refs["_d"], asked["_d"], asked["_bound"]))
            step = max(1, min(256, NEAR_PAIRS // len(v)))
            for k in range(0, len(q), step):
                at = slice(k, k + step)
                fits = ~((far < (d[at] - bound[at]).min()) | (far > (d[at] + bound[at]).max()))
                if fits.any():
                    out.append(asked.iloc[at][keep].assign(distance=np.fmin.reduce(_apart(q[at], v[fits]), axis=1)))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in [*keep, "distance"]}, dtype=object)

    return run


def nearest_in_space(queries: DataFrame, references: DataFrame, features: list[str], weights: dict[str, float] | None = None, key: str = "q", by: list[str] | None = None) -> DataFrame:
    """JOI11: of each query row (by..., key) the distance to its nearest reference row of the group, in a weighted space; null without any or with a null feature.

    A group's references are dealt to pivots, about the root of their number (``MOST_PIVOTS`` at most) drawn among them by hash, each to the nearest one.  A
    query first meets the cell of its own nearest pivot; what it finds there bounds its distance.  Other cells whose pivot is farther than the bound and
    the cell's radius cannot hold its neighbour, nor can references whose own distance to the pivot differs from the query's by more than
    the bound (triangle inequality).  The rest is compared.  Rows meet pivots, and queries a cell's references, by parts of ``NEAR_ROWS`` rows
    in a task; only the least distances leave it, no pairs.
    """
    from rangeflow.operators.lineage import cut

    by, w = by or [], weights or {}
    group = by or ["_g"]
    # one array of the features: a plan with a column each takes the optimiser minutes where there are dozens
    vector = F.array(*[F.col(f).cast("double") * math.sqrt(w.get(f, 1.0)) for f in features])
    whole = lambda df: df.where(~F.exists("_v", lambda v: v.isNull() | F.isnan(v)))
    one = [] if by else [F.lit(0).alias("_g")]
    refs = cut(whole((references.dropna(subset=by) if by else references).select(*by, *one, vector.alias("_v"))).distinct())
    asked = cut(whole(queries.dropna(subset=[*by, key]).select(*by, *one, key, vector.alias("_v"))))
    kinds = {"_g": "int", **dict(asked.dtypes)}
    typed = lambda names, *more: ", ".join([*[f"`{c}` {kinds[c]}" for c in names], *more])
    h = F.xxhash64("_v")
    sizes = refs.groupBy(*group).agg(F.count("*").alias("_n"), F.min(h).alias("_first"))
    some = F.least(F.ceil(F.sqrt("_n")), F.lit(MOST_PIVOTS))
    pivots = cut(refs.join(sizes, group).where((F.pmod(h, F.col("_n")) < some) | (h == F.col("_first"))).select(*group, "_v").withColumn("_p", F.monotonically_increasing_id()))
    # few groups' numbers of parts go to every task, so that a large group's rows stay where they are
    beside = F.broadcast if not by or pivots.count() <= BROADCAST_PIVOTS else (lambda df: df)
    parts = lambda df, on, out: df.groupBy(*on).agg(F.ceil(F.count("*") / NEAR_ROWS).cast("int").alias(out))
    part = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def by_pivots(rows: DataFrame, pivots: DataFrame, keep: list[str], near: bool) -> DataFrame:
        n = cut(parts(rows, group, "_n"))
        left = rows.join(beside(n), group).withColumn("_part", part("_n", *[c for c in (key, "_v") if c in rows.columns])).drop("_n")
        right = pivots.join(beside(n), group).withColumn("_part", each("_n")).drop("_n")
        # both sides may come from one table; new columns keep them apart
        left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]).groupBy(*group, "_part") for df in (left, right))
        return cut(left.cogroup(right).applyInPandas(_to_pivots(keep, near), typed(keep, "_p bigint", "_d double")))

    def by_cells(rows: DataFrame, dealt: DataFrame) -> DataFrame:
        cell = [*group, "_p"]
        n = cut(parts(rows, cell, "_na").join(parts(dealt, cell, "_nb"), cell))
        left = rows.join(beside(n), cell).withColumn("_a", part("_na", key)).withColumn("_b", each("_nb")).drop("_na", "_nb")
        right = dealt.join(beside(n), cell).withColumn("_b", part("_nb", "_v")).withColumn("_a", each("_na")).drop("_na", "_nb")
        left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]).groupBy(*cell, "_a", "_b") for df in (left, right))
        met = left.cogroup(right).applyInPandas(_least_of_cell([*group, key]), typed([*group, key], "distance double"))
        return cut(met.groupBy(*group, key).agg(F.min("distance").alias("distance")))

    bound = lambda d: d * (1 + 1e-9) + 1e-12
    dealt = by_pivots(refs, pivots, [*group, "_v"], True)
    home = by_pivots(asked, pivots, [*group, key, "_v"], True)
    first = by_cells(home.withColumn("_bound", bound(F.col("_d"))), dealt)
    known = cut(pivots.join(dealt.groupBy(*group, "_p").agg(F.max("_d").alias("_radius")), [*group, "_p"]))
    kinds["_bound"] = "double"
    open_ = home.select(*group, key, "_v", F.col("_p").alias("_home")).join(first, [*group, key]).withColumn("_bound", bound(F.col("distance"))).drop("distance")
    rest = by_cells(by_pivots(open_, known, [*group, key, "_v", "_bound"], False), dealt)
    found = first.unionByName(rest).groupBy(*by, key).agg(F.min("distance").alias("distance"))
    return queries.select(*by, key).distinct().join(found, [*by, key], "left")


def held_out_distances(sites: DataFrame, taxon: str = "taxon", fold: str = "fold", key: str = "site", to_detections: bool = False, x: str = "x", y: str = "y") -> DataFrame:
    """JOI12: of each held-out site the distance to the nearest site of the other folds (or detections only)."""
    folds = sites.select(taxon, F.col(fold).alias("held")).distinct()
    other = sites.where("presence = 1") if to_detections else sites
    train = other.join(folds, taxon).where(F.col(fold) != F.col("held")).select(taxon, F.col("held").alias(fold), x, y)
    return nearest(sites.select(F.col(key).alias("q"), taxon, fold, x, y), train, [taxon, fold], x=x, y=y)


def recorded_near(points: DataFrame, cells: DataFrame, km: float = NEAR_KM, point: str = "point") -> DataFrame:
    """JOI13: records of each taxon within a distance of each point (points: point, lat, lng; cells: taxon, lat, lng, records).

    Rows meet by squares, latitude bands cut in longitude at the width that the band's end nearer to a pole needs, so a point asks three bands and
    three columns of each; then by great-circle distance.  Near the poles a band is one square.  A place is asked once, however many points it has.
    """
    tall = km / 111.0
    widest = lambda band: F.greatest(F.abs(band), F.abs(band + 1)) * tall  # noqa: E731  the band's largest latitude
    narrow = lambda band: F.cos(F.radians(F.least(widest(band), F.lit(90.0))))
    columns = lambda band: F.when(narrow(band) < 0.1, F.lit(1)).otherwise(F.floor(360.0 * 111.0 * narrow(band) / km)).cast("long")
    column = lambda lng, band: F.when(columns(band) < 3, F.lit(0)).otherwise(F.floor(F.pmod(lng + 180.0, F.lit(360.0)) / (360.0 / columns(band))))
    at = F.floor(F.col("lat") / tall)
    asked = points.select(point, F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    p = points.select("lat", "lng").distinct().select(F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"), F.explode(F.sequence(at - 1, at + 1)).alias("band"))
    own = column(F.col("p_lng"), F.col("band"))
    around = F.when(columns(F.col("band")) < 3, F.array(F.lit(0).cast("long"))).otherwise(F.array(*[F.pmod(own + k, columns(F.col("band"))).cast("long") for k in (-1, 0, 1)]))
    p = p.withColumn("column", F.explode(F.array_distinct(around)))
    c = cells.withColumn("band", at).withColumn("column", column(F.col("lng"), F.col("band")).cast("long"))
    near = p.join(c, ["band", "column"]).where(km_between("p_lat", "p_lng", "lat", "lng") <= km)
    near = near.groupBy("p_lat", "p_lng", "taxon").agg(F.sum("records").alias("records"))
    return asked.join(near, ["p_lat", "p_lng"]).groupBy(point, "taxon").agg(F.sum("records").cast("long").alias("records"))


def what_grows_here(points: DataFrame, index: DataFrame, models: DataFrame, cells: DataFrame | None = None, cell_km: float = 20) -> DataFrame:
    """JOI14: per point and taxon, the mean rank over its fitted models (``score``, 0..1) and how many agree (rank >= 90).

    points: point, lat, lng; index: cell, model, rank; models: model, taxon.  With ``cells``, records nearby are added.
    """
    x, y = albers("lat", "lng")
    placed = points.withColumns({"_x": x, "_y": y}).withColumn("cell", grid_cell("_x", "_y", cell_km))
    fitted = models.groupBy("taxon").agg(F.count("*").alias("fitted"))
    hits = placed.join(index, "cell").join(models.select("model", "taxon"), "model")
    scored = hits.groupBy("point", "taxon").agg(F.sum("rank").alias("ranks"), F.count_if(F.col("rank") >= 90).alias("agree"), F.count("*").alias("models"))
    out = scored.join(fitted, "taxon").select("point", "taxon", (F.col("ranks") / (100.0 * F.col("fitted"))).alias("score"), "agree", "models")
    if cells is None:
        return out
    near = recorded_near(points, cells)
    return out.join(near.withColumnRenamed("records", "nearby"), ["point", "taxon"], "left").withColumn("nearby", F.coalesce("nearby", F.lit(0)))


def unmapped_near(points: DataFrame, cells: DataFrame, models: DataFrame) -> DataFrame:
    """JOI14: taxa recorded near a point that have no map."""
    return recorded_near(points, cells).join(models.select("taxon").distinct(), "taxon", "left_anti")


def region_counts(values: DataFrame, cell_region: DataFrame, presences: DataFrame, quantile: float = 0.10) -> DataFrame:
    """JOI15: per model and region: cells, cells reached (with a value), cells at or above the presences' low quantile.

    values: model, cell, value; cell_region: cell, code; presences: model, value.
    """
    floor = presences.groupBy("model").agg(F.percentile("value", quantile).alias("floor"))
    cells = cell_region.groupBy("code").agg(F.count("*").alias("cells"))
    met = values.where("value is not null").join(cell_region, "cell").join(floor, "model")
    got = met.groupBy("model", "code").agg(F.count("*").alias("reach"), F.count_if(F.col("value") >= F.col("floor")).alias("suitable"))
    return got.join(cells, "code").select("model", "code", "cells", "reach", "suitable")


def region_status(recorded: DataFrame, predictions: DataFrame, min_share: float = 0.10) -> DataFrame:
    """JOI16: records by region beside predictions; regions with predictions only are added where likely or possible.

    recorded: taxon, code, records, localities; predictions: taxon, code, reach_share, suitable_share, best_share.
    """
    mapped = predictions.select("taxon").distinct().withColumn("_mapped", F.lit(True))
    both = recorded.join(predictions, ["taxon", "code"], "full_outer").join(mapped, "taxon", "left")
    both = both.where(F.col("records").isNotNull() | (F.col("best_share") >= min_share - 1e-9))
    seen = F.col("_mapped") & (F.col("code") != "")
    shares = {c: F.when(seen, F.coalesce(c, F.lit(0.0))) for c in ("reach_share", "suitable_share", "best_share")}
    both = both.withColumns(shares).withColumns({"records": F.coalesce("records", F.lit(0)), "localities": F.coalesce("localities", F.lit(0))}).drop("_mapped")
    return both.withColumn("model", region_verdict(F.col("reach_share"), F.col("suitable_share"), F.col("best_share"), min_share))


# ---- names over time ---------------------------------------------------------


def resolve_names(asked: DataFrame, names: DataFrame, renames: DataFrame, hops: int = 10) -> DataFrame:
    """JOI17: asked names to current ones: exact, by spelling key, or along renames of up to ``hops``; ``how`` and ``hops`` say by which.

    asked: name; names: name (current); renames: old_name, new_name.
    """
    from rangeflow.operators.lineage import cut

    current = names.select(F.col("name").alias("hit")).distinct()
    by_key = current.groupBy(name_key("hit").alias("key")).agg(F.min("hit").alias("hit"), F.count("*").alias("n")).where("n = 1").drop("n")
    moves = renames.select(name_key("old_name").alias("key"), F.col("new_name").alias("next")).groupBy("key").agg(F.min("next").alias("next"))
    state = asked.select("name").distinct().select("name", F.col("name").alias("at"), F.lit(None).cast("string").alias("found"), F.lit(None).cast("string").alias("how"), F.lit(0).alias("hops"))
    for k in range(hops + 1):
        exact = state.join(current, F.col("at") == F.col("hit"), "left").withColumnRenamed("hit", "_exact").withColumn("key", name_key("at"))
        tried = exact.join(by_key.withColumnRenamed("hit", "_spelled"), "key", "left")
        kind = "exact" if k == 0 else "renamed"
        tried = tried.select(
            "name", "at", "key", F.coalesce("found", "_exact", "_spelled").alias("found"), "hops",
            F.coalesce("how", F.when(F.col("_exact").isNotNull(), kind), F.when(F.col("_spelled").isNotNull(), "spelling" if k == 0 else "renamed")).alias("how"),
        )
        if k == hops:
            state = tried.drop("key")
            break
        moved = tried.join(moves, "key", "left").drop("key")
        go = F.col("found").isNull() & F.col("next").isNotNull()
        state = cut(moved.select("name", F.when(go, F.col("next")).otherwise(F.col("at")).alias("at"), "found", "how", (F.col("hops") + go.cast("int")).alias("hops"), go.alias("_go")))
        moving = not state.where("_go").isEmpty()
        state = state.drop("_go")
        if not moving:
            break
    return asked.select("name").join(state.select("name", "found", "how", "hops"), "name", "left")


def fold_counts(raw: DataFrame, taxa: DataFrame, counts: list[str]) -> DataFrame:
    """JOI18: raw spellings' counts summed by name key under the modelled name."""
    folded = raw.groupBy(name_key("taxon").alias("key")).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in counts])
    return taxa.select("scientific_name", name_key("scientific_name").alias("key")).join(folded, "key").drop("key")


def latest_renames(changes: DataFrame, current: DataFrame) -> DataFrame:
    """JOI19, WIN5: the latest change of each old name, without names that are current again (changes: id, old_name, new_name)."""
    order = Window.partitionBy("key").orderBy(F.desc("id"))
    last = changes.withColumn("key", name_key("old_name")).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    now = current.select(name_key("name").alias("key")).distinct()
    return last.join(now, "key", "left_anti")


def merge_renames(logged: DataFrame, guessed: DataFrame) -> DataFrame:
    """JOI19: logged renames, and guessed ones of names the log does not have."""
    keyed = guessed.withColumn("key", name_key("old_name"))
    return logged.select("key", "old_name", "new_name").unionByName(keyed.join(logged.select("key"), "key", "left_anti").select("key", "old_name", "new_name"))


def change_reasons(changes: DataFrame, occurrences: DataFrame) -> DataFrame:
    """JOI20: taxa touched by merges and splits, by either name or by a record's reference; reasons joined in order.

    changes: kind, old_name, new_name, refs array<string>.
    """
    some = changes.where(F.col("kind").isin("merge", "split"))
    taxa = occurrences.select("scientific_name", name_key("scientific_name").alias("key")).distinct()
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for p in REF_PREFIX.items() for x in p]), F.col("source"))
    refs = occurrences.select("scientific_name", F.concat(prefix, F.lit(":"), F.col("observation_id").cast("string")).alias("ref"))
    reason = F.concat_ws(" ", "kind", F.lit("of"), "old_name", F.lit("to"), "new_name")
    by_name = [some.select(name_key(c).alias("key"), reason.alias("reason")).join(taxa, "key").select("scientific_name", "reason") for c in ("old_name", "new_name")]
    by_ref = some.select(F.explode("refs").alias("ref"), reason.alias("reason")).join(refs, "ref").select("scientific_name", "reason")
    every = by_name[0].union(by_name[1]).union(by_ref)
    return every.groupBy("scientific_name").agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reasons"))


def name_as_of(finds: DataFrame, changes: DataFrame) -> DataFrame:
    """JOI21: the name a record had on a day: the old name of its earliest later change, else its name now.

    finds: ref, day, name; changes: id, ref, day, kind, old_name.  ``flag``: same day, or a kind that is kept apart.
    """
    c = changes.select("ref", F.col("day").alias("c_day"), F.col("id").alias("c_id"), "kind", "old_name")
    met = finds.join(c, "ref").where(F.col("c_day") >= F.col("day"))
    later = met.where(F.col("c_day") > F.col("day")).groupBy("ref", "day", "name").agg(F.min_by(F.struct("old_name", "kind"), F.struct("c_day", "c_id")).alias("first"))
    same = met.where(F.col("c_day") == F.col("day")).select("ref", "day", "name").distinct().withColumn("_same", F.lit(True))
    out = finds.join(later, ["ref", "day", "name"], "left").join(same, ["ref", "day", "name"], "left")
    flag = F.when(F.col("_same"), "same day").when(F.col("first.kind").isin("merge", "split"), F.col("first.kind"))
    return out.select("ref", "day", "name", F.coalesce("first.old_name", "name").alias("name_then"), flag.alias("flag"))


def live_at(days: DataFrame, promotions: DataFrame, by: list[str] | None = None, day: str = "day", at: str = "promoted_at", value: str = "release") -> DataFrame:
    """JOI22: the last promotion strictly before each day: union of both sides, and the last value seen (no range join).

    The ordered window is over a month of a key; what earlier months leave comes from a row per month, so no key fills a task.
    """
    by = by or []
    left = days.select(*by, F.col(day).cast("timestamp").alias("_t"), F.lit(0).alias("_p"), F.lit(None).cast(promotions.schema[value].dataType).alias("_v"))
    right = promotions.select(*by, F.col(at).cast("timestamp").alias("_t"), F.lit(1).alias("_p"), F.col(value).alias("_v"))
    both = left.unionByName(right).withColumn("_m", F.coalesce(F.date_format("_t", "yyyy-MM"), F.lit("")))
    months = both.groupBy(*by, "_m").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("_carry", F.last("_last", True).over(before))
    same = F.col("a._m") == F.col("b._m")
    for c in by:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = both.alias("a").join(months.alias("b"), same, "left").select("a.*", "b._carry")
    seen = Window.partitionBy(*by, "_m").orderBy("_t", "_p", "_v").rowsBetween(Window.unboundedPreceding, 0)
    filled = met.withColumn(value, F.coalesce(F.last("_v", True).over(seen), "_carry"))
    return filled.where("_p = 0").select(*by, F.col("_t").alias(day), value)


def rank_at(points: DataFrame, ranked: DataFrame, key: list[str] | None = None) -> DataFrame:
    """JOI23: rank and place of points on maps (ranked: map, cell, rank, inside boolean)."""
    out = points.join(ranked, key or ["map", "cell"], "left")
    place = F.when(F.col("inside"), "inside").when(F.col("inside").isNotNull(), "outside_aoa").otherwise("beyond_reach")
    return out.withColumn("place", place).withColumn("rank", F.when(F.col("inside"), F.col("rank"))).drop("inside")


def staleness(candidates: DataFrame, index: DataFrame, failed: DataFrame | None = None, low: int = 20, high: int = 10_000_000) -> DataFrame:
    """JOI24: what to do with each (taxon, algorithm): current, changed, new, retired, refused.

    candidates: taxon, algorithm, fingerprint, settings, sites; index: taxon, algorithm, fingerprint, settings.
    """
    i = index.select("taxon", "algorithm", F.col("fingerprint").alias("was"), F.col("settings").alias("set"))
    both = candidates.join(i, ["taxon", "algorithm"], "full_outer")
    out = both.withColumn(
        "state",
        F.when(F.col("fingerprint").isNull(), "retired").when(~F.col("sites").between(low, high), "refused").when(F.col("was").isNull(), "new")
        .when((F.col("was") == F.col("fingerprint")) & (F.col("set") == F.col("settings")), "current").otherwise("changed"),
    )
    if failed is None:
        return out.drop("set")
    known = failed.select("taxon", "algorithm", "fingerprint", "settings").distinct().withColumn("_f", F.lit(True))
    out = out.join(known, ["taxon", "algorithm", "fingerprint", "settings"], "left")
    return out.withColumn("state", F.when(F.col("state").isin("new", "changed") & F.col("_f"), "known failed").otherwise(F.col("state"))).drop("_f", "set")


def align_labels(dna: DataFrame, record: DataFrame) -> DataFrame:
    """JOI25: the same records under two namings: same, spelling, species, genus, no_taxon (both: source, observation_id, scientific_name)."""
    d = dna.select(record_key("source", "observation_id").alias("key"), "source", F.col("scientific_name").alias("dna"))
    r = record.select(record_key("source", "observation_id").alias("key"), F.col("scientific_name").alias("record"))
    first = lambda c: F.lower(F.regexp_replace(c, " .*$", ""))
    change = (
        F.when(F.col("record").isNull(), "no_taxon").when(F.col("dna") == F.col("record"), "same").when(name_key("dna") == name_key("record"), "spelling")
        .when(first("dna") == first("record"), "species").otherwise("genus")
    )
    return d.join(r, "key", "left").withColumn("change", change)


def paired_rows(model: DataFrame, baseline: DataFrame, by: tuple[str, ...] = ("taxon", "map", "place")) -> DataFrame:
    """JOI26: rows of two arms on the same places, both ranked; a place that only one arm has is an error."""
    keys = list(by)
    lone = model.select(*keys).join(baseline.select(*keys), keys, "left_anti").limit(1)
    if not lone.isEmpty():
        raise ValueError("a row of one arm has no partner")
    b = baseline.select(*keys, F.col("rank").alias("baseline_rank"))
    return model.select(*keys, "rank").join(b, keys).where("rank is not null and baseline_rank is not null")


def trained_records(index: DataFrame, occurrences: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """JOI27: records of every model of a release, found by their set's fingerprint (fingerprints: scientific_name, fingerprint)."""
    taxa = index.select("taxon", "fingerprint").distinct().join(fingerprints, "fingerprint")
    rows = occurrences.join(taxa.select("scientific_name", "taxon"), "scientific_name")
    return rows.select("taxon", record_key("source", "observation_id").alias("record")).distinct()


def split_finds(pull: DataFrame, cutoff: str, observed_after: bool = False, excluded: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """JOI28: the pull with ``side`` (train, test) and ``apart`` (undated, off_grid, observed_before, excluded, held)."""
    day, cut = F.col("first_green_on").cast("date"), F.lit(cutoff).cast("date")
    df = pull.withColumn("_key", record_key("source", "observation_id"))
    flags = {"_x": excluded, "_h": held}
    for name, side in flags.items():
        if side is None:
            df = df.withColumn(name, F.lit(False))
        else:
            df = df.join(side.select(F.col("record").alias("_key")).distinct().withColumn(name, F.lit(True)), "_key", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    df = df.withColumn("side", F.when(day <= cut, "train").when(day > cut, "test"))
    off = ~F.coalesce(on_grid(*albers("latitude", "longitude")), F.lit(False))
    before = F.coalesce(F.col("observed_on").cast("date") <= cut, F.lit(True)) if observed_after else F.lit(False)
    apart = F.when(day.isNull(), "undated").when(F.col("side") == "test", F.when(off, "off_grid").when(before, "observed_before").when(F.col("_x"), "excluded").when(F.col("_h"), "held"))
    return df.withColumn("apart", apart).drop("_key", "_x", "_h")


def refit_overlay(refit: DataFrame, models: DataFrame) -> DataFrame:
    """JOI29: models of a refit beside those they replace; either may be missing."""
    a = refit.select("taxon", "algorithm", F.struct(*[c for c in refit.columns if c not in ("taxon", "algorithm")]).alias("refit"))
    b = models.select("taxon", "algorithm", F.struct(*[c for c in models.columns if c not in ("taxon", "algorithm")]).alias("model"))
    return a.join(b, ["taxon", "algorithm"], "full_outer").withColumn("owned", F.col("refit").isNotNull())


def occurrence_points(df: DataFrame, cell_km: float = 5, thin_km: float | None = None) -> DataFrame:
    """JOI30: records on the grid: taxon, cell, the cell's centre, year, and the effort site when thinned."""
    px, py = albers("latitude", "longitude")
    out = df.withColumns({"_px": px, "_py": py}).withColumn("cell", grid_cell("_px", "_py", cell_km)).where("cell is not null")
    cx, cy = cell_centre("cell", cell_km)
    out = out.select("id", F.col("scientific_name").alias("taxon"), "cell", cx.alias("x"), cy.alias("y"), record_year("observed_on").alias("year"))
    if thin_km is None:
        return out.withColumn("site", F.col("cell"))
    busy = out.groupBy("cell", "x", "y").agg(F.count("*").alias("records"))
    centres = thin_by_distance(busy, thin_km * 1000.0)
    sites = attach_sites(busy.select("cell", "x", "y"), centres, thin_km * 1000.0).select("cell", "site")
    return out.join(sites, "cell")


def paired_ground(kernel: DataFrame, model: DataFrame) -> DataFrame:
    """JOI31: a baseline ranked again over the cells that the model ranks (both: map, cell, value/rank)."""
    from rangeflow.operators.windows import rank_scale

    ground = model.where("rank is not null").select("map", "cell")
    return rank_scale(kernel.join(ground, ["map", "cell"]), "value", ["map"], "rank")


def reuse_blocks(tasks: DataFrame, earlier: DataFrame) -> DataFrame:
    """JOI32: block size and seed of an earlier model on the same records; own algorithm first, else the first other one."""
    own = earlier.select("taxon", "algorithm", "fingerprint", F.struct("block_km", "seed").alias("_own"))
    other = earlier.groupBy("taxon", "fingerprint").agg(F.min_by(F.struct("block_km", "seed"), "algorithm").alias("_other"))
    out = tasks.join(own, ["taxon", "algorithm", "fingerprint"], "left").join(other, ["taxon", "fingerprint"], "left")
    pick = F.coalesce("_own", "_other")
    return out.withColumns({"block_km": pick["block_km"], "seed": pick["seed"]}).drop("_own", "_other")
