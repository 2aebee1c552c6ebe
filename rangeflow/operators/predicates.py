"""Filters and predicates on occurrence tables (FIL1 to FIL17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeflow.functions.scalars import albers, on_grid
from rangeflow.functions.text import _col, any_of, record_key, region_key

#: Fixed values.
COUNTRIES = ("US", "CA", "MX", "PR", "VI")
MAX_ACCURACY_M, MAX_LOCATION_M, KM_PER_DEGREE = 1000, 5000, 111.2
INAT, MO = "iNaturalist", "MO Observations"
MAX_UNANSWERED, MAX_BEYOND = 0.02, 0.01
NOT_SPECIES_RANK, NOT_SPECIES_TAXON = "a rank above species", "not a species name"


def any_validated(*slots: str) -> Column:
    """FIL1: 'yes' in any of the status slots, exactly; null as ''."""
    return F.array_contains(F.array(*[F.coalesce(F.col(s), F.lit("")) for s in slots]), "yes")


def has_place(lat: str = "latitude", lng: str = "longitude") -> Column:
    """FIL2: coordinates that are there and project into the grid's extent."""
    return F.col(lat).isNotNull() & F.col(lng).isNotNull() & F.coalesce(on_grid(*albers(lat, lng)), F.lit(False))


def in_covered_place(country: str = "country", state: str = "state") -> Column:
    """FIL3: the covered countries, or Puerto Rico by its state."""
    return F.coalesce(F.col(country).isin(*COUNTRIES), F.lit(False)) | F.coalesce(F.col(state) == "Puerto Rico", F.lit(False))


def asking(asks: Column, number: str) -> Column:
    """A join key: numbers marked by whether their rows ask, so that the others meet nothing and yet spread; null keys would all go to one task."""
    return F.concat(F.when(asks, "=").otherwise("-"), F.col(number).cast("string"))


def drop_obscured(df: DataFrame, answers: DataFrame, max_m: float = MAX_ACCURACY_M, source: str = "source", number: str = "observation_id") -> DataFrame:
    """FIL4: rows of one source with an obscured or coarse answer dropped; unknown accuracy kept; other sources untouched."""
    bad = answers.where(F.col("obscured") | (F.col("accuracy_m") > max_m)).select(asking(F.lit(True), "number").alias("_k")).distinct()
    return df.withColumn("_k", asking(F.col(source) == INAT, number)).join(bad, "_k", "left_anti").drop("_k")


def half_diagonal_m(north: str, south: str, east: str, west: str) -> Column:
    """FIL5: half the diagonal of a box, in metres."""
    tall = (_col(north) - _col(south)) * KM_PER_DEGREE
    wide = (_col(east) - _col(west)) * KM_PER_DEGREE * F.cos(F.radians((_col(north) + _col(south)) / 2))
    return F.sqrt(tall * tall + wide * wide) / 2 * 1000


def small_location(df: DataFrame, answers: DataFrame, max_m: float = MAX_LOCATION_M, keep_unknown: bool = False, source: str = "source", number: str = "observation_id") -> DataFrame:
    """FIL5: rows of one source kept when their answer has a point or a small box; rows without an answer by the switch."""
    small = F.col("gps").isNotNull() | (half_diagonal_m("north", "south", "east", "west") <= max_m)
    known = answers.select(asking(F.lit(True), "number").alias("_k"), F.coalesce(small, F.lit(False)).alias("_small")).groupBy("_k").agg(F.bool_or("_small").alias("_small"))
    joined = df.withColumn("_k", asking(F.col(source) == MO, number)).join(known, "_k", "left")
    return joined.where((F.col(source) != MO) | F.coalesce("_small", F.lit(keep_unknown))).drop("_k", "_small")


def drop_shared_points(df: DataFrame, uncertainty: str = "uncertainty_m", max_m: float = MAX_LOCATION_M, keep_unknown: bool = True, lat: str = "latitude", lng: str = "longitude", locality: str = "locality") -> DataFrame:
    """FIL6: points on which two or more localities sit are geocoder's points, dropped; else by the source's uncertainty."""
    shared = df.groupBy(lat, lng).agg(F.count_distinct(F.coalesce(locality, F.lit(""))).alias("_n")).where("_n >= 2").select(lat, lng)
    fine = F.coalesce(F.col(uncertainty) <= max_m, F.lit(keep_unknown))
    return df.where(fine).join(shared, [lat, lng], "left_anti")


def species_level(name: Column | str) -> Column:
    """FIL7: a name of two words or more that is no placeholder and no bare ``Genus sp.``."""
    x = F.trim(_col(name))
    return F.coalesce((x != "") & ~x.isin("Fungi", "Unknown") & x.contains(" ") & ~F.lower(x).rlike(" sp[.]?$"), F.lit(False))


def not_species(name: Column | str, named: tuple[str, ...] = ()) -> Column:
    """FIL7: why a name with a space is still no species, else null."""
    x = F.trim(_col(name))
    rank = x.rlike(" (sect|subsect|subg|subgen|ser)[.] ") | x.rlike("^(Subgenus|Section|Series|Family|Order|Class|Complex) ")
    taxon = x.rlike("(?i)mix-?up") | x.rlike("(?i)^uncultured ") | (x.isin(*named) if named else F.lit(False))
    return F.when(rank, NOT_SPECIES_RANK).when(taxon, NOT_SPECIES_TAXON)


def modelled_name(name: Column | str, named: tuple[str, ...] = ()) -> Column:
    """FIL7: whether a name is modelled."""
    return species_level(name) & not_species(name, named).isNull()


def apply_exclusions(df: DataFrame, drops: DataFrame, id_col: str = "id", source: str = "source", number: str = "observation_id") -> DataFrame:
    """FIL8: rows listed by id or by source:number dropped (``drops``: by, key; kinds ``id`` and ``source_observation``)."""
    kinds = drops.where(~F.col("by").isin("id", "source_observation")).limit(1)
    if not kinds.isEmpty():
        raise ValueError("unknown kind of key in the drop list")
    by_id = drops.where("by = 'id'").select(F.col("key").cast("long").alias(id_col))
    by_key = drops.where("by = 'source_observation'").select(F.col("key").alias("_k"))
    return df.join(by_id, id_col, "left_anti").withColumn("_k", record_key(source, number)).join(by_key, "_k", "left_anti").drop("_k")


def exclusion_report(df: DataFrame, drops: DataFrame, id_col: str = "id", source: str = "source", number: str = "observation_id") -> DataFrame:
    """FIL8: how many keys of each kind are listed, and how many rows they remove."""
    keyed = df.select(F.col(id_col).cast("string").alias("id"), record_key(source, number).alias("source_observation"))
    long = keyed.select(F.explode(F.array(*[F.struct(F.lit(k).alias("by"), F.col(k).alias("key")) for k in ("id", "source_observation")])).alias("r")).select("r.*")
    removed = long.join(drops.select("by", "key").distinct(), ["by", "key"]).groupBy("by").agg(F.count("*").alias("removed"))
    listed = drops.groupBy("by").agg(F.count_distinct("key").alias("listed"))
    return listed.join(removed, "by", "left").select("by", "listed", F.coalesce("removed", F.lit(0)).alias("removed"))


def other_kingdom(df: DataFrame, kingdoms: DataFrame, covered: tuple[str, ...] = ("Fungi",), allow: tuple[str, ...] = (), name: str = "scientific_name") -> DataFrame:
    """FIL9: rows whose name is matched exactly to a kingdom that is not covered, unless allowed."""
    bad = kingdoms.where(F.col("exact") & ~F.col("kingdom").isin(*covered)).select(F.col("name").alias(name), "kingdom").dropDuplicates([name])
    out = df.join(bad, name)
    return out.where(~F.col(name).isin(*allow)) if allow else out


def drop_other_kingdoms(df: DataFrame, kingdoms: DataFrame, covered: tuple[str, ...] = ("Fungi",), allow: tuple[str, ...] = (), name: str = "scientific_name") -> DataFrame:
    """FIL9: the rows that stay."""
    bad = other_kingdom(kingdoms.select(F.col("name").alias(name)).distinct(), kingdoms, covered, allow, name).select(name)
    return df.join(bad, name, "left_anti")


def kingdom_counts(df: DataFrame, kingdoms: DataFrame, **how) -> DataFrame:
    """FIL9: records left out by name and kingdom."""
    return other_kingdom(df, kingdoms, **how).groupBy("scientific_name", "kingdom").agg(F.count("*").alias("records"))


def validated_through(df: DataFrame, cutoff: str, keep_undated: bool = False, column: str = "first_green_on") -> DataFrame:
    """FIL10: first validated on or before a date; undated rows by the switch."""
    day = F.col(column).cast("date")
    return df.where(F.coalesce(day <= F.lit(cutoff).cast("date"), F.lit(keep_undated)))


def record_named(df: DataFrame, record_name: str = "record_name", named: tuple[str, ...] = ()) -> DataFrame:
    """FIL11: the pull under its records' own names, species only, one spelling per taxon."""
    from rangeflow.operators.aggs import canonicalise

    return canonicalise(df.withColumn("scientific_name", F.trim(record_name)).where(modelled_name("scientific_name", named)))


def privacy_list(df: DataFrame, answers: DataFrame, source: str = "source", number: str = "observation_id") -> DataFrame:
    """FIL12: records whose place is hidden, or of which that is unknown, or that are deleted (``answers``: source, number, hidden, deleted)."""
    flags = answers.groupBy("source", "number").agg(F.bool_or("hidden").alias("hidden"), F.bool_or("deleted").alias("deleted"))
    joined = df.select(F.col(source).alias("source"), F.col(number).cast("string").alias("number")).join(flags, ["source", "number"], "left")
    why = F.when(F.col("deleted"), "deleted").when(F.col("hidden"), "place").when(F.col("hidden").isNull(), "unknown")
    return joined.withColumn("privacy", why).where("privacy is not null").select("source", F.col("number").alias("observation_id"), "privacy").distinct()


def drop_private(df: DataFrame, listed: DataFrame, source: str = "source", number: str = "observation_id") -> DataFrame:
    """FIL12: rows that are not on the list, by record key."""
    keys = listed.select(record_key("source", "observation_id").alias("_k")).distinct()
    return df.withColumn("_k", record_key(source, number)).join(keys, "_k", "left_anti").drop("_k")


def status_groups(df: DataFrame, listed: DataFrame, status: DataFrame, source: str = "source", number: str = "observation_id") -> DataFrame:
    """FIL13: four reasons to hide a record now: listed, hidden or unanswered, not shown, deleted (``status``: source, number, hidden, shown, deleted)."""
    truth = lambda c: F.lower(F.col(c).cast("string")).isin("t", "true")
    now = status.select("source", "number", truth("hidden").alias("hidden"), truth("shown").alias("shown"), truth("deleted").alias("deleted"))
    now = now.groupBy("source", "number").agg(F.bool_or("hidden").alias("hidden"), F.bool_and("shown").alias("shown"), F.bool_or("deleted").alias("deleted"))
    keys = listed.select(F.col("source"), F.col("observation_id").cast("string").alias("number")).distinct().withColumn("listed", F.lit(True))
    rows = df.select(F.col(source).alias("source"), F.col(number).cast("string").alias("number")).distinct()
    joined = rows.join(keys, ["source", "number"], "left").join(now, ["source", "number"], "left")
    return joined.select(
        "source", "number", F.coalesce("listed", F.lit(False)).alias("listed"),
        ((F.col("source") == INAT) & F.coalesce("hidden", F.lit(True))).alias("hidden"),
        ((F.col("source") == MO) & ~F.coalesce("shown", F.lit(False))).alias("not_shown"),
        ((F.col("source") == MO) & F.coalesce("deleted", F.lit(False))).alias("deleted"),
        ((F.col("source") == INAT) & F.col("hidden").isNull()).alias("unanswered"),
    )


def check_status_groups(groups: DataFrame) -> DataFrame:
    """FIL13: the shares that stop a write: unanswered over 2 %, hidden beyond the list over 1 %."""
    beyond = (F.col("hidden") | F.col("not_shown") | F.col("deleted")) & ~F.col("listed")
    shares = groups.agg(F.avg(F.col("unanswered").cast("double")).alias("unanswered"), F.avg(beyond.cast("double")).alias("beyond"))
    return shares.withColumn("stop", (F.col("unanswered") > MAX_UNANSWERED) | (F.col("beyond") > MAX_BEYOND))


def check_rows(df: DataFrame, id_col: str = "id", name: str = "scientific_name", lat: str = "latitude", lng: str = "longitude") -> DataFrame:
    """FIL14: one row of fault counts: null coordinates, null or empty names, repeated ids."""
    missing = [c for c in (id_col, name, lat, lng) if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.agg(
        F.count_if(F.col(lat).isNull() | F.col(lng).isNull()).alias("no_coordinates"),
        F.count_if(F.col(name).isNull() | (F.trim(name) == "")).alias("no_name"),
        (F.count(id_col) - F.count_distinct(id_col)).alias("repeated_ids"),
    )


def complete_cases(df: DataFrame, bands: list[str]) -> DataFrame:
    """FIL15: rows with every band, and how many lacked one is ``incomplete_count``."""
    return df.dropna(subset=bands)


def incomplete_count(df: DataFrame, bands: list[str], by: list[str]) -> DataFrame:
    """FIL15: rows with any null band, by group."""
    return df.groupBy(*by).agg(F.count_if(any_of([F.col(b).isNull() for b in bands])).alias("incomplete"))


def taxa_page(taxa: DataFrame, q: str | None = None, min_localities: int = 0, limit: int = 50, offset: int = 0, most: int = 500) -> DataFrame:
    """FIL16: a page of the taxon list by substring and localities, richest first; ``total`` is over all matches."""
    if limit < 1 or offset < 0 or min_localities < 0:
        raise ValueError("limit, offset and min_localities are whole numbers from 1, 0 and 0")
    hits = taxa.where(F.col("localities") >= min_localities)
    if q:
        hits = hits.where(F.lower("scientific_name").contains(q.lower()))
    total = hits.agg(F.count("*").alias("total"))
    page = hits.orderBy(F.desc("localities"), "scientific_name").offset(offset).limit(min(limit, most))
    return page.crossJoin(F.broadcast(total))  # a page by one row


def checklist(table: DataFrame, region: str | None = None, taxon: str | None = None) -> DataFrame:
    """FIL17: rows of a region (code, name or country code) and/or a taxon; an unknown region is an error."""
    out = table
    if region is not None:
        key = region.strip()
        hit = (F.upper("code") == key.upper()) | (F.col("country_code") == key.upper()) | (region_key("region") == region_key(F.lit(key)))
        out = table.where(hit)
        if out.isEmpty():
            raise ValueError(f"unknown region: {region}")
    return out if taxon is None else out.where(F.col("taxon") == taxon)
