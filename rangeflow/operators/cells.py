"""Map algebra on cell tables (CEL1 to CEL9).  Cells are (row, col) of a grid, or cell numbers with x and y."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeflow.functions.text import any_of

_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def coarsen(cells: DataFrame, factor: int, bands: list[str]) -> DataFrame:
    """CEL1: means of finer cells per coarser cell (row, col)."""
    by = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return cells.groupBy(*by).agg(*[F.avg(b).alias(b) for b in bands])


def class_shares(cells: DataFrame, factor: int, column: str, groups: dict[str, list[int]]) -> DataFrame:
    """CEL1: shares of class codes per coarser cell."""
    by = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return cells.groupBy(*by).agg(*[F.avg(F.col(column).isin(*codes).cast("double")).alias(g) for g, codes in groups.items()])


def snap_window(low: float, high: float, step: float) -> tuple[float, float]:
    """CEL2: a range snapped outwards to a step."""
    return math.floor(low / step) * step, math.ceil(high / step) * step


def crop(cells: DataFrame, x: tuple[float, float], y: tuple[float, float], step: float = 1.0) -> DataFrame:
    """CEL2: rows inside an outward-snapped window."""
    (x0, x1), (y0, y1) = snap_window(*x, step), snap_window(*y, step)
    return cells.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def supplement(cells: DataFrame, extra: DataFrame, bands: list[str], key: str = "cell", known: str = "known") -> DataFrame:
    """CEL3: where all bands are missing, the other source's; ``known`` 1 for own values, 0 for filled ones, null for neither."""
    side = extra.select(key, *[F.col(b).alias(f"_x_{b}") for b in bands])
    own = any_of([F.col(b).isNotNull() for b in bands])
    out = cells.join(side, key, "left").withColumn(known, F.when(own, 1).when(any_of([F.col(f"_x_{b}").isNotNull() for b in bands]), 0))
    return out.withColumns({b: F.when(F.col(known) == 1, F.col(b)).otherwise(F.col(f"_x_{b}")) for b in bands}).drop(*[f"_x_{b}" for b in bands])


def neighbours(cells: DataFrame, columns: list[str]) -> DataFrame:
    """(row, col, di, dj, columns of the neighbour at that offset) of the eight cells around."""
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in _AROUND]))
    to = cells.select("row", "col", *columns, spread.alias("o"))
    return to.select((F.col("row") - F.col("o.di")).cast("int").alias("row"), (F.col("col") - F.col("o.dj")).cast("int").alias("col"), "o.di", "o.dj", *columns)


def fill_near(cells: DataFrame, band: str, rings: int) -> DataFrame:
    """CEL4: empty land cells take the mean of filled neighbours, one ring per pass (cells: row, col, land, band)."""
    from rangeflow.operators.lineage import cut

    out = cells
    for _ in range(rings):
        near = neighbours(out.where(F.col(band).isNotNull()), [band]).groupBy("row", "col").agg(F.avg(band).alias("_near"))
        filled = F.coalesce(F.col(band), F.when(F.col("land"), F.col("_near")))
        out = cut(out.join(near, ["row", "col"], "left").withColumn(band, filled).drop("_near"))
    return out


def fill_outside(cells: DataFrame, bands: list[str], described: str = "described", land: str = "land", known: str = "known") -> DataFrame:
    """CEL5: 0 on land that the source is silent about, with ``known`` 0; the sea stays null."""
    said = F.coalesce(F.col(described), F.lit(False))
    values = {b: F.when(F.col(land), F.when(said, F.coalesce(F.col(b), F.lit(0.0))).otherwise(0.0)) for b in bands}
    return cells.withColumns(values | {known: F.when(F.col(land), said.cast("int"))})


def mosaic(first: DataFrame, second: DataFrame, bands: list[str], prefer_first: Column, key: str = "cell") -> DataFrame:
    """CEL6: one layer of two inventories; where both know a cell the condition says whose value counts."""
    a = first.select(key, *[F.col(b).alias(f"_a_{b}") for b in bands], F.lit(True).alias("_a"))
    b_ = second.select(key, *[F.col(b).alias(f"_b_{b}") for b in bands], F.lit(True).alias("_b"))
    both = a.join(b_, key, "full_outer")
    use_a = F.col("_a").isNotNull() & (F.col("_b").isNull() | prefer_first)
    return both.select(key, *[F.when(use_a, F.col(f"_a_{b}")).otherwise(F.col(f"_b_{b}")).alias(b) for b in bands])


def terrain(cells: DataFrame, height: str = "elevation", size_m: float = 1000.0) -> DataFrame:
    """CEL7: slope in degrees (Horn) and roughness (mean absolute difference) of a 3 x 3 neighbourhood; the sea counts as 0."""
    z = F.coalesce(F.col(height), F.lit(0.0))
    near = neighbours(cells.withColumn("_z", z), ["_z"])
    at = {(i, j): F.max(F.when((F.col("di") == i) & (F.col("dj") == j), F.col("_z"))) for i, j in _AROUND}
    wide = near.groupBy("row", "col").agg(*[at[k].alias(f"z{k[0] + 1}{k[1] + 1}") for k in _AROUND])
    own = cells.withColumn("_z", z).join(wide, ["row", "col"], "left").na.fill(0.0, [f"z{i + 1}{j + 1}" for i, j in _AROUND])
    c = F.col
    dx = ((c("z02") + 2 * c("z12") + c("z22")) - (c("z00") + 2 * c("z10") + c("z20"))) / (8 * size_m)
    dy = ((c("z20") + 2 * c("z21") + c("z22")) - (c("z00") + 2 * c("z01") + c("z02"))) / (8 * size_m)
    rough = sum((F.abs(c(f"z{i + 1}{j + 1}") - c("_z")) for i, j in _AROUND), F.lit(0.0)) / 8
    land = F.col(height).isNotNull()
    return own.select("row", "col", F.when(land, F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))).alias("slope"), F.when(land, rough).alias("roughness"))


def mask_to_area(cells: DataFrame, detections: DataFrame, buffer_km: float = 500) -> DataFrame:
    """CEL8: (taxon, cell...) of the cells within a taxon's accessible area."""
    from rangeflow.operators.joins import accessible_sites

    return accessible_sites(cells, detections, buffer_km)


def full_extent(scored: DataFrame, cells: DataFrame, detections: DataFrame, buffer_km: float = 500, key: str = "cell") -> DataFrame:
    """CEL8: cells of each taxon's accessible area that are not scored yet."""
    return mask_to_area(cells, detections, buffer_km).join(scored.select("taxon", key), ["taxon", key], "left_anti")


def upsert_manifest(manifest: DataFrame, entries: DataFrame, key: str = "layer") -> DataFrame:
    """CEL9: one row per layer, replaced on a rebuild."""
    return manifest.join(entries.select(key), key, "left_anti").unionByName(entries)


def layers_key(manifest: DataFrame) -> DataFrame:
    """CEL9: one key over all builds (a manifest has one row per layer)."""
    rows = F.array_sort(F.collect_list(F.concat_ws("=", "layer", "build")))
    return manifest.agg(F.sha2(F.array_join(rows, ";"), 256).alias("key"))


def layer_of(bands: DataFrame, layers: DataFrame) -> DataFrame:
    """CEL9: each band's layer."""
    return bands.join(layers, "band", "left")
