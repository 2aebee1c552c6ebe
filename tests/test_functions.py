import pytest
from pyspark.sql import functions as F

from rangeflow.functions import scalars as S
from rangeflow.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "name, want",
    [
        ("Amanita sp-IN01", "Amanita sp. 'IN01'"), ("Amanita  'sp-PNW02'", "Amanita sp. 'PNW02'"), ("Russula sp. ‘A b", "Russula sp. 'A b'"),
        ("  Boletus edulis ", "Boletus edulis"),
    ],
)
def test_regular_name(spark, name, want):
    assert one(spark, X.regular_name(F.lit(name))) == want


@pytest.mark.parametrize(
    "name, want",
    [
        ("Amanita muscaria (L.) Lam.", "Amanita muscaria"), ("Amanita muscaria var. flavivolvata Singer", "Amanita muscaria var. flavivolvata"),
        ("Boletus edulis", "Boletus edulis"), ("Russula IN01 abc", "Russula IN01 abc"), ("Agaricus bisporus ex Lange", "Agaricus bisporus"), (None, None),
    ],
)
def test_strip_authors(spark, name, want):
    assert one(spark, X.strip_authors(F.lit(name).cast("string"))) == want


def test_name_key_joins_spellings(spark):
    a = one(spark, X.name_key(F.lit("Amanita muscaria ssp. flavivolvata Singer")))
    assert a == one(spark, X.name_key(F.lit("Amanita  muscaria subsp. flavivolvata")))
    assert one(spark, X.name_key(F.lit("Amanita sp. 'IN_01'"))) == "amanita sp. 'in-01'"


def test_search_and_region_keys(spark):
    assert one(spark, X.search_key(F.lit("Amanita cf. muscaria var. X-1"))) == "amanita muscaria x 1"
    assert one(spark, X.region_key(F.lit(" Nuevo  León!"))) == "nuevo leon"


def test_dates(spark):
    assert str(one(spark, S.parse_validation_date(F.lit("4/3/2024 10:00")))) == "2024-04-03"
    assert one(spark, S.parse_validation_date(F.lit("4/31/2024"))) is None
    assert str(one(spark, S.parse_validation_date(F.lit("2024-02-29x")))) == "2024-02-29"


def test_projection_origin_and_cells(spark):
    x, y = S.albers(F.lit(40.0), F.lit(-96.0))
    assert abs(one(spark, x)) < 1e-6 and abs(one(spark, y)) < 1e-6
    cell = one(spark, S.grid_cell(F.lit(0.0), F.lit(0.0), 20))
    cx, cy = S.cell_centre(F.lit(cell), 20)
    assert abs(one(spark, cx)) <= 10_000 and abs(one(spark, cy)) <= 10_000
    assert one(spark, S.grid_cell(F.lit(9e9), F.lit(0.0), 20)) is None


def test_bands_and_intervals(spark):
    assert [one(spark, S.place_band(F.lit(v))) for v in (0.0, 5.0, 5.1, 501.0)] == ["0-5", "0-5", "5-25", "500+"]
    assert [one(spark, S.count_band(F.lit(v))) for v in (19, 20, 29, 30, 200)] == ["<20", "20-29", "20-29", "30-49", "200+"]
    w = one(spark, S.wilson(F.lit(5), F.lit(10)))
    assert (w["low"], w["high"]) == (0.237, 0.763)
    assert one(spark, S.wilson(F.lit(0), F.lit(0)))["low"] is None


def test_the_origin_lies_on_its_cell_edge(spark):
    from rangeflow.functions.scalars import albers, grid_cell

    at = spark.createDataFrame([(40.0, -96.0)], "lat double, lng double").withColumns(dict(zip(("x", "y"), albers("lat", "lng"))))
    row = at.select("x", "y", grid_cell("x", "y", 5).alias("c5"), grid_cell("x", "y", 20).alias("c20")).first()
    assert (row.x, row.y, row.c5, row.c20) == (0.0, 0.0, 2310818, 144706)


def test_coarser_cells_beyond_the_extent_stay_apart(spark):
    from rangeflow.functions.scalars import coarser_cell

    cells = [1, 2436, 2436 * 1539, 2436 * 1539 + 1, 4_000_000, 20_000_000]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "cell long").select(coarser_cell("cell", 5, 20)).collect()]
    assert got == [(c - 1) // 2436 // 4 * 609 + (c - 1) % 2436 // 4 + 1 for c in cells]
