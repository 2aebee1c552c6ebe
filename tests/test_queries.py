import duckdb
import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F
from rangeflow.plans import model as M
from rangeflow.plans.stand_ins import points

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["agg7_region_table", "txt4_name_key", "fil6_shared_points", "joi5_region_of", "joi22_live_at", "agg29_tracker_summary", "win6_auc", "win8_q_values", "top4_weighted_sample", "set7_refit_plan", "cel7_terrain", "stm1_streamed_counts", "mod1_training_table", "mod3_spatial_folds", "mod4_pruned_by_taxon", "mod10_kernel_baseline", "joi9_thinning"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def cells(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, DIR)
    names = sorted(got.columns)
    sql = db.execute(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert cells(got.select(*names).collect()) == cells(sql)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["mod3_spatial_folds", "mod11_cross_validation"])
def test_models_run(spark, name):
    assert entry.queries()[name](spark, DIR).columns


def test_training_keeps_every_detection(spark):
    p = points(spark, DIR).where("cell20 is not null")
    x = p.groupBy("cell20").agg(F.avg("x").alias("mean_x"))
    seen = "id % 3 = 2 or id % 3 = 0 and mean_x > 0 or id % 3 = 1 and mean_x < -1e6"
    want = p.join(x, "cell20").where(seen).select(F.col("id") % 3, "cell20").distinct().count()
    assert entry.queries()["mod1_training_table"](spark, DIR).where("presence = 1").count() == want


def test_learners_take_the_librarys_procedures(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(M, "null_test", lambda *a, **k: seen.update(null=(a[2:], k)))
    monkeypatch.setattr(M, "fit_taxa", lambda *a, **k: seen.update(taxa=(a[2:], k)))
    for name in ("mod13_null_test", "mod19_fit_taxa"):
        entry.queries()[name](spark, DIR)
    assert seen == {"null": ((), {}), "taxa": ((), {})}


@pytest.fixture(scope="module")
def at_origin(tmp_path_factory):
    """Records at 40 N 96 W, the projection's origin, which lies on an edge of cells (two customers, since places repeat after 342,200 keys), and at others."""
    d, c = tmp_path_factory.mktemp("origin"), duckdb.connect()
    c.execute(f"COPY (SELECT * FROM '{DIR}/nation.parquet') TO '{d}/nation.parquet'")
    keys = "SELECT * FROM (VALUES (283800), (626000), (283801), (283810), (1)) v(k)"
    c.execute(f"COPY (SELECT CAST(k AS BIGINT) AS c_custkey, CAST(k % 25 AS INT) AS c_nationkey FROM ({keys})) TO '{d}/customer.parquet'")
    c.execute(f"COPY (SELECT CAST(row_number() OVER (ORDER BY k, n) AS BIGINT) AS o_orderkey, CAST(k AS BIGINT) AS o_custkey, 'F' AS o_orderstatus, 10.0::DOUBLE * n AS o_totalprice, TIMESTAMP '1995-08-01' + INTERVAL (n) DAY AS o_orderdate, '1-URGENT' AS o_orderpriority FROM ({keys}), range(8) r(n)) TO '{d}/orders.parquet'")
    for t in ("nation", "customer", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["joi14_what_grows_here", "joi30_occurrence_points", "stm1_streamed_scores", "mod1_training_table"])
def test_records_at_the_origin_equal_sql(spark, at_origin, name):
    folder, c = at_origin
    got = entry.queries()[name](spark, folder)
    names = sorted(got.columns)
    sql = c.execute(f"SELECT {', '.join(f'"{n}"' for n in names)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sql and cells(got.select(*names).collect()) == cells(sql)


def test_places_are_projected_once(spark, at_origin):
    from rangeflow.plans.stand_ins import places

    assert places(spark, at_origin[0]).count() == 4 and points(spark, at_origin[0]).count() == 40
