from pyspark.sql import functions as F

from rangeflow.sources import snapshots as SN
from rangeflow.sources import tables as ST
from rangeflow.streaming import streams as T


def test_tsv_round_trip(spark, tmp_path):
    rows = [(1, "7", "iNaturalist", "Amanita 'x'", "Amanita", "2024-01-02", "40.5", "-96.25", None, "US", None, "2024-02-01")]
    df = spark.createDataFrame(rows, ST.OCCURRENCE_SCHEMA)
    ST.write_tsv_gz(df, str(tmp_path / "a"))
    r = ST.read_tsv(spark, str(tmp_path / "a")).first()
    assert (r["id"], r["scientific_name"], r["latitude"], str(r["observed_on"]), r["state"]) == (1, "Amanita 'x'", 40.5, "2024-01-02", None)


def test_an_equal_snapshot_is_skipped(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    first = SN.publish_snapshot(df, str(tmp_path / "s"), "r1")
    assert first and SN.publish_snapshot(df.orderBy(F.desc("k")), str(tmp_path / "s"), "r2", first) is None
    assert SN.publish_snapshot(df.limit(1), str(tmp_path / "s"), "r3", first)
    assert ST.read_summary(spark, str(tmp_path / "s"), df.schema).count() == 1


def test_private_fields_go_at_any_depth(spark):
    df = spark.sql("SELECT 1 AS k, 'f' AS fingerprint, array(named_struct('seed', 1, 'v', named_struct('seed', 2, 'w', 3))) AS a")
    assert ST.public_fields(df).first().asDict(True) == {"k": 1, "a": [{"v": {"w": 3}}]}


def test_streamed_scores_equal_the_batch(spark, tmp_path):
    finds = spark.createDataFrame([(f"s:{k}", f"t{k % 3}", k % 4, "2024-01-01") for k in range(20)], "record string, taxon string, cell int, updated_at string")
    ranked = spark.createDataFrame([("t0", 0, 0.9, True), ("t0", 1, 0.4, False), ("t1", 1, 0.7, True)], "taxon string, cell int, rank double, inside boolean")
    trained = spark.createDataFrame([("t0", "s:0")], "taxon string, record string")
    finds.union(finds).write.parquet(str(tmp_path / "in"))
    stream = T.watch_finds(spark, str(tmp_path / "in"), finds.schema)
    T.stream_scores(stream, ranked, trained, str(tmp_path / "ledger"), str(tmp_path / "check")).awaitTermination()
    columns = ["record", "taxon", "cell", "rank", "place", "status"]
    got = spark.read.parquet(str(tmp_path / "ledger")).select(*columns)
    want = T.score_finds(finds, ranked, trained).select(*columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r["status"] for r in want.collect()} == {"trained on", "no map", "ranked", "outside_aoa", "beyond_reach"}
