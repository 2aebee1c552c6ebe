import math
from datetime import date, datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rangeflow.operators import aggs as A
from rangeflow.operators import windows as W
from rangeflow.plans import model as M
from rangeflow.streaming import streams as T

EVENT = "record long, kind string, taxon string, cell long, retracted_on date, at timestamp"


def run(spark, folder, batches):
    """The last state of every record after the batches, each a file of the stream."""
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "record long, kind string, taxon string, cell long, since string, at string")
        frame.select("record", "kind", "taxon", "cell", F.col("since").cast("date").alias("retracted_on"), F.col("at").cast("timestamp").alias("at")).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        keep = lambda batch, k, n=n: batch.withColumn("batch", F.lit(1000 * n + k)).write.mode("overwrite").parquet(f"{folder}/changes/b={n}-{k}")
        events = spark.readStream.schema(EVENT).parquet(f"{folder}/events")
        T.watch_retractions(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{folder}/changes").groupBy("record").agg(F.max_by(F.struct("reason", "retracted_on"), "batch").alias("s"))
    return {r["record"]: (r["reason"], str(r["since"]) if r["since"] else None) for r in last.select("record", "s.reason", F.col("s.retracted_on").alias("since")).collect()}


def test_retractions_as_a_stream(spark, tmp_path):
    listed = [(k, "listed", "t", 5, None, "2024-01-01 00:00:00") for k in range(6)]
    day = lambda d, rows: [(k, "seen", t, c, None, f"2024-01-{d:02d} 12:00:00") for k, t, c in rows]
    first = day(2, [(0, "t", 5), (1, "u", 5), (2, "t", 6), (4, "t", 5), (5, "t", 6), (99, "t", 5)])  # 3 is not there; 99 is not listed
    second = day(4, [(0, "t", 5), (1, "u", 5), (2, "t", 5), (3, "t", 5), (5, "u", 5)])  # 2 and 3 come back, 5 is renamed now
    got = run(spark, str(tmp_path), [listed, first, second])
    assert got[0] == (None, None) and got[1] == ("renamed", "2024-01-02") and got[2] == (None, None) and got[3] == (None, None)
    assert got[4][0] == "gone" and got[5] == ("renamed", "2024-01-02") and 99 not in got


def test_upper_tail_and_keyset_windows(spark):
    z = [-6.0, -1.5, -1e-9, 0.0, 0.3, 1.96, 5.0, 9.0]
    rows = spark.createDataFrame([(v,) for v in z] + [(None,)], "z double").select("z", A.upper_tail("z").alias("p")).collect()
    assert all(r["p"] is None if r["z"] is None else abs(r["p"] / (0.5 * math.erfc(r["z"] / math.sqrt(2))) - 1) < 3e-7 for r in rows)
    got = sorted(map(tuple, W.keyset_windows(spark.createDataFrame([(30,), (10,), (20,)], "bound long")).collect()), key=lambda r: r[0])
    assert got == [(0, 10), (10, 20), (20, 30), (30, None)]


def test_pass_model_equals_newton_steps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -2.0])))).astype(float)
    rows = spark.createDataFrame([(bool(p), float(a), float(b)) for p, (a, b) in zip(y, x, strict=True)], "passed boolean, a double, b double")
    got = {r["term"]: r["coefficient"] for r in M.pass_model(rows, ["a", "b"]).collect()}
    z, beta = np.column_stack([np.ones(400), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p))
    assert np.allclose([got["intercept"], got["a"], got["b"]], beta, atol=1e-3)


def test_bootstrap_equals_its_slots(spark):
    from rangeflow.operators import topk as K

    rows = spark.createDataFrame([(k % 7, float(k)) for k in range(60)], "cluster int, v double")
    got = K.cluster_bootstrap(rows, "cluster", ["v"], 50).first()
    K.BROADCAST_CLUSTERS, kept = 0, K.BROADCAST_CLUSTERS
    try:
        assert K.cluster_bootstrap(rows, "cluster", ["v"], 50).first() == got
    finally:
        K.BROADCAST_CLUSTERS = kept


def test_retractions_by_parts_equal_a_record_at_a_time(spark, tmp_path):
    rng, known, plain, start = np.random.default_rng(7), pd.DataFrame(columns=T._KNOWN), {}, datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000
    for k in range(8):
        n, watermark = 150, int(start + k * 43_200_000)
        rows = pd.DataFrame({
            "record": rng.integers(0, 60, n), "kind": rng.choice(["listed", "seen", "seen"], n), "taxon": rng.choice(["t", "u", None], n), "cell": rng.integers(1, 3, n),
            "retracted_on": [date(2023, 5, 1) if v else None for v in rng.random(n) < 0.3], "at": pd.to_datetime(start + rng.permutation(n) * 600_000 + k * 43_200_000, unit="ms"),
        })
        known, told = T._told(known, rows, watermark, 1.0)
        want = {}
        for record, s in plain.items():
            if s["due"] is not None and s["due"] < watermark and record not in set(rows["record"]):
                s["due"] = None
                if s["listed"] and s["reason"] != "gone":
                    s["reason"], s["since"] = "gone", s["since"] or datetime.fromtimestamp(watermark / 1000, timezone.utc).date()
                    want[record] = s["reason"], s["since"]
        for r in rows.sort_values("at").itertuples():
            s = plain.setdefault(r.record, {"listed": False, "reason": None, "since": None, "due": None})
            if r.kind == "listed":
                s |= {"taxon": r.taxon, "cell": r.cell, "since": r.retracted_on, "listed": True}
            elif s["listed"]:
                s["reason"] = "renamed" if r.taxon != s["taxon"] else "moved" if r.cell != s["cell"] else None
                s["since"] = (s["since"] or r.at.date()) if s["reason"] else None
            s["due"] = max(r.at.timestamp() * 1000 + 86_400_000, watermark + 1)
            if s["listed"]:
                want[r.record] = s["reason"], s["since"]
        assert {r.record: (r.reason, r.since) for r in told.itertuples()} == want
    seen = spark.range(500).selectExpr("id as record", "'listed' as kind", "'t' as taxon", "1L as cell", "cast(null as date) as retracted_on", "timestamp '2024-01-01' as at")
    seen.write.parquet(f"{tmp_path}/events")
    events = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/events")
    q = T.watch_retractions(events, parts=4).writeStream.outputMode("update").format("memory").queryName("told").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("told").count() == 500 and max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) == 4
