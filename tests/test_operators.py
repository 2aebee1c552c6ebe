import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rangeflow.operators import aggs as A
from rangeflow.operators import joins as J
from rangeflow.operators import topk as K
from rangeflow.operators import windows as W


def average_ranks(v):
    order = np.argsort(v, kind="stable")
    out = np.empty(len(v))
    out[order] = np.arange(1, len(v) + 1)
    return np.array([out[v == x].mean() for x in v])


def test_thinning_equals_the_greedy_rule(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(rng.integers(1, 6)), float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 100, (150, 2)))]
    chosen = []
    for k, w, x, y in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all((x - a) ** 2 + (y - b) ** 2 >= 100 for _, a, b in chosen):
            chosen.append((k, x, y))
    got = J.thin_by_distance(spark.createDataFrame(rows, "cell long, records int, x double, y double"), 10.0).select("cell").collect()
    assert {r["cell"] for r in got} == {k for k, *_ in chosen}


def test_thinning_of_an_even_strip_decides_every_point(spark):
    rows = [(k, 1, 10.0 * k, 0.0) for k in range(134)]  # every second one is a centre, one a round: 67 rounds
    got = J.thin_by_distance(spark.createDataFrame(rows, "cell long, records int, x double, y double"), 15.0).select("cell").collect()
    assert {r["cell"] for r in got} == set(range(0, 134, 2))


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(4)
    q, t = rng.uniform(0, 1e6, (40, 2)), rng.uniform(0, 1e6, (15, 2))
    frame = lambda a, name: spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(a)], f"{name} long, x double, y double")
    got = {r["q"]: r["distance"] for r in J.nearest(frame(q, "q"), frame(t, "t"), start=20_000.0).collect()}
    for k, p in enumerate(q):
        assert abs(got[k] - np.sqrt(((t - p) ** 2).sum(axis=1)).min()) < 1e-6


def test_points_take_turns_for_sites(spark):
    rng = np.random.default_rng(6)
    p, t = rng.uniform(0, 1e5, (60, 2)), rng.uniform(0, 1e5, (70, 2))
    t[60:] += 1e6  # far ones, taken at last
    points = spark.createDataFrame([("g", k, float(x), float(y)) for k, (x, y) in enumerate(p)] + [("h", 0, None, 1.0)], "taxon string, from_site long, x double, y double")
    sites = spark.createDataFrame([(k, float(x), float(y), k + 1) for k, (x, y) in enumerate(t[:62])], "site long, x double, y double, weight long")
    order = {r["from_site"]: r["o"] for r in points.select("from_site", K.unit_hash(F.col("taxon"), F.col("from_site"), F.lit("order")).alias("o")).where("x is not null").collect()}
    drawn = {(r["f"], r["s"]): r["u"] for r in points.select(F.col("from_site").alias("f")).crossJoin(sites.select(F.col("site").alias("s"))).select("f", "s", K.unit_hash(F.lit("g"), F.col("f"), F.col("s")).alias("u")).collect()}
    for effort in (False, True):
        got = {r["from_site"]: (r["site"], r["far"]) for r in K.snap_to_sites(points, sites, ["taxon"], effort=effort).collect()}
        want, free = {}, set(range(62))
        for k in sorted(order, key=order.get):
            d = np.sqrt(((t[:62] - p[k]) ** 2).sum(axis=1))
            near = sorted(free, key=d.__getitem__)
            s = near[0]
            if effort and d[s] <= 25_000:
                s = min((x for x in near[:5] if d[x] <= 25_000), key=lambda x: -np.log(drawn[k, x]) / (x + 1))
            free.discard(s)
            want[k] = (s, bool(d[s] > 25_000))
        assert got == want and len(got) == 60


@pytest.mark.parametrize("sent", [10_000, 0])
def test_nearest_in_space_equals_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(J, "BROADCAST_PIVOTS", sent)
    rng = np.random.default_rng(9)
    refs = [("ab"[k % 2], float(x), float(y), float(z)) for k, (x, y, z) in enumerate(np.round(rng.normal(size=(400, 3)), 1))]
    asked = [("abc"[k % 3], k, float(x), None if k == 7 else float(y), float(z)) for k, (x, y, z) in enumerate(rng.normal(size=(90, 3)) * 2)]
    r = spark.createDataFrame(refs, "g string, u double, v double, w double")
    q = spark.createDataFrame(asked, "g string, q long, u double, v double, w double")
    got = {(x["g"], x["q"]): x["distance"] for x in J.nearest_in_space(q, r, ["u", "v", "w"], {"v": 2.0}, by=["g"]).collect()}
    alone = {x["q"]: x["distance"] for x in J.nearest_in_space(q, r, ["u", "v", "w"]).collect()}
    z = np.array([x[1:] for x in refs])
    for g, k, *at in asked:
        own = np.array([x[0] == g for x in refs])
        if None in at or not own.any():
            assert got[g, k] is None
        else:
            assert abs(got[g, k] - np.sqrt(((z[own] - at) ** 2 * [1, 2, 1]).sum(axis=1)).min()) < 1e-9
        assert alone[k] is None if None in at else abs(alone[k] - np.sqrt(((z - at) ** 2).sum(axis=1)).min()) < 1e-9
    assert J.nearest_in_space(q, r.limit(0), ["u"]).where("distance is not null").count() == 0


def test_nearest_in_space_meets_by_parts(spark, monkeypatch):
    # nearly all rows in one cell: it is dealt to parts of both sides, and no pairs are joined
    monkeypatch.setattr(J, "NEAR_ROWS", 16)
    rng = np.random.default_rng(10)
    z, a = rng.normal(size=(150, 2)) * 1e-3, np.vstack([rng.normal(size=(60, 2)) * 1e-3, rng.normal(size=(10, 2)) * 5])
    z[:3] += 40
    frame = lambda m: spark.createDataFrame([(f"q{k}", *map(float, row)) for k, row in enumerate(m)], "q string, u double, v double")
    found = J.nearest_in_space(frame(a), frame(z), ["u", "v"])
    want = np.sqrt(((a[:, None] - z[None]) ** 2).sum(axis=2)).min(axis=1)
    got = {r["q"]: r["distance"] for r in found.collect()}
    assert np.allclose([got[f"q{k}"] for k in range(70)], want, rtol=0, atol=1e-12)
    none = J.nearest_in_space(frame(a).withColumn("q", F.when(F.col("q") != "q1", F.col("q"))), frame(z), ["u", "v"])
    assert [r["distance"] for r in none.where("q is null").collect()] == [None] and none.count() == 70


def test_recorded_near_equals_brute_force(spark):
    rng = np.random.default_rng(12)
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-89.9, 89.9, 60), rng.uniform(-180, 180, 60), strict=True))] + [(60, 10.0, 179.9), (61, 89.95, 5.0), (62, -60.0, -179.99)]
    cells = [("t", p[1] + float(a), p[2] + float(b), 1) for p in points for a, b in rng.normal(0, 0.4, (25, 2))]
    cells = [(t, max(-90.0, min(90.0, a)), (b + 180) % 360 - 180, n) for t, a, b, n in cells]
    got = {r["point"]: r["records"] for r in J.recorded_near(spark.createDataFrame(points, "point long, lat double, lng double"), spark.createDataFrame(cells, "taxon string, lat double, lng double, records long"), 50).collect()}
    c = np.radians([x[1:3] for x in cells])
    for k, a, b in points:
        la, lo = np.radians(a), np.radians(b)
        h = np.sin((c[:, 0] - la) / 2) ** 2 + np.cos(la) * np.cos(c[:, 0]) * np.sin((c[:, 1] - lo) / 2) ** 2
        assert got.get(k, 0) == (2 * 6371 * np.arcsin(np.sqrt(h)) <= 50).sum()


def test_auc_and_boyce_against_numpy(spark):
    rng = np.random.default_rng(5)
    score, label = np.round(rng.normal(size=300), 1), (rng.random(300) < 0.3).astype(int)
    df = spark.createDataFrame([("g", float(s), int(y)) for s, y in zip(score, label, strict=True)], "g string, score double, presence int")
    r = average_ranks(score)
    n1, n0 = label.sum(), (1 - label).sum()
    assert abs(W.auc(df, ["g"]).first()["auc"] - (r[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)) < 1e-9
    lo, hi = score.min(), score.max()
    span = 0.1 * (hi - lo)
    mids, ratios = [], []
    for b in lo + (hi - span - lo) * np.arange(100) / 99:
        inside = (score >= b) & (score <= b + span)
        covered = inside[label == 0].mean()
        if covered:
            mids.append(b + span / 2)
            ratios.append(inside[label == 1].mean() / covered)
    want = np.corrcoef(average_ranks(np.array(mids)), average_ranks(np.array(ratios)))[0, 1]
    assert abs(W.boyce(df, ["g"]).first()["boyce"] - want) < 1e-6


def test_ranks_of_many_values_equal_numpy(spark):
    rng = np.random.default_rng(6)
    values = [("a", float(v)) for v in np.round(rng.normal(size=3000), 2)] + [("b", float(v)) for v in rng.normal(size=500)] + [("c", 1.0)] * 400 + [("c", float("nan")), ("c", None)]
    df = spark.createDataFrame([(k, g, v) for k, (g, v) in enumerate(values)], "k long, g string, v double")
    for few in (False, True):
        got = {r["k"]: r["r"] for r in W.average_rank(df, "v", ["g"], "r", few).collect()}
        assert len(got) == len(values) and got[len(values) - 1] is None and got[len(values) - 2] is None
        for g in "abc":
            at = [k for k, (h, v) in enumerate(values) if h == g and v is not None and v == v]
            assert [got[k] for k in at] == average_ranks(np.array([values[k][1] for k in at])).tolist()
    whole = {r["k"]: r["r"] for r in W.average_rank(df.where("g <> 'c'"), "v", [], "r").collect()}
    want = average_ranks(np.array([v for g, v in values if g != "c"]))
    assert [whole[k] for k in range(len(want))] == want.tolist()
    reference = df.where("g = 'b'").withColumnRenamed("v", "value").select("g", "value")
    place = W.percentile_in(df.where("g = 'b'").select("g", F.col("v").alias("value")), reference, ["g"]).orderBy("value").collect()
    assert np.allclose([r["percentile"] for r in place], np.arange(500) / 499)


def test_turns_by_squares_equal_turns_over_all_sites():
    rng = np.random.default_rng(3)
    (sx, sy), (px, py), w = rng.uniform(0, 3e5, (2, 300)), rng.uniform(-5e4, 3e5, (2, 120)), rng.integers(1, 9, 300).astype(float)
    for weight in (None, w):
        free, want = np.ones(300, bool), np.full(120, -1)
        for i in sorted(range(120), key=lambda k: K._unit("t", 1, k, "order")):
            d2 = np.where(free, (sx - px[i]) ** 2 + (sy - py[i]) ** 2, np.inf)
            near = [j for j in np.argsort(d2)[:5] if d2[j] <= 25000.0**2]
            want[i] = min(near, key=lambda j: -np.log(K._unit("t", 1, i, j)) / w[j]) if weight is not None and near else d2.argmin()
            free[want[i]] = False
        assert (K._take_turns(("t", 1), list(range(120)), px, py, sx, sy, list(range(300)), weight, 25)[0] == want).all()


def test_shared_sites_are_not_crossed_with_taxa(spark, monkeypatch):
    rng = np.random.default_rng(4)
    s = spark.createDataFrame([(k, float(x), float(y), 1 + k % 5) for k, (x, y) in enumerate(rng.uniform(0, 4e5, (200, 2)))], "site long, x double, y double, records long")
    f = s.where("site % 2 = 0").select((F.col("site") % 7).cast("string").alias("taxon"), "site", "x", "y")
    one = K.shifted_null(f, s, 2, tries=10, effort=True)
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(K, "BUNDLE_ROWS", 40)
    assert sorted(map(str, one.collect())) == sorted(map(str, K.shifted_null(f, s, 2, tries=10, effort=True).collect())) and one.count() == 200


def test_shifted_nulls_place_every_detection(spark):
    rng = np.random.default_rng(8)
    sites = [(k, float(x), float(y), int(n)) for k, (x, y, n) in enumerate(zip(*rng.uniform(0, 4e5, (2, 250)), rng.integers(1, 50, 250), strict=True))]
    found = [("near", *s[:3]) for s in sites if s[1] < 9e4 and s[2] < 9e4] + [("wide", *s[:3]) for s in sites[::5]]
    s = spark.createDataFrame(sites, "site long, x double, y double, records long")
    f = spark.createDataFrame(found, "taxon string, site long, x double, y double")
    size = {t: sum(r[0] == t for r in found) for t in ("near", "wide")}
    for effort in (False, True):
        rows = K.shifted_null(f, s, 2, tries=25, effort=effort).collect()
        for t in size:
            for draw in (1, 2):
                mine = [r for r in rows if (r["taxon"], r["draw"]) == (t, draw)]
                assert len(mine) == len({r["site"] for r in mine}) == size[t] and len({r["try"] for r in mine}) == 1
    own = s.select(F.lit("near").alias("taxon"), "*").where("site < 200")
    rows = K.shifted_null(f, own, 1, tries=2).collect()
    assert {r["taxon"] for r in rows} == {"near"} and all(r["site"] < 200 for r in rows)
    assert K.shifted_null(f.limit(0), s, 1, tries=2).count() == 0


def test_sequential_p(spark):
    rows = [("stops", k, 1.0, 0.5) for k in range(10)] + [("runs", k, float(k == 0), 0.5) for k in range(9)]
    got = {r["t"]: (r["p"], r["draws"]) for r in W.sequential_p(spark.createDataFrame(rows, "t string, draw int, null_score double, observed double"), ["t"], 5).collect()}
    assert got == {"stops": (1.0, 5), "runs": (0.2, 9)}


def test_one_value_ranks_one(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("b", None)], "g string, v double")
    got = sorted((r["g"], r["rank"]) for r in W.rank_scale(df, "v", ["g"]).where("v is not null").collect())
    assert got == [("a", 1.0), ("b", 1.0)]


def test_fingerprint_ignores_order(spark):
    rows = [("s", str(k), "n", 1.0 * k, 2.0) for k in range(5)]
    schema = "source string, observation_id string, scientific_name string, latitude double, longitude double"
    a = A.group_fingerprint(spark.createDataFrame(rows, schema), ["scientific_name"]).first()
    b = A.group_fingerprint(spark.createDataFrame(rows[::-1], schema).repartition(3), ["scientific_name"]).first()
    assert a == b


def test_search_finds_near_misses(spark):
    taxa = spark.createDataFrame([("Amanita muscaria", 5, 4), ("Amanita pantherina", 3, 2), ("Boletus edulis", 9, 9)], "scientific_name string, records int, localities int")
    assert [r["match"] for r in K.search(taxa, "amanita muscaria").collect()][0] == "exact"
    hit = K.search(taxa, "amanita muscarya").first()
    assert (hit["scientific_name"], hit["match"]) == ("Amanita muscaria", "similar")
    assert K.search(taxa, "").count() == 0


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "g string, score double, presence int")
    assert W.auc(df, ["g"]).count() == 0
    assert A.waterfall(df.withColumn("source", F.col("g")), [("a", F.lit(True))]).where("source is not null").count() == 0


def test_kernels_equal_numpy_and_far_sites_do_not_tie(spark):
    import numpy as np

    from rangeflow.plans.model import kernel_scores

    rng = np.random.default_rng(1)
    found = [("t", float(x), float(y)) for x, y in rng.uniform(0, 3e5, (30, 2))]
    asked = [("t", k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-3e6, 3e6, (60, 2)))] + [("none", 99, 0.0, 0.0)]
    q = spark.createDataFrame(asked, "taxon string, site long, x double, y double")
    got = {r["site"]: r["score"] for r in kernel_scores(q, spark.createDataFrame(found, "taxon string, x double, y double"), 50.0, ["taxon"]).collect()}
    place = np.array([f[1:] for f in found])
    for _, k, x, y in asked[:-1]:
        e = -((place - [x, y]) ** 2).sum(axis=1) / (2 * 50_000.0**2)
        assert abs(got[k] - (e.max() + np.log(np.exp(e - e.max()).sum()))) < 1e-9 * max(1, abs(e.max()))
    assert got[99] is None and len(set(got.values())) == len(got)


def test_rows_are_numbered_in_order(spark):
    from rangeflow.operators.lineage import numbered

    rows = numbered(spark.range(1000).selectExpr("(id * 7919) % 1009 as v", "id"), ["v", "id"], "k").collect()
    assert [r["v"] for r in sorted(rows, key=lambda r: r["k"])] == sorted(r["v"] for r in rows) and {r["k"] for r in rows} == set(range(1, 1001))
    assert numbered(spark.range(0).selectExpr("id"), ["id"], "k").count() == 0


def test_thinning_of_a_long_falling_chain(spark):
    from rangeflow.operators.joins import thin_by_distance

    rows = [(k, 1000 - k, 0.6 * k, 0.0) for k in range(400)]
    got = thin_by_distance(spark.createDataFrame(rows, "cell long, records int, x double, y double"), 1.0).collect()
    assert sorted(r["cell"] for r in got) == list(range(0, 400, 2))


def test_accessible_sites_equal_all_pairs(spark):
    rng = random.Random(7)
    at = lambda n: [(k, rng.uniform(-9e5, 9e5), rng.uniform(-9e5, 9e5)) for k in range(n)]
    sites, found = [*at(400), (900, 100_000.0, 0.0), (901, 100_000.1, 0.0), (902, None, 0.0)], [("q", 0.0, 0.0)] + [(rng.choice("pq"), x, y) for _, x, y in at(12)]
    s, f = spark.createDataFrame(sites, "site int, x double, y double"), spark.createDataFrame(found, "taxon string, x double, y double")
    want = {(t, k) for t, u, v in found for k, x, y in sites if x is not None and (x - u) ** 2 + (y - v) ** 2 <= 1e10}
    got = J.accessible_sites(s, f.unionByName(f), 100).collect()
    assert {(r["taxon"], r["site"]) for r in got} == want and len(got) == len(want)
    assert J.accessible_sites(s, f.limit(0), 100).count() == 0



def test_accessible_squares_are_neither_broadcast_nor_multiplied(spark):
    rng = random.Random(5)
    s = spark.createDataFrame([(i, rng.uniform(-6e6, 6e6), rng.uniform(-6e6, 6e6)) for i in range(300)], "site long, x double, y double")
    f = s.where("site % 4 = 0").withColumn("taxon", F.when(F.col("site") % 3 > 0, (F.col("site") % 3).cast("string")))
    out = J.accessible_sites(s, f, 900)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "FlatMapGroupsInPandas" in plan
    rows, found = s.collect(), f.collect()
    want = {(d.taxon, c.site) for d in found for c in rows if (c.x - d.x) ** 2 + (c.y - d.y) ** 2 <= 900_000**2}
    assert {(r.taxon, r.site) for r in out.collect()} == want and out.count() == len(want)


def test_live_at_without_a_key(spark):
    p = spark.createDataFrame([("r1", "2024-01-05 00:00:00"), ("r2", "2024-01-20 12:00:00"), (None, "2024-02-02 00:00:00"), ("r3", "2024-05-01 00:00:00")], "release string, promoted_at string")
    days = spark.createDataFrame([(d,) for d in ("2024-01-05", "2024-01-06", "2024-03-01", "2024-05-01", "2024-05-02", "2024-05-02")], "day string")
    got = J.live_at(days, p.withColumn("promoted_at", F.col("promoted_at").cast("timestamp"))).orderBy("day").collect()
    assert [r["release"] for r in got] == [None, "r1", "r2", "r2", "r3", "r3"]


def test_nearest_among_many_features(spark):
    rng = np.random.default_rng(5)
    names, a, b = [f"f{k}" for k in range(30)], rng.normal(size=(40, 30)), rng.normal(size=(60, 30))
    frame = lambda m: spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(m)], ["q", *names])
    got = {x["q"]: x["distance"] for x in J.nearest_in_space(frame(a), frame(b), names, {"f3": 4.0}).collect()}
    w = np.ones(30)
    w[3] = 4.0
    want = np.sqrt((((a[:, None] - b[None]) ** 2) * w).sum(axis=2)).min(axis=1)
    assert np.allclose([got[k] for k in range(40)], want)


def test_sequence_names_are_gathered_by_key(spark):
    rec = [(i, ("iNaturalist", "MO Observations", "MyCoPortal")[i % 3], str(i % 4), ("Amanita muscaria", "Amanita", "Boletus edulis Fr.")[i % 3]) for i in range(40)] + [(1, "iNaturalist", "1", "Amanita muscaria")]
    records = spark.createDataFrame(rec, "id long, source string, observation_id string, scientific_name string")
    seq = [("inat:0", "Amanita muscaria"), ("mo:1", "Amanita  muscaria"), ("mo:3", "Boletus edulis"), ("mo:2", " "), ("inat:3", "Russula")] * 50
    sequences = spark.createDataFrame([(*s, True, None) for s in seq], "ref string, species_name string, approved boolean, flags string")
    links = spark.createDataFrame([(f"inat:{k}", f"mo:{k}") for k in range(4)], "ref string, other_ref string")
    names = J.sequence_names(records, sequences, links)
    prefix = {"iNaturalist": "inat", "MO Observations": "mo", "MyCoPortal": "mycoportal"}
    refs = {(i, f"{prefix[s]}:{o}") for i, s, o, _ in rec} | {(i, f"mo:{o}") for i, s, o, _ in rec if s == "iNaturalist"}
    want = sorted((i, n.strip()) for i, f in refs for g, n in set(seq) if f == g and n.strip())
    assert sorted(map(tuple, names.collect())) == want
    single = records.where("id <> 1")
    cols = ["id", "record_name", "scientific_name", "name_status"]
    got = J.sequenced_records(single, sequences, links).select(cols).collect()
    assert sorted(got, key=str) == sorted(J.dna_names(single, names).select(cols).collect(), key=str)
    plan = J.sequenced_records(single, sequences, links)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(id" not in plan and "Aggregate [id#" not in plan


def test_quantile_gap_orders_by_ranges(spark):
    rng = random.Random(9)
    rows = [(g, rng.random() < 0.4, float(rng.randrange(60)) if g else rng.gauss(0, 9)) for g in (0, 1, None) for _ in range(700)]
    rows += [(2, True, 1.0), (3, True, 4.0), (3, False, 1.5), (4, True, None)]
    df = spark.createDataFrame(rows, "g int, side boolean, v double")
    out = W.quantile_gap(df, ["g"], "v", "side")
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.g: r.gap for r in out.collect()}
    at = [(k + 0.5) / 1000 for k in range(1000)]
    for g in (0, 1, None, 3):
        a, b = (np.quantile([v for h, s, v in rows if h == g and s == side], at) for side in (True, False))
        assert got[g] == pytest.approx(float(np.mean(np.abs(a - b))), abs=1e-9)
    assert len(got) == 6 and got[2] is None and got[4] is None


def test_points_of_a_place_ask_once(spark):
    from rangeflow.operators import joins as J

    points = spark.range(400).selectExpr("id as point", "cast(40 + id % 2 as double) as lat", "-90.0D as lng")
    cells = spark.range(50).selectExpr("if(id % 2 = 0, 'a', 'b') as taxon", "cast(40 + id / 1000 as double) as lat", "-90.0D as lng", "id as records")
    got = J.recorded_near(points, cells, 20)
    assert {r["point"]: r["records"] for r in got.where("taxon = 'a'").collect()} == {k: sum(range(0, 50, 2)) for k in range(0, 400, 2)}
    pairs = got._jdf.queryExecution().executedPlan()
    got.collect()
    rows = []

    def walk(node):
        found = node.metrics().get("numOutputRows")
        if "Join" in node.nodeName() and found.isDefined():
            rows.append(found.get().value())
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        for child in inner + [node.children().apply(k) for k in range(node.children().size())]:
            walk(child)

    walk(pairs)
    assert not rows or max(rows) <= 400 * 2


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unadaptive(spark):
    """Joins and shuffles as they are planned, without broadcasts by size."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_records_of_other_sources_spread_over_tasks(spark, unadaptive):
    df = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, "MO Observations").otherwise("iNaturalist").alias("source"), (F.col("id") % 500).cast("string").alias("observation_id"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    ask = spark.createDataFrame([(4, 50.0, 60.0), (5, 51.0, 61.0)], "number int, gps_lat double, gps_lng double").withColumns({c: F.lit(None).cast("double") for c in ("north", "south", "east", "west")})
    out = J.override_coordinates(df, ask)
    assert max(r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("latitude")).collect()) < 2000
    moved = out.where("latitude <> 1.0")
    assert {(r["id"] % 500, r["source"], r["latitude"], r["longitude"]) for r in moved.collect()} == {(4, "MO Observations", 50.0, 60.0)} and moved.count() == 8 and out.count() == 4000


def test_group_sums_shuffle_by_cell_not_by_species(spark, unadaptive):
    values = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "z", 4.0), (2, "c", 8.0), (3, "z", 1.0), (4, "a", None)], "cell int, species string, value double")
    groups = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("b", "y"), ("c", "other")], "species string, group string")
    out = A.group_sums(values, groups, ["x", "y"])
    assert "hashpartitioning(species" not in _plan(out) and _plan(out).count("Exchange hashpartitioning(cell") == 1
    assert {tuple(r) for r in out.select("cell", "x", "y", "total").collect()} == {(1, 3.0, 4.0, 7.0), (2, 0.0, 0.0, 8.0), (4, 0.0, 0.0, None)}


def test_truth_summary_reads_ranks_and_quantiles_off_one_order(spark):
    rng = np.random.default_rng(3)
    rows = [(t, None if k % 17 == 0 else float(rng.integers(0, 40)), float("nan") if k % 23 == 0 else float(rng.integers(0, 400))) for t in ("a", "b") for k in range(300)]
    out = A.truth_summary(spark.createDataFrame([*rows, ("c", None, 1.0)], "taxon string, predicted double, truth double"), ["taxon"])
    assert "percentile(" not in _plan(out)
    got = {r["taxon"]: (r["spearman"], r["top_share"]) for r in out.collect()}
    for t in ("a", "b"):
        own = pd.DataFrame([r[1:] for r in rows if r[0] == t], columns=["p", "t"])
        rank = pd.DataFrame({"p": own["p"].rank(), "t": own["t"].rank()})
        last = own["t"].fillna(np.inf)  # NaN is the largest
        cp, ct = own["p"].quantile(0.9), np.quantile(last, 0.9)
        assert got[t] == (pytest.approx(rank.corr().iloc[0, 1]), pytest.approx(((last >= ct) & (own["p"] >= cp)).sum() / (last >= ct).sum()))
    assert got["c"] == (None, 0.0)
