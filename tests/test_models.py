import json

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from rangeflow.plans import learners as L
from rangeflow.plans import model as M


@pytest.fixture(scope="module")
def rows():
    """Two taxa in five folds: ``a`` decides presence, ``b`` is noise, ``c`` nearly repeats ``a``."""
    rng = np.random.default_rng(3)
    parts = []
    for taxon in ("p", "q"):
        a = rng.normal(size=150)
        y = (a + rng.normal(scale=0.5, size=150) > 0.5).astype(int)
        place = {"x": rng.uniform(0, 2e6, 150), "y": rng.uniform(0, 2e6, 150)}
        parts.append(pd.DataFrame({"taxon": taxon, "site": np.arange(150), "fold": np.arange(150) % 5 + 1, "presence": y, "a": a, "b": rng.normal(size=150), "c": 2 * a + rng.normal(scale=0.1, size=150), "effort": rng.random(150), "records": 3, **place}))
    return pd.concat(parts, ignore_index=True)


def frame(spark, rows):
    return spark.createDataFrame(rows).withColumn("presence", F.col("presence").cast("int"))


def curved(n=2000, seed=0):
    """Detections peak at v1 = 1; v2 is noise."""
    rng = np.random.default_rng(seed)
    v1, v2 = rng.normal(size=n) * 1.2, rng.normal(size=n)
    y = (rng.random(n) < 0.12 * np.exp(-1.5 * (v1 - 1) ** 2)).astype(int)
    return pd.DataFrame({"presence": y, "site": range(n), "x": rng.random(n) * 3e6, "y": rng.random(n) * 3e6, "v1": v1, "v2": v2, "effort": np.log(1 + rng.poisson(3, n))})


def test_pruning_by_taxon(spark, rows):
    odd = rows.assign(a=np.where(rows["taxon"] == "q", 1.0, rows["a"]))
    kept = {r["taxon"]: r["kept"] for r in M.prune_by_taxon(frame(spark, odd), ["a", "b", "c"]).collect()}
    assert kept == {"p": ["a", "b"], "q": ["b", "c"]}


def test_pairs_weigh_by_held_out_folds(rows):
    p = rows[rows["taxon"] == "p"]
    noise = p.assign(n=np.random.default_rng(5).normal(size=len(p)))
    both = L.small_fit(noise, ["a", "b", "n"], 0.01, True)(noise)
    assert L.area(both, noise["presence"].to_numpy()) > 0.85
    # one fold holds every detection: no fold can be scored and the pairs weigh the same
    apart = p.assign(fold=np.where(p["presence"] == 1, 1, 2))
    got = L.small_fit(apart, ["a", "b", "c"], 0.01, True)(apart)
    alone = [L.small_fit(apart, list(c), 0.01, False)(apart) for c in (("a", "b"), ("a", "c"), ("b", "c"))]
    assert np.allclose(got, np.mean(alone, axis=0))


# ---- learners against plain versions --------------------------------------------------------


def plain_tree(x, up, weight, depth, ridge, child):
    """The tree's value for every row, by trying every split of every node on the values themselves."""
    out = np.full(len(x), up.sum() / (weight.sum() + ridge))
    gain_of = lambda k: up[k].sum() ** 2 / (weight[k].sum() + ridge)
    best = (1e-10, None)
    for j in range(x.shape[1]) if depth else ():
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, j] < cut
            if min(weight[left].sum(), weight[~left].sum()) >= child:
                gain = gain_of(left) + gain_of(~left) - gain_of(np.ones(len(x), bool))
                if gain > best[0] + 1e-9:
                    best = (gain, left)
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = plain_tree(x[side], up[side], weight[side], depth - 1, ridge, child)
    return out


@pytest.mark.parametrize("taxon", ["p", "q"])
def test_trees_equal_a_plain_one(rows, taxon):
    t = rows[rows["taxon"] == taxon]
    x, y = t[["a", "b"]].to_numpy(), t["presence"].to_numpy(float)
    bins = L.Bins(x, 256)
    for up, weight, ridge, child in ((y - 0.4, np.full(len(y), 0.24), 1.0, 2.0), (y, np.ones(len(y)), 0.0, 1.0)):
        got = L.grow(bins(x), bins.size, up, weight, depth=3, ridge=ridge, child=child)(bins(x))
        assert np.allclose(got, plain_tree(x, up, weight, 3, ridge, child))


def test_rounds_stop_where_a_full_curve_says(rows):
    t = curved()
    fold = np.arange(len(t)) % 3
    got = L.staged_rounds(t, ["v1", "v2"], fold, 2, 7, most=90, patience=12)
    x, y, curve = t[["v1", "v2"]].to_numpy(), t["presence"].to_numpy(float), np.zeros((3, 90))
    for f in range(3):
        out = fold == f
        bins = L.Bins(x[~out], L.BOOSTED_BINS)
        line = np.zeros(out.sum())
        for n, tree in zip(range(90), L._boost(bins(x[~out]), bins.size, y[~out], 2, 7), strict=False):
            line += tree(bins(x[out]))
            curve[f, n] = L.area(line, y[out])
    mean, best = curve.mean(axis=0), 0
    for n in range(90):
        if mean[n] > mean[best]:
            best = n
        elif n - best >= 12:
            break
    assert got == (best + 1, mean[best])


def test_boosted_trees(rows):
    t = curved()
    sweep = pd.DataFrame({"v1": np.arange(-3, 3, 0.05), "v2": 0.0})
    for learner, settings in ((L.BOOSTED, {"rounds": 200}), (L.FOREST, {}), (L.PRESENCE, {}), (L.PRESENCE, {"classes": "lqpht"}), (L.DETECTION, {})):
        score = learner.fit(t, ["v1", "v2"], settings, 1)(sweep.assign(effort=0.0))
        assert abs(sweep["v1"][score.argmax()] - 1) < 0.5 and score.max() > 2 * score[0]
    # one block: no inner fold can be held out, and the number of rounds is fixed
    one = t.assign(x=1.0, y=1.0)
    assert np.array_equal(L.boosted_fit(one, ["v1"], {})(t), L.boosted_fit(one, ["v1"], {"rounds": 200})(t))
    assert np.isnan(L.boosted_fit(t.assign(presence=(np.arange(len(t)) == 0).astype(int)), ["v1"], {})(t)).all()


def test_balanced_weights():
    y = np.r_[np.ones(20), np.zeros(1000)]
    w = L.balanced(y)
    assert w[y == 1].sum() == w[y == 0].sum() and (w[y == 0] == 1).all() and (L.balanced(np.zeros(2)) == 1).all()


def test_a_forest_draws_equal_classes(monkeypatch):
    t, seen = curved(), []
    grown = L.grow
    monkeypatch.setattr(L, "grow", lambda codes, size, up, weight, **how: seen.append((up.sum(), weight.sum())) or grown(codes, size, up, weight, **how))
    score = L.forest_fit(t, ["v1", "v2"], {"trees": 20}, 1)(t)
    n1 = t["presence"].sum()
    assert len(seen) == 20 and all(s == (n1, 2 * n1) for s in seen)
    assert 0 <= score.min() and score.max() <= 1 and L.area(score, t["presence"].to_numpy(float)) > 0.8


def plain_votes(x, y, drawn, node_over, mtry, rng):
    """The share of detections at every row's leaf, level by level, by trying every split on the values of the bands drawn for a node."""
    out, level = np.zeros(len(x)), [np.arange(len(x))]
    share = lambda k: (drawn * y)[k].sum() / drawn[k].sum()
    while level:
        allowed, below = np.argsort(rng.random((len(level), x.shape[1])), axis=1)[:, :mtry], []
        for k, bands in zip(level, allowed, strict=True):
            out[k], n, best = share(k), drawn[k].sum(), (1e-9, None)
            for j in sorted(bands) if n > node_over else ():
                values = np.unique(x[:, j])
                for cut in (values[1:] + values[:-1]) / 2:
                    sides = k[x[k, j] < cut], k[x[k, j] >= cut]
                    if all(map(len, sides)):
                        gain = sum(share(s) ** 2 * drawn[s].sum() for s in sides) - share(k) ** 2 * n
                        best = (gain, sides) if gain > best[0] + 1e-9 else best
            below += best[1] or ()
        level = below
    return out


@pytest.mark.parametrize("mtry", [1, 2, 3])
def test_trees_of_votes_equal_a_plain_one(rows, mtry):
    t = rows[rows["taxon"] == "p"]
    x, y = t[["a", "b", "c"]].to_numpy(), t["presence"].to_numpy(float)
    drawn = np.bincount(np.random.default_rng(2).integers(0, len(t), 200), minlength=len(t)).astype(float)
    k, bins = np.flatnonzero(drawn), L.Bins(x, 256)
    tree = L.grow_votes(bins(x)[k], bins.size, (drawn * y)[k], drawn[k], depth=64, node_over=10.0, mtry=mtry, rng=np.random.default_rng(4))
    got = tree(bins(x)[k])
    assert np.allclose(got, plain_votes(x[k], y[k], drawn[k], 10.0, mtry, np.random.default_rng(4)))
    assert len(np.unique(got)) > 3


def plain_l1(x, penalty, curve, start, steps=60000):
    """Accelerated proximal gradient steps until they no longer move."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.r_[0.0, penalty]
    beta = np.r_[start, np.zeros(x.shape[1] - 1)]
    rate, ahead, t = 1e-3, beta.copy(), 1.0
    for _ in range(steps):
        loss, slope, _ = curve(x @ ahead)
        while True:
            to = ahead + rate * (x.T @ slope)
            to = np.sign(to) * np.maximum(0, np.abs(to) - rate * penalty)
            d = to - ahead
            if curve(x @ to)[0] <= loss - (x.T @ slope) @ d + (d @ d) / (2 * rate) + 1e-12:
                break
            rate /= 2
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, moved, beta, t = to + (t - 1) / after * (to - beta), np.abs(to - beta).max(), to, after
        if moved < 1e-11:
            break
    return beta


@pytest.mark.parametrize("link", ["logit", "cloglog"])
def test_penalised_fits_equal_plain_ones(link):
    t = curved(500)
    y, z = t["presence"].to_numpy(float), t[["v1", "v2"]].to_numpy()
    z = np.column_stack([z, z**2])
    z = (z - z.min(axis=0)) / (z.max(axis=0) - z.min(axis=0))
    curve = L.logistic_curve(y, y + 100) if link == "logit" else L.cloglog_curve(y, t["effort"].to_numpy())
    penalty = y.sum() * np.array([0.05, 0.2, 0.01, 0.05])
    got, want = L.l1_fit(z, penalty, curve, -4.0), plain_l1(z, penalty, curve, -4.0)
    assert np.abs(got - want).max() < 1e-4 * max(1, np.abs(want).max()) and (got == 0).any()


def test_penalties_by_hand():
    t = curved()
    found = t["presence"].to_numpy() == 1
    n = found.sum()
    features = L.Features(t[["v1"]].to_numpy(), "lqht")
    z = features(t[["v1"]].to_numpy())
    got = features.penalties(z, found)
    size = np.interp(n, (0, 10, 17, 30, 100), (1.3, 0.8, 0.5, 0.25, 0.05)) / np.sqrt(n)
    assert np.isclose(got[0], max(0.001, z[found, 0].std(ddof=1) * size)) and z.shape[1] == 2 + 98 + 50
    hinge = z[found, 10].std(ddof=1)
    assert np.isclose(got[10], max(0.001, 0.5 / np.sqrt(n) * max(hinge, 1 / np.sqrt(n)), hinge * 0.5 / np.sqrt(n)))
    empty = np.flatnonzero((features.kinds == "threshold") & (z[found].sum(axis=0) == n))
    assert len(empty) and (got[empty] >= 1).all()
    assert L.feature_classes(29) == "lq" and L.feature_classes(30) == "lqh"


# ---- all groups in one job -----------------------------------------------------------------


def test_learners_in_cross_validation_equal_a_loop(spark, rows):
    t = frame(spark, rows)
    for learner in (L.DETECTION, L.FOREST, L.BOOSTED):
        got = {(r["taxon"], r["site"]): r["score"] for r in M.cross_validated_scores(t, ["a", "b"], ["taxon"], learner=learner, null=True).collect()}
        assert len(got) == 300
        q = rows[rows["taxon"] == "q"]
        test, train = q[q["fold"] == 2], q[q["fold"] != 2]
        level = q.loc[q["presence"] == 1, "effort"].median()
        want = learner.fit(train, ["a", "b"], learner.at_null(int(train["presence"].sum()), 2), 1)(test.assign(effort=level))
        assert all(np.isclose(got["q", s], w) for s, w in zip(test["site"], want, strict=True))


def test_a_learner_without_detections_scores_null(spark, rows):
    t = frame(spark, rows).where("taxon = 'p'").withColumn("presence", F.lit(0))
    got = M.cross_validated_scores(t, ["a"], ["taxon"], learner=L.PRESENCE)
    assert got.count() == 150 and got.where("score is not null and not isnan(score)").count() == 0


def test_nested_validation_equals_a_loop(spark, rows):
    p = rows[rows["taxon"] == "p"]
    got = {r["fold"]: r for r in M.nested_cross_validate(frame(spark, p), ["a", "b", "c"], ["taxon"], L.RIDGE_MODEL, 300).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for f in (1, 4):
        train, test = p[p["fold"] != f], p[p["fold"] == f]
        folds = M.spatial_folds(frame(spark, train.drop(columns="fold")), 3, 300, 1 + f).toPandas().sort_values("site")
        tried = []
        for s in L.RIDGE_MODEL.grid(0, 0):
            areas = []
            for k in sorted(folds["fold"].unique()):
                out = folds[folds["fold"] == k]
                areas.append(L.area(L.RIDGE_MODEL.fit(folds[folds["fold"] != k], ["a", "b", "c"], s, 1)(out), out["presence"].to_numpy(float)))
            tried.append(np.nanmean(areas))
        best = L.RIDGE_MODEL.grid(0, 0)[int(np.argmax(tried))]
        want = L.area(L.RIDGE_MODEL.fit(train, ["a", "b", "c"], best, 1)(test), test["presence"].to_numpy(float))
        assert got[f]["params"] == L.label_of(best) and np.isclose(got[f]["auc"], want)


def test_settings_of_boosted_trees_hold_depth_and_rounds(spark, rows):
    got = M.tuned_settings(frame(spark, rows), ["a", "b"], ["taxon"], L.BOOSTED).collect()
    p = rows[rows["taxon"] == "p"]
    tried = [L.boosted_search(p, ["a", "b"], p["fold"].to_numpy(), {"depth": d}, 1) for d in (2, 3, 5)]
    best = max(tried, key=lambda t: t[0])[1]
    assert {r["taxon"] for r in got} == {"p", "q"}
    assert json.loads(next(r["settings"] for r in got if r["taxon"] == "p")) == best and best["rounds"] >= 1


def test_importance_of_a_learner(spark, rows):
    falls = M.permutation_importance(frame(spark, rows).where("taxon = 'p'"), ["a", "b"], ["taxon"], 2, groups={"both": ["a", "b"]}, learner=L.PRESENCE)
    fall = {r["name"]: r["fall"] for r in falls.collect()}
    assert set(fall) == {"predictor:a", "predictor:b", "layer:both"}
    assert fall["predictor:a"] > 0.2 > abs(fall["predictor:b"]) and fall["layer:both"] > 0.2


def test_learners_are_arms_and_candidates(spark, rows):
    t = frame(spark, rows)
    arms = M.run_arms(t, {"ridge": {"bands": ["a"]}, "presence": {"bands": ["a"], "learner": L.PRESENCE}, "noise": {"bands": ["b"]}})
    assert arms.count() == 6
    best = M.tune(t, ["a"], ["taxon"], learners={"presence": L.PRESENCE, "forest": L.FOREST}).collect()
    assert {r["taxon"] for r in best} == {"p", "q"} and all(r["auc"] > 0.8 for r in best)


def test_maps_equal_the_model(spark, rows):
    t = frame(spark, rows)
    taxa = spark.createDataFrame([("p", ["a", "c"], 0.1), ("q", ["b"], None)], "taxon string, kept array<string>, ridge double")
    models = M.final_models(t, taxa, ["a", "b", "c"])
    cells = t.select("taxon", F.col("site").alias("cell"), (F.col("a") * 3).alias("a"), "b", F.when(F.col("site") != 7, F.col("c")).alias("c"))
    got = {(r["taxon"], r["cell"]): r["score"] for r in M.map_scores(models, cells, ["a", "b", "c"]).collect()}
    p, q = rows[rows["taxon"] == "p"], rows[rows["taxon"] == "q"]
    want_p, want_q = L.small_fit(p, ["a", "c"], 0.1, False)(p.assign(a=p["a"] * 3)), L.small_fit(q, ["b"], 0.01, False)(q)
    assert got["p", 7] is None
    assert all(np.isclose(got["p", k], v) for k, v in enumerate(want_p) if k != 7) and all(np.isclose(got["q", k], v) for k, v in enumerate(want_q))


def test_maps_of_any_learner(spark, rows):
    t = frame(spark, rows)
    cells = t.select("taxon", F.col("site").alias("cell"), "a", F.when(F.col("site") != 7, F.col("b")).alias("b"))
    got = {(r["taxon"], r["cell"]): r["score"] for r in M.learner_map(M.learner_models(t, ["a", "b"], L.FOREST), cells, ["a", "b"], part_cells=40).collect()}
    p = rows[rows["taxon"] == "p"]
    want = L.FOREST.fit(p, ["a", "b"], L.FOREST.default(0, 2), 1)(p)
    assert len(got) == 300 and got["p", 7] is None and all(np.isclose(got["p", k], v) for k, v in enumerate(want) if k != 7)


# ---- nulls --------------------------------------------------------------------------------


def test_nulls_that_fail_are_drawn_again(spark, rows, monkeypatch):
    asked = []

    def drawn(training, draws, design, seed, first=1):
        asked.append((first, draws))
        out = training.withColumn("draw", F.explode(F.sequence(F.lit(first), F.lit(first + draws - 1))))
        return out.withColumn("presence", F.when(F.col("draw") > 2, F.col("presence")).otherwise(0))  # the first two have no detection

    monkeypatch.setattr(M, "null_tables", drawn)
    got = M.null_test(frame(spark, rows).where("taxon = 'p'"), ["a"], draws=4, batch=4).collect()[0]
    assert asked == [(1, 4), (5, 4)] and got["reps"] == 4 and got["drawn"] == 6


def test_nulls_stop_where_a_full_run_says(spark, rows):
    # p has skill; q has none, so that its nulls beat it soon
    q = rows["taxon"] == "q"
    t = frame(spark, rows.assign(presence=np.where(q, np.random.default_rng(2).permutation(rows["presence"]), rows["presence"])))
    sizes, told = [], M.null_tables

    def counted(training, draws, design, seed, first=1):
        sizes.append((first, draws, {r["taxon"] for r in training.select("taxon").distinct().collect()}))
        return told(training, draws, design, seed, first)

    M.null_tables = counted
    try:
        few = {r["taxon"]: r.asDict() for r in M.null_test(t, ["a", "b"], draws=24, stop_after=3, batch=5).collect()}
        one = {r["taxon"]: r.asDict() for r in M.null_test(t, ["a", "b"], draws=24, stop_after=3, batch=24).collect()}
    finally:
        M.null_tables = told
    for taxon in "pq":
        assert few[taxon].keys() == one[taxon].keys()
        assert all(few[taxon][k] == pytest.approx(one[taxon][k], abs=1e-9) if isinstance(few[taxon][k], float) else few[taxon][k] == one[taxon][k] for k in few[taxon])
    every = M.cross_validate(told(t, 24, "scatter", 1), ["a", "b"], ["taxon", "draw"]).toPandas().sort_values("draw")
    own = every[every["taxon"] == "q"]["auc"].to_numpy()
    hits = np.cumsum(own >= few["q"]["observed"])
    stop = int(np.argmax(hits >= 3)) + 1
    assert few["q"]["stopped_early"] and few["q"]["reps"] == stop and few["q"]["p"] == pytest.approx(3 / stop) and few["q"]["auc_mean"] == pytest.approx(own[:stop].mean())
    assert few["p"]["reps"] == 24 and not few["p"]["stopped_early"]
    assert "q" not in sizes[-2][2]  # a decided taxon gets no further draws


def test_settings_are_tried_fold_by_fold(spark, rows):
    # a task fits one fold of one candidate; the mean over folds chooses
    tried = lambda t, b, s, seed: (lambda at: at["a"].to_numpy() * s["sign"] if t["fold"].nunique() == at_folds - 1 else np.full(len(at), np.nan))
    at_folds = rows["fold"].nunique()
    one = M.Learner("one", tried, lambda n, p: [{"sign": -1.0}, {"sign": 1.0}], lambda n, p: {"sign": 1.0})
    got = {r["taxon"]: r for r in M.tuned_settings(frame(spark, rows), ["a", "b"], ["taxon"], one).collect()}
    for taxon, own in rows.groupby("taxon"):
        fits = [M.area(f["a"].to_numpy(), f["presence"].to_numpy(float)) for _, f in own.groupby("fold")]
        up = float(np.mean(fits))
        assert got[taxon]["auc"] == pytest.approx(max(up, 1 - up)) and json.loads(got[taxon]["settings"])["sign"] == (1.0 if up > 0.5 else -1.0)
    jobs = M.tuned_settings(frame(spark, rows), ["a", "b"], ["taxon"], one)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [taxon" in jobs and "_held" in jobs.split("FlatMapGroupsInPandas")[1].split("\n")[0]


def test_settings_are_fitted_in_tasks_of_their_own(spark, rows):
    # small groups do not end in one task, where their models would be fitted one after another
    def where(detections, bands):
        return [{"task": TaskContext.get().partitionId() if TaskContext.get() else -1}]

    some = pd.concat([rows.assign(taxon=rows["taxon"] + str(k)) for k in range(4)])
    one = M.Learner("one", lambda t, b, s, seed: lambda at: at["a"].to_numpy(), where, lambda n, p: {})
    got = M.tuned_settings(frame(spark, some), ["a", "b"], ["taxon"], one).collect()
    assert len(got) == 8 and len({r["settings"] for r in got}) >= 6


@pytest.mark.parametrize("design", ["scatter", "shift"])
def test_nulls_are_scored_in_their_tasks(spark, rows, design):
    # the same areas and indices as the table of held-out scores gives, and no more draws than are needed
    t = frame(spark, rows)
    tables = M.cut(M.null_tables(t, 3, design, 1))
    held = M.cut(M.cross_validated_scores(tables, ["a", "b"], ["taxon", "draw"], null=True))
    enough = held.groupBy("taxon", "draw", "fold").agg(F.count_if(F.col("presence") == 1).alias("n")).where("n >= 2").drop("n")
    areas = M.auc(held.join(enough, ["taxon", "draw", "fold"]), ["taxon", "draw", "fold"], few=True).groupBy("taxon", "draw").agg(F.avg("auc").alias("auc"))
    want = {(r["taxon"], r["draw"]): (r["auc"], r["boyce"]) for r in areas.join(M.pooled_boyce(held, ["taxon", "draw"]), ["taxon", "draw"], "left").collect()}
    got = {(r["taxon"], r["draw"]): (r["null_score"], r["null_boyce"]) for r in M._null_scores(tables, ["a", "b"]).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for k in got:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


# ---- studies and applicability ------------------------------------------------------------


def test_block_sizes_by_hand(spark, rows):
    t = frame(spark, rows)
    area = t.select("taxon", F.col("site").alias("cell"), "x", "y")
    got = {(r["taxon"], r["block_km"]): r for r in M.block_study(t, area, ["a"], (300, 700)).collect()}
    assert set(got) == {(t, s) for t in "pq" for s in (300.0, 700.0)}
    p = rows[(rows["taxon"] == "p")]
    for size in (300.0, 700.0):
        found = p[p["presence"] == 1]
        blocks = len({(int(x // (size * 1000)), int(y // (size * 1000))) for x, y in zip(found["x"], found["y"], strict=True)})
        r = got["p", size]
        assert r["blocks"] == blocks and r["scorable"] == (blocks >= 5) and r["auc"] > 0.8
        folds = M.spatial_folds(t.drop("fold"), 5, size).where("taxon = 'p'").toPandas()
        xy, fold = folds[["x", "y"]].to_numpy() / 1000, folds["fold"].to_numpy()
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
        held = np.array([d[k, fold != fold[k]].min() for k in range(len(d))])
        at = (np.arange(1000) + 0.5) / 1000
        assert abs(r["gap_all"] - np.abs(np.quantile(held, at)).mean()) < 1e-6  # the area's cells are the sites themselves


def test_arms_by_ratio_and_layer(spark, rows):
    t = frame(spark, rows).withColumnsRenamed({"a": "clim_a", "b": "soil_b"})
    arms = M.run_arms(t, {"few": {"bands": ["clim_a", "soil_b", "c"], "per_presence": 4}, "soil": {"bands": ["clim_a", "soil_b"], "layers": ["soil"]}, "clim": {"bands": ["clim_a"]}})
    score = {(r["taxon"], r["arm"]): r["auc"] for r in arms.collect()}
    want = {r["taxon"]: r["auc"] for r in M.cross_validate(t, ["soil_b"], ["taxon"]).collect()}
    assert all(np.isclose(score[k, "soil"], want[k]) for k in "pq") and score["p", "few"] > 0.8 > score["p", "soil"]


def test_applicability_by_hand(spark, rows):
    t = frame(spark, rows)
    cells = spark.createDataFrame([("p", 1, 0.0, 0.0), ("p", 2, 9.0, -9.0), ("p", 3, None, 0.0), ("q", 1, 0.1, 0.1)], "taxon string, cell long, a double, b double")
    falls = spark.createDataFrame([("p", "predictor:a", 0.4), ("p", "predictor:b", -0.1), ("q", "predictor:a", -1.0), ("q", "predictor:b", 0.0)], "taxon string, name string, fall double")
    got = {(r["taxon"], r["cell"]): r for r in M.applicability(t, cells, ["a", "b"], M.applicability_weights(falls, ["a", "b"])).collect()}
    for taxon, weight in (("p", np.array([0.4, 0.0])), ("q", np.ones(2))):
        own = rows[rows["taxon"] == taxon]
        x = own[["a", "b"]].to_numpy()
        mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
        z = (x - mean) * weight / sd
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
        scale = d[np.triu_indices(len(d), 1)].mean()
        fold = own["fold"].to_numpy()
        cv = np.sort([d[k, fold != fold[k]].min() / scale for k in range(len(d))])
        half = (len(cv) + 1) // 2
        q1, q3 = np.median(cv[:half]), np.median(cv[-half:])
        threshold = cv[cv <= q3 + 1.5 * (q3 - q1)].max()
        for cell, at in ((1, (0.0, 0.0) if taxon == "p" else (0.1, 0.1)), (2, (9.0, -9.0))):
            if (taxon, cell) in got:
                index = np.sqrt((((np.array(at) - mean) * weight / sd - z) ** 2).sum(axis=1)).min() / scale
                r = got[taxon, cell]
                assert np.isclose(r["index"], index) and np.isclose(r["threshold"], threshold) and r["inside"] == (index <= threshold)
    assert got["p", 3]["index"] is None


def test_applicability_means_all_pairs(spark):
    rng, n = np.random.default_rng(6), 2300
    t = pd.DataFrame({"taxon": "p", "site": np.arange(n), "fold": np.arange(n) % 5 + 1, "a": rng.lognormal(size=n), "b": rng.normal(size=n)})
    x = t[["a", "b"]].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    scale = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)).sum() / (n * (n - 1))
    cells = spark.createDataFrame([("p", 1, 30.0, 0.0), ("p", 2, 1.0, 4.0)], "taxon string, cell long, a double, b double")
    got = M.applicability(spark.createDataFrame(t), cells, ["a", "b"]).collect()
    for r in got:
        at = (np.array([r["a"], r["b"]]) - x.mean(axis=0)) / x.std(axis=0, ddof=1)
        assert r["index"] == pytest.approx(np.sqrt(((at - z) ** 2).sum(axis=1)).min() / scale, rel=1e-11)
    assert len(got) == 2


def test_pairs_meet_part_by_part(spark):
    rng, n = np.random.default_rng(6), 700
    t = pd.DataFrame({"taxon": "p", "site": np.arange(n), "_parts": 5, "a": rng.lognormal(size=n), "b": rng.normal(size=n)})
    gone = t.head(3).assign(site=[n, n + 1, n + 2], a=np.nan)  # rows without a band are in no pair
    alike = t.head(1).assign(taxon="alike", _parts=2)
    rows = pd.concat([t, gone, alike, alike.assign(site=1), alike.assign(taxon="alone")])
    got = {r["taxon"]: r["mean"] for r in M._pair_means(spark.createDataFrame(rows), ["a", "b"]).collect()}
    z = t[["a", "b"]].to_numpy()
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    assert got == {"p": pytest.approx(d[np.triu_indices(n, 1)].mean(), rel=1e-12), "alike": 1.0, "alone": 1.0}


def test_kernels_store_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    place, asked, stored = rng.uniform(0, 4e5, (300, 2)), rng.uniform(-1e5, 5e5, (200, 2)), []
    monkeypatch.setattr(M, "cut", lambda df, f=M.cut: stored.append((out := f(df)).count()) or out)
    monkeypatch.setattr(M, "KERNEL_ROWS", 40, raising=False)
    monkeypatch.setattr(M, "KERNEL_CELLS", 1000, raising=False)
    q = spark.createDataFrame([("t", k, float(x), float(y)) for k, (x, y) in enumerate(asked)], "taxon string, site long, x double, y double")
    got = M.kernel_scores(q, spark.createDataFrame([("t", float(x), float(y)) for x, y in place], "taxon string, x double, y double"), 20.0, ["taxon"])
    for r in got.collect():
        e = -((place - [r["x"], r["y"]]) ** 2).sum(axis=1) / (2 * 20_000.0**2)
        assert abs(r["score"] - (e.max() + np.log(np.exp(e - e.max()).sum()))) < 1e-6
    assert max(stored) < 20 * len(asked)
