"""Sorts, limits, top-k and sampling (TOP1 to TOP7).  Random choices are orders by a hash of the seed and the row's key."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeflow.functions.scalars import count_band
from rangeflow.functions.text import search_key

SEARCH_TIERS = ("exact", "prefix", "words", "contains", "similar")
SNAP_KM, FAR_SHARE, SHIFT_TRIES = 25, 0.2, 200
#: Free sites an effort-weighted point chooses among, and parts that a taxon's shifted draws are dealt to.
SNAP_CHOICES, SHIFT_PARTS = 5, 8
#: Detections (times parts of draws) of a bundle of taxa that share their sites.
BUNDLE_ROWS = 50_000
#: Sites up to which a try's points meet them all at once.
FEW_SITES = 2_000
#: Clusters whose sums a bootstrap sends to every task.
BROADCAST_CLUSTERS = 100_000


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) from the hash of the parts, the same in every run."""
    digits = F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**12)


def hash_order(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def _near(word: Column, query: str) -> Column:
    """Whether a word, or its start, is within the allowed edits of a query word."""
    n = len(query)
    if n < 4:
        return F.lit(False)
    allowed = 2 if n >= 7 else 1
    q = F.lit(query)
    whole = F.levenshtein(word, q, allowed) >= 0
    start = F.levenshtein(F.substring(word, 1, n), q, allowed) >= 0
    return (F.length(word) >= n - allowed) & (whole | start)


def search(taxa: DataFrame, query: str, mapped: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """TOP1: taxa by tier (exact, prefix, words, contains, similar), then genus hit, extra words, has a map, localities, name.

    taxa: scientific_name, records, localities; mapped: taxon.  One narrow pass and a top-k; near misses count only when the
    closer tiers leave room.
    """
    key = F.col("_key")
    rows = taxa.withColumn("_key", search_key("scientific_name")).withColumn("_words", F.split("_key", " "))
    q = taxa.sparkSession.range(1).select(search_key(F.lit(query)).alias("q")).first()["q"]
    if not q:
        return taxa.limit(0).withColumn("match", F.lit(None).cast("string"))
    words = q.split(" ")

    def has(test, w: str) -> Column:
        return F.exists("_words", lambda x: test(x, w))

    def all_words(test) -> Column:
        out = F.lit(True)
        for w in words:
            out = out & has(test, w)
        return out

    tier = (
        F.when(key == q, 1).when(key.startswith(q), 2).when(all_words(lambda x, w: x.startswith(w)), 3).when(key.contains(q), 4)
        .when(all_words(lambda x, w: x.startswith(w) | _near(x, w)), 5)
    )
    hits = rows.withColumn("_tier", tier).where("_tier is not null")
    if hits.where("_tier < 5").limit(limit).count() >= limit:
        hits = hits.where("_tier < 5")
    first = F.col("_words")[0]
    genus = first.startswith(words[0]) | _near(first, words[0])
    if mapped is None:
        hits = hits.withColumn("_mapped", F.lit(False))
    else:
        m = mapped.select(F.col("taxon").alias("scientific_name")).distinct().withColumn("_m", F.lit(True))
        hits = hits.join(m, "scientific_name", "left").withColumn("_mapped", F.coalesce("_m", F.lit(False))).drop("_m")
    order = [F.asc("_tier"), genus.desc(), (F.size("_words") - len(words)).asc(), F.desc("_mapped"), F.desc("localities"), F.asc("scientific_name")]
    names = F.array(*[F.lit(t) for t in SEARCH_TIERS])
    return hits.orderBy(*order).limit(limit).select("scientific_name", "records", "localities", F.element_at(names, F.col("_tier")).alias("match"))


def search_genera(taxa: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """TOP1: genera a one-word query could mean: by prefix, else by a near miss; most records first."""
    genus = F.regexp_replace(F.trim("scientific_name"), " .*$", "")
    g = taxa.withColumn("genus", genus).withColumn("_key", search_key("genus"))
    n = g.groupBy("_key").agg(F.min("genus").alias("genus"), F.count("*").alias("taxa"), F.sum("records").cast("long").alias("records"))
    q = query.lower()
    hit = n.where(F.col("_key").startswith(q))
    if hit.isEmpty():
        hit = n.where(_near(F.col("_key"), q))
    return hit.orderBy(F.desc("records"), "genus").limit(limit).drop("_key")


def top_per_point(scored: DataFrame, k: int, by: list[str], order: list[Column]) -> DataFrame:
    """TOP2: the k best rows of each point."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def stratified_sample(candidates: DataFrame, per_stratum: int, seed: int, stratum: Column, key: str = "taxon") -> DataFrame:
    """TOP3: up to n rows per stratum, all if fewer; ``weight`` is what each drawn row stands for."""
    rows = candidates.withColumn("stratum", stratum).withColumn("_o", hash_order(F.lit(seed), F.col(key)))
    w = Window.partitionBy("stratum").orderBy("_o", key)
    n = rows.groupBy("stratum").agg(F.count("*").alias("_n"))
    drawn = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_stratum).join(n, "stratum")
    return drawn.withColumn("weight", F.col("_n") / F.least(F.col("_n"), F.lit(per_stratum))).drop("_o", "_k", "_n")


def sweep_sample(candidates: DataFrame, per_band: int, seed: int = 1, count: str = "cells", key: str = "taxon") -> DataFrame:
    """TOP3: up to n taxa of each band of site counts."""
    return stratified_sample(candidates, per_band, seed, count_band(count), key)


def weighted_sample(rows: DataFrame, n: int, seed: int, by: list[str], key: str, weight: str) -> DataFrame:
    """TOP4: n rows of each group without replacement, in proportion to their weight (exponential keys)."""
    e = -F.log(unit_hash(F.lit(seed), *[F.col(b) for b in by], F.col(key))) / F.col(weight)
    w = Window.partitionBy(*by).orderBy("_e", key)
    return rows.where(F.col(weight) > 0).withColumn("_e", e).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_e", "_k")


def background_sample(pool: DataFrame, n: int, seed: int = 1, by: tuple[str, ...] = ("taxon",), key: str = "cell") -> DataFrame:
    """TOP5: at most n rows of each group, the same for a seed."""
    w = Window.partitionBy(*by).orderBy("_o", key)
    return pool.withColumn("_o", hash_order(F.lit(seed), F.col(key))).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_o", "_k")


def _unit(*parts) -> float:
    """``unit_hash`` of one row's parts."""
    return (int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) + 0.5) / float(16**12)


class _Near:
    """Sites by squares as wide as the snapping distance: those that can lie within it of a place, in the sites' order."""

    def __init__(self, sx: np.ndarray, sy: np.ndarray, snap_km: float):
        self.size = snap_km * 1000.0 * (1 + 1e-9)
        i, j = np.floor(sx / self.size), np.floor(sy / self.size)
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])][: len(i)])
        self.at = dict(zip(zip(i[first].tolist(), j[first].tolist(), strict=True), np.split(order, first[1:]), strict=True)) if len(i) else {}

    def __call__(self, x: float, y: float) -> np.ndarray:
        i, j = float(np.floor(x / self.size)), float(np.floor(y / self.size))
        met = [self.at[k] for a in (-1, 0, 1) for b in (-1, 0, 1) if (k := (i + a, j + b)) in self.at]
        return np.sort(np.concatenate(met)) if met else np.empty(0, dtype=np.int64)


def _take_turns(name: tuple, ids: list, px: np.ndarray, py: np.ndarray, sx: np.ndarray, sy: np.ndarray, sites: list, weight: np.ndarray | None, snap_km: float, near_of: _Near | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(site, squared distance) of every point, -1 where none is free: points in the order of a hash, each to its nearest free site.

    With weights a point chooses among its SNAP_CHOICES nearest free sites within ``snap_km``, in proportion to them (exponential keys by hash).
    The squares around a point are looked up first; only a point without a free site within ``snap_km`` meets all sites.
    """
    near_of = near_of or _Near(sx, sy, snap_km)
    chosen, apart, free = np.full(len(ids), -1), np.full(len(ids), np.inf), np.ones(len(sites), dtype=bool)
    snap2 = (snap_km * 1000.0) ** 2
    for i in sorted(range(len(ids)), key=lambda k: _unit(*name, ids[k], "order")):
        if not free.any():
            break
        near = near_of(px[i], py[i])
        near = near[free[near]]
        d2 = (sx[near] - px[i]) ** 2 + (sy[near] - py[i]) ** 2
        if not len(near) or d2.min() > snap2:
            d2 = np.where(free, (sx - px[i]) ** 2 + (sy - py[i]) ** 2, np.inf)
            near = np.arange(len(d2))
        k = int(d2.argmin())
        if weight is not None and d2[k] <= snap2:
            best = np.argsort(d2, kind="stable")[:SNAP_CHOICES]
            k = int(min(best[d2[best] <= snap2], key=lambda k: -math.log(_unit(*name, ids[i], sites[near[k]])) / weight[near[k]]))
        chosen[i], apart[i], free[near[k]] = near[k], d2[k], False
    return chosen, apart


def snap_to_sites(points: DataFrame, sites: DataFrame, key: list[str], by: list[str] | None = None, snap_km: float = SNAP_KM, effort: bool = False) -> DataFrame:
    """TOP6: points (key..., from_site, x, y) to distinct sites (by..., site, x, y, weight) of their group: key..., from_site, site, d2, far.

    The points of a group take turns in the order of a hash of their key, each to its nearest free site (``far`` where that is beyond
    ``snap_km``); with ``effort`` a point chooses among its nearest free sites within ``snap_km`` in proportion to their weight.  Points without a
    place, and points that find no free site, are left out.  A group's points and sites (a taxon's) meet in one task.
    """
    by = by or []
    asked = points.select(*key, "from_site", "x", "y").dropna()
    # a group's own copy of the sites, under other names for its key
    groups = asked.select(*[F.col(k).alias(f"_of_{k}") for k in key]).distinct()
    at = sites.select(*[F.col(b).alias(f"_at_{b}") for b in by], "site", "x", "y", *(["weight"] if effort else []))
    same = [F.col(f"_of_{b}") == F.col(f"_at_{b}") for b in by]
    beside = groups.join(at, same) if by else groups.join(at, how="cross")
    kinds = dict(asked.dtypes)
    site_kind = dict(sites.dtypes)["site"]

    def run(of: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        of, at = of.sort_values("from_site", kind="stable"), at.sort_values("site", kind="stable")
        ids, names = of["from_site"].tolist(), at["site"].tolist()
        place = [f[c].to_numpy(float) for f in (of, at) for c in "xy"]
        j, d2 = _take_turns(tuple(of[k].iloc[0] for k in key) if len(of) else (), ids, *place, names, at["weight"].to_numpy(float) if effort else None, snap_km)
        out = of.assign(site=[names[k] if k >= 0 else None for k in j], d2=d2)[j >= 0]
        return out[[*key, "from_site", "site", "d2"]]

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*key, "from_site"]], f"site {site_kind}", "d2 double"])
    met = asked.groupBy(*key).cogroup(beside.groupBy(*[f"_of_{k}" for k in key])).applyInPandas(run, schema)
    return met.withColumn("far", F.col("d2") > (snap_km * 1000.0) ** 2)


def shifted_null(
    detections: DataFrame,
    sites: DataFrame,
    draws: int,
    seed: int = 1,
    tries: int = SHIFT_TRIES,
    snap_km: float = SNAP_KM,
    far_share: float = FAR_SHARE,
    effort: bool = False,
    first_draw: int = 1,
) -> DataFrame:
    """TOP6: each taxon's detections rotated and moved to a random site, each snapped to a free site: (taxon, draw, site, try, far, best_effort).

    detections: taxon, site, x, y; sites: site, x, y, with ``taxon`` where each taxon has its own, and with ``records`` where
    busier sites are moved to more often.  A try is accepted when at most ``far_share`` of its points find no free site within
    ``snap_km``; after the last try the one with the fewest points far from any site stands (``best_effort``).  Points that are far take the nearest
    free site wherever it is (``far`` is true), so a null has as many detections as its taxon, unless that has more than there are sites.
    ``effort``: points choose among near sites in proportion to records.  Draws are numbered from ``first_draw`` and depend on their number alone.

    One job: a task has some draws (one of ``SHIFT_PARTS`` parts) of a taxon, its detections and its sites.  Sites that all taxa share go to bundles of
    such parts, a few for each core or one for ``BUNDLE_ROWS`` detections, not to every taxon.  Points take turns as in ``snap_to_sites``.
    """
    own = "taxon" in sites.columns
    records = F.greatest(F.coalesce(F.col("records").cast("long"), F.lit(1)), F.lit(1)) if "records" in sites.columns else F.lit(1).cast("long")
    pool = sites.select(*(["taxon"] if own else []), "site", "x", "y", records.alias("weight")).dropna()
    found = detections.select("taxon", F.col("site").alias("from_site"), "x", "y").dropna()
    parts = min(draws, SHIFT_PARTS)
    # both sides may come from one table; new columns keep them apart
    spread = lambda df, name, n: df.select(*[F.col(c).alias(c) for c in df.columns], F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
    if own:
        left, right = spread(found, "part", parts).groupBy("taxon", "part"), spread(pool.withColumnRenamed("taxon", "_of"), "_part", parts).groupBy("_of", "_part")
    else:
        from rangeflow.operators.lineage import cut

        found = cut(found)
        bundles = max(4 * found.sparkSession.sparkContext.defaultParallelism, -(-found.count() * parts // BUNDLE_ROWS))
        dealt = spread(found, "part", parts).withColumn("_bundle", F.pmod(F.xxhash64("taxon", "part"), F.lit(bundles)).cast("int"))
        left, right = dealt.groupBy("_bundle"), spread(pool, "_to", bundles).groupBy("_to")
    kinds = dict(sites.dtypes) | {"taxon": dict(detections.dtypes)["taxon"]}
    snap2 = (snap_km * 1000.0) ** 2

    def turns(taxon, part: int, of: pd.DataFrame, names: list, sx: np.ndarray, sy: np.ndarray, weight: np.ndarray, up: np.ndarray, near_of: _Near) -> list[tuple]:
        rows, ids, (x, y) = [], of["from_site"].tolist(), (of[c].to_numpy(float) for c in "xy")
        allowed = math.floor(far_share * len(ids))

        def moved(draw: int, n: int) -> tuple[np.ndarray, np.ndarray]:
            angle = 2 * math.pi * _unit(seed, taxon, draw, n, "a")
            to = min(int(np.searchsorted(up, _unit(seed, taxon, draw, n, "s") * up[-1], side="right")), len(up) - 1)
            dx, dy = x - x.mean(), y - y.mean()
            return sx[to] + math.cos(angle) * dx - math.sin(angle) * dy, sy[to] + math.sin(angle) * dx + math.cos(angle) * dy

        def far_of(px: np.ndarray, py: np.ndarray, most: int) -> int:  # beyond ``most`` the count does not matter
            far = 0
            if len(sx) <= FEW_SITES:
                return sum(int((((sx - px[k : k + 64, None]) ** 2 + (sy - py[k : k + 64, None]) ** 2).min(axis=1) > snap2).sum()) for k in range(0, len(px), 64))
            for u, v in zip(px.tolist(), py.tolist(), strict=True):
                near = near_of(u, v)
                far += not ((sx[near] - u) ** 2 + (sy[near] - v) ** 2 <= snap2).any()
                if far > most:
                    break
            return far

        for draw in range(first_draw + part, first_draw + draws, parts):
            best, taken = None, None
            for n in range(1, tries + 1):
                px, py = moved(draw, n)
                far = far_of(px, py, max(allowed, best[0] if best else len(ids)))  # far from every site is far from every free one
                best = min(best or (far, n), (far, n))
                if far <= allowed:
                    j, d2 = _take_turns((taxon, draw, n), ids, px, py, sx, sy, names, weight if effort else None, snap_km, near_of)
                    if (d2 > snap2).sum() <= allowed:
                        taken = (n, j, d2, False)
                        break
            if taken is None:
                taken = (best[1], *_take_turns((taxon, draw, best[1]), ids, *moved(draw, best[1]), sx, sy, names, weight if effort else None, snap_km, near_of), True)
            n, j, d2, forced = taken
            rows += [(taxon, draw, names[k], n, bool(d > snap2), forced) for k, d in zip(j.tolist(), d2.tolist(), strict=True) if k >= 0]
        return rows

    def run(of: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(of) and len(at):
            at = at.sort_values("site", kind="stable")
            names, weight = at["site"].tolist(), at["weight"].to_numpy(float)
            (sx, sy), up = (at[c].to_numpy(float) for c in "xy"), np.cumsum(weight)
            near_of = _Near(sx, sy, snap_km)
            for (taxon, part), one in of.groupby(["taxon", "part"], sort=False):
                rows += turns(taxon, int(part), one.sort_values("from_site", kind="stable"), names, sx, sy, weight, up, near_of)
        return pd.DataFrame(rows, columns=["taxon", "draw", "site", "try", "far", "best_effort"], dtype=object)

    schema = f"taxon {kinds['taxon']}, draw int, site {kinds['site']}, try int, far boolean, best_effort boolean"
    return left.cogroup(right).applyInPandas(run, schema)


def cluster_bootstrap(rows: DataFrame, cluster: str, values: list[str], reps: int = 1000, seed: int = 1, strata: str | None = None) -> DataFrame:
    """TOP7: clusters drawn again with replacement, per stratum: means of the values over rows, with 2.5 % and 97.5 % quantiles.

    rows carry per-row values; they are summed per cluster first, so a draw moves clusters, not rows.  Up to ``BROADCAST_CLUSTERS``
    clusters' sums are sent to every task, and what is drawn is added up there: only a row a replicate and task is shuffled.
    """
    by = [strata] if strata else []
    sums = rows.groupBy(*by, cluster).agg(F.count("*").alias("_c"), *[F.sum(v).alias(v) for v in values])
    if by:
        listed = sums.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(cluster)))
    else:
        from rangeflow.operators.lineage import numbered

        listed = numbered(sums, [cluster], "_k")
    size = listed.groupBy(*by).agg(F.max("_k").alias("_n"))
    if listed.count() <= BROADCAST_CLUSTERS:
        listed = F.broadcast(listed)
    slots = size.select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).select("*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("slot"))
    pick = (F.floor(unit_hash(F.lit(seed), *[F.col(b) for b in by], F.col("rep"), F.col("slot")) * F.col("_n")) + 1).cast("long")
    drawn = slots.withColumn("_k", pick).join(listed, [*by, "_k"])
    means = drawn.groupBy("rep").agg(*[(F.sum(v) / F.sum("_c")).alias(v) for v in values])
    out = F.array(*[F.struct(F.lit(v).alias("value"), F.avg(v).alias("mean"), F.percentile(v, 0.025).alias("low"), F.percentile(v, 0.975).alias("high")) for v in values])
    return means.agg(out.alias("o")).select(F.explode("o").alias("o")).select("o.*").withColumn("above_zero", F.col("low") > 0)
