"""Learners of presence models (MOD5 to MOD9): fits on one model's rows, inside grouped tasks.

A study has thousands of small models (taxa x folds x arms x null draws), each of one taxon's sites, which the background cap bounds.  So a
model is a group of a table and is fitted in one task; all models of a study are one Spark job.  A learner takes a group's training
rows and returns a scorer of rows; its grid holds the settings that tuning tries, simplest first.  Sampling is by a seed that only
the settings, the round or the tree decide, so a repeated task gives the same model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd

Scorer = Callable[[pd.DataFrame], np.ndarray]

BOOSTED_DEPTHS, BOOSTED_ROUNDS, PATIENCE, FALLBACK_ROUNDS = (2, 3, 5), 1000, 30, 200
FOREST_TREES, FOREST_BINS, BOOSTED_BINS = 250, 64, 256


@dataclass(frozen=True)
class Learner:
    """``fit(rows, bands, settings, seed)`` gives a scorer; ``grid(detections, bands)`` the settings to try, ``default`` those of an untuned fit.

    ``search(rows, bands, fold, settings, seed)`` may take the place of cross-validating one candidate: it gives (mean area,
    settings), or None where the folds cannot be scored.
    """

    name: str
    fit: Callable[[pd.DataFrame, list[str], dict, int], Scorer]
    grid: Callable[[int, int], list[dict]]
    default: Callable[[int, int], dict]
    search: Callable[[pd.DataFrame, list[str], np.ndarray, dict, int], tuple[float, dict] | None] | None = None
    null: Callable[[int, int], dict] | None = None

    def at_null(self, detections: int, bands: int) -> dict:
        """The settings of the null test: the untuned ones, unless the learner names cheaper ones."""
        return (self.null or self.default)(detections, bands)


def average_ranks(value: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    order = np.argsort(value, kind="stable")
    s = value[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[first, len(s)])
    rank = np.empty(len(s))
    rank[order] = np.repeat(first + (size + 1) / 2, size)
    return rank


def boyce_index(score: np.ndarray, y: np.ndarray, windows: int = 100, width: float = 0.1) -> float | None:
    """The index of ``windows.boyce`` over one group's rows; None where it has none."""
    known = ~np.isnan(score)
    ones, zeros = (np.sort(score[known & (y == label)]) for label in (1, 0))
    if len(ones) < 3 or len(zeros) < 3:
        return None
    lo, hi = min(ones[0], zeros[0]), max(ones[-1], zeros[-1])
    if not hi > lo:
        return None
    span = width * (hi - lo)
    begin = lo + (hi - span - lo) * np.arange(windows) / (windows - 1)
    inside = lambda v: np.searchsorted(v, begin + span, side="right") - np.searchsorted(v, begin, side="left")
    p, b = inside(ones) / len(ones), inside(zeros) / len(zeros)
    ratio, middle = p[b > 0] / b[b > 0], (begin + span / 2)[b > 0]
    if len(ratio) < 3 or (ratio == ratio[0]).all():
        return None
    return float(np.corrcoef(average_ranks(middle), average_ranks(ratio))[0, 1])


def area(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the curve from average ranks; NaN where a class is empty."""
    n1 = y.sum()
    if n1 == 0 or n1 == len(y):
        return np.nan
    rank = average_ranks(score)
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1)))


def nothing(rows: pd.DataFrame) -> np.ndarray:
    """The scorer of a model that could not be fitted."""
    return np.full(len(rows), np.nan)


def label_of(settings: dict) -> str:
    """Settings as ``name=value`` pairs."""
    return " ".join(f"{k}={v:g}" if isinstance(v, (int, float)) else f"{k}={v}" for k, v in settings.items())


# ---- penalised models -------------------------------------------------------------------


#: Penalties by number of detections, (numbers, penalties) to interpolate, for each feature class.
PENALTIES = {
    "linear": ((0, 10, 30, 100), (1, 1, 0.2, 0.05)),
    "quadratic": ((0, 10, 17, 30, 100), (1.3, 0.8, 0.5, 0.25, 0.05)),
    "product": ((0, 10, 17, 30, 100), (2.6, 1.6, 0.9, 0.55, 0.05)),
    "hinge": ((0, 1), (0.5, 0.5)),
    "threshold": ((0, 100), (2, 1)),
}
KNOTS = 50


def feature_classes(detections: int) -> str:
    """Linear and quadratic features; hinges too from 30 detections on."""
    return "lq" if detections < 30 else "lqh"


class Features:
    """Linear, quadratic, product, hinge and threshold features of bands, held within the training range."""

    def __init__(self, x: np.ndarray, classes: str):
        self.low, self.high, self.classes = x.min(axis=0), x.max(axis=0), classes
        raw = self._raw(x)
        self.first, span = raw.min(axis=0), raw.max(axis=0) - raw.min(axis=0)
        self.span = np.where(span > 0, span, 1.0)
        self.kinds = self._kinds(x.shape[1])

    def _kinds(self, p: int) -> np.ndarray:
        counts = {"l": ("linear", p), "q": ("quadratic", p), "p": ("product", p * (p - 1) // 2), "h": ("hinge", 2 * (KNOTS - 1) * p), "t": ("threshold", KNOTS * p)}
        return np.repeat([counts[c][0] for c in "lqpht" if c in self.classes], [counts[c][1] for c in "lqpht" if c in self.classes])

    def _raw(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.low, self.high)
        out = [x] if "l" in self.classes else []
        if "q" in self.classes:
            out.append(x * x)
        if "p" in self.classes:
            out.append(np.column_stack([x[:, a] * x[:, b] for a, b in combinations(range(x.shape[1]), 2)] or [np.zeros((len(x), 0))]))
        for j in range(x.shape[1]) if "h" in self.classes else ():
            knots = np.linspace(self.low[j], self.high[j], KNOTS)
            rising = (x[:, j, None] - knots[:-1]) / (self.high[j] - knots[:-1])
            falling = (x[:, j, None] - self.low[j]) / (knots[1:] - self.low[j])
            out += [np.clip(rising, 0, 1), np.clip(falling, 0, 1)]
        for j in range(x.shape[1]) if "t" in self.classes else ():
            out.append((x[:, j, None] >= np.linspace(self.low[j], self.high[j], KNOTS + 2)[1:-1]).astype(float))
        return np.hstack(out)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((self._raw(x) - self.first) / self.span, 0, 1)

    def penalties(self, scaled: np.ndarray, found: np.ndarray) -> np.ndarray:
        """One penalty for each scaled feature, from its spread among the detections and their number."""
        n = int(found.sum())
        base = "product" if "p" in self.classes else "quadratic" if "q" in self.classes else "linear"
        table = lambda kind: PENALTIES[kind if kind in ("hinge", "threshold") else base]
        size = np.array([np.interp(n, *table(k)) for k in self.kinds]) / np.sqrt(n)
        at = scaled[found]
        spread = at.std(axis=0, ddof=1) if n > 1 else np.zeros(scaled.shape[1])
        least = np.full(len(size), 0.001)
        hinge = self.kinds == "hinge"
        least[hinge] = np.maximum(least[hinge], np.maximum(spread[hinge], 1 / np.sqrt(n)) * 0.5 / np.sqrt(n))
        same = (self.kinds == "threshold") & ((at.sum(axis=0) == 0) | (at.sum(axis=0) == n))
        least[same] = np.maximum(least[same], 1 / self.span[same])
        return np.maximum(least, spread * size)


def logistic_curve(y: np.ndarray, total: np.ndarray, offset: np.ndarray | float = 0.0):
    """(loss, slope, curvature) of ``y`` detections among ``total`` at each row's line."""

    def at(line: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        eta = line + offset
        mu = 1 / (1 + np.exp(-np.clip(eta, -500, 500)))
        return float((total * np.logaddexp(0, eta) - y * eta).sum()), y - total * mu, np.maximum(total * mu * (1 - mu), 1e-10)

    return at


def cloglog_curve(y: np.ndarray, offset: np.ndarray):
    """(loss, slope, curvature) of single detections with chance 1 - exp(-exp(line + offset))."""

    def at(line: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        t = np.exp(np.clip(line + offset, -30, 6))  # beyond, a detection is certain
        ratio = t / np.expm1(t)  # t exp(-t) / (1 - exp(-t))
        return float(((1 - y) * t - y * np.log(-np.expm1(-t))).sum()), y * ratio - (1 - y) * t, np.maximum(t * ratio, 1e-10)

    return at


def l1_fit(x: np.ndarray, penalty: np.ndarray, curve, start: float, rounds: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Intercept and coefficients with the least loss plus ``penalty * |coefficient|``, by proximal Newton steps.

    Each step solves the penalised quadratic on the coefficients that are not settled (coordinate by coordinate, on their Gram
    matrix) and is halved until the loss falls.  It ends where no coefficient breaks the optimality conditions.
    """
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.r_[0.0, penalty]
    beta = np.zeros(x.shape[1])
    beta[0] = start
    loss, slope, bend = curve(x @ beta)
    for _ in range(rounds):
        grad = x.T @ slope
        apart = np.where(beta != 0, np.abs(grad - penalty * np.sign(beta)), np.maximum(0, np.abs(grad) - penalty))
        if apart.max() <= tolerance * (1 + penalty.max()):
            break
        live = np.flatnonzero((beta != 0) | (apart > 0))
        if len(live) > 40:  # the worst first; the others come up in later steps
            live = np.union1d(np.flatnonzero(beta != 0), live[np.argsort(-apart[live])[:40]])
        live = np.union1d([0], live)
        z = x[:, live]
        gram = (z * bend[:, None]).T @ z
        diagonal = np.diag(gram) + 1e-12 * max(1.0, np.trace(gram))
        new, pull = beta[live].copy(), grad[live].copy()  # pull: gradient at the step's end
        cost_of, exact = penalty[live], gram + np.diag(np.full(len(live), 1e-12 * max(1.0, np.trace(gram))))
        for sweep in range(200):
            most = 0.0
            for k in range(len(live)):
                want = diagonal[k] * new[k] + pull[k]
                to = np.sign(want) * max(0.0, abs(want) - cost_of[k]) / diagonal[k]
                if (d := to - new[k]) != 0.0:
                    pull -= d * gram[:, k]
                    new[k] = to
                    most = max(most, d * d * diagonal[k])
            if most < 1e-14:
                break
            if sweep % 5 == 4:  # where the signs stand, the rest is a linear system
                on = np.flatnonzero((new != 0) | (cost_of == 0))
                moved = new.copy()
                moved[on] += np.linalg.solve(exact[np.ix_(on, on)], pull[on] - cost_of[on] * np.sign(new[on]))
                if (np.sign(moved[on]) == np.sign(new[on]))[cost_of[on] > 0].all():
                    pull -= gram @ (moved - new)
                    new = moved
                    if (np.abs(pull) <= cost_of + 1e-9 * (1 + cost_of))[new == 0].all():
                        break
        step = new - beta[live]
        fall = grad[live] @ step - (penalty[live] * (np.abs(new) - np.abs(beta[live]))).sum()  # first-order promise
        size, line, cost = 1.0, x @ beta, (penalty * np.abs(beta)).sum()
        move = z @ step
        while True:
            tried = beta.copy()
            tried[live] = new if size == 1.0 else beta[live] + size * step
            got = curve(line + size * move)
            if got[0] + (penalty * np.abs(tried)).sum() <= loss + cost - 1e-4 * size * fall or size < 1e-8:
                break
            size /= 2
        if size < 1e-8:
            break
        beta, (loss, slope, bend) = tried, got
    return beta


def _bands_of(train: pd.DataFrame, bands: list[str]) -> list[str]:
    """Bands that vary among the rows."""
    return [b for b in bands if train[b].nunique() > 1]


def presence_fit(train: pd.DataFrame, bands: list[str], settings: dict, seed: int = 1) -> Scorer:
    """MOD5: L1-penalised model of detections against all sites, scored as 1 - exp(-exp(entropy + line)).

    Every site is a background row of weight 100, every detection a row of weight 1 beside it.  ``classes`` names feature classes
    (by detections where left out), ``regmult`` multiplies the penalties, ``effort`` is none, covariate, weights or offset.
    """
    mode = settings.get("effort", "none")
    used = _bands_of(train, [*bands, *(["effort"] if mode == "covariate" else [])])
    y = train["presence"].to_numpy(float)
    if y.sum() < 2 or not used:
        return nothing
    features = Features(train[used].to_numpy(float), settings.get("classes") or feature_classes(int(y.sum())))
    z = features(train[used].to_numpy(float))
    penalty = y.sum() * settings.get("regmult", 1.0) * features.penalties(z, y == 1)
    effort = train["effort"].to_numpy(float) if mode in ("weights", "offset") else np.zeros(len(y))
    weight = 100 * (np.exp(effort) if mode == "weights" else 1.0)
    curve = logistic_curve(y, y + weight, effort if mode == "offset" else 0.0)
    beta = l1_fit(z, penalty, curve, float(np.log(y.sum() / np.sum(np.ones(len(y)) * weight))))[1:]
    line = z @ beta
    top = line.max()
    shift = -np.log(np.exp(line - top).sum()) - top
    share = np.exp(line + shift)
    entropy = -(share * np.log(np.maximum(share, 1e-300))).sum()

    def score(rows: pd.DataFrame) -> np.ndarray:
        return -np.expm1(-np.exp(np.clip(features(rows[used].to_numpy(float)) @ beta + shift + entropy, -500, 500)))

    return score


def detection_fit(train: pd.DataFrame, bands: list[str], settings: dict, seed: int = 1) -> Scorer:
    """MOD9: chance of a detection, 1 - exp(-intensity x records), on the features and penalties of the presence model; log records are an offset."""
    used = _bands_of(train, bands)
    y = train["presence"].to_numpy(float)
    if y.sum() < 2 or not used:
        return nothing
    features = Features(train[used].to_numpy(float), settings.get("classes") or feature_classes(int(y.sum())))
    z = features(train[used].to_numpy(float))
    effort = train["effort"].to_numpy(float)
    penalty = y.sum() * settings.get("regmult", 1.0) * features.penalties(z, y == 1)
    beta = l1_fit(z, penalty, cloglog_curve(y, effort), float(np.log(y.sum() / np.exp(np.clip(effort, -30, 30)).sum())))

    def score(rows: pd.DataFrame) -> np.ndarray:
        line = beta[0] + features(rows[used].to_numpy(float)) @ beta[1:]
        return -np.expm1(-np.exp(np.clip(line + (rows["effort"].to_numpy(float) if "effort" in rows else 0.0), -500, 500)))

    return score


# ---- trees ----------------------------------------------------------------------------


class Bins:
    """Bands as the number of their cut points at or below a value; cuts lie between neighbouring values, or at quantiles where there are many."""

    def __init__(self, x: np.ndarray, most: int):
        self.cuts = []
        for column in x.T:
            values = np.unique(column)
            if len(values) > most:
                values = np.unique(np.quantile(column, np.linspace(0, 1, most), method="nearest"))
            self.cuts.append((values[1:] + values[:-1]) / 2)
        self.size = max([len(c) + 1 for c in self.cuts], default=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, column, side="right") for c, column in zip(self.cuts, x.T, strict=True)])


@dataclass
class Tree:
    """Splits by node: band (-1 at a leaf), the last bin that goes left, the left child (the right one follows it), and the node's value."""

    band: np.ndarray
    last: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(len(codes), dtype=np.int64)
        rows = np.arange(len(codes))
        while len(rows := rows[self.band[node[rows]] >= 0]):  # those at a leaf stay there
            at = node[rows]
            node[rows] = self.left[at] + (codes[rows, self.band[at]] > self.last[at])
        return self.value[node]


def grow(
    codes: np.ndarray, size: int, up: np.ndarray, weight: np.ndarray, *, depth: int, ridge: float = 0.0, child: float = 1.0, node_over: float = 0.0,
    columns: np.ndarray | None = None, mtry: int | None = None, rng: np.random.Generator | None = None,
) -> Tree:
    """A tree by levels: one histogram over (node, band, bin) a level, and the best split of every node from its running sums.

    A split's gain is the rise of the sum of ``up^2 / (weight + ridge)`` (second-order boosting).  A child weighs ``child`` at least.
    With ``mtry`` it is a tree of votes (``grow_votes``), to which neither ridge, child nor columns apply.
    """
    if mtry is not None:
        return grow_votes(codes, size, up, weight, depth=depth, node_over=node_over, mtry=mtry, rng=rng)
    columns = np.arange(codes.shape[1]) if columns is None else columns
    p = len(columns)
    codes = codes[:, columns]
    band, last, left = [np.array([-1])], [np.array([0])], [np.array([0])]
    ups, weights = [np.array([up.sum()])], [np.array([weight.sum()])]
    known, front = 1, np.array([1.0])  # nodes so far; the last level's nodes
    local, rows = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
    for _ in range(depth):
        width = len(front)
        flat = ((local[rows][:, None] * p + np.arange(p)) * size + codes[rows]).ravel()
        total = width * p * size
        u = np.bincount(flat, np.repeat(up[rows], p), total).reshape(width, p, size).cumsum(axis=2)
        w = np.bincount(flat, np.repeat(weight[rows], p), total).reshape(width, p, size).cumsum(axis=2)
        all_u, all_w = u[:, :1, -1:], w[:, :1, -1:]
        right_u, right_w = all_u - u, all_w - w
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = u**2 / (w + ridge) + right_u**2 / (right_w + ridge) - all_u**2 / (all_w + ridge)
        gain[(w < child - 1e-9) | (right_w < child - 1e-9) | (w <= 1e-12) | (right_w <= 1e-12)] = -np.inf
        gain = gain.reshape(width, -1)
        best = gain.argmax(axis=1)
        split = np.flatnonzero(gain[np.arange(width), best] > 1e-10)
        if not len(split):
            break
        b, c = np.divmod(best[split], size)
        band[-1][split], last[-1][split], left[-1][split] = columns[b], c, known + 2 * np.arange(len(split))
        two = lambda x, y: np.column_stack([x, y]).ravel()
        ups.append(two(u[split, b, c], right_u[split, b, c]))
        weights.append(two(w[split, b, c], right_w[split, b, c]))
        band.append(np.full(2 * len(split), -1))
        last.append(np.zeros(2 * len(split), dtype=np.int64))
        left.append(np.zeros(2 * len(split), dtype=np.int64))
        first = np.full(width, -1)
        first[split] = 2 * np.arange(len(split))
        rows = rows[first[local[rows]] >= 0]
        at = local[rows]
        own_b, own_c = np.divmod(best[at], size)
        local[rows] = first[at] + (codes[rows, own_b] > own_c)
        known, front = known + 2 * len(split), ups[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.nan_to_num(np.concatenate(ups) / (np.concatenate(weights) + ridge))
    return Tree(np.concatenate(band), np.concatenate(last), np.concatenate(left), value)


def grow_votes(codes: np.ndarray, size: int, up: np.ndarray, drawn: np.ndarray, *, depth: int, node_over: float, mtry: int, rng: np.random.Generator) -> Tree:
    """A tree of votes by levels: the best split of every node by the Gini index, on ``mtry`` bands drawn for it; its value is the share of detections.

    ``drawn`` tells how often a row was drawn, ``up`` the same of detections and 0 of others; a node that splits has more than ``node_over`` draws, of both classes.  Only such nodes and their drawn bands get
    histograms, one over (node, class, bin) a band.  Counts are whole numbers, so sums are exact.
    """
    n, p = codes.shape
    m = min(mtry, p)
    flat, start, found = codes.ravel(), np.arange(n) * p, (up > 0).astype(np.int64)
    band, last, left = [np.array([-1])], [np.array([0])], [np.array([0])]
    ones, totals = [np.array([up.sum()])], [np.array([drawn.sum()])]
    known, node = 1, np.zeros(n, dtype=np.int64)  # nodes so far; the rows' place among the last level's nodes
    for _ in range(depth):
        width = len(totals[-1])
        bands = np.tile(np.arange(p), (width, 1)) if m == p else np.sort(np.argsort(rng.random((width, p)), axis=1)[:, :m], axis=1)
        live = np.flatnonzero((totals[-1] > node_over) & (ones[-1] > 0) & (ones[-1] < totals[-1]))
        if not len(live):
            break
        bands, slot = bands[live], np.full(width, -1)
        slot[live] = np.arange(len(live))
        at = slot[node]
        if len(live) < width:
            at, start, found, drawn = (v[kept] for kept in [at >= 0] for v in (at, start, found, drawn))
        cells = np.empty((len(live), m, 2, size))
        for k in range(m):
            bins = (at * 2 + found) * size + flat[start + bands[at, k]]
            cells[:, k] = np.bincount(bins, drawn, len(live) * 2 * size).reshape(-1, 2, size)
        below = cells.cumsum(axis=3)
        u, w = below[:, :, 1], below.sum(axis=2)
        all_u, all_w = u[:, :1, -1:], w[:, :1, -1:]
        right_u, right_w = all_u - u, all_w - w
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = u**2 / w + right_u**2 / right_w - all_u**2 / all_w
        gain[(w < 1) | (right_w < 1)] = -np.inf
        gain = gain.reshape(len(live), -1)
        best = gain.argmax(axis=1)
        fine = np.flatnonzero(gain[np.arange(len(live)), best] > 1e-10)
        if not len(fine):
            break
        b, c = np.divmod(best[fine], size)
        by, k = bands[fine, b], 2 * np.arange(len(fine))
        band[-1][live[fine]], last[-1][live[fine]], left[-1][live[fine]] = by, c, known + k
        for sums, lower, upper in ((ones, u, right_u), (totals, w, right_w)):
            sums.append(np.column_stack([lower[fine, b, c], upper[fine, b, c]]).ravel())
        for values, empty in ((band, -1), (last, 0), (left, 0)):
            values.append(np.full(2 * len(fine), empty))
        first, cut_band, cut_bin = np.full(len(live), -1), np.zeros(len(live), dtype=np.int64), np.zeros(len(live), dtype=np.int64)
        first[fine], cut_band[fine], cut_bin[fine] = k, by, c
        if len(fine) < len(live):
            at, start, found, drawn = (v[kept] for kept in [first[at] >= 0] for v in (at, start, found, drawn))
        node = first[at] + (flat[start + cut_band[at]] > cut_bin[at])
        known += 2 * len(fine)
    return Tree(np.concatenate(band), np.concatenate(last), np.concatenate(left), np.concatenate(ones) / np.concatenate(totals))


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights under which detections count as much as the rest; plain where a class is empty."""
    n1 = y.sum()
    return np.where(y == 1, (len(y) - n1) / n1, 1.0) if 0 < n1 < len(y) else np.ones(len(y))


def _boost(codes: np.ndarray, size: int, y: np.ndarray, depth: int, seed: int) -> Iterator[Tree]:
    """Trees of boosted log-odds without end: 5 % steps, three quarters of the rows and four fifths of the bands a round."""
    line, w, p = np.zeros(len(y)), balanced(y), codes.shape[1]
    for n in range(1 << 30):
        rng = np.random.default_rng([seed, n])
        chance = 1 / (1 + np.exp(-line))
        rows = np.flatnonzero(rng.random(len(y)) < 0.75)
        columns = np.sort(rng.permutation(p)[: max(1, int(0.8 * p))])
        tree = grow(codes[rows], size, (w * (y - chance))[rows], (w * chance * (1 - chance))[rows], depth=depth, ridge=1.0, child=5.0, columns=columns)
        tree.value *= 0.05
        line += tree(codes)
        yield tree


def staged_rounds(train: pd.DataFrame, bands: list[str], fold: np.ndarray, depth: int, seed: int, most: int = BOOSTED_ROUNDS, patience: int = PATIENCE) -> tuple[int, float] | None:
    """(rounds, mean area) at the best mean held-out area of the folds, stopped after ``patience`` rounds without a better one; None where a fold lacks detections."""
    y, x = train["presence"].to_numpy(float), train[bands].to_numpy(float)
    folds = np.unique(fold)
    if len(folds) < 2 or any(y[fold == f].sum() in (0, y.sum(), (fold == f).sum()) for f in folds):
        return None
    runs = []
    for f in folds:
        out = fold == f
        bins = Bins(x[~out], BOOSTED_BINS)
        runs.append((_boost(bins(x[~out]), bins.size, y[~out], depth, seed), bins(x[out]), y[out], np.zeros(int(out.sum()))))
    best, at = -np.inf, 0
    for n in range(1, most + 1):
        areas = []
        for trees, codes, truth, line in runs:
            line += next(trees)(codes)
            areas.append(area(line, truth))
        if (mean := float(np.mean(areas))) > best:
            best, at = mean, n
        elif n - at >= patience:
            break
    return at, best


def block_folds(x: np.ndarray, y: np.ndarray, k: int, block_km: float, seed: int) -> np.ndarray:
    """Square blocks dealt at random to folds of equal numbers of blocks."""
    _, block = np.unique(np.column_stack([np.floor(x / (block_km * 1000)), np.floor(y / (block_km * 1000))]), axis=0, return_inverse=True)
    block = np.ravel(block)
    n = int(block.max(initial=-1)) + 1
    k = max(2, min(k, n))
    return np.random.default_rng(seed).permutation(np.arange(n) % k)[block] if n else block


def boosted_fit(train: pd.DataFrame, bands: list[str], settings: dict, seed: int = 1) -> Scorer:
    """MOD6: boosted trees of ``depth``; the number of rounds is given, or found on three inner folds of 200 km blocks (200 where one lacks detections)."""
    y, x = train["presence"].to_numpy(float), train[bands].to_numpy(float)
    if y.sum() < 2 or not bands:
        return nothing
    depth, rounds = int(settings.get("depth", 3)), settings.get("rounds")
    if rounds is None:
        inner = block_folds(train["x"].to_numpy(float), train["y"].to_numpy(float), 3, settings.get("block_km", 200), seed + 1)
        found = staged_rounds(train, bands, inner, depth, seed)
        rounds = found[0] if found else FALLBACK_ROUNDS
    bins = Bins(x, BOOSTED_BINS)
    trees = [t for t, _ in zip(_boost(bins(x), bins.size, y, depth, seed), range(int(rounds)))]

    def score(rows: pd.DataFrame) -> np.ndarray:
        codes = bins(rows[bands].to_numpy(float))
        return 1 / (1 + np.exp(-sum((t(codes) for t in trees), np.zeros(len(codes)))))

    return score


def boosted_search(train: pd.DataFrame, bands: list[str], fold: np.ndarray, settings: dict, seed: int = 1) -> tuple[float, dict] | None:
    """MOD12: a depth with the rounds that early stopping finds on the given folds."""
    found = staged_rounds(train, bands, fold, int(settings["depth"]), seed)
    return (found[1], {**settings, "rounds": found[0]}) if found else None


def forest_fit(train: pd.DataFrame, bands: list[str], settings: dict, seed: int = 1) -> Scorer:
    """MOD7: a forest whose trees each draw as many detections as there are, and as many other rows, with replacement; the mean of the leaves' shares.

    Nodes of more than ten drawn rows split, on the best of ``mtry`` bands drawn for the node.
    """
    y, x = train["presence"].to_numpy(float), train[bands].to_numpy(float)
    if y.sum() < 2 or y.all() or not bands:
        return nothing
    bins = Bins(x, FOREST_BINS)
    codes, ones, zeros = bins(x), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mtry = int(settings.get("mtry") or max(1, int(np.sqrt(len(bands)))))
    trees = []
    for n in range(int(settings.get("trees", FOREST_TREES))):
        rng = np.random.default_rng([seed, n])
        drawn = np.bincount(np.r_[rng.choice(ones, len(ones)), rng.choice(zeros, len(ones))], minlength=len(y)).astype(float)
        rows = np.flatnonzero(drawn)
        trees.append(grow(codes[rows], bins.size, (drawn * y)[rows], drawn[rows], depth=64, node_over=10.0, mtry=mtry, rng=rng))

    def score(rows: pd.DataFrame) -> np.ndarray:
        at = bins(rows[bands].to_numpy(float))
        return sum((t(at) for t in trees), np.zeros(len(at))) / len(trees)

    return score


# ---- ridge models and ensembles of pairs --------------------------------------------------


def design(x: np.ndarray, squares: bool) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, x**2]) if squares else np.column_stack([np.ones(len(x)), x])


def ridge_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.01, steps: int = 25) -> np.ndarray:
    """Weighted ridge logistic coefficients by Newton steps."""
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * w.sum())
    penalty[0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - penalty * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def scale_of(train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sd = train.std(axis=0)
    return train.mean(axis=0), np.where(sd > 0, sd, 1.0)


def small_fit(train: pd.DataFrame, bands: list[str], ridge: float, pairs: bool, fold: str = "fold") -> Scorer:
    """MOD8: one ridge model, or the ensemble of all pairs of bands.

    A pair weighs its Somers' D over the pooled scores of the training folds, each held out in turn, never below 0; all weigh
    the same where none beats chance or no fold can be scored.  NaN where the training rows lack a class.
    """
    y = train["presence"].to_numpy(float)
    if y.sum() in (0, len(y)) or not bands:
        return nothing
    mean, sd = scale_of(train[bands].to_numpy(float))
    z = (train[bands].to_numpy(float) - mean) / sd
    low, high = z.min(axis=0), z.max(axis=0)

    def fit(cols: list[int], rows: np.ndarray) -> np.ndarray:
        found = y[rows]
        w = np.where(found == 1, len(found) / (2 * found.sum()), len(found) / (2 * (len(found) - found.sum())))
        return ridge_logistic(design(z[rows][:, cols], True), found, w, ridge)

    def score(at: np.ndarray, cols: list[int], beta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(at[:, cols], True) @ beta, -30, 30)))

    def beyond_chance(cols: list[int]) -> float:
        held = []
        for f in np.unique(blocks):
            out = blocks == f
            if y[~out].sum() >= 2 and not y[~out].all() and 0 < y[out].sum() < out.sum():
                held.append((score(z[out], cols, fit(cols, ~out)), y[out]))
        d = 2 * area(*map(np.concatenate, zip(*held, strict=True))) - 1 if held else np.nan
        return max(0.0, d) if np.isfinite(d) else 0.0

    members, weights = [list(range(len(bands)))], np.ones(1)
    if pairs and len(bands) > 1:
        members, blocks = [list(c) for c in combinations(range(len(bands)), 2)], train[fold].to_numpy()
        weights = np.array([beyond_chance(c) for c in members])
        weights = weights if weights.any() else np.ones(len(members))
    used = [(w / weights.sum(), c, fit(c, np.ones(len(y), bool))) for w, c in zip(weights, members, strict=True) if w > 0]

    def scores(rows: pd.DataFrame) -> np.ndarray:
        at = np.clip((rows[bands].to_numpy(float) - mean) / sd, low, high)
        return sum(w * score(at, c, beta) for w, c, beta in used)

    return scores


# ---- the learners -----------------------------------------------------------------------

#: Penalty multipliers that tuning tries, simplest first.
REGMULTS = (4.0, 2.0, 1.0, 0.5, 0.25)


def _penalised_grid(detections: int, bands: int) -> list[dict]:
    return [{"classes": c, "regmult": m} for c in ("lq", "lqh") for m in REGMULTS]


def _mtry_grid(detections: int, bands: int) -> list[dict]:
    return [{"mtry": m} for m in sorted({min(bands, max(1, k)) for k in (2, int(np.sqrt(bands)), bands // 3)})]


RIDGES = (1.0, 0.1, 0.01, 0.001)
RIDGE_MODEL = Learner(
    "ridge", lambda t, b, s, seed: small_fit(t, b, s.get("ridge", 0.01), bool(s.get("pairs"))), lambda n, p: [{"ridge": r} for r in RIDGES], lambda n, p: {"ridge": 0.01}
)
PRESENCE = Learner("presence", presence_fit, _penalised_grid, lambda n, p: {"classes": feature_classes(n), "regmult": 1.0})
BOOSTED = Learner("boosted", boosted_fit, lambda n, p: [{"depth": d} for d in BOOSTED_DEPTHS], lambda n, p: {"depth": 3}, boosted_search, lambda n, p: {"depth": 3, "rounds": FALLBACK_ROUNDS})
FOREST = Learner("forest", forest_fit, _mtry_grid, lambda n, p: {"mtry": max(1, int(np.sqrt(p)))})
DETECTION = Learner("detection", detection_fit, _penalised_grid, lambda n, p: {"classes": feature_classes(n), "regmult": 1.0})
LEARNERS = {m.name: m for m in (RIDGE_MODEL, PRESENCE, BOOSTED, FOREST, DETECTION)}
