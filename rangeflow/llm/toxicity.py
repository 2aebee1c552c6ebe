"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Document labels become token labels by multiple-instance reasoning on a bounded sample: the words and word starts that best
cover the toxic documents and hardly occur in clean ones mark toxic tokens.  The field has two states, hashed features of the
word and of its first bytes, and transitions; it is fitted by the gradient of its likelihood (forward-backward).  Whole texts
are then tagged by exact forward-backward: chains are cut in blocks whose 2 x 2 products are composed, so all blocks of a
batch advance together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeflow.llm.linear import SAMPLE_BYTES, row_sums, sigmoid
from rangeflow.llm.rows import with_text_columns
from rangeflow.llm.text import U64, Words, byte_table, text_pieces

#: Labelled texts that the field is fitted on, at most about, of each label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1200, 1800
STARTS = (4, 5, 6, 7)
_BITS = (20, 18, 18, 18, 18)
_FIRST = np.concatenate([[0], np.cumsum([1 << b for b in _BITS])])
_BLOCK = 64
_TABLE = byte_table("letters")


def features(words: Words) -> np.ndarray:
    """Slots of each word's features: the whole word, and its first bytes."""
    out = np.empty((len(_BITS), len(words)), dtype=np.int32)
    for k, width in enumerate((None, *STARTS)):
        out[k] = (words.hashes(width) >> U64(64 - _BITS[k])).astype(np.int64) + _FIRST[k]
    return out


class Field:
    """A two-state chain: weights of features, log transitions relative to clean -> clean, and a document calibration."""

    def __init__(self):
        self.w = np.zeros(_FIRST[-1], dtype=np.float32)
        self.bias = -6.0
        self.move = np.array([0.0, 0.0, 0.0])  # clean -> toxic, toxic -> clean, toxic -> toxic
        self.calibration = np.array([1.0, 1.0, 0.0])

    def potentials(self, slots: np.ndarray) -> np.ndarray:
        total = np.full(slots.shape[1], self.bias)
        for row in slots:
            total += self.w[row]
        return np.exp(np.clip(total, -30, 30))

    def marginals(self, w: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: probability of toxic, forward odds before its own potential's successor, backward odds."""
        n = np.diff(bounds)
        blocks = -(-n // _BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        if not first[-1]:
            none = np.zeros(0)
            return none, none, none
        doc = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(w)) - bounds[doc]
        at = (first[doc] + inside // _BLOCK, inside % _BLOCK)
        x = np.zeros((first[-1], _BLOCK))
        real = np.zeros(x.shape, dtype=bool)
        x[at], real[at] = w, True
        a01, a10, a11 = np.exp(self.move)
        # products of the blocks' steps
        p00, p01, p10, p11 = np.ones(len(x)), np.zeros(len(x)), np.zeros(len(x)), np.ones(len(x))
        for t in range(_BLOCK):
            v, m = x[:, t], real[:, t]
            q00, q01 = p00 + a10 * p10, p01 + a10 * p11
            q10, q11 = v * (a01 * p00 + a11 * p10), v * (a01 * p01 + a11 * p11)
            scale = 1 / (q00 + q01 + q10 + q11)
            p00, p01 = np.where(m, q00 * scale, p00), np.where(m, q01 * scale, p01)
            p10, p11 = np.where(m, q10 * scale, p10), np.where(m, q11 * scale, p11)
        ahead, behind = np.zeros(len(x)), np.ones(len(x))  # odds that enter a block from the left, and from the right
        order = np.argsort(-blocks, kind="stable")
        longest = blocks[order]
        for k in range(1, int(longest[0]) if len(longest) else 0):
            live = order[: np.searchsorted(-longest, -k, side="left")]
            b = first[live] + k
            r = ahead[b - 1]
            ahead[b] = (p10[b - 1] + p11[b - 1] * r) / (p00[b - 1] + p01[b - 1] * r)
            b = first[live + 1] - 1 - k
            q = behind[b + 1]
            behind[b] = (p01[b + 1] + p11[b + 1] * q) / (p00[b + 1] + p10[b + 1] * q)
        r, q = np.empty_like(x), np.empty_like(x)
        odds = ahead
        for t in range(_BLOCK):
            odds = x[:, t] * (a01 + a11 * odds) / (1 + a10 * odds)
            r[:, t] = odds
        back = behind
        for t in range(_BLOCK - 1, -1, -1):
            q[:, t] = back
            ahead_of = x[:, t] * back
            back = np.where(real[:, t], (a10 + a11 * ahead_of) / (1 + a01 * ahead_of), back)
        r, q = r[at], q[at]
        return r * q / (1 + r * q), r, q

    def fit(self, slots: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, rounds: int = 40, rate: float = 0.5, ridge: float = 1e-3) -> None:
        """Gradient ascent on the likelihood of token labels (adaptive steps)."""
        y = toxic.astype(np.float64)
        starts = np.zeros(len(y), dtype=bool)
        starts[bounds[:-1][bounds[:-1] < len(y)]] = True
        before = np.concatenate([[0.0], y[:-1]])
        before[starts] = 0
        seen_w, seen = np.full(len(self.w), 1e-6), np.full(4, 1e-6)
        used = np.unique(slots)
        for _ in range(rounds):
            w = self.potentials(slots)
            m, r, q = self.marginals(w, bounds)
            gap = y - m
            g = np.zeros(len(self.w))
            for row in slots:
                g += np.bincount(row, gap, len(self.w))
            g[used] -= ridge * self.w[used]
            seen_w += g * g
            self.w += (rate * g / np.sqrt(seen_w)).astype(np.float32)
            a01, a10, a11 = np.exp(self.move)
            left = np.concatenate([[0.0], r[:-1]])
            left[starts] = 0
            ahead = w * q
            total = 1 + a01 * ahead + left * a10 + left * a11 * ahead
            expected = np.array([(a01 * ahead / total).sum(), (left * a10 / total).sum(), (left * a11 * ahead / total).sum()])
            got = np.array([((1 - before) * y).sum(), (before * (1 - y)).sum(), (before * y).sum()])
            g4 = np.concatenate([[gap.sum()], got - expected - ridge * self.move])
            seen += g4 * g4
            step = 0.3 * g4 / np.sqrt(seen)
            self.bias += step[0]
            self.move = np.clip(self.move + step[1:], -6, 6)

    def evidence(self, m: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Two numbers of each text: log of its expected toxic tokens, and log odds of its surest one."""
        some = np.diff(bounds) > 0
        top = np.full(len(bounds) - 1, 1e-7)
        if len(m):
            top[some] = np.maximum.reduceat(m, bounds[:-1][some])
        top = np.clip(top, 1e-7, 1 - 1e-7)
        return np.stack([np.log(row_sums(m, bounds) + 1e-4), np.log(top / (1 - top))], axis=1)

    def score(self, m: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return sigmoid(self.evidence(m, bounds) @ self.calibration[:2] + self.calibration[2])

    def calibrate(self, seen: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 400) -> None:
        """A logistic curve over the texts' evidence; weights restore the labels' shares before sampling."""
        centre, spread = seen.mean(axis=0), seen.std(axis=0) + 1e-6
        z = (seen - centre) / spread
        c, total = np.zeros(3), np.full(3, 1e-6)
        for _ in range(rounds):
            gap = weight * (toxic - sigmoid(z @ c[:2] + c[2]))
            g = np.append(gap @ z, gap.sum()) / len(toxic) - 1e-3 * np.append(c[:2], 0)
            total += g * g
            c = c + 0.5 * g / np.sqrt(total)
        self.calibration = np.append(c[:2] / spread, c[2] - (c[:2] * centre / spread).sum())


def toxic_tokens(slots: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which tokens of the toxic texts are toxic: greedy cover of those texts by features that clean texts hardly have."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    pairs = np.unique((np.tile(doc, len(slots)).astype(np.int64) << 32) | slots.ravel())
    who, what = pairs >> 32, pairs & 0xFFFFFFFF
    clean = np.bincount(what[~toxic[who]], minlength=_FIRST[-1])
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    who, what = who[toxic[who]], what[toxic[who]]
    every = np.bincount(what, minlength=_FIRST[-1])
    fine = (every >= 2) & ((every / n_toxic) > 20 * (clean + 0.02) / n_clean)
    keep = fine[what]
    who, what = who[keep], what[keep]
    chosen, open_ = [], np.ones(len(toxic), dtype=bool)
    while len(what):
        count = np.bincount(what, minlength=_FIRST[-1])
        best = int(count.argmax())
        if count[best] < 2:
            break
        chosen.append(best)
        open_[who[what == best]] = False
        keep = open_[who]
        who, what = who[keep], what[keep]
    marked = np.zeros(_FIRST[-1], dtype=bool)
    marked[chosen] = True
    return marked[slots].any(axis=0) & toxic[doc]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_toxic: int = SAMPLE_TOXIC,
    sample_clean: int = SAMPLE_CLEAN, sample_bytes: int = SAMPLE_BYTES,
) -> Field:
    """The field, from labelled texts of at most ``sample_bytes`` bytes: about ``sample_toxic`` and ``sample_clean`` of them, by a hash of the id.

    Twice as many at most, in labels (which bounds what is broadcast) and in texts.  A label that only longer texts carry is learned from the shortest
    of them.
    """
    counts = {r[label_col]: r["count"] for r in labels.where(F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}
    pick, hashed = F.lit(False), F.pmod(F.xxhash64(F.col(id_col), F.lit("toxic")), F.lit(1_000_000))
    for label, most in ((1, sample_toxic), (0, sample_clean)):
        share = min(1_000_000, int(1_000_000 * most / max(1, counts.get(label, 0))) + 1)
        pick = pick | ((F.col(label_col) == label) & (hashed < share))
    most = 2 * (sample_toxic + sample_clean)
    some = labels.where(pick).groupBy(id_col).agg(F.max(label_col).alias("label")).limit(most)
    size = F.octet_length(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for a, b, data, offsets in text_pieces(batch.column(0)):
                words = Words(data, offsets, _TABLE)
                held = features(words)
                parts = [held[:, i:j].tobytes() for i, j in zip(words.row[:-1], words.row[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(label[a:b], pa.int32()), pa.array(parts, pa.binary())], names=["label", "slots"])

    met = docs.join(F.broadcast(some), id_col).select(text_col, F.col("label").cast("int").alias("label"))
    fits = met.where(size <= sample_bytes)
    found = fits.limit(most).mapInArrow(run, "label int, slots binary").toArrow()
    if len(set(found["label"].to_pylist())) < len([c for c in (0, 1) if counts.get(c)]):
        seen = set(found["label"].to_pylist())
        short = met.where(size > sample_bytes).where(~F.col("label").isin(*seen) if seen else F.lit(True))
        short = short.groupBy("label").agg(F.min_by(text_col, F.struct(size, text_col)).alias(text_col)).select(text_col, "label")
        found = pa.concat_tables([found, short.mapInArrow(run, "label int, slots binary").toArrow()])
    field = Field()
    if not found.num_rows:
        return field
    label = found["label"].to_numpy() == 1
    parts = [np.frombuffer(s.as_py(), dtype=np.int32).reshape(len(_BITS), -1) for s in found["slots"]]
    bounds = np.concatenate([[0], np.cumsum([p.shape[1] for p in parts])])
    slots = np.concatenate(parts, axis=1)
    field.fit(slots, bounds, toxic_tokens(slots, bounds, label))
    m = field.marginals(field.potentials(slots), bounds)[0]
    share = np.where(label, counts.get(1, 0) / max(1, label.sum()), counts.get(0, 0) / max(1, (~label).sum()))
    field.calibrate(field.evidence(m, bounds), label.astype(np.float64), share / share.mean())
    return field


def with_toxicity(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with ``OWN``-prefixed columns score (0 to 1) and spans (code points of runs of tokens that are rather toxic).

    Texts without words (null, empty) have the score of no evidence, and no spans.  Equal texts score equally; repeated rows and
    extra columns stay as they are; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        field = shared.value
        for batch in batches:
            scores, spans = [np.zeros(0)], []
            for a, b, data, offsets in text_pieces(batch.column(0)):
                words = Words(data, offsets, _TABLE)
                m = field.marginals(field.potentials(features(words)), words.row)[0]
                scores.append(field.score(m, words.row))
                out: list = [[] for _ in range(b - a)]
                hit = np.flatnonzero(m >= 0.5)
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                for k, row in zip(hit.tolist(), (np.searchsorted(words.row, hit, side="right") - 1).tolist(), strict=True):
                    begin = offsets[row]
                    points = lambda z: int(lead[z] - lead[begin])  # noqa: B023, E731
                    if out[row] and out[row][-1]["token"] == k - 1:
                        out[row][-1] |= {"end": points(words.end[k]), "token": k}
                    else:
                        out[row].append({"start": points(words.start[k]), "end": points(words.end[k]), "token": k})
                spans += [[{"start": s["start"], "end": s["end"]} for s in row] for row in out]
            yield [pa.array(np.concatenate(scores)), pa.array(spans, span)]

    return with_text_columns(docs, "score double; spans array<struct<start:int,end:int>>", run, [text_col])
