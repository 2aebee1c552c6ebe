"""Quality by a weak-label model.

Overlapping heuristic labellers, some of which often err, call a text clean, poor, or abstain.  Expectation-maximisation over the counts of
their joint votes estimates, without labels and without bounds, how often each calls clean texts poor and poor ones clean.  Poor texts are of
several kinds, since labellers that see the same fault agree within a kind and not beyond it.  The posteriors of a bounded sample train a
hashed linear scorer of byte n-grams and binned statistics, which then scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeflow.llm.linear import BITS, Sparse, fit, gram_rows, gram_slots, named_slot, row_sums, sampled, sigmoid
from rangeflow.llm.rows import OWN, own, with_text_columns
from rangeflow.llm.text import Words, byte_table, text_pieces

#: Texts that the scorer is fitted on, at most about.
SAMPLE_ROWS = 3000
GRAM_SCALE = 30.0
POOR, CLEAN, ABSTAIN = 0, 1, 2
POOR_KINDS, PRIOR_TEXTS = 3, 20
#: (statistic, clean below, poor above, fewest words); a text between the two, or shorter, gets no vote.
LABELLERS = (
    ("symbols", 0.02, 0.06, 1),
    ("capitals", 0.15, 0.5, 3),
    ("tables", 0.02, 0.2, 3),
    ("shouting", 0.05, 0.2, 3),
    ("repetition", 0.45, 0.65, 20),
    ("echo", 0.05, 0.2, 10),
    ("unlettered", 0.21, 0.25, 20),
    ("long words", 6.9, 7.3, 20),
    ("variety", 4.25, 4.42, 40),
    ("monotony", 1.4, 1.55, 40),
)
#: Where each kind of poor text starts from: junk, repetition, shouting.
_SEEN_BY = (("symbols", "tables", "unlettered"), ("repetition", "echo"), ("capitals", "shouting"))
_EDGES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8])
_SLOTS = np.array([[named_slot(f"{name}:{k}") for k in range(len(_EDGES) + 1)] for name, *_ in LABELLERS])


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of words, matrix of the labellers' statistics) of each row."""

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)

    kind = np.zeros((6, 256), dtype=bool)
    kind[0, [ord(c) for c in "*#$%&^~=|\\<>{}@_+"]] = True
    kind[1, 65:91] = True
    kind[2, 65:91] = kind[2, 97:123] = True
    kind[3, ord("|")] = True
    kind[4, ord("!")] = True
    kind[5, [0x20, *range(9, 14)]] = True
    symbol, upper, letter, pipe, shout, space = (per_row(k[data]) for k in kind)
    words = Words(data, offsets, byte_table("space"))
    h, bounds = words.hashes(), words.row
    n = np.diff(bounds).astype(np.float64)
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    firsts = bounds[:-1][bounds[:-1] < len(h)]
    same[firsts] = False
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], dtype=np.float64)
    some = np.maximum(n, 1)
    solid = np.maximum(np.diff(offsets) - space, 1)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    share = np.bincount(row * 256 + data, minlength=256 * len(size)).reshape(len(size), 256) / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(share, out=np.zeros_like(share), where=share > 0)).sum(axis=1)
    unlettered = 1 - (letter + per_row(data >= 0x80)) / np.maximum(size, 1)
    table = [symbol / solid, upper / np.maximum(letter, 1), pipe / some, shout / some, np.where(n > 0, 1 - distinct / some, 0), row_sums(same, bounds) / some]
    return n, np.stack([*table, unlettered, size / some, entropy, np.where(size > 0, 5 - entropy, 0)], axis=1)


def votes(n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each labeller's vote on each row."""
    out = np.full(table.shape, ABSTAIN, dtype=np.int8)
    for k, (_, clean, poor, fewest) in enumerate(LABELLERS):
        enough = n >= fewest
        out[enough & (table[:, k] < clean), k] = CLEAN
        out[enough & (table[:, k] > poor), k] = POOR
    return out


_BASE = 3 ** np.arange(len(LABELLERS))


class LabelModel:
    """Accuracies of the labellers by expectation-maximisation over the counts of joint votes (3^10 rows at most).

    A text is clean or of one of ``POOR_KINDS`` kinds of poor; ``poor_vote[c, k]`` is the chance that labeller ``k``, if it votes, calls a text of
    class ``c`` poor.  All chances are estimated freely (one made-up vote each way keeps them off 0 and 1), the shares with the weight of
    ``PRIOR_TEXTS`` texts on what they start from; the class with the largest share is the clean one.  An abstention says nothing.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, rounds: int = 200):
        shown = _shown(codes)
        prior = self.share = np.array([0.85, *[0.15 / POOR_KINDS] * POOR_KINDS])
        self.poor_vote = np.full((1 + POOR_KINDS, len(LABELLERS)), 0.2)
        self.poor_vote[0] = 0.05
        for c, names in enumerate(_SEEN_BY, 1):
            self.poor_vote[c, [k for k, (name, *_) in enumerate(LABELLERS) if name in names]] = 0.7
        for _ in range(rounds if len(codes) else 0):
            w = self._classes(shown) * counts[:, None]
            self.share = (w.sum(axis=0) + PRIOR_TEXTS * prior) / (counts.sum() + PRIOR_TEXTS)
            got = np.einsum("ic,ijk->cjk", w, shown) + 1
            self.poor_vote = got[..., POOR] / (got[..., POOR] + got[..., CLEAN])
        first = np.argsort(-self.share, kind="stable")
        self.share, self.poor_vote = self.share[first], self.poor_vote[first]

    @property
    def clean(self) -> float:
        """Share of clean texts."""
        return float(self.share[0])

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Of each labeller: how often its votes on clean and on poor texts are right."""
        poor = self.share[1:] @ self.poor_vote[1:] / self.share[1:].sum()
        return {name: (float(1 - self.poor_vote[0, k]), float(poor[k])) for k, (name, *_) in enumerate(LABELLERS)}

    def _classes(self, shown: np.ndarray) -> np.ndarray:
        weigh = np.zeros((*self.poor_vote.shape, 3))
        weigh[..., POOR], weigh[..., CLEAN] = np.log(self.poor_vote), np.log(1 - self.poor_vote)
        z = np.log(self.share) + np.einsum("ijk,cjk->ic", shown, weigh)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is clean."""
        return self._classes(_shown(codes))[:, 0]


def _shown(codes: np.ndarray) -> np.ndarray:
    """Votes as ones: pattern x labeller x vote."""
    return np.eye(3)[(np.asarray(codes, dtype=np.int64)[:, None] // _BASE) % 3]


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_pieces(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(votes(*statistics(data, offsets)).astype(np.int64) @ _BASE, pa.int64())], names=["code"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in text_pieces(batch.column(0)):
            n, table = statistics(data, offsets)
            code = votes(n, table).astype(np.int64) @ _BASE
            bins = np.take_along_axis(_SLOTS.T, np.searchsorted(_EDGES, table), axis=0)
            slots, values = [], []
            for (s, share), own_bins in zip(gram_rows(*gram_slots(data, offsets)), bins, strict=True):
                slots.append(np.concatenate([s, own_bins]).tolist())
                values.append(np.concatenate([share * GRAM_SCALE, np.ones(len(own_bins))]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["code", "slots", "values"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[LabelModel, np.ndarray, float]:
    """(label model over all texts, scorer's weights, bias)."""
    counts = docs.select(text_col).mapInArrow(_codes, "code long").groupBy("code").count().collect()
    model = LabelModel(np.array([r["code"] for r in counts], dtype=np.int64), np.array([r["count"] for r in counts], dtype=np.float64))
    some = sampled(docs, id_col, text_col, sample_rows, sum(r["count"] for r in counts), "sample").select(text_col)
    rows = some.mapInArrow(_features, "code long, slots array<int>, values array<float>").toArrow()
    target = model.posterior(rows["code"].to_numpy()) if rows.num_rows else np.zeros(0)
    x = Sparse([np.array(s.as_py(), np.int64) for s in rows["slots"]], [np.array(v.as_py()) for v in rows["values"]], 1 << BITS)
    weight = 1 / max(1, len(target))
    w, b = fit(x, lambda z: (sigmoid(z) - target) * weight, rounds=150)
    return model, w, b


def with_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``OWN``-prefixed columns posterior (label model), score (linear scorer, 0 to 1) and keep (score >= 0.5).

    A text without words (null, empty) gets no votes, and the share of clean texts as score; it is kept.  Equal texts score
    equally.  An empty table gives no rows.
    """
    model, w, b = train(docs, id_col, text_col, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast((model, w.astype(np.float32), b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        model, w, b = shared.value
        for batch in batches:
            post, score = [], []
            for _, _, data, offsets in text_pieces(batch.column(0)):
                n, table = statistics(data, offsets)
                post.append(model.posterior(votes(n, table).astype(np.int64) @ _BASE))
                slots, bounds = gram_slots(data, offsets)
                mean = row_sums(w[slots], bounds) / np.maximum(np.diff(bounds), 1)
                bins = np.take_along_axis(_SLOTS.T, np.searchsorted(_EDGES, table), axis=0)
                score.append(np.where(n > 0, sigmoid(GRAM_SCALE * mean + w[bins].sum(axis=1) + b), model.clean))
            yield [pa.array(np.concatenate([*post, []])), pa.array(np.concatenate([*score, []]))]

    scored = with_text_columns(docs, "posterior double; score double", run, [text_col])
    return scored.withColumn(OWN + "keep", own("score") >= 0.5)
