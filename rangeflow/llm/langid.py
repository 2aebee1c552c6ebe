"""Language identification in two steps: the family, then the language within it.

Both steps are linear support vector machines over hashed byte trigrams of the text's letters, one for each pair (of families,
and of languages of one family); the pairs vote with their margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeflow.llm.linear import BITS, SAMPLE_BYTES, Sparse, fit, gram_rows, gram_slots, row_sums, sigmoid
from rangeflow.llm.rows import with_text_columns
from rangeflow.llm.text import byte_table, text_pieces

#: Labelled texts of each language that the machines are fitted on, at most about (twice as many of all together).
SAMPLE_ROWS = 500
GRAM_SCALE = 30.0
UNKNOWN = "und"
#: Families of common languages by ISO 639-1 code; other codes share a family by their first letter, so that pairs stay few.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTERS = byte_table("letters")


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, f"other {lang[:1]}")


class Machines:
    """One linear machine for each pair of families, and of languages of a family."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        self.members: dict[str, list[str]] = {}
        for lang in self.langs:
            self.members.setdefault(family_of(lang), []).append(lang)
        self.families = sorted(self.members)
        self.pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = {}
        for group, name in [(self.families, family_of), *[(m, str) for m in self.members.values()]]:
            for a, b in combinations(group, 2):
                self.pairs[a, b] = self._fit([(1.0 if name(lang) == a else -1.0, s, v) for lang, s, v in rows if name(lang) in (a, b)])

    @staticmethod
    def _fit(rows: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
        y = np.array([r[0] for r in rows])
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
        x = Sparse([r[1] for r in rows], [r[2] * GRAM_SCALE for r in rows], 1 << BITS)
        w, b = fit(x, lambda z: np.where(y * z < 1, -y, 0.0) * weight, rounds=60)
        return w.astype(np.float32), b

    def predict(self, slots: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language of each row, and how sure (0 to 1)."""
        n = len(bounds) - 1
        some = np.maximum(np.diff(bounds), 1)
        margin = {p: GRAM_SCALE * row_sums(w[slots], bounds) / some + b for p, (w, b) in self.pairs.items()}

        def vote(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
            wins, worst = np.zeros((len(group), n)), np.full((len(group), n), 40.0)
            for i, j in combinations(range(len(group)), 2):
                m = margin[group[i], group[j]]
                wins[i] += sigmoid(4 * m)
                wins[j] += sigmoid(-4 * m)
                worst[i], worst[j] = np.minimum(worst[i], m), np.minimum(worst[j], -m)
            best = wins.argmax(axis=0)
            return best, sigmoid(2 * worst[best, np.arange(n)])

        family, sure = vote(self.families)
        lang, score = [""] * n, np.zeros(n)
        for f, name in enumerate(self.families):
            best, within = vote(self.members[name])
            for k in np.flatnonzero(family == f).tolist():
                lang[k], score[k] = self.members[name][best[k]], sure[k] * within[k]
        return lang, score


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Machines | None:
    """Machines from texts with a language: about ``sample_rows`` of each, of at most ``sample_bytes`` bytes, by a hash of the id and the text; None without any.

    A language that only longer texts have is learned from the shortest of them.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    size = F.octet_length(text_col)
    counts = known.groupBy(lang_col).agg(F.count_if(size <= sample_bytes).alias("n")).collect()
    if not counts:
        return None
    short = [r for r in counts if r["n"]]
    fits = known.where(size <= sample_bytes)
    if short:
        share = F.element_at(F.create_map(*[F.lit(x) for r in short for x in (r[lang_col], int(1_000_000 * sample_rows / r["n"]) + 1)]), F.col(lang_col))
        fits = fits.where(F.pmod(F.xxhash64(F.col(id_col), F.xxhash64(text_col), F.lit("lang")), F.lit(1_000_000)) < share)
    chosen = fits.limit(2 * sample_rows * len(counts)).select(F.col(lang_col).alias("lang"), text_col)
    if len(short) < len(counts):
        long = known.where(F.col(lang_col).isin([r[lang_col] for r in counts if not r["n"]]))
        chosen = chosen.unionByName(long.groupBy(F.col(lang_col).alias("lang")).agg(F.min_by(text_col, F.struct(size, text_col)).alias(text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_pieces(batch.column(1)):
                rows = gram_rows(*gram_slots(_LETTERS[data], offsets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([s.astype(np.int32).tobytes() for s, _ in rows], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary())],
                    names=["lang", "slots", "shares"],
                )

    found = chosen.mapInArrow(run, "lang string, slots binary, shares binary").toArrow()
    rows = [(r["lang"], np.frombuffer(r["slots"], np.int32).astype(np.int64), np.frombuffer(r["shares"], np.float32)) for r in found.to_pylist()]
    return Machines(rows) if rows else None


def with_language(docs: DataFrame, machines: Machines | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``OWN``-prefixed columns lang_pred and score; ``und`` and 0 for a null text or one without letters.

    Equal texts are named alike; of equal votes the first language by code wins; repeated rows and extra columns stay as they
    are; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        machines = shared.value
        for batch in batches:
            lang, score = [], [np.zeros(0)]
            for a, b, data, offsets in text_pieces(batch.column(0)):
                low = _LETTERS[data]
                letter = np.concatenate([[0], np.cumsum((low > 0) & (data < 0x80))])
                plain = letter[offsets[1:]] > letter[offsets[:-1]]
                known, sure = machines.predict(*gram_slots(low, offsets)) if machines else ([UNKNOWN] * (b - a), np.zeros(b - a))
                for k in np.flatnonzero(~plain).tolist():
                    if not any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")):
                        known[k], sure[k] = UNKNOWN, 0.0
                lang += known
                score.append(sure)
            yield [pa.array(lang, pa.string()), pa.array(np.concatenate(score))]

    return with_text_columns(docs, "lang_pred string; score double", run, [text_col])
