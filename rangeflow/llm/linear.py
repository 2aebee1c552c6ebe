"""Hashed byte n-gram features and linear fits on bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeflow.llm.text import U64

BITS = 16


def gram_slots(data: np.ndarray, offsets: np.ndarray, width: int = 3, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hash slot of every byte n-gram that lies within a row, and n + 1 bounds of the rows' n-grams."""
    n = len(data)
    size = np.maximum(np.diff(offsets) - width + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(size)])
    if n < width:
        return np.zeros(0, dtype=np.int64), bounds
    x = data.astype(np.uint32)
    key = x[: n - width + 1].copy()
    for k in range(1, width):
        key *= np.uint32(0x01000193)
        key += x[k : n - width + 1 + k]
    slot = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    inside = np.ones(len(slot), dtype=bool)
    for k in range(1, width):
        cut = offsets[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(inside))]] = False
    return slot[inside].astype(np.int64), bounds


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; 0 for a row without any."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Bytes of the longest text that a sample takes, so that what is fitted on is bounded in rows and bytes.
SAMPLE_BYTES = 1 << 15


def sampled(docs: DataFrame, id_col: str, text_col: str, rows: int, total: int, salt: str) -> DataFrame:
    """About ``rows`` of ``total`` rows, twice as many at most, the same ones each time: by a hash of the id and the text.

    Only texts of at most SAMPLE_BYTES bytes are taken.  The limit binds only where one row is repeated many times.
    """
    fits = docs.where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= SAMPLE_BYTES)
    if total <= rows:
        return fits.limit(2 * rows)
    share = int(1_000_000 * rows / total) + 1
    return fits.where(F.pmod(F.xxhash64(F.col(id_col), F.xxhash64(text_col), F.lit(salt)), F.lit(1_000_000)) < share).limit(2 * rows)


class Sparse:
    """Rows of (slot, value) pairs one after another."""

    def __init__(self, slots: list[np.ndarray], values: list[np.ndarray], size: int):
        self.row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
        self.slot = np.concatenate(slots) if slots else np.zeros(0, np.int64)
        self.value = np.concatenate(values) if values else np.zeros(0)
        self.n, self.size = len(slots), size

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.slot] * self.value, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.slot, g[self.row] * self.value, self.size)


def fit(x: Sparse, slope, rounds: int = 80, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by adaptive gradient steps; ``slope(margins)`` gives the loss's slope at each row's margin."""
    w, b = np.zeros(x.size), 0.0
    seen, seen_b = np.full(x.size, 1e-8), 1e-8
    for _ in range(rounds):
        g = slope(x.dot(w) + b)
        gw, gb = x.back(g) + ridge * w, float(g.sum())
        seen += gw * gw
        seen_b += gb * gb
        w -= rate * gw / np.sqrt(seen)
        b -= rate * gb / np.sqrt(seen_b)
    return w, b


def gram_rows(slots: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct slots of each row with their share of the row's n-grams."""
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        s, c = np.unique(slots[a:b], return_counts=True)
        out.append((s, c / max(1, b - a)))
    return out


_SALT = U64(0xC2B2AE3D27D4EB4F)


def named_slot(name: str, bits: int = BITS) -> int:
    """The slot of a named feature."""
    h = U64(14695981039346656037)
    with np.errstate(over="ignore"):
        for c in name.encode():
            h = (h ^ U64(c)) * U64(1099511628211)
        return int((h * _SALT) >> U64(64 - bits))
