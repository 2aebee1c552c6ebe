"""Whole-number vectors in blocks: a block of queries of bounded size goes to every task, which streams its rows past it.

A row takes part if its id and vector are given and every component is given and finite.  A component ``x`` becomes
``floor(scale * x)`` as a double.  Vectors of unlike lengths are multiplied as if the shorter one ended in zeros.  An id that
stands in several query rows is asked once, with the smallest of its rows; on the other side every row counts for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of one packed row of queries, and of the queries that one pass sends to every task.
CHUNK_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20

#: Rows and queries that meet in one product inside a task.
ROWS, QUERIES = 4096, 512

#: Products of norms below this are exact in doubles.
EXACT = float(1 << 52)

_LEAST = np.iinfo(np.int64).min


def whole_vectors(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the rows that take part, their whole-number components as a matrix of doubles)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column)
    flat = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    fine = ~np.asarray(pc.is_null(column).to_numpy(zero_copy_only=False), dtype=bool)
    fine[owner[~np.isfinite(flat)]] = False
    width = int(lengths[fine].max(initial=0))
    with np.errstate(over="ignore"):
        flat = np.floor(scale * flat)
    fine[owner[~np.isfinite(flat)]] = False
    if len(lengths) and (lengths == width).all() and fine.all():
        return np.arange(len(lengths)), flat.reshape(len(lengths), width)
    matrix = np.zeros((len(lengths), width))
    used = fine[owner]
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    matrix[owner[used], place[used]] = flat[used]
    kept = np.flatnonzero(fine)
    return kept, matrix[kept]


def widened(matrix: np.ndarray, width: int) -> np.ndarray:
    """The matrix with ``width`` columns: zeros are added, columns beyond meet nothing."""
    if matrix.shape[1] >= width:
        return np.ascontiguousarray(matrix[:, :width])
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


@dataclass
class Block:
    """Queries of one pass: ids, labels and components."""

    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray


def query_rows(rows: DataFrame, chosen: Column, columns: list[str]) -> DataFrame:
    """The chosen rows, one for each id (``columns`` begin with it)."""
    first, *rest = columns
    picked = rows.where(chosen & F.col(first).isNotNull())
    return picked.groupBy(first).agg(F.min(F.struct(*rest)).alias("_row")).select(first, *[F.col(f"_row.{c}").alias(c) for c in rest])


def packed(queries: DataFrame, scale: int) -> DataFrame:
    """Queries (id, label, vector) in rows of about ``CHUNK_BYTES``, vectors that take no part left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, matrix = whole_vectors(batch.column(2), scale)
            ids, labels = (batch.column(k).take(pa.array(kept)).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            step = max(1, CHUNK_BYTES // (8 * max(1, matrix.shape[1])))
            for a in range(0, len(kept), step):
                part = [x[a : a + step].tobytes() for x in (ids, labels, matrix)]
                yield pa.RecordBatch.from_pydict({"width": pa.array([matrix.shape[1]], pa.int32()), **{n: pa.array([x], pa.binary()) for n, x in zip(("ids", "labels", "body"), part)}})

    return queries.mapInArrow(pack, "width int, ids binary, labels binary, body binary")


def blocks(chunks: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of at most ``limit`` bytes (one packed row at least), read one partition after another."""
    held: list[Block] = []
    size = 0
    for row in chunks.toLocalIterator():
        ids = np.frombuffer(row.ids, dtype=np.int64)
        body = np.frombuffer(row.body, dtype=np.float64).reshape(len(ids), row.width)
        if held and size + len(row.body) > limit:
            yield _joined(held)
            held, size = [], 0
        held.append(Block(ids, np.frombuffer(row.labels, dtype=np.int64), body))
        size += len(row.body)
    if held:
        yield _joined(held)


def _joined(parts: list[Block]) -> Block:
    width = max(p.matrix.shape[1] for p in parts)
    return Block(np.concatenate([p.ids for p in parts]), np.concatenate([p.labels for p in parts]), np.concatenate([widened(p.matrix, width) for p in parts]))


def norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", matrix, matrix))


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products beyond the doubles' reach, in Python's whole numbers; an error where one does not fit 64 bits."""
    out = np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], dtype=object).reshape(b.shape).T
    if out.size and max(abs(int(out.max())), abs(int(out.min()))) >= 1 << 63:
        raise OverflowError("an inner product does not fit 64 bits")
    return out.astype(np.int64)


class Best:
    """The first ``k`` rows of each key by score descending, then id ascending, among those a task has seen."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.key, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.floor = np.full(keys, _LEAST)  # the k-th score, once k rows are known

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        able = score >= self.floor[key]
        if not able.any():
            return
        key, score, ids = (np.concatenate([old, new[able]]) for old, new in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        self.floor[key[rank == self.k - 1]] = score[rank == self.k - 1]
        kept = rank < self.k
        self.key, self.score, self.id = key[kept], score[kept], ids[kept]

    def add_table(self, at: int, scores: np.ndarray, valid: np.ndarray, ids: np.ndarray) -> None:
        """Scores of keys ``at``, ``at`` + 1 ... by the rows ``ids``, where ``valid``."""
        least = self.floor[at : at + len(scores)].copy()
        open_ = np.flatnonzero(least == _LEAST)
        if len(open_) and scores.shape[1] > self.k:
            cut = scores.shape[1] - self.k
            least[open_] = np.partition(np.where(valid[open_], scores[open_], _LEAST), cut, axis=1)[:, cut]
        q, r = np.nonzero(valid & (scores >= least[:, None]))
        self.add(q + at, scores[q, r], ids[r])
