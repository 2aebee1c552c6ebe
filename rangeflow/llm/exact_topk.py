"""Exact top-k by inner product with bounds from segment statistics, coarse to fine.

A vector is cut into segments; each gives its mean and deviation, times the root of its length.  The squared distance of two such
lists is a lower bound of the vectors' squared distance, and both lists have the vectors' norms, so half of (sum of the squared norms less
the bound), which is the lists' inner product, is an upper bound of the score.  Levels of 1, 4 and 16 segments refute pairs of a query and a row that
cannot reach the query's k-th score so far (with a margin for rounding); survivors get their exact score.  Each task keeps the first
k rows of every query, and a window ranks what the tasks keep.

Rows without id or vector, or with a component that is null or not finite, take no part; repeated rows each count, but a query id is
asked once (see ``vectors``).  Ties go to the smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeflow.llm.store import Scratch
from rangeflow.llm.vectors import BLOCK_BYTES, EXACT, QUERIES, ROWS, Best, Block, blocks, exact_product, norms, packed, query_rows, whole_vectors, widened

#: Segments of the levels, coarse to fine.
LEVELS = (1, 4, 16)

#: Share of open pairs from which a whole product costs less than the pairs one by one, and pairs gathered at a time.
_DENSE, _PAIRS = 0.15, 1 << 18

#: Rounding margin of a bound, as a share of the product of the norms.
_MARGIN = 1e-9


def segment_statistics(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the rows' segments, times the root of the segments' lengths."""
    width = matrix.shape[1]
    segments = max(1, min(segments, width))
    if not width:
        return np.zeros((len(matrix), 2))
    cuts = np.arange(segments) * width // segments
    length = np.diff(np.r_[cuts, width])
    mean = np.add.reduceat(matrix, cuts, axis=1) / length
    spread = matrix - np.repeat(mean, length, axis=1)
    return np.hstack([mean * np.sqrt(length), np.sqrt(np.add.reduceat(spread * spread, cuts, axis=1))])


def _pairs(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", a[q[k : k + _PAIRS]], b[r[k : k + _PAIRS]]) for k in range(0, len(q), _PAIRS)] or [np.zeros(0)])


def _search(block, scale: int, k: int, tally: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Block = block.value
        width = held.matrix.shape[1]
        best = Best(len(held.ids), k)
        levels = [segment_statistics(held.matrix, s) for s in LEVELS]
        length = norms(held.matrix)
        met = np.zeros(len(LEVELS) + 1, dtype=np.int64)  # pairs that reach each level, and the exact score
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                kept, matrix = whole_vectors(part.column(1), scale)
                if not len(kept):
                    continue
                ids = part.column(0).take(pa.array(kept)).to_numpy(zero_copy_only=False).astype(np.int64)
                matrix = widened(matrix, width)
                own = norms(matrix)
                exact = np.isfinite(own).all() and np.isfinite(length).all() and length.max(initial=0) * own.max(initial=0) < EXACT
                rows = [segment_statistics(matrix, s) for s in LEVELS] if exact else []
                for at in range(0, len(held.ids), QUERIES):
                    few = slice(at, at + QUERIES)
                    other = held.ids[few, None] != ids
                    if not exact:
                        best.add_table(at, exact_product(held.matrix[few], matrix), other, ids)
                        continue
                    floor = best.floor[few].astype(np.float64)[:, None] - _MARGIN * length[few, None] * own - 1e-6
                    if (best.floor[few] == np.iinfo(np.int64).min).any():  # no k rows yet: nothing to refute by
                        met[-1] += other.sum()
                        best.add_table(at, (held.matrix[few] @ matrix.T).astype(np.int64), other, ids)
                        continue
                    met[0] += other.sum()
                    open_, q, r = other & (levels[0][few] @ rows[0].T >= floor), None, None
                    for n in range(1, len(LEVELS) + 1):
                        left, right = (levels[n][few], rows[n]) if n < len(LEVELS) else (held.matrix[few], matrix)
                        if q is None and open_.mean() > _DENSE:
                            met[n] += open_.sum()
                            value = left @ right.T
                            if n == len(LEVELS):
                                best.add_table(at, value.astype(np.int64), open_, ids)
                            else:
                                open_ &= value >= floor
                            continue
                        if q is None:
                            q, r = np.nonzero(open_)
                        met[n] += len(q)
                        value = _pairs(left, right, q, r)
                        if n == len(LEVELS):
                            best.add(q + at, value.astype(np.int64), ids[r])
                        else:
                            able = value >= floor[q, r]
                            q, r = q[able], r[able]
        if tally:
            yield pa.RecordBatch.from_pydict({"level": np.arange(len(met)), "pairs": met})
        else:
            yield pa.RecordBatch.from_pydict({"query_id": held.ids[best.key], "vec_id": best.id, "score": best.score})

    return run


def _passes(rows: DataFrame, queries: Column, id: str, vector: str, scale: int, block_bytes: int, scratch: Scratch):
    table = rows.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.lit(0).cast("long").alias("label"), F.col(vector).alias("vector"), queries.alias("asked"))
    chunks = scratch.write(packed(query_rows(table, F.col("asked"), ["id", "label", "vector"]), scale), "queries")
    fed = table.select("id", "vector")
    for block in blocks(chunks, block_bytes):
        sent = rows.sparkSession.sparkContext.broadcast(block)
        yield fed, sent
        sent.unpersist()


def top_products(
    rows: DataFrame, queries: Column, *, id: str = "vec_id", vector: str = "embedding", scale: int = 64, k: int = 20, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The ``k`` other rows of the highest inner product for each row that ``queries`` chooses: query_id, rank, vec_id, score."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    schema = "query_id long, rank int, vec_id long, score long"
    out, made = spark.createDataFrame([], schema), []
    for fed, sent in _passes(rows, queries, id, vector, scale, block_bytes, scratch):
        found = fed.mapInArrow(_search(sent, scale, k, False), "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        made.append(f"found{len(made)}")
        scratch.write(found.withColumn("rank", rank).where(F.col("rank") <= k).select(*out.columns), made[-1])
    return spark.read.schema(out.schema).parquet(*[f"{scratch.root}/{m}" for m in made]) if made else out


def pairs_met(rows: DataFrame, queries: Column, *, id: str = "vec_id", vector: str = "embedding", scale: int = 64, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """How many pairs reach each level of bounds, and the exact score (the last level): level, pairs."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    made = []
    for fed, sent in _passes(rows, queries, id, vector, scale, block_bytes, scratch):
        made.append(f"met{len(made)}")
        scratch.write(fed.mapInArrow(_search(sent, scale, k, True), "level long, pairs long"), made[-1])
    met = spark.read.parquet(*[f"{scratch.root}/{m}" for m in made]) if made else spark.createDataFrame([], "level long, pairs long")
    return met.groupBy("level").agg(F.sum("pairs").alias("pairs"))
