"""Hard negatives by exact inner products in a residue number system, and windows over what the tasks select.

For a block of anchors, every task multiplies its rows' components modulo several small primes in single precision: centred
residues are so small that a whole sum stays below 2^24, so each product is exact.  Mixed-radix digits (Chinese remaindering) put
the signed score together; as many primes are taken as the largest product of norms needs.  The first pass selects each anchor's
positives, the second the negatives within the band of each positive; windows rank what the tasks select.

Rows without id, label or vector, or with a component that is null or not finite, take no part; repeated rows each count, but an
anchor id is asked once (see ``vectors``).  Ties go to the smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeflow.llm.store import Scratch
from rangeflow.llm.vectors import BLOCK_BYTES, EXACT, QUERIES, ROWS, Best, Block, blocks, exact_product, norms, packed, query_rows, whole_vectors, widened

#: Components that are summed before a reduction; narrower vectors allow larger primes.
_WIDE = 4096


def moduli(width: int, bound: float) -> list[int]:
    """The largest primes for exact single-precision sums of ``width`` products, enough to tell all scores up to ``bound``."""
    half = isqrt(((1 << 24) - 1) // max(1, min(width, _WIDE)))
    found: list[int] = []
    reach, p = 1, min(2 * half + 1, 4095)
    while reach <= 2 * bound + 1 or len(found) < 2:
        if all(p % d for d in range(2, isqrt(p) + 1)):
            found.append(p)
            reach *= p
        p -= 1
    return found


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2 of whole numbers below 2^52."""
    return x - p * np.rint(x / p)


def residue_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    bound = float(norms(a).max(initial=0)) * float(norms(b).max(initial=0)) * (1 + 1e-9)
    primes = moduli(a.shape[1], bound) if np.isfinite(bound) and bound < EXACT / 4096 else []
    if not primes or np.abs(a).max(initial=0) >= EXACT or np.abs(b).max(initial=0) >= EXACT:
        return exact_product(a, b)
    score, reach = np.zeros((len(a), len(b))), 1
    for p in primes:
        ra, rb = centred(a, p).astype(np.float32), centred(b, p).astype(np.float32)
        total = np.zeros((len(a), len(b)))
        for k in range(0, a.shape[1], _WIDE):
            total += centred((ra[:, k : k + _WIDE] @ rb[:, k : k + _WIDE].T).astype(np.float64), p)
        digit = centred(centred(total - score, p) * pow(reach, -1, p), p)
        score += reach * digit
        reach *= p
    return score.astype(np.int64)


def _streamed(batches: Iterator[pa.RecordBatch], scale: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, components) of at most ``ROWS`` rows at a time; the batches hold id, label and vector."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            kept, matrix = whole_vectors(part.column(2), scale)
            if len(kept):
                ids, labels = (part.column(k).take(pa.array(kept)).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                yield ids, labels, widened(matrix, width)


def _positives(block: Block, scale: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Block = block.value
        best = Best(len(held.ids), k)
        for ids, labels, matrix in _streamed(batches, scale, held.matrix.shape[1]):
            for q in range(0, len(held.ids), QUERIES):
                mine, label = held.ids[q : q + QUERIES, None], held.labels[q : q + QUERIES, None]
                best.add_table(q, residue_product(held.matrix[q : q + QUERIES], matrix), (label == labels) & (mine != ids), ids)
        yield pa.RecordBatch.from_pydict({"anchor": best.key, "positive_id": best.id, "positive_score": best.score})

    return run


def _negatives(block: Block, found, scale: int, k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Block = block.value
        anchor, positive, score = found.value  # by anchor, then rank; at least one
        first, last = np.full(len(held.ids), np.iinfo(np.int64).max), np.full(len(held.ids), np.iinfo(np.int64).min)
        least = np.array([-(-low * int(s) // high) for s in score], dtype=np.int64)  # the smallest score in the band
        np.minimum.at(first, anchor, least)
        np.maximum.at(last, anchor, score)
        start, stop = np.searchsorted(anchor, np.arange(len(held.ids))), np.searchsorted(anchor, np.arange(len(held.ids)), side="right")
        best = Best(len(anchor), k)
        for ids, labels, matrix in _streamed(batches, scale, held.matrix.shape[1]):
            for q in range(0, len(held.ids), QUERIES):
                scores = residue_product(held.matrix[q : q + QUERIES], matrix)
                mine, label = held.ids[q : q + QUERIES, None], held.labels[q : q + QUERIES, None]
                inside = (scores >= first[q : q + QUERIES, None]) & (scores <= last[q : q + QUERIES, None])
                a, r = np.nonzero(inside & (label != labels) & (mine != ids))
                got, a = scores[a, r], a + q
                for j in range(int((stop - start).max(initial=0))):
                    pair = start[a] + j
                    fits = np.flatnonzero(pair < stop[a])
                    fits = fits[(got[fits] >= least[pair[fits]]) & (got[fits] <= score[pair[fits]])]
                    best.add(pair[fits], got[fits], ids[r[fits]])
        yield pa.RecordBatch.from_pydict({
            "anchor_id": held.ids[anchor[best.key]], "pair": best.key, "positive_id": positive[best.key], "positive_score": score[best.key],
            "negative_id": best.id, "negative_score": best.score,
        })

    return run


def hard_negatives(
    rows: DataFrame, anchors: Column, *, id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5,
    negatives: int = 5, low: int = 80, high: int = 100, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each anchor's first positives, and for each the first other-label rows with ``low * positive <= high * negative <= high * positive``.

    ``anchors`` chooses the anchor rows; ids and labels are whole numbers.  Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    context = spark.sparkContext
    table = rows.where(F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), anchors.alias("asked"))
    chunks = scratch.write(packed(query_rows(table, F.col("asked"), ["id", "label", "vector"]), scale), "anchors")
    fed = table.select("id", "label", "vector")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = spark.createDataFrame([], schema)
    made = []
    for n, block in enumerate(blocks(chunks, block_bytes)):
        sent = context.broadcast(block)
        near = fed.mapInArrow(_positives(sent, scale, positives), "anchor long, positive_id long, positive_score long")
        place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
        near = near.withColumn("place", place).where(F.col("place") <= positives).toArrow().sort_by([("anchor", "ascending"), ("place", "ascending")])  # at most ``positives`` rows an anchor of the block
        if near.num_rows:
            pairs = context.broadcast(tuple(near.column(c).to_numpy().astype(np.int64) for c in ("anchor", "positive_id", "positive_score")))
            found = fed.mapInArrow(_negatives(sent, pairs, scale, negatives, low, high), "anchor_id long, pair long, positive_id long, positive_score long, negative_id long, negative_score long")
            rank = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("negative_score"), "negative_id"))
            made.append(f"found{n}")
            scratch.write(found.withColumn("rank", rank).where(F.col("rank") <= negatives).select(*out.columns), made[-1])
            pairs.unpersist()
        sent.unpersist()
    return spark.read.schema(out.schema).parquet(*[f"{scratch.root}/{m}" for m in made]) if made else out
