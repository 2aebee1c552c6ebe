"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks chunk ends; normalised chunking asks for more hash bits before a chunk's normal size
and fewer after it.  A fingerprint is the set of chunk digests with their lengths: an insertion shifts bytes but changes only
the chunks it touches.  The likeness of one fingerprint to another is the share of its length that lies in common chunks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeflow.llm.store import Scratch
from rangeflow.llm.text import U64, mix, span_hashes, text_pieces

SMALLEST, NORMAL, LARGEST = 32, 64, 256
_BEFORE, _AFTER = np.uint32(0x7F << 25), np.uint32(0x1F << 27)
_GEAR = (mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407)) >> U64(32)).astype(np.uint32)
#: Bytes of text in one range of ids.
RANGE_BYTES = 16 << 20


def _ends(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Places after which a chunk may end: before its normal size, and after it."""
    h = _GEAR[data]
    step = 1
    while step < 32:  # doubling: the hash of 2k bytes from two hashes of k bytes
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return np.flatnonzero((h & _BEFORE) == 0).tolist(), np.flatnonzero((h & _AFTER) == 0).tolist()


def chunk_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of each row the sorted distinct chunks: 48 bits of digest, 16 bits of length.

    The hash looks back no further than the smallest chunk, so a row's chunks depend on its own bytes only.
    """
    strict, loose = _ends(data) if len(data) >= 32 else ([], [])
    start, row = [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        while a < b:
            start.append(a)
            cut = b
            if b - a > SMALLEST:
                normal = min(a + NORMAL, b)
                k = bisect_left(strict, a + SMALLEST)
                if k < len(strict) and strict[k] < normal:
                    cut = strict[k] + 1
                else:
                    k = bisect_left(loose, normal)
                    cut = min(loose[k] + 1 if k < len(loose) else b, a + LARGEST, b)
            a = cut
        row.append(len(start))
    if not start:
        return [np.zeros(0, dtype=U64)] * (len(offsets) - 1)
    begin = np.array(start, dtype=np.int64)
    end = np.append(begin[1:], offsets[-1])
    key = (span_hashes(data, begin, end) >> U64(16) << U64(16)) | (end - begin).astype(U64)
    return [np.unique(key[i:j]) for i, j in zip(row[:-1], row[1:], strict=True)]


def as_text(chunks: np.ndarray) -> str:
    """16 hexadecimal digits a chunk: 12 of its digest, 4 of its length; empty for an empty text."""
    return chunks.astype(">u8").tobytes().hex()


def containment(own: np.ndarray, other: np.ndarray) -> float:
    """Share of a fingerprint's length in the other one; an empty one is in itself only."""
    if not len(own):
        return float(not len(other))
    length = (own & U64(0xFFFF)).astype(np.int64)
    if not len(other):
        return 0.0
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    return float(length[other[at] == own].sum() / length.sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and fingerprint of the whole text (null: empty).  Repeated rows each have theirs; no rows give none.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [as_text(c) for _, _, data, offsets in text_pieces(batch.column(1)) for c in chunk_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, fingerprint string")


def _compared(now: bytes, then: bytes) -> tuple[int, str, np.ndarray]:
    """(code points, SHA-256 of the edited text, its bytes) of a text and the next one."""
    x, y = np.frombuffer(now, np.uint8), np.frombuffer(then, np.uint8)
    points = np.flatnonzero((x & 0xC0) != 0x80)
    half = len(points) // 2
    if half:
        starts = np.flatnonzero((y & 0xC0) != 0x80)
        x = np.concatenate([x[: points[len(points) - half]], y[: starts[half]] if len(starts) > half else y])
    return len(points), hashlib.sha256(x.tobytes()).hexdigest(), x


_NAMES = ["id", "part", "edge", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text"]
_KINDS = "part int, edge int, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
FIRST, LAST = 0, 1


def _results(pairs: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    """Finished rows of (id, text, chunks, next text, next chunks)."""
    seen = [_compared(now, then) for _, now, _, then, _ in pairs]
    new = chunk_sets(np.concatenate([e for _, _, e in seen]), np.concatenate([[0], np.cumsum([len(e) for _, _, e in seen])]))
    n, blank = len(pairs), pa.nulls(len(pairs), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], id_type), blank, blank, pa.array([k for k, _, _ in seen], pa.int64()), pa.array([h for _, h, _ in seen]),
         pa.array([p[2].astype(">u8").tobytes() for p in pairs], pa.binary()), pa.array([c.astype(">u8").tobytes() for c in new], pa.binary()),
         pa.array([containment(p[2], c) for p, c in zip(pairs, new, strict=True)]), pa.array([containment(p[2], p[4]) for p in pairs]), pa.nulls(n, pa.string())],
        names=_NAMES,
    )


def _edge(part: int, edge: int, name: object, text: bytes, id_type: pa.DataType) -> pa.RecordBatch:
    columns = {"id": pa.array([name], id_type), "part": pa.array([part], pa.int32()), "edge": pa.array([edge], pa.int32()), "text": pa.array([text.decode("utf-8", "replace")])}
    kinds = [id_type, pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string()]
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(1, k)) for c, k in zip(_NAMES, kinds, strict=True)], names=_NAMES)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_chars, the fingerprints of its text and of its edited text, and their likenesses.

    The edited text has the last floor(n_chars / 2) code points replaced by as many first ones (or all) of the next row's text,
    by ascending id (of any type that has an order; rows of one id by a hash of the text; a null id comes first; the first row
    follows the last).  Null text counts as empty.  Repeated rows each have their row; an empty table gives none; other columns
    are left out.

    Rows are dealt out in ranges and sorted; a range's rows meet their successors as they stream by.  Its first and its last row
    are handed on, two a range, and the last rows meet the next range's first ones by a small join.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = rows.select("id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "text")
    order = ["id", "h", "row"]
    ranged = keyed.repartitionByRange(max(1, total // RANGE_BYTES), *order).sortWithinPartitions(*order).select("id", "text")
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, id_type = TaskContext.get().partitionId(), None, None  # held: (id, text, chunks) of the row whose successor comes next
        for batch in batches:
            id_type = batch.schema.field(0).type
            names = batch.column(0).to_pylist()
            for a, b, data, offsets in text_pieces(batch.column(1)):
                own = chunk_sets(data, offsets)
                here = [(names[a + k], data[offsets[k] : offsets[k + 1]].tobytes(), own[k]) for k in range(b - a)]
                if held is None:
                    yield _edge(part, FIRST, here[0][0], here[0][1], id_type)
                chain = ([held] if held is not None else []) + here
                held = chain[-1]
                if len(chain) > 1:
                    yield _results([(*now, *then[1:]) for now, then in zip(chain[:-1], chain[1:], strict=True)], id_type)
        if held is not None:
            yield _edge(part, LAST, held[0], held[1], id_type)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field(0).type
            for name, now, then in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x, y = now.encode(), then.encode()
                own, other = (chunk_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (x, y))
                yield _results([(name, x, own, y, other)], id_type)

    schema = f"id {kind}, {_KINDS}"
    found = scratch.write(ranged.mapInArrow(run, schema), "found")
    edges = found.where("edge is not null")
    parts = edges.where(F.col("edge") == FIRST).select("part")  # one small row a range
    ahead = F.lead("part").over(Window.orderBy("part"))
    begin = parts.agg(F.min("part")).first()[0] or 0
    follows = parts.select("part", F.coalesce(ahead, F.lit(begin)).alias("next"))
    heads = edges.where(F.col("edge") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("then"))
    met = edges.where(F.col("edge") == LAST).join(follows, "part").join(heads, "next").select("id", "text", "then")
    done = found.where("edge is null").unionByName(met.mapInArrow(last, schema))
    as_hex = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return done.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", *as_hex, "near_edited", "near_next")
