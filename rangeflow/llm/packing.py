"""Hierarchical multi-length packing of documents into context windows.

Each document goes to the smallest context tier that holds it; what is longer than the longest tier fills whole windows
first, and its rest goes to a tier.  A tier's windows begin with its own documents, longest first; the gap that is left is
filled from shorter tiers with whole documents (one, or two, that fit exactly, else the longest that fits), and only a gap
that no document fits is filled with a cut one.  Every window is exactly full.

A task packs its rows in a stock of bounded size, so that small documents are at hand to fill gaps; what is left at its end,
less than one window, is its tail.  The tails of all tasks follow one another in windows of the longest tier.  Windows are
numbered, and dealt to step groups, by prefix sums of one small row per task and tier; no rows are shuffled but these.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeflow.llm.store import Scratch
from rangeflow.llm.text import text_pieces

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Windows of one step group hold about this many tokens together.
STEP_TOKENS = 1 << 19
#: Tokens that a task keeps in stock to choose from.
STOCK_TOKENS = 1 << 20
#: Lane totals (one per input partition and tier) are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_LANES = 1 << 18

TAIL = 0
_PACKED = "id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, lane long, tier int, window long, offset long, ids binary"
_PIECES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]


class Stock:
    """Pieces of documents by length, and the windows made of them.  A piece is (row, start, ids, tokens of its document)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = sorted(tiers, reverse=True)
        self.by_size: list[list] = [[] for _ in range(self.tiers[0] + 1)]
        self.there = np.zeros(self.tiers[0] + 1, dtype=bool)
        self.tokens = 0

    def put(self, piece: tuple) -> None:
        n = len(piece[2])
        if n:
            self.by_size[n].append(piece)
            self.there[n] = True
            self.tokens += n

    def take(self, n: int) -> tuple:
        piece = self.by_size[n].pop()
        self.there[n] = bool(self.by_size[n])
        self.tokens -= n
        return piece

    def longest(self, above: int, upto: int) -> int:
        """The largest length there is in (above, upto]; 0 for none."""
        some = np.flatnonzero(self.there[above + 1 : upto + 1])
        return int(some[-1]) + above + 1 if len(some) else 0

    def add(self, row: object, ids: np.ndarray) -> Iterator[tuple[int, list]]:
        """Takes a document in; yields the whole windows of one that is too long."""
        at, longest = 0, self.tiers[0]
        while len(ids) - at >= longest:
            yield longest, [(row, at, ids[at : at + longest], len(ids))]
            at += longest
        self.put((row, at, ids[at:].copy(), len(ids)))

    def fill(self, gap: int) -> tuple[list, int]:
        """Whole pieces for a gap, and what is left of it."""
        out = []
        while gap:
            if self.there[gap]:
                return [*out, self.take(gap)], 0
            both = np.flatnonzero(self.there[1:gap] & self.there[1:gap][::-1]) + 1
            both = both[(both * 2 != gap) | (np.array([len(self.by_size[k]) > 1 for k in both.tolist()], dtype=bool) if gap % 2 == 0 else True)]
            if len(both):
                k = int(both[-1])
                return [*out, self.take(k), self.take(gap - k)], 0
            n = self.longest(0, gap)
            if not n:
                break
            out.append(self.take(n))
            gap -= n
        return out, gap

    def windows(self, keep: int) -> Iterator[tuple[int, list]]:
        """(tier, pieces) of full windows, until at most ``keep`` tokens are in stock; a window that cannot be filled goes back."""
        for tier, below in zip(self.tiers, [*self.tiers[1:], 0], strict=True):
            while self.tokens > keep:
                n = self.longest(below, tier)
                if not n:
                    break
                first = self.take(n)
                more, gap = self.fill(tier - n)
                pieces = [first, *more]
                if gap:
                    larger = np.flatnonzero(self.there[gap + 1 :])
                    if not len(larger):
                        for piece in pieces:
                            self.put(piece)
                        return
                    row, start, ids, total = self.take(int(larger[0]) + gap + 1)
                    pieces.append((row, start, ids[:gap], total))
                    self.put((row, start + gap, ids[gap:], total))
                yield tier, pieces

    def rest(self) -> list:
        """All pieces left, longest first."""
        return [piece for pieces in reversed(self.by_size) for piece in pieces]


def pack_lanes(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, stock_tokens: int = STOCK_TOKENS) -> DataFrame:
    """Pieces of every whole text of (id, text) in the full windows of its task (lane), and the lane's tail with its ids (tier TAIL)."""
    kind = dict(docs.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rangeflow.llm.tokens import WordBpe

        bpe, lane, stock = WordBpe(tokenizer), TaskContext.get().partitionId(), Stock(tiers)
        made, rows = dict.fromkeys([TAIL, *tiers], 0), []

        def lay(tier: int, pieces: list) -> None:
            at = 0
            for row, start, ids, total in pieces:
                body = ids.astype("<u4")
                rows.append((row, start, len(ids), zlib.crc32(body), total, lane, tier, made[tier], at, body.tobytes() if tier == TAIL else None))
                at += len(ids)
            made[tier] += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            arrays = [pa.array(c, t) for c, t in zip(columns, [id_type, *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.int64(), pa.binary()], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens", "lane", "tier", "window", "offset", "ids"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            names = batch.column(0).to_pylist()
            for a, b, data, offsets in text_pieces(batch.column(1)):
                ids, bound = bpe.texts(data, offsets)
                whole = np.insert(ids, bound[1:], END_ID)
                cuts = bound + np.arange(len(bound))
                for k in range(b - a):
                    for window in stock.add(names[a + k], whole[cuts[k] : cuts[k + 1]]):
                        lay(*window)
                    if stock.tokens > stock_tokens:
                        for window in stock.windows(stock_tokens // 2):
                            lay(*window)
                    if len(rows) > 8192:
                        yield out()
        for window in stock.windows(0):
            lay(*window)
            if len(rows) > 8192:
                yield out()
        if stock.tokens:
            lay(TAIL, stock.rest())
        if rows:
            yield out()

    return docs.mapInArrow(run, _PACKED.format(id_type=kind))


def lane_starts(packed: DataFrame) -> DataFrame:
    """Per tier and lane the windows (tail: tokens) of the lanes before it: one small row per input partition and tier."""
    size = F.when(F.first("tier") == TAIL, F.sum("length")).otherwise(F.max("window") + 1)
    lanes = packed.groupBy("tier", "lane").agg(size.alias("lane_size"), F.sum("length").alias("lane_tokens"))
    before = Window.partitionBy("tier").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    return lanes.withColumn("lane_base", F.coalesce(F.sum("lane_size").over(before), F.lit(0)))


def pack(
    docs: DataFrame,
    tokenizer: str,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
    stock_tokens: int = STOCK_TOKENS,
) -> DataFrame:
    """Pieces of all documents in windows of the tiers' sizes.

    ``ids_crc32`` is over the piece's ids as little-endian 32-bit numbers.  Only the last window can be shorter than its size.
    ``step_group`` deals each tier's windows round robin, so that training steps have equal numbers of windows of every tier, but
    for one.  Null and empty texts have one token, the end id.  Repeated rows and ids are packed row by row.  An empty table
    gives no rows; other columns are left out.
    """
    scratch = Scratch(docs.sparkSession)
    packed = scratch.write(pack_lanes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tokenizer, tiers, stock_tokens), "packed")
    lanes = scratch.write(lane_starts(packed), "lanes")
    totals = {r["tier"]: (int(r["n"]), int(r["tokens"])) for r in lanes.groupBy("tier").agg(F.sum("lane_size").alias("n"), F.sum("lane_tokens").alias("tokens")).collect()}
    first, windows, longest = {}, 0, max(tiers)  # where each tier's windows are numbered from
    for tier in sorted(tiers, reverse=True):
        first[tier] = windows
        windows += totals.get(tier, (0, 0))[0]
    dealt = totals.get(longest, (0, 0))[0]
    groups = max(1, -(-sum(t for _, t in totals.values()) // step_tokens))
    starts = lanes.select("tier", "lane", "lane_base")
    if lanes.count() <= BROADCAST_LANES:
        starts = F.broadcast(starts)
    placed = packed.join(starts, ["tier", "lane"])

    number = F.col("lane_base") + F.col("window")
    base = F.element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), F.col("tier")).cast("long")
    full = placed.where(F.col("tier") != TAIL).select("id", "start", "length", "ids_crc32", "doc_tokens", (base + number).alias("sequence_id"), "offset", "tier", (number % groups).alias("step_group"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, rows = [], []
            for i, (start, total, place, held) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                ids = np.frombuffer(held, dtype="<u4")
                at = 0
                while at < len(ids):
                    window, offset = divmod(place + at, longest)
                    part = ids[at : at + longest - offset]
                    doc.append(i)
                    rows.append((start + at, len(part), zlib.crc32(part), total, windows + window, offset, longest, (dealt + window) % groups))
                    at += len(part)
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(_PIECES)).T
            arrays = [pa.array(c.astype(np.int32) if name == "tier" else c) for name, c in zip(_PIECES, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), *arrays], names=["id", *_PIECES])

    tails = placed.where(F.col("tier") == TAIL).select("id", "start", "doc_tokens", (F.col("lane_base") + F.col("offset")).alias("place"), "ids")
    rest = tails.mapInArrow(cut, full.schema)
    return full.unionByName(rest).withColumnRenamed("id", id_col)
