"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of 13 consecutive words of a benchmark item (a shorter item is one window of its own length).  For
each pattern length, a shift table over blocks of two words tells how far a block lies from the nearest pattern end; a block
in no pattern lets the search skip every window that holds it.  Blocks are probed at the stride of that longest skip,
so each window holds exactly one probe; probes that hit give candidate ends.  A candidate's suffix block names a bucket of windows that end
alike, the words before it select test windows there, and the words' bytes are compared.  Equal windows are one, with a list of items, so
a window that many items share is compared once.  The benchmark is broadcast in blocks of a checked size, as flat arrays of about five times its
bytes; texts meet blocks in narrow passes, which hand on what they hit and no texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeflow.llm.rows import OWN, own, with_text_columns
from rangeflow.llm.store import Scratch
from rangeflow.llm.text import U64, Words, byte_table, mix, string_buffers, text_pieces, window_hashes

WINDOW = 13
#: Bytes of benchmark text broadcast at once; more are searched for in further narrow passes over the documents.
BLOCK_BYTES = 8 << 20
_SHIFT_BITS = 18


def _joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space between them, and each word's span there."""
    kept = words.low != 0
    begin = np.cumsum(kept)
    spaces = np.arange(len(words))
    size = words.end - words.start
    start = (begin[words.start] - 1 + spaces) if len(words) else np.zeros(0, np.int64)
    out = np.full((int(begin[-1]) if len(begin) else 0) + len(words), 0x20, dtype=np.uint8)
    if len(words):
        which = np.repeat(spaces, size)
        out[np.arange(len(which)) + which] = words.low[kept]
    return out, start, start + size


class Patterns:
    """Shift tables and suffix buckets of one block of the benchmark, in flat arrays.

    ``names`` are the items (None for one without an id).  Of each pattern length there are the shift table, the hashes of the suffix blocks (sorted;
    each a bucket), and for every different window its key (bucket and hash of the words before the suffix, sorted), where it begins and ends in
    ``joined``, and the run of its items.
    """

    def __init__(self, ids: list, texts: list[str | None], width: int = WINDOW):
        self.names = [None if i is None else str(i) for i in ids]
        data, offsets = string_buffers(pa.array(texts, pa.string()))
        words = Words(data, offsets, byte_table("alnum"))
        h = words.hashes()
        self.joined, start, end = _joined(words)
        begin, count = words.row[:-1], np.diff(words.row)
        self.groups: dict[int, dict] = {}
        for m in sorted({min(width, n) for n in count.tolist()} - {0}):
            mine = np.flatnonzero(np.minimum(count, width) == m)
            windows = count[mine] - m + 1
            item = np.repeat(mine, windows)
            first = np.repeat(begin[mine] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
            self.groups[m] = self._tables(m, h, first, start[first], end[first + m - 1], item)

    @staticmethod
    def blocks(hashes: np.ndarray, size: int) -> np.ndarray:
        return mix(hashes) if size == 1 else mix(hashes[..., :-1] * U64(3) + (hashes[..., 1:] ^ U64(0x5851F42D4C957F2D)) * U64(5))

    def _tables(self, m: int, h: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> dict:
        size = min(2, m)
        block = (self.blocks(h, size) >> U64(64 - _SHIFT_BITS)).astype(np.int64)
        skip = np.full(1 << _SHIFT_BITS, m - size + 1, dtype=np.int16)
        for j in range(m - size + 1):
            np.minimum.at(skip, block[first + j], m - size - j)
        suffixes = np.unique(self.blocks_at(h, first + m - size, size))
        key = self._keys(h, first, m, size, suffixes)
        order = np.argsort(key, kind="stable")
        key, start, end, item = key[order], start[order].astype(np.int32), end[order].astype(np.int32), item[order].astype(np.int32)
        head = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, dtype=bool)
        text = lambda k: self.joined[start[k] : end[k]].tobytes()
        for k in np.flatnonzero(~head).tolist():  # equal keys whose words differ are windows of their own
            head[k] = text(k) != text(k - 1)
        at = np.flatnonzero(head)
        return {"size": size, "skip": skip, "suffixes": suffixes, "keys": key[at], "start": start[at], "end": end[at], "items": item, "runs": np.r_[at, len(key)]}

    def blocks_at(self, h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the blocks that begin at the given words."""
        return self.blocks(h[at[:, None] + np.arange(size)], size).reshape(len(at))

    def _keys(self, h: np.ndarray, first: np.ndarray, m: int, size: int, suffixes: np.ndarray) -> np.ndarray:
        """Bucket (the place of the suffix block among ``suffixes``) and 40 bits of the hash of the words before it."""
        bucket = np.searchsorted(suffixes, self.blocks_at(h, first + m - size, size)).astype(U64)
        prefix = _hash_of(h, first, m - size) if m > size else np.zeros(len(first), dtype=U64)
        return (bucket << U64(40)) | (prefix >> U64(24))

    def search(self, m: int, h: np.ndarray, bounds: np.ndarray, joined: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the occurrences of patterns of m words, and the window that each is."""
        g = self.groups[m]
        size, skip = g["size"], g["skip"]
        stride = m - size + 1
        counts = np.diff(bounds)
        probes = np.where(counts >= m, (counts - size) // stride + 1, 0)
        upto = np.cumsum(probes) - probes
        total, none = int(probes.sum()), np.zeros(0, np.int64)
        if not total:
            return none, none
        row = np.repeat(np.arange(len(counts)), probes)
        at = bounds[row] + (np.arange(total) - upto[row]) * stride
        slot = (self.blocks(h, size) >> U64(64 - _SHIFT_BITS)).astype(np.int64)
        far = skip[slot[at]]
        some = far < stride
        at, row, far = at[some], row[some], far[some].astype(np.int64)
        # the probe may stand at any place of a pattern up to m - size - shift
        reach = stride - far
        first = np.repeat(at, reach) - (np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach))
        row = np.repeat(row, reach)
        inside = (first >= bounds[row]) & (first + m <= bounds[row + 1])
        first = first[inside]
        first = first[skip[slot[first + m - size]] == 0]
        if not len(first):
            return none, none
        # the suffix block's bucket, then the windows in it with the same words before
        block = self.blocks_at(h, first + m - size, size)
        bucket = np.minimum(np.searchsorted(g["suffixes"], block), len(g["suffixes"]) - 1)
        first = first[g["suffixes"][bucket] == block]
        key = self._keys(h, first, m, size, g["suffixes"])
        low, high = (np.searchsorted(g["keys"], key, side=s) for s in ("left", "right"))
        run = high - low
        first = np.repeat(first, run)
        window = np.repeat(low - (np.cumsum(run) - run), run) + np.arange(int(run.sum()))
        same = [
            joined[a:b].tobytes() == self.joined[c:d].tobytes()
            for a, b, c, d in zip(start[first].tolist(), end[first + m - 1].tolist(), g["start"][window].tolist(), g["end"][window].tolist(), strict=True)
        ]
        same = np.array(same, dtype=bool)
        return first[same], window[same]

    def items(self, m: int, windows: np.ndarray) -> np.ndarray:
        """The items of different windows of m words."""
        g = self.groups[m]
        return np.concatenate([g["items"][g["runs"][w] : g["runs"][w + 1]] for w in windows.tolist()] or [np.zeros(0, np.int32)])


def _hash_of(h: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the runs of m words from each first word on."""
    out = np.zeros(len(first), dtype=U64)
    for a in range(0, len(first), 1 << 16):
        some = first[a : a + (1 << 16)]
        out[a : a + (1 << 16)] = window_hashes(h[some[:, None] + np.arange(m)].ravel(), np.arange(0, len(some) * m + 1, m), m)[0]
    return out


_FIELDS = "n_words long; hits binary; items array<string>; n_hit long"


def _scan(patterns) -> object:
    table = byte_table("alnum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        known: Patterns = patterns.value
        for batch in batches:
            n_words, hits, items = [], [], []
            for a, b, data, offsets in text_pieces(batch.column(0)):
                words = Words(data, offsets, table)
                h, bounds = words.hashes(), words.row
                joined, start, end = _joined(words)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                met: dict[int, set] = {}
                for m in known.groups:
                    first, which = known.search(m, h, bounds, joined, start, end)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + m, -1)
                    row = np.searchsorted(bounds, first, side="right") - 1
                    pairs = np.unique(np.column_stack([row, which]), axis=0) if len(row) else np.zeros((0, 2), np.int64)
                    for r in np.unique(pairs[:, 0]).tolist():
                        names = {known.names[p] for p in np.unique(known.items(m, pairs[pairs[:, 0] == r, 1])).tolist()}
                        met.setdefault(r, set()).update(names - {None})
                covered = np.cumsum(edge[:-1]) > 0
                n_words += np.diff(bounds).tolist()
                for r in range(b - a):
                    some = met.get(r)
                    hits.append(np.packbits(covered[bounds[r] : bounds[r + 1]]).tobytes() if some is not None else None)
                    items.append(sorted(some or ()))
            if batch.num_columns > 1:  # what earlier blocks of the benchmark found
                for r, (found, names) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    for bits in found or ():
                        mine = np.frombuffer(hits[r], np.uint8) if hits[r] is not None else np.uint8(0)
                        hits[r] = (np.frombuffer(bits, np.uint8) | mine).tobytes()
                    items[r] = sorted({*items[r], *(names or ())})
            n_hit = [0 if x is None else int(np.bitwise_count(np.frombuffer(x, np.uint8)).sum()) for x in hits]
            yield [pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(n_hit, pa.int64())]

    return run


def _benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[bool, list, list]]:
    """(whether it is the last, items, texts) of blocks of at most about ``block_bytes``, each fetched only once its size is known."""
    sized = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        rows = (sized if n == 1 else sized.where(F.expr(f"pmod(xxhash64(item, text), {n}) = {k}"))).collect()
        yield k == n - 1, [r["item"] for r in rows], [r["text"] for r in rows]


def with_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    share: int = 20,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``OWN``-prefixed columns n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit when it lies in any occurrence of a window; a text is contaminated when n_hit > 0 and share * n_hit >= n_words.
    Null text has no words.  Items without words, or with a null text, have no windows; the windows of an item without an id hit words and name nothing.
    Equal items all count.  Rows keep their other columns, repeated rows are judged alike; an empty table gives no rows.  Where the
    benchmark takes several blocks, each pass but the last writes what it hits, by two hashes of the text (one row for equal texts, none for texts that
    are not hit), and the last adds it up.
    """
    spark = docs.sparkSession
    scratch, passes, out = Scratch(spark), [], None
    digest = [F.xxhash64(text_col).alias(OWN + "d1"), F.xxhash64(F.lit("again"), text_col).alias(OWN + "d2")]
    for last, ids, texts in _benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(Patterns(ids, texts, width))
        if not last:
            found = with_text_columns(docs.select(*digest, F.col(text_col).alias("text")), _FIELDS, _scan(shared), ["text"]).where(own("hits").isNotNull())
            found = found.dropDuplicates([OWN + "d1", OWN + "d2"]).select(OWN + "d1", OWN + "d2", own("hits").alias("hits"), own("items").alias("items"))
            passes.append(scratch.write(found, f"pass{len(passes)}"))
            shared.unpersist()
        elif not passes:
            out = with_text_columns(docs, _FIELDS, _scan(shared), [text_col])
        else:
            every = passes[0]
            for one in passes[1:]:
                every = every.unionByName(one)
            before = every.groupBy(OWN + "d1", OWN + "d2").agg(F.collect_list("hits").alias(OWN + "old_hits"), F.flatten(F.collect_list("items")).alias(OWN + "old_items"))
            held = docs.withColumns({OWN + "d1": digest[0], OWN + "d2": digest[1]}).join(before, [OWN + "d1", OWN + "d2"], "left")
            out = with_text_columns(held, _FIELDS, _scan(shared), [text_col, OWN + "old_hits", OWN + "old_items"])
            out = out.drop(*[OWN + c for c in ("d1", "d2", "old_hits", "old_items")])
    return (
        out.withColumn(OWN + "n_items", F.size(own("items")).cast("long"))
        .withColumn(OWN + "items_sha256", F.sha2(F.array_join(F.array_sort(own("items")), ","), 256))
        .withColumn(OWN + "contaminated", (own("n_hit") > 0) & (share * own("n_hit") >= own("n_words")))
        .drop(OWN + "hits", OWN + "items")
    )
