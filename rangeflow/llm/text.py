"""Vectorised text primitives on Arrow string buffers.

All functions work on the UTF-8 bytes of a whole batch at once: words are runs of bytes of a class, and the hashes of all
words advance together by eight bytes a step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once inside a task; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20

U64 = np.uint64


def byte_table(words: str) -> np.ndarray:
    """Table byte -> lower-cased byte, or 0 where the byte ends a word.

    ``alnum``: words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z;
    ``space``: words of ``[^\\x20\\x09-\\x0D]+`` (NUL bytes belong to words and are kept as 1);
    ``letters``: ASCII letters and all bytes of other scripts.
    """
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    if words == "alnum":
        for a, b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
            t[a : b + 1] = 0
    elif words == "letters":
        for a, b in ((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
            t[a : b + 1] = 0
    elif words == "space":
        t[0] = 1
        t[[0x20, *range(0x09, 0x0E)]] = 0
    else:
        raise ValueError(words)
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def text_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of each piece of a string column."""
    data, offsets = string_buffers(column)
    for a, b in pieces(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


#: Masks that keep the first bytes of a lane, and the bytes beyond which a span is digested on its own.
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
_LONG_SPAN = 512


def _stir(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits, a little cheaper than ``mix``."""
    h = h * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(32)
    h *= U64(0xC2B2AE3D27D4EB4F)
    h ^= h >> U64(29)
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time go through a bijection (not a polynomial, which periodic texts defeat).

    Spans of more than ``_LONG_SPAN`` bytes are digested by BLAKE2b.
    """
    if not len(start):
        return np.zeros(0, dtype=U64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded.data, strides=(1,))
    at, left = start, end - start
    out = h = mix(left.astype(U64) + U64(seed))
    long = np.flatnonzero(left > _LONG_SPAN)
    live = np.flatnonzero(left <= _LONG_SPAN) if len(long) else None
    if live is not None:
        at, left, h = at[live], left[live], h[live]
        key = seed.to_bytes(8, "little")
        out[long] = [int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8, key=key).digest(), "little") for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    while len(at):
        h = _stir(h ^ (lanes[at] & _KEEP[np.minimum(left, 8)]))
        if live is None:
            out = h.copy()
        else:
            out[live] = h
        more = np.flatnonzero(left > 8)
        h, at, left = h[more], at[more] + 8, left[more] - 8
        live = more if live is None else live[more]
    return mix(out)


class Words:
    """The words of a piece: byte spans, row bounds and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        low = table[data]
        inside = low != 0
        first = np.empty(len(low) + 1, dtype=bool)
        first[:-1] = inside
        first[-1] = False
        edge = first.copy()
        edge[1:] &= ~inside
        cuts = offsets[:-1][offsets[:-1] < len(low)]
        edge[cuts] = first[cuts]
        self.start = np.flatnonzero(edge)
        # a word ends where the next byte is outside, or another row begins
        after = np.empty(len(low), dtype=bool)
        if len(low):
            after[:-1] = ~inside[1:]
            after[-1] = True
            after[offsets[1:][offsets[1:] > 0] - 1] = True
            after &= inside
        self.end = np.flatnonzero(after) + 1
        self.row = np.searchsorted(self.start, offsets)  # n + 1 bounds of the rows' words
        self.low = low

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, width: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``width`` bytes."""
        return span_hashes(self.low, self.start, self.end if width is None else np.minimum(self.end, self.start + width))

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))


_SHINGLE = [U64(mix(np.array([k + 1], dtype=U64))[0] | U64(1)) for k in range(64)]


def window_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` consecutive words within a row, and n + 1 bounds of the rows' windows.

    A row of fewer words, but not none, has one window: the whole row.
    """
    counts = np.diff(bounds)
    n_windows = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(n_windows)])
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, dtype=U64), out_bounds
    first = np.repeat(bounds[:-1] - out_bounds[:-1], n_windows) + np.arange(total)
    length = np.repeat(np.minimum(counts, width), n_windows)
    h = length.astype(U64)
    padded = np.concatenate([words, np.zeros(width, dtype=U64)])
    short = length < width
    for k in range(width):
        part = padded[first + k] * _SHINGLE[k]
        if k and short.any():
            part[length <= k] = 0
        h += part
    return mix(h), out_bounds
