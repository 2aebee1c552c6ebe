"""Word-end BPE on distinct words of a batch, equal to the public tokenizer's own encoding.

A text is cut where the tokenizer's pre-tokenizer cuts it; each distinct unit is encoded once per task.  Units of ASCII and
Latin-1 letters, digits and ASCII punctuation are merged for all words of one length at once; a white-space-delimited
chunk with anything else in it (apostrophes, other scripts, control characters, special tokens) is handed whole to the
``tokenizers`` library.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer

from rangeflow.llm.text import U64, mix, span_hashes

_NONE = np.int32(2**31 - 1)
_LONGEST = 48
_KEPT_UNITS, _KEPT_BYTES = 1 << 19, 8 << 20
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    chars = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


def _classes() -> np.ndarray:
    t = np.full(256, OTHER, dtype=np.uint8)
    t[0x21:0x7F] = MARK
    t[0x30:0x3A] = DIGIT
    t[0x41:0x5B] = t[0x61:0x7B] = LETTER
    t[0x09:0x0E] = SPACE
    t[0x20] = SPACE
    t[0x27] = OTHER
    return t


class WordBpe:
    """Token ids of whole texts for a lower-casing word-end BPE file; keeps the units it has seen."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab.get(c, 0) for c in chars], dtype=np.int32)
        self.final = np.array([vocab.get(c + suffix, 0) for c in chars], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self._index((left << 16) | right)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.table = _classes()
        self.seed = 0
        self.reset()

    def _index(self, keys: np.ndarray) -> None:
        """An open-addressing table pair -> rank with few probes."""
        self.bits = 18
        slots = np.full(1 << self.bits, -1, dtype=np.int64)
        ranks = np.full(1 << self.bits, _NONE, dtype=np.int32)
        todo, probe = np.arange(len(keys)), 0
        while len(todo):
            at = self._slot(keys[todo], probe)
            free = slots[at] < 0
            _, first = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            slots[at[placed]] = keys[todo[placed]]
            ranks[at[placed]] = todo[placed]
            todo = np.delete(todo, placed)
            probe += 1
        self.slots, self.ranks, self.probes = slots, ranks, probe

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = (keys.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)
        return ((h + U64(probe)) & U64((1 << self.bits) - 1)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or the largest int32."""
        keys = (left.astype(np.int64) << 16) | right
        flat = keys.ravel()
        at = self._slot(flat, 0)
        found = self.slots[at]
        out = np.where(found == flat, self.ranks[at], _NONE)
        open_ = np.flatnonzero((found != flat) & (found >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            at = self._slot(flat[open_], probe)
            found = self.slots[at]
            hit = found == flat[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out.reshape(keys.shape)

    def reset(self) -> None:
        """Forgets the units seen."""
        self.held = np.zeros(0, dtype=np.uint8)
        self.held_at = np.zeros(0, dtype=np.int64)
        self.held_size = np.zeros(0, dtype=np.int64)
        self.keys = np.zeros(0, dtype=U64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint16)

    def _merge(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of words of one length: (row numbers, matrix of ids) for each number of ids."""
        rows, out = np.arange(len(x)), []
        r = self.rank(x[:, :-1], x[:, 1:]) if x.shape[1] > 1 else None
        while r is not None and r.shape[1]:
            j = r.argmin(axis=1)
            best = r[np.arange(len(r)), j]
            done = best == _NONE
            if done.any():
                out.append((rows[done], x[done]))
                keep = ~done
                rows, x, r, j, best = rows[keep], x[keep], r[keep], j[keep], best[keep]
            if not len(rows):
                return out
            k, m = np.arange(len(rows)), x.shape[1]
            x = np.where(np.arange(m - 1) <= j[:, None], x[:, :-1], x[:, 1:])
            x[k, j] = self.made[best]
            r = np.where(np.arange(m - 2) < j[:, None], r[:, :-1], r[:, 1:])
            a = np.flatnonzero(j > 0)
            r[a, j[a] - 1] = self.rank(x[a, j[a] - 1], x[a, j[a]])
            b = np.flatnonzero(j < m - 2)
            r[b, j[b]] = self.rank(x[b, j[b]], x[b, j[b] + 1])
        out.append((rows, x))
        return out

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each unit, and all ids one after another."""
        size = end - start
        plain = plain & (size <= _LONGEST)
        counts = np.zeros(len(start), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(size[plain]):
            mine = np.flatnonzero(plain & (size == n))
            raw = data[start[mine][:, None] + np.arange(n)]
            x = self.inner[raw]
            x[:, -1] = self.final[raw[:, -1]]
            for rows, ids in self._merge(x):
                counts[mine[rows]] = ids.shape[1]
                parts.append((mine[rows], ids))
        rest = np.flatnonzero(~plain)
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[rest], end[rest], strict=True)]
        other = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        counts[rest] = [len(x) for x in other]
        at = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(at[-1], dtype=np.uint16)
        for rows, ids in parts:
            flat[at[rows][:, None] + np.arange(ids.shape[1])] = ids
        for k, ids in zip(rest, other, strict=True):
            flat[at[k] : at[k + 1]] = ids
        return counts, flat

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-cased bytes, unit starts, unit ends, whether the unit is plain)."""
        n = len(data)
        kind = self.table[data]
        low = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)
        lead = np.flatnonzero(data[:-1] == 0xC3) if n > 1 else np.zeros(0, np.int64)
        second = data[lead + 1] if len(lead) else np.zeros(0, np.uint8)
        fine = (second >= 0x80) & (second != 0x97) & (second != 0xB7)
        lead, second = lead[fine], second[fine]
        kind[lead] = kind[lead + 1] = LETTER
        upper = second <= 0x9E
        low[lead[upper] + 1] = second[upper] + 0x20
        if n > 1:
            kind[:-1][(data[:-1] == 0x3C) & (data[1:] == 0x7C)] = OTHER
        new_row = np.zeros(n + 1, dtype=bool)
        new_row[offsets] = True
        if (kind == OTHER).any():
            # chunks between white space that hold anything else go to the library whole, as they stand
            solid = kind != SPACE
            begins = solid & new_row[:-1]
            begins[1:] |= solid[1:] & ~solid[:-1]
            chunk = np.cumsum(begins)
            odd = np.zeros(int(chunk[-1]) + 1, dtype=bool)
            odd[chunk[kind == OTHER]] = True
            mine = odd[chunk] & solid
            kind[mine] = OTHER
            low[mine] = data[mine]
        solid = kind != SPACE
        cut = new_row[:-1] | (kind == DIGIT)
        cut[1:] |= kind[1:] != kind[:-1]
        start = np.flatnonzero(solid & cut)
        stop = np.empty(n, dtype=bool)
        if n:
            stop[:-1] = cut[1:]
            stop[-1] = True
        end = np.flatnonzero(solid & stop) + 1
        return low, start, end, kind[start] != OTHER

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a piece one after another, and the n + 1 bounds of the rows.

        Units are looked up by hash and compared by their bytes; should two units share a hash, all begins anew with another one.
        """
        low, start, end, plain = self.units(data, offsets)
        key = span_hashes(low, start, end, self.seed)
        key[~plain] = mix(key[~plain])
        distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
        known = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inside = known < len(self.keys)
        new[inside] = self.keys[known[inside]] != distinct[inside]
        if new.any():
            if len(self.keys) > _KEPT_UNITS or len(self.held) > _KEPT_BYTES:
                self.reset()
                new[:] = True
            some = first[new]
            counts, flat = self._encode(low, start[some], end[some], plain[some])
            at = len(self.flat) + np.cumsum(counts) - counts
            size = end[some] - start[some]
            held_at = len(self.held) + np.cumsum(size) - size
            self.held = np.concatenate([self.held, low[_runs(start[some], size)]])
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.at = np.concatenate([self.at, at])[order]
            self.size = np.concatenate([self.size, counts])[order]
            self.held_at = np.concatenate([self.held_at, held_at])[order]
            self.held_size = np.concatenate([self.held_size, size])[order]
            self.flat = np.concatenate([self.flat, flat])
            known = np.searchsorted(self.keys, distinct)
        unit = known[which]
        size = end - start
        if not np.array_equal(self.held_size[unit], size) or not np.array_equal(self.held[_runs(self.held_at[unit], size)], low[_runs(start, size)]):
            self.seed += 1
            self.reset()
            return self.texts(data, offsets)
        at, size = self.at[unit], self.size[unit]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.flat[_runs(at, size)], upto[np.searchsorted(start, offsets)]


def _runs(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices of runs of ``size`` places from ``at`` on, one after another."""
    upto = np.cumsum(size) - size
    return np.repeat(at - upto, size) + np.arange(int(size.sum()))
