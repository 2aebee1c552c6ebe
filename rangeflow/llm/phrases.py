"""Phrases that stand together more often than their parts do, by SON partitioning.

Documents are dealt to shards by their text's hash.  Every shard is mined completely for all phrases of 1 to ``longest`` words at a
support lowered in proportion: ``support`` times the shard's share of its group's words, rounded up.  A phrase that reaches the support
overall reaches the lowered one in some shard, so the union of what the shards find holds every frequent phrase.  All of the union is
then counted over all texts, exactly.

A shard is no task: its tasks send sorted 40-bit hashes by ranges of the hash (about five bytes a different phrase and task), and a range of a
shard is counted in one task; the number of ranges grows with the words.  Collisions there only add candidates.  The union becomes a bitmap of at most
``FILTER_BITS`` bits (eight for each candidate or more, as long as that is below the bound; beyond, more phrases pass it); tasks of the
count send the phrases that pass, added up, and Spark sums them by their words.  So the bitmap, too, only decides how much is counted.

Words: A-Z is lower-cased, texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs; phrases stay within pieces.
Null and empty texts have no words.  A null group counts as ``und``.  Ties are broken as ``collocations`` says; repeated rows count as often as they stand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeflow.llm.store import Scratch
from rangeflow.llm.text import U64, mix, span_hashes, string_buffers

#: Bytes of text that a task adds up before it sends phrases; a longer document is a piece of its own.
FLUSH_BYTES = 4 << 20

#: Bytes of hashes in one range of a shard, and bits of the candidates' bitmap at most.
RANGE_BYTES, FILTER_BITS = 12 << 20, 1 << 28

_BREAKS = np.zeros(256, dtype=np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_BREAKS[[0x20, 0x09]] = 1
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_FACTOR = [U64(mix(np.array([k + 1], dtype=U64))[0] | U64(1)) for k in range(16)]


class Pieces:
    """Words of a run of texts: normalised bytes (a blank after each word), spans, hashes, and where phrases may not pass."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kind = _BREAKS[data]
        word = kind == 0
        at_row = np.zeros(len(data) + 1, dtype=bool)
        at_row[offsets[:-1]] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | at_row[1:-1]
        start = np.flatnonzero(begins)
        ends = word.copy()
        ends[:-1] &= ~word[1:] | at_row[1:-1]
        end = np.flatnonzero(ends) + 1
        self.row = np.searchsorted(offsets, start, side="right") - 1
        # words of one piece have the same number of breaks before them, and the same row
        breaks = np.cumsum(kind == 2)[start] if len(start) else np.zeros(0, dtype=np.int64)
        self.joined = np.zeros(len(start), dtype=bool)  # whether the next word continues the piece
        self.joined[:-1] = (breaks[1:] == breaks[:-1]) & (self.row[1:] == self.row[:-1])
        length = end - start
        self.start = np.cumsum(length + 1) - (length + 1)
        self.end = self.start + length
        self.bytes = np.full(int((length + 1).sum()), 0x20, dtype=np.uint8)
        inside = np.ones(len(self.bytes), dtype=bool)
        inside[self.end] = False
        self.bytes[inside] = _LOWER[data[word]]
        self.hash = span_hashes(self.bytes, self.start, self.end)

    def phrases(self, width: int, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of all phrases of ``width`` words; ``seed`` is a hash for each row."""
        going = np.ones(max(0, len(self.hash) - width + 1), dtype=bool)
        for k in range(width - 1):
            going &= self.joined[k : k + len(going)]
        first = np.flatnonzero(going)
        h = seed[self.row[first]] + U64(width)
        for k in range(width):
            h += self.hash[first + k] * _FACTOR[k]
        return first, mix(h)


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The batches' rows in runs of about ``limit`` bytes of text (the first column), one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, offsets = string_buffers(batch.column(0))
        a = 0
        while a < batch.num_rows:
            b = max(a + (not held), int(np.searchsorted(offsets, offsets[a] + max(0, limit - size), side="right")) - 1)
            if b > a:
                held.append(batch.slice(a, b - a))
                size += int(offsets[b] - offsets[a])
                a = b
            if a < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _seeds(groups: pa.ChunkedArray) -> tuple[list, np.ndarray, np.ndarray]:
    """(different groups, the index of each row's, the hash seed of each row)."""
    coded = groups.combine_chunks().dictionary_encode()
    data, offsets = string_buffers(coded.dictionary)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary.to_pylist(), code, span_hashes(data, offsets[:-1], offsets[1:], seed=1)[code]


def _five(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _shard_phrases(longest: int, bits: int):
    """Sorted 40-bit hashes of a run's phrases by group, shard and range (the hash's first ``bits`` bits): seen once, and oftener."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, FLUSH_BYTES):
            names, code, seed = _seeds(table.column(1))
            shard = table.column(2).to_numpy().astype(np.int64)
            words = Pieces(*string_buffers(table.column(0)))
            kinds_of = code * (1 << 16) + shard
            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for width in range(1, longest + 1):  # phrases of different widths have different hashes
                first, h = words.phrases(width, seed)
                of = kinds_of[words.row[first]]
                del first
                for which in np.unique(of).tolist():
                    held.setdefault(which, []).append(np.unique(h[of == which], return_counts=True))
                del h, of
            rows: list[tuple] = []
            for which in sorted(held):
                seen, times = (np.concatenate(x) for x in zip(*held.pop(which), strict=True))
                order = np.argsort(seen, kind="stable")
                seen, times = seen[order], times[order]
                part = (seen >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(seen), dtype=np.int64)
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, dtype=np.int64)
                low = (seen >> U64(24 - bits)) & U64((1 << 40) - 1)
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    once = times[a:b] == 1
                    rows.append((names[which >> 16], which & 0xFFFF, int(part[a]), _five(low[a:b][once]), _five(low[a:b][~once]), times[a:b][~once].astype("<u4").tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["grp", "shard", "part", "once", "more", "times"])

    return run


def _frequent(table: pa.Table) -> pa.Table:
    """The hashes of a group's shard and range that reach the shard's support."""
    least = table.column("least")[0].as_py()
    hashes = [_wide(b) for n in ("once", "more") for b in table.column(n).to_pylist()]
    times = [np.ones(len(x), dtype=np.int64) for x in hashes[: table.num_rows]] + [np.frombuffer(b, dtype="<u4").astype(np.int64) for b in table.column("times").to_pylist()]
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    h, times = h[order], np.concatenate(times)[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=np.int64)
    total = np.add.reduceat(times, first) if len(h) else times
    found = h[first][total >= least]
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "n": pa.array([len(found)], pa.int64()), "found": pa.array([_five(found)], pa.binary())})


def _bitmap(bits: int, size: int, group_bits: int):
    """The part of the candidates' bitmap (of 2^``size`` bits) that a range of 2^``group_bits`` ranges covers."""

    def make(table: pa.Table) -> pa.Table:
        marks = np.zeros(1 << (size - group_bits), dtype=bool)
        group = table.column("slice")[0].as_py()
        for part, found in zip(table.column("part").to_pylist(), table.column("found").to_pylist(), strict=True):
            h = (U64(part) << U64(64 - bits) if bits else U64(0)) | (_wide(found) << U64(24 - bits))
            marks[(h >> U64(64 - size)).astype(np.int64) - (group << (size - group_bits))] = True
        return pa.table({"slice": pa.array([group], pa.int32()), "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    return make


def _candidate_counts(longest: int, size: int, bitmap):
    """Counts of a run's phrases that pass the bitmap, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bitmap.value
        for table in _runs(batches, FLUSH_BYTES):
            names, code, seed = _seeds(table.column(1))
            words = Pieces(*string_buffers(table.column(0)))
            for width in range(1, longest + 1):
                first, h = words.phrases(width, seed)
                at = (h >> U64(64 - size)).astype(np.int64)
                passed = np.flatnonzero((marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                _, one, times = np.unique(h[passed], return_index=True, return_counts=True)
                first = first[passed[one]]
                start, end = words.start[first], words.end[first + width - 1]
                length = end - start
                bounds = np.concatenate([[0], np.cumsum(length)])
                body = words.bytes[np.repeat(start - bounds[:-1], length) + np.arange(int(bounds[-1]))]
                for a in range(0, len(first), 1 << 16):
                    b = min(len(first), a + (1 << 16))
                    text = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer((bounds[a : b + 1] - bounds[a]).astype(np.int32)), pa.py_buffer(body[bounds[a] : bounds[b]])])
                    group = pa.DictionaryArray.from_arrays(pa.array(code[words.row[first[a:b]]]), pa.array(names, pa.string())).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([group, text, pa.array(np.full(b - a, width, dtype=np.int32)), pa.array(times[a:b].astype(np.int64))], names=["grp", "phrase", "width", "a"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a run of texts, by group and shard."""
    for table in _runs(batches, FLUSH_BYTES):
        names, code, _ = _seeds(table.column(1))
        shard = table.column(2).to_numpy().astype(np.int64)
        data, offsets = string_buffers(table.column(0))
        word = _BREAKS[data] == 0
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        begins[cuts] = word[cuts]
        total = np.concatenate([[0], np.cumsum(begins)])
        words = total[offsets[1:]] - total[offsets[:-1]]
        of, place = np.unique(code * (1 << 16) + shard, return_inverse=True)
        sums = np.bincount(place, weights=words, minlength=len(of)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([names[k >> 16] for k in of.tolist()], pa.string()), pa.array((of & 0xFFFF).astype(np.int32)), pa.array(sums)], names=["grp", "shard", "words"])


def frequent_phrases(docs: DataFrame, *, text: str = "text", group: str = "lang", longest: int = 3, support: int = 10, shards: int = 4, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(grp, phrase, width, a) of all phrases of 1 to ``longest`` words that stand ``support`` times in their group, and (grp, n) with the groups' words."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    fed = docs.select(F.col(text).alias("text"), F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("grp"), F.pmod(F.xxhash64(F.col(text)), F.lit(shards)).cast("int").alias("shard"))
    fed = fed.where(F.length("text") > 0)
    sizes = scratch.write(fed.mapInArrow(_word_counts, "grp string, shard int, words long").groupBy("grp", "shard").agg(F.sum("words").alias("words")), "words")
    totals = sizes.groupBy("grp").agg(F.sum("words").alias("n"))
    # ceil(support * share) in whole numbers
    least = sizes.join(totals, "grp").where("words > 0").select("grp", "shard", F.expr(f"cast(({support}L * words + n - 1) div n as int)").alias("least"))
    words = sizes.agg(F.sum("words")).first()[0] or 0
    bits = max(0, min(24, math.ceil(math.log2(max(1, words * longest * 5 / shards / RANGE_BYTES)))))
    sent = fed.mapInArrow(_shard_phrases(longest, bits), "grp string, shard int, part int, once binary, more binary, times binary")
    mined = sent.join(least, ["grp", "shard"]).groupBy("grp", "shard", "part").applyInArrow(_frequent, "part int, n long, found binary")
    union = scratch.write(mined.where("n > 0"), "union")
    n = union.agg(F.sum("n")).first()[0] or 0
    size = min(int(math.log2(FILTER_BITS)), max(16, math.ceil(math.log2(8 * max(1, n)))))
    group_bits = min(bits, size - 3, 10)
    slices = union.withColumn("slice", F.shiftright("part", bits - group_bits)).groupBy("slice").applyInArrow(_bitmap(bits, size, group_bits), "slice int, bits binary")
    marks = np.zeros(1 << (size - 3), dtype=np.uint8)  # at most FILTER_BITS, however many candidates there are
    step = len(marks) >> group_bits
    for row in slices.toLocalIterator():
        marks[row.slice * step : (row.slice + 1) * step] = np.frombuffer(row.bits, dtype=np.uint8)
    bitmap = spark.sparkContext.broadcast(marks)
    counted = fed.select("text", "grp").mapInArrow(_candidate_counts(longest, size, bitmap), "grp string, phrase string, width int, a long")
    frequent = counted.groupBy("grp", "phrase", "width").agg(F.sum("a").alias("a")).where(F.col("a") >= support)
    out = scratch.write(frequent, "frequent")
    bitmap.unpersist()
    return out, totals


def collocations(
    docs: DataFrame, *, text: str = "text", group: str = "lang", longest: int = 3, support: int = 10, covered: int = 50, most: int = 2000, shards: int = 4
) -> DataFrame:
    """Each group's first ``most`` phrases of 2 to ``longest`` words: group, rank, phrase, a, l, r, n, score.

    The score of a cut is ``floor(1000000 * a * a / (l * r))``, ``l`` and ``r`` being the counts of its two parts; the lowest cut counts, ties to the
    shortest first part.  Phrases within a longer candidate with ``100 * f(longer) >= covered * a`` are left out.  Order: score and
    ``a`` descending, phrase by its bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    frequent, totals = frequent_phrases(docs, text=text, group=group, longest=longest, support=support, shards=shards, scratch=scratch)
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    candidates = frequent.where("width >= 2").withColumn("words", words)
    # one row for each cut and side, joined with the counts of the parts
    cuts = candidates.select("grp", "phrase", "a", "width", F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k"), "words")
    cuts = cuts.select("grp", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("width") - F.col("k")).alias("right"))
    counts = frequent.select("grp", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = cuts.join(counts.select("grp", F.col("part").alias("left"), F.col("f").alias("l")), ["grp", "left"]).join(counts.select("grp", F.col("part").alias("right"), F.col("f").alias("r")), ["grp", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("top", wide("a") * wide("a") * F.lit(1000000).cast("decimal(7,0)")).withColumn("below", wide("l") * wide("r"))
    scored = cuts.withColumn("score", F.expr("top div below"))
    best = scored.groupBy("grp", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = candidates.where("width >= 3").select("grp", F.col("a").alias("longer"), "words", "width")
    inside = inside.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("width") - 1)))
    inside = inside.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("width") - F.col("m") + 1))).select("grp", part(F.col("at"), F.col("m")).alias("phrase"), "longer")
    inside = inside.groupBy("grp", "phrase").agg(F.max("longer").alias("longer"))
    left = best.join(inside, ["grp", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    rows = left.select("grp", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.withColumn("salt", salt)
    for few in (salt, F.col("salt") % 8):  # the first of every part, then of eight parts, and at last of the group
        rows = rows.withColumn("salt", few).withColumn("rank", F.row_number().over(Window.partitionBy("grp", "salt").orderBy(*order))).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("rank") <= most)
    return rows.join(totals, "grp").select(F.col("grp").alias(group), "rank", "phrase", "a", "l", "r", "n", "score")
