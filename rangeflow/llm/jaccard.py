"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

Two sets of shingles with Jaccard similarity t or more share at least T = t / (1 + t) * (|A| + |B|) shingles: a document reaches
the required overlap with a query when it occurs in T of the query's inverted lists.  DivideSkip sets the query's L longest
lists aside, merges the short ones on a heap, and keeps documents that occur T - L times there; only these are looked up, by
binary probes, in the long lists.

The corpus is searched in two steps.  Its index posts each set's |A| - L shortest lists only, with the largest L that loses
nothing (least T - 1): a partner then occurs there once at least.  Pairs that these lists give, and that small bitmaps of the
sets do not refute, are shipped as sets; every query is answered over blocks of its candidates by a heap merge of short lists
and binary probes of long ones.

Hot groups: equal sets are one node; a list yields pairs with its smallest node only, and pairs of nodes that the links found
leave in different components are then searched in full.  So no list emits all its pairs, and no link between different
components is lost.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeflow.llm.graph import components
from rangeflow.llm.store import Scratch
from rangeflow.llm.text import U64, Words, byte_table, mix, text_pieces, window_hashes

#: The frequency sketch has one counter for so many bytes of text, between 2^16 and 2^26 of them; it only chooses the order of
#: shingles, never what is found.  Counters are added up in parts of SKETCH_PART.
SKETCH_BYTES, SKETCH_LEAST, SKETCH_MOST = 256, 16, 26
SKETCH_PART = 1 << 14
_FLUSH = 1 << 21
#: Shingle occurrences of short lists per bucket.
BUCKET_ROWS = 400_000
#: Lists with more than this share of all long-list occurrences are joined by a broadcast: there are at most so many of them.
HOT_LISTS = 10_000
#: Candidates of one query that are searched at once, the bytes they may hold together, and candidates of one shipped group.
BLOCK, BLOCK_BYTES, GROUP = 64, 8 << 20, 4096
#: Rows of a list that meet in one task, in the search of pairs left open.
LIST_ROWS = 512
#: DivideSkip's weight of the longest list in L = T / (MU * log2(longest) + 1).
MU = 0.01


def _sets(column: pa.Array, words: str, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for null or no words."""
    table = byte_table(words)
    for a, b, data, offsets in text_pieces(column):
        w = Words(data, offsets, table)
        h, bound = window_hashes(w.hashes(), w.row, width)
        for k in range(b - a):
            yield np.unique(h[bound[k] : bound[k + 1]])


def sketch_bits(text_bytes: int) -> int:
    """Counters of the sketch, as a power of two, for a table of this many bytes of text."""
    return int(min(SKETCH_MOST, max(SKETCH_LEAST, (max(1, text_bytes) // SKETCH_BYTES).bit_length())))


def _counters(slots: np.ndarray) -> pa.RecordBatch:
    """A task's counted slots in parts: the places of a part one by one, or four bits a counter where that is shorter (and the rest one by one)."""
    part, place = slots // SKETCH_PART, slots % SKETCH_PART
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order], prepend=-1))
    rows: list[tuple[int, bool, bytes]] = []
    for k, places in zip(part[order][cut].tolist(), np.split(place[order], cut[1:]), strict=True):
        if len(places) > SKETCH_PART // 4:
            counts = np.bincount(places, minlength=SKETCH_PART)
            low = np.minimum(counts, 15).astype(np.uint8)
            rows.append((k, True, (low[0::2] | low[1::2] << 4).tobytes()))
            places = np.repeat(np.arange(SKETCH_PART), counts - low)
        if len(places):
            rows.append((k, False, places.astype("<u2").tobytes()))
    none = pa.nulls(len(rows), pa.int64())
    parts, dense, bodies = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(parts, pa.int32()), pa.array(dense), pa.array(bodies, pa.binary())], names=_PROFILE)


_PROFILE = ["id", "n", "one", "two", "part", "dense", "counts"]


def profile(docs: DataFrame, width: int, words: str, bits: int) -> DataFrame:
    """Per text: id, number of shingles, 128-bit digest of the set; and, tagged by ``part``, each task's shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n_seen = [], 0
        for batch in batches:
            n, one, two = [], [], []
            for s in _sets(batch.column(1), words, width):
                n.append(len(s))
                one.append(np.add.reduce(s, dtype=U64))
                two.append(np.bitwise_xor.reduce(mix(s)) if len(s) else U64(0))
                seen.append((s >> U64(64 - bits)).astype(np.int32))
                n_seen += len(s)
                if n_seen >= _FLUSH:
                    yield _counters(np.concatenate(seen))
                    seen, n_seen = [], 0
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(n, dtype=np.int64)), pa.array(np.array(one, dtype=U64).view(np.int64)),
                 pa.array(np.array(two, dtype=U64).view(np.int64)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.bool_()), pa.nulls(rows, pa.binary())],
                names=_PROFILE,
            )
        if n_seen:
            yield _counters(np.concatenate(seen))

    return docs.mapInArrow(run, "id long, n long, one long, two long, part int, dense boolean, counts binary")


def sketch(tagged: DataFrame, bits: int) -> np.ndarray:
    """Levels of the sketch's counters: 0 for short lists, more for longer ones; one byte each (64 MB at most).

    Each part's counts are added up as they stream by, a batch at a time.
    """
    mean = (tagged.agg(F.sum("n")).first()[0] or 0) / (1 << bits)

    def level(part: int, total: np.ndarray) -> pa.RecordBatch:
        over = total - mean - max(64.0, 6 * np.sqrt(mean))
        levels = np.where(over > 0, 1 + np.log2(np.maximum(over, 1)), 0).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([levels.tobytes()], pa.binary())], names=["part", "levels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(0)
        for batch in batches:
            for p, dense, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if p != part:
                    if part is not None:
                        yield level(part, total)
                    part, total = p, np.zeros(SKETCH_PART, dtype=np.int64)
                body = np.frombuffer(held.as_buffer(), dtype=np.uint8 if dense else "<u2")
                total += np.stack([body & 15, body >> 4], axis=1).ravel() if dense else np.bincount(body, minlength=SKETCH_PART)
        if part is not None:
            yield level(part, total)

    parts = tagged.where("part is not null").select("part", "dense", "counts").repartition("part").sortWithinPartitions("part")
    out = np.zeros(1 << bits, dtype=np.uint8)
    for r in parts.mapInArrow(run, "part int, levels binary").collect():
        out[r["part"] * SKETCH_PART : (r["part"] + 1) * SKETCH_PART] = np.frombuffer(r["levels"], dtype=np.uint8)
    return out


def prefixes(docs: DataFrame, levels: np.ndarray, width: int, words: str, num: int, den: int) -> DataFrame:
    """Per text: its |A| - L shortest lists in the common order, L = ceil(t |A|) - 1, how many of them are short, and a bitmap.

    The levels are broadcast: one byte a counter, at most 64 MB.
    """
    shared, shift = docs.sparkSession.sparkContext.broadcast(levels), U64(64 - (len(levels).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            n, light, heads, maps = [], [], [], []
            for s in _sets(batch.column(1), words, width):
                maps.append(bitmap(s))
                own = level[(s >> shift).astype(np.int64)]
                keep = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                order = np.argsort(own, kind="stable")[:keep]
                n.append(len(s))
                light.append(int((own[order] == 0).sum()))
                heads.append(s[order].view(np.int64))
            sizes = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
            flat = np.concatenate(heads) if heads else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(light, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat)), pa.array(maps, pa.binary())],
                names=["id", "n", "light", "grams", "map"],
            )

    return docs.mapInArrow(run, "id long, n int, light int, grams array<long>, map binary")


def bitmap(s: np.ndarray) -> bytes:
    """A set's size, and a bitmap of two to four bits a shingle, by the low bits of their hashes."""
    width = 1 << max(6, int(2 * len(s) - 1).bit_length() if len(s) else 0)
    bits = np.zeros(width, dtype=bool)
    bits[(s & U64(width - 1)).astype(np.int64)] = True
    return len(s).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def may_reach(query: bytes, members: list[bytes], num: int, den: int) -> np.ndarray:
    """Which members' bitmaps allow the similarity: a bit that only one set has is a shingle that only it has.  Loses no link."""
    out = np.zeros(len(members), dtype=bool)
    n, own = int.from_bytes(query[:8], "little"), np.frombuffer(query, np.uint64, offset=8)
    folded = {len(own): own}

    def fold(x: np.ndarray, size: int) -> np.ndarray:
        while len(x) > size:
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        return x

    for k, body in enumerate(members):
        m, other = int.from_bytes(body[:8], "little"), np.frombuffer(body, np.uint64, offset=8)
        size = min(len(own), len(other))
        if size not in folded:
            folded[size] = fold(own, size)
        a, b = folded[size], fold(other, size)
        lone, lone_b = int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum())
        out[k] = min(n - lone, m - lone_b) * (num + den) >= num * (n + m)
    return out


def _blocks(buckets: int):
    """Short-list occurrences of a task, gathered by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def out() -> pa.RecordBatch:
            every = np.concatenate(held)
            bucket = (mix(every["gram"].view(U64)) % U64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            every, bucket = every[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            bodies = [_planes(x) for x in np.split(every, cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(bodies, pa.binary())], names=["bucket", "rows"])

        for batch in batches:
            ids, n, light = (batch.column(k).to_numpy() for k in range(3))
            grams = batch.column(3)
            bound = grams.offsets.to_numpy().astype(np.int64)
            flat = grams.values.to_numpy()
            total = int(light.sum())
            if not total:
                continue
            upto = np.cumsum(light) - light
            pos = np.arange(total) - np.repeat(upto, light)
            x = np.empty(total, dtype=_OCCURRENCE)
            x["gram"] = flat[np.repeat(bound[:-1], light) + pos]
            x["id"], x["n"], x["pos"] = np.repeat(ids, light), np.repeat(n, light), pos
            held.append(x)
            rows += total
            if rows > 1_000_000:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return run


def _planes(x: np.ndarray) -> bytes:
    """Occurrences byte plane by byte plane: the many zero bytes lie together, which the shuffle's compression takes away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(body: bytes) -> np.ndarray:
    planes = np.frombuffer(body, dtype=np.uint8).reshape(_OCCURRENCE.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(_OCCURRENCE).ravel()


_OCCURRENCE = np.dtype([("gram", "<i8"), ("id", "<i8"), ("n", "<i4"), ("pos", "<i4")])
_LISTS = "gram long, id long, n int, pos int, size long, leader long, leader_n int, leader_pos int"


def _merge_lists(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges each bucket's runs and keeps the lists of two nodes or more, each with its smallest node."""
    for pdf in blocks:
        for _, one in pdf.groupby("bucket"):
            x = np.concatenate([_unplaned(r) for r in one["rows"]])
            x = x[np.lexsort((x["id"], x["gram"]))]
            first = np.ones(len(x), dtype=bool)
            first[1:] = (x["gram"][1:] != x["gram"][:-1]) | (x["id"][1:] != x["id"][:-1])
            x = x[first]
            head = np.flatnonzero(np.diff(x["gram"], prepend=~x["gram"][0]))
            size = np.diff(np.append(head, len(x)))
            lead, size = np.repeat(head, size), np.repeat(size, size)
            keep = size > 1
            x, lead = x[keep], x[lead[keep]]
            yield pd.DataFrame({
                "gram": x["gram"], "id": x["id"], "n": x["n"], "pos": x["pos"], "size": size[keep].astype(np.int64),
                "leader": lead["id"], "leader_n": lead["n"], "leader_pos": lead["pos"],
            })


def _fits(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int) -> Column:
    """Whether two sets that first meet at these places of their orders can still share enough."""
    shared = 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
    return (shared * (num + den) >= num * (n1 + n2)) & (F.least(n1, n2) * den >= F.greatest(n1, n2) * num)


def inverted_lists(heads: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Occurrences in lists of two nodes or more: short lists merged by bucket, long ones (hot shingles) row by row.

    The few longest lists meet their smallest node by a broadcast of at most HOT_LISTS rows, the rest by a shuffle, so that no
    task gets more than a small share of the occurrences.
    """
    total = heads.agg(F.sum("light")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_ROWS))
    short = (
        heads.select("id", "n", "light", "grams")
        .mapInArrow(_blocks(buckets), "bucket int, rows binary")
        .groupBy("bucket")
        .applyInPandas(lambda pdf: pd.concat(list(_merge_lists(iter([pdf])))), _LISTS)
    )
    rows = heads.where(F.size("grams") > F.col("light")).select(
        "id", "n", "light", F.posexplode(F.slice("grams", F.col("light") + 1, F.size("grams") - F.col("light"))).alias("k", "gram")
    )
    rows = rows.select("gram", "id", "n", (F.col("light") + F.col("k")).cast("int").alias("pos"))
    lead = rows.groupBy("gram").agg(F.count("*").alias("size"), F.min(F.struct("id", "n", "pos")).alias("lead")).where("size > 1")
    lead = lead.select("gram", "size", F.col("lead.id").alias("leader"), F.col("lead.n").alias("leader_n"), F.col("lead.pos").alias("leader_pos"))
    lead = scratch.write(lead, "long_lists")
    bound = max(1000, (lead.agg(F.sum("size")).first()[0] or 0) // HOT_LISTS)
    hot = F.broadcast(lead.where(F.col("size") > bound))
    rest = rows.join(hot.select("gram"), "gram", "left_anti").join(lead.where(F.col("size") <= bound), "gram")
    columns = _LISTS.replace(" long", "").replace(" int", "").split(", ")
    return short.unionByName(rows.join(hot, "gram").select(*columns)).unionByName(rest.select(*columns))


def reaching(query: np.ndarray, members: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which members occur in so many of the query's inverted lists that their similarity is num / den or more.

    DivideSkip over the members: the L longest lists are set aside, the others are merged on a heap, and members with T - L
    occurrences there are looked up in the long lists.
    """
    sizes = np.array([len(m) for m in members])
    need = -(-num * (len(query) + sizes) // (num + den))
    every, who = np.concatenate(members), np.repeat(np.arange(len(members)), sizes)
    at = np.minimum(np.searchsorted(query, every), len(query) - 1)
    same = query[at] == every
    lists, doc = at[same], who[same]
    order = np.argsort(lists, kind="stable")  # each list goes by member
    lists, doc = lists[order], doc[order]
    length = np.bincount(lists, minlength=len(query))
    begin = np.cumsum(length) - length
    longest, least = int(length.max()), int(need.min())
    aside = max(0, min(least - 1, int(least / (MU * log2(max(longest, 1)) + 1))))
    by_length = np.argsort(length, kind="stable")
    short, long = by_length[: len(query) - aside], by_length[len(query) - aside :]
    short = short[length[short] > 0]
    merged = np.fromiter(heapq.merge(*[doc[begin[g] : begin[g] + length[g]].tolist() for g in short.tolist()]), dtype=np.int64)
    count = np.bincount(merged, minlength=len(members))
    open_ = np.flatnonzero(count >= need - aside)
    key = lists * len(members) + doc
    step = max(1, _FLUSH // max(1, len(open_)))
    for a in range(0, len(long) if len(open_) and len(key) else 0, step):
        probe = long[a : a + step, None] * len(members) + open_
        found = key[np.minimum(np.searchsorted(key, probe), len(key) - 1)] == probe
        count[open_] += found.sum(axis=0)
    return count >= need


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What sorted pairs (a, b) want shipped: (id, a, part, role), a query (role 0) once for each group of GROUP pairs in a row."""
    task, at, last = TaskContext.get().partitionId() << 33, 0, None
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        part = (np.arange(at, at + len(a)) // GROUP) + task
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (part[1:] != part[:-1])
        if len(a):
            new[0] = (a[0], part[0]) != last
            last = (a[-1], part[-1])
        at += len(a)
        columns = [np.concatenate(c) for c in ((b, a[new]), (a, a[new]), (part, part[new]))]
        role = np.repeat(np.array([1, 0], dtype=np.int32), [len(a), int(new.sum())])
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(role)], names=["id", "a", "part", "role"])


def _searched(bodies: DataFrame, pairs: DataFrame, judge) -> DataFrame:
    """Those of the pairs (a, b) that ``judge`` (query, members: which of them) accepts; bodies: id, body.

    A group ships one query's body and up to GROUP candidates' bodies, so a hot node's candidates spread over tasks; a task
    holds a block of them.
    """
    wanted = pairs.select("a", "b").repartitionByRange("a", "b").sortWithinPartitions("a", "b").mapInArrow(_wanted, "id long, a long, part long, role int")
    shipped = bodies.join(wanted, "id").select("a", "part", "role", "id", "body").repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, ids, members, size = None, [], [], [], 0

        def linked() -> pa.RecordBatch:
            hit = np.zeros(len(ids), dtype=bool)
            for query in queries:
                hit |= judge(query, members)
            found = np.array(ids, dtype=np.int64)[hit]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key[0])), pa.array(found)], names=["a", "b"])

        for batch in batches:
            a, part, role, node = (batch.column(k).to_numpy() for k in range(4))
            for k, body in enumerate(batch.column(4)):
                body = body.as_py()
                if (a[k], part[k]) != key or len(ids) >= BLOCK or size + len(body) > BLOCK_BYTES:
                    if ids and queries:
                        yield linked()
                    ids, members, size = [], [], 0
                if (a[k], part[k]) != key:
                    key, queries = (a[k], part[k]), []
                if role[k] == 0:
                    queries.append(body)
                else:
                    ids.append(node[k])
                    members.append(body)
                    size += len(body)
        if ids and queries:
            yield linked()

    return shipped.mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, heads: DataFrame, pairs: DataFrame, width: int, words: str, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets reach the similarity: every a is a query over its candidates b.

    Bitmaps are shipped first and leave few pairs but the links; the sets of these are worked out once for each node and shipped.
    """
    maps = heads.select("id", F.col("map").alias("body"))
    likely = scratch.write(_searched(maps, pairs, lambda q, m: may_reach(q, m, num, den)), f"{name}_likely")
    ids = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [s.tobytes() for s in _sets(batch.column(1), words, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["id", "body"])

    sets = scratch.write(docs.join(ids, "id", "left_semi").select("id", "text").mapInArrow(hashed, "id long, body binary").where("body <> X''"), f"{name}_sets")
    as_set = lambda body: np.frombuffer(body, dtype=U64)
    return _searched(sets, likely, lambda q, m: reaching(as_set(q), [as_set(x) for x in m], num, den))


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    num: int = 80,
    den: int = 100,
    words: str = "space",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: its id, ``n_shingles``, and ``component_id``, the smallest id reachable by links (itself included).

    Two texts link when den * |A and B| >= num * |A or B| for their sets of ``width``-word shingles; a text of fewer words is
    one shingle; null, empty and wordless texts have no set and link with nothing.  Ids are integers; a null id is never a
    component's name while another id is there.  Repeated rows are equal sets; an id that stands for two different texts is
    one document that links by either.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bits = sketch_bits(base.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    tagged = scratch.write(profile(base, width, words, bits), "profile")
    own = tagged.where("part is null").select("id", "n", "one", "two")
    nodes = own.where("n > 0").groupBy("one", "two", "n").agg(F.min("id").alias("node"))
    nodes = scratch.write(nodes, "nodes")
    levels = sketch(tagged, bits)
    copies = own.where("n > 0").join(nodes, ["one", "two", "n"]).where("id <> node").select("id").distinct()
    copies = copies.join(nodes.select(F.col("node").alias("id")), "id", "left_anti")
    heads = prefixes(base.where("id is not null"), levels, width, words, num, den).where("n > 0")
    heads = scratch.write(heads.join(scratch.write(copies, "copies"), "id", "left_anti"), "heads")
    lists = scratch.write(inverted_lists(heads, num, den, scratch), "lists")

    starred = lists.where(F.col("id") != F.col("leader")).where(_fits(F.col("n"), F.col("pos"), F.col("leader_n"), F.col("leader_pos"), num, den))
    pairs = scratch.write(starred.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "star_pairs")
    links = scratch.write(verified(base, heads, pairs, width, words, num, den, scratch, "star"), "star_links")
    labels = components(links, scratch, "star")

    open_pairs = scratch.write(_open_pairs(lists, labels, num, den, scratch).join(pairs, ["a", "b"], "left_anti"), "open_pairs")
    if not open_pairs.isEmpty():
        more = scratch.write(verified(base, heads, open_pairs, width, words, num, den, scratch, "open"), "open_links")
        if not more.isEmpty():
            labels = components(links.unionByName(more), scratch, "all")
    for name in ("heads", "copies", "lists", "long_lists", "star_pairs", "open_pairs", "mixed", *[f"{k}_{n}" for k in ("star", "open") for n in ("likely", "sets", "links")]):
        scratch.drop(name)
    named = nodes.join(labels, "node", "left").select("one", "two", "n", F.coalesce("component", "node").alias("component_id"))
    full = own.where("n > 0").join(named, ["one", "two", "n"]).select("id", "n", "component_id")
    result = full.unionByName(own.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _open_pairs(lists: DataFrame, labels: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Pairs of one list in different components, other than with the list's leader.

    Only nodes outside a list's commonest component are paired with the rest, so a list that is one component gives none.
    Rows of a list are dealt to tasks by LIST_ROWS; the minority meets each of these parts.
    """
    parts = (F.col("size") / LIST_ROWS).cast("long")
    every = F.explode(F.sequence(F.lit(0), parts).cast("array<long>")).alias("deal")
    seen = lists.where("size > 2").join(labels.withColumnRenamed("node", "id"), "id", "left")
    seen = seen.withColumn("component", F.coalesce("component", "id")).select("gram", "size", "id", "n", "pos", "leader", "component")
    kinds = seen.groupBy("gram", "size").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    seen = seen.withColumn("deal", F.expr(f"pmod(xxhash64(id), cast(size / {LIST_ROWS} as long) + 1)"))
    mixed = scratch.write(seen.join(kinds.select("gram", every), ["gram", "deal"]), "mixed")
    counts = mixed.groupBy("gram", "size", "component").agg(F.count("*").alias("members"))
    most = counts.groupBy("gram", "size").agg(F.max_by("component", F.struct("members", "component")).alias("most")).select("gram", "most", every)
    rows = mixed.join(most, ["gram", "deal"]).where("id <> leader")
    o = rows.where("component <> most").select("gram", every, *[F.col(c).alias(f"o_{c}") for c in ("id", "n", "pos", "component")])
    met = o.join(rows, ["gram", "deal"]).where(
        (F.col("o_component") != F.col("component"))
        & ((F.col("component") == F.col("most")) | (F.col("o_id") < F.col("id")))
        & _fits(F.col("o_n"), F.col("o_pos"), F.col("n"), F.col("pos"), num, den)
    )
    return met.select(F.least("o_id", "id").alias("a"), F.greatest("o_id", "id").alias("b")).distinct()


#: Sets and shingles of one part of a component whose links are counted, and parts a row's component is looked up in.
COUNT_SETS, COUNT_SHINGLES, COUNT_SALT = 512, 1 << 18, 16
_UNIT = ["component", "low", "low_part", "high", "high_part"]


def link_counts(
    docs: DataFrame,
    width: int = 5,
    num: int = 80,
    den: int = 100,
    words: str = "space",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """What ``near_duplicates`` gives per row, and ``n_links``: how many other rows it links with, copies included.

    A component's sets are dealt by size class and hash into parts of bounded size, and every two parts whose classes can link
    meet in one task, which answers each set of the one over the sets of the other and gives counts only, no pairs.  The
    work grows with the square of a component's different sets, as its links may.  Null, empty and wordless texts have none.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    digest = ["one", "two", "n"]

    def hashed(bodies: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = list(_sets(batch.column(1), words, width))
                columns = [
                    pa.array(np.array([np.add.reduce(s, dtype=U64) for s in sets], dtype=U64).view(np.int64)),
                    pa.array(np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else U64(0) for s in sets], dtype=U64).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int64()),
                ]
                body = pa.array([s.tobytes() for s in sets], pa.binary()) if bodies else pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, body], names=["id", *digest, "body"])

        return run

    schema = "id long, one long, two long, n long, body binary"
    named = scratch.write(near_duplicates(docs, width, num, den, words, id_col, text_col).select(F.col(id_col).alias("id"), "component_id").distinct(), "counted_names")
    own = scratch.write(base.mapInArrow(hashed(False), schema).drop("body"), "counted_own")
    nodes = own.where("n > 0").groupBy(*digest).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    nodes = scratch.write(nodes.join(named.withColumnRenamed("component_id", "component"), "id"), "counted_nodes")
    several = nodes.groupBy("component").agg(F.count("*").alias("sets")).where("sets > 1").select("component")
    # sets that link differ in size by less than one class
    size = F.floor(F.log("n") / log2(1.01 * den / num) * log2(np.e)).cast("int")
    open_ = nodes.join(several, "component").withColumn("class", size)
    load = open_.groupBy("component", "class").agg(F.ceil(F.greatest(F.count("*") / COUNT_SETS, F.sum("n") / COUNT_SHINGLES)).cast("int").alias("parts"))
    load = scratch.write(load, "counted_load").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COUNT_SALT - 1))))
    salted = open_.withColumn("salt", F.pmod(F.xxhash64(*digest), F.lit(COUNT_SALT)).cast("int")).join(load, ["component", "class", "salt"])
    salted = salted.withColumn("part", F.pmod(F.xxhash64("two", "one"), F.col("parts")).cast("int")).drop("parts")
    other = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    met = salted.withColumn("other", other).join(load.withColumnRenamed("class", "other"), ["component", "other", "salt"])
    met = met.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    mine, its = F.struct(F.col("class"), F.col("part")), F.struct(F.col("other").alias("class"), F.col("other_part").alias("part"))
    met = met.withColumns({"low": F.least(mine, its), "high": F.greatest(mine, its), "side": F.when(mine == its, 0).when(mine < its, 1).otherwise(2)})
    met = met.select(
        *digest, "copies", "component", "side", F.col("low.class").alias("low"), F.col("low.part").alias("low_part"),
        F.col("high.class").alias("high"), F.col("high.part").alias("high_part"),
    )
    wanted = base.join(open_.select("id").distinct(), "id", "left_semi").mapInArrow(hashed(True), schema)
    bodies = scratch.write(wanted.join(open_.select("id", *digest), ["id", *digest], "left_semi").dropDuplicates(digest).select(*digest, "body"), "counted_bodies")
    shipped = bodies.join(met, digest).select(*_UNIT, "side", *digest, "copies", "body").repartition(*_UNIT).sortWithinPartitions(*_UNIT, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def counted() -> pa.RecordBatch:
            sides = [[r for r in rows if r[0] in two] for two in ((0, 1), (0, 2))]
            found = {r[1]: 0 for r in rows}
            sets = [[np.frombuffer(r[3], dtype=U64) for r in side] for side in sides]
            for a, query in zip(sides[0], sets[0], strict=True):
                for at in range(0, len(sides[1]), BLOCK):
                    block = sides[1][at : at + BLOCK]
                    for k in np.flatnonzero(reaching(query, sets[1][at : at + BLOCK], num, den)).tolist():
                        if block[k][1] != a[1]:
                            found[a[1]] += block[k][2]
                            if a[0]:  # within one part each pair is met from both ends
                                found[block[k][1]] += a[2]
            columns = [pa.array(c, pa.int64()) for c in zip(*[(*k, v) for k, v in found.items()], strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=[*digest, "links"])

        for batch in batches:
            places = list(zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True))
            values = [batch.column(k).to_pylist() for k in range(5, 10)]
            for k, place in enumerate(places):
                if place != key:
                    if rows:
                        yield counted()
                    key, rows = place, []
                side, one, two, n, copies = (v[k] for v in values)
                rows.append((side, (one, two, n), copies, batch.column(10)[k].as_py()))
        if rows:
            yield counted()

    links = shipped.mapInArrow(run, "one long, two long, n long, links long").groupBy(*digest).agg(F.sum("links").alias("links"))
    totals = nodes.select(*digest, "copies", "component").join(links, digest, "left")
    totals = totals.select(*digest, "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = own.where("n > 0").join(totals, digest)
    result = linked.unionByName(own.where("n = 0").select("*", F.col("id").alias("component"), F.lit(0).cast("long").alias("n_links")))
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")


#: Ids of documents to drop are broadcast up to this many, and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the near-duplicates of a document with a smaller id; texts that link with nothing all stay.

    Of rows that repeat both id and text one stays.  Rows with a null id stay.
    """
    scratch = Scratch(docs.sparkSession)
    named = scratch.write(near_duplicates(docs, id_col=id_col, text_col=text_col, **how), "named")
    gone = named.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    repeated = named.groupBy(id_col).count().where("count > 1").select(id_col)
    gone, repeated = scratch.write(gone, "gone"), scratch.write(repeated, "repeated")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, id_col, "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    single = kept.join(repeated, id_col, "left_anti")
    again = kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return single.select(*docs.columns).unionByName(again.select(*docs.columns))
