"""Hard negatives, phrases and top-k against brute force, and odd rows."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rangeflow.llm import exact_topk, negatives, phrases, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def table(spark, rng, n=150, width=12, ids=None):
    """Vectors with ties, repeated rows and others that take no part."""
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[n // 3 : n // 2] = x[n // 3]  # a third of a quarter are the same
    rows = [(int(k if ids is None else ids[k]), [float(v) for v in x[k]], int(rng.integers(0, 10)), "c") for k in range(n)]
    odd = [(n, None, 1, "c"), (n + 1, [1.0, None] + [0.0] * (width - 2), 1, "c"), (n + 2, [float("nan")] * width, 1, "c"), (n + 3, [float("inf")] * width, 2, "c"), (None, rows[0][1], 1, "c"), (n + 5, rows[1][1], None, "c")]
    return rows, spark.createDataFrame([*rows, *odd], SCHEMA).repartition(3)


def whole(rows, scale):
    return np.floor(scale * np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64))


def brute_top(rows, asked, scale, k):
    v, out = whole(rows, scale), []
    for q in asked:
        scored = sorted((-int(v[q] @ v[c]), rows[c][0]) for c in range(len(rows)) if rows[c][0] != rows[q][0])[:k]
        out += [(rows[q][0], n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 500])
def test_top_products_equal_brute_force(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK_BYTES", 300)
    rows, df = table(spark, np.random.default_rng(1))
    extra = spark.createDataFrame([(150, rows[9][1], 3, "c")], SCHEMA)  # another id, the same vector; row 150 is null in the table
    got = exact_topk.top_products(df.unionByName(extra), F.col("vec_id") % 20 == 0, k=7, block_bytes=block_bytes)
    rows = [*rows, (150, rows[9][1], 3, "c")]
    asked = [k for k, r in enumerate(rows) if r[0] % 20 == 0]
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(rows, asked, 64, 7)


def test_repeated_rows_count_and_repeated_queries_do_not(spark):
    rows = [(0, [1.0, 0.0], 1, "c"), (0, [1.0, 0.0], 1, "c"), (1, [2.0, 0.0], 1, "c"), (1, [2.0, 0.0], 1, "c"), (2, [1.5], 1, "c"), (3, [], 1, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_topk.top_products(df, F.col("vec_id") == 0, scale=2, k=5).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 8), (1, 8), (2, 6), (3, 0)]
    assert exact_topk.top_products(df.limit(0), F.col("vec_id") == 0).count() == 0 and exact_topk.top_products(df, F.col("vec_id") == 9).count() == 0


def test_bounds_are_bounds_and_refute(spark):
    rng = np.random.default_rng(2)
    a, b = np.floor(64 * rng.normal(size=(40, 64))), np.floor(64 * rng.normal(size=(50, 64)))
    exact, last = a @ b.T, np.inf
    for segments in exact_topk.LEVELS:
        bound = exact_topk.segment_statistics(a, segments) @ exact_topk.segment_statistics(b, segments).T
        assert (bound >= exact - 1e-6).all() and bound.sum() <= last + 1e-6
        last = bound.sum()
    # vectors of few directions: most pairs need no exact score
    base = rng.normal(size=(20, 64))
    x = np.repeat(base, 300, axis=0) * rng.uniform(0.5, 2, (6000, 1)) + 0.01 * rng.normal(size=(6000, 64))
    x += np.repeat(rng.normal(size=(20, 16)), 300, axis=0).repeat(4, axis=1) * 3
    df = spark.createDataFrame([(k, [float(v) for v in r], 0, "c") for k, r in enumerate(x)], SCHEMA).coalesce(1)
    met = {r["level"]: r["pairs"] for r in exact_topk.pairs_met(df, F.col("vec_id") % 500 == 0, k=5).collect()}
    assert met[3] < 0.8 * 12 * 5999 and met[0] > 0


def brute_negatives(rows, scale=256, k=5, m=5):
    v, out = whole(rows, scale), []
    for a, r in enumerate(rows):
        if r[0] % 10:
            continue
        scored = sorted(((-int(v[a] @ v[c]), rows[c][0], rows[c][2] == r[2]) for c in range(len(rows)) if rows[c][0] != r[0]), key=lambda x: x[:2])
        for s, p, _ in [x for x in scored if x[2]][:k]:
            fits = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:m]
            out += [(r[0], p, n, x[1], -s, -x[0]) for n, x in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_hard_negatives_equal_brute_force(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK_BYTES", 200)
    rows, df = table(spark, np.random.default_rng(4))
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block_bytes=block_bytes)
    want = brute_negatives(rows)
    assert len(want) > 20 and sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want
    assert negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("width, size", [(1, 10), (64, 300), (700, 50), (9000, 20), (64, 100_000), (5, 3_000_000)])
def test_residue_products_are_exact(width, size):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-size, size + 1, (9, width)).astype(float) for _ in range(2))
    a[0], b[0] = size, -size
    want = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    assert (negatives.residue_product(a, b) == want.astype(np.int64)).all()
    primes = negatives.moduli(width, float(size) ** 2 * width)
    half = [(p - 1) // 2 for p in primes]
    assert len(set(primes)) == len(primes) and all(h * h * min(width, 4096) < 1 << 24 for h in half)


def test_products_beyond_doubles_are_exact_or_an_error():
    a = np.array([[2.0**40, 3.0]])
    assert negatives.residue_product(a, np.array([[2.0**20, 5.0]]))[0, 0] == 2**60 + 15
    with pytest.raises(OverflowError):
        negatives.residue_product(a, a)


# ---- phrases ---------------------------------------------------------------------------------


def brute_phrases(rows, support=10, longest=3, most=2000):
    counts, n = {}, Counter()
    for text, lang in rows:
        f = counts.setdefault(lang or "und", Counter())
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        able = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        kept = []
        for p, a in able.items():
            longer = [b for q, b in able.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 50 * a for b in longer):
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, t.decode(), -a, x, y, n[lang], -s) for r, (s, a, t, x, y) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def words_of(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "!\n"]) for _ in range(n))


def phrase_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = ["New", "York", "é", "ß", "x\x00y", "a-b", "THE", "the", "of", "z", "十"] + [f"w{k}" for k in range(3)]
    rows = [(words_of(rng, rng.randint(1, 60), vocabulary), rng.choice(["en", "en", "fr", None])) for _ in range(500)]
    rows += [(None, "en"), ("", "de"), (" \t ,.", "fr"), ("New\tYork  city " * 40, "en"), ("New York city. " * 30, "en")] + [rows[0]] * 12
    return rows


@pytest.mark.parametrize("shards, flush", [(4, 1 << 20), (1, 200), (7, 3000)])
def test_phrases_equal_brute_force(spark, monkeypatch, shards, flush):
    monkeypatch.setattr(phrases, "FLUSH_BYTES", flush)
    monkeypatch.setattr(phrases, "RANGE_BYTES", 500 if shards == 7 else 1 << 20)  # several ranges
    rows = phrase_rows()
    df = spark.createDataFrame([(t, lang, 1) for t, lang in rows], "text string, lang string, words int").repartition(5)
    got = phrases.collocations(df, shards=shards).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = brute_phrases(rows)
    assert len(want) > 100 and sorted(map(tuple, got)) == want


def test_most_phrases_and_empty_tables(spark):
    rows = phrase_rows(5)
    df = spark.createDataFrame(rows, "text string, lang string")
    got = phrases.collocations(df, most=7).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, most=7)
    assert phrases.collocations(df.limit(0)).count() == 0
    few = spark.createDataFrame([("rare words only", "en")], "text string, lang string")
    assert phrases.collocations(few).count() == 0


def test_every_frequent_phrase_is_frequent_in_a_shard(spark):
    """The union of the shards holds every phrase of the support, whatever the shards' sizes."""
    for counts in itertools.product((0, 1, 4, 9, 30), repeat=3):
        sizes = [c + s for c, s in zip(counts, (50, 10, 3), strict=True)]
        if sum(counts) >= 10:
            assert any(c >= -(-10 * s // sum(sizes)) for c, s in zip(counts, sizes, strict=True))


def test_words_of_a_very_long_text_stand_once():
    text = "Ab c," * 300_000
    words = phrases.Pieces(*phrases.string_buffers(pa.array([text, "c d"])))
    assert len(words.hash) == 600_002 and words.joined.sum() == 300_001 and words.bytes[:5].tobytes() == b"ab c "
