"""Operators against naive versions, and odd rows: very long, repeated, clashing, none."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rangeflow.llm import chat, decontam, fingerprint, jaccard, langid, linear, packing, pii, quality, sharding, text
from rangeflow.llm.queries import tokenizer_path
from rangeflow.llm.rows import own

LONG = "word%d and some more text here " * 60_000


def long_text(k):
    return LONG % tuple(range(k, k + 60_000))


def doubling(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_words_that_defeat_polynomial_hashes():
    from tokenizers import Tokenizer

    from rangeflow.llm.tokens import WordBpe

    words = [w for n in (64, 512, 1024, 4096) for w in (doubling(n), doubling(n).translate(str.maketrans("ab", "ba")))]
    data, offsets = text.string_buffers(pa.array(words))
    assert len(set(text.span_hashes(data, offsets[:-1], offsets[1:]).tolist())) == len(words)
    library = Tokenizer.from_file(tokenizer_path())
    ids, bound = WordBpe(tokenizer_path()).texts(data, offsets)
    for k, w in enumerate(words):
        assert ids[bound[k] : bound[k + 1]].tolist() == library.encode(w, add_special_tokens=False).ids


def test_units_that_share_a_hash_begin_anew(monkeypatch):
    from rangeflow.llm import tokens

    real = tokens.span_hashes
    monkeypatch.setattr(tokens, "span_hashes", lambda d, a, b, seed: real(d, a, b, seed) if seed else np.zeros(len(a), dtype=np.uint64))
    bpe = tokens.WordBpe(tokenizer_path())
    data, offsets = text.string_buffers(pa.array(["one two", "three"]))
    ids, bound = bpe.texts(data, offsets)
    assert bpe.seed == 1 and ids[bound[1] :].tolist() == bpe.library.encode("three", add_special_tokens=False).ids


def test_divide_skip_reaches_what_counting_reaches():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 120))
        query = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        members = []
        for _ in range(int(rng.integers(1, 40))):
            keep = query[rng.random(len(query)) < rng.choice([0.5, 0.85, 0.95, 1.0])]
            members.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(1, 12))).astype(np.uint64)])))
        want = [100 * (c := len(np.intersect1d(query, m))) >= 80 * (len(query) + len(m) - c) for m in members]
        assert jaccard.reaching(query, members, 80, 100).tolist() == want
        may = jaccard.may_reach(jaccard.bitmap(query), [jaccard.bitmap(m) for m in members], 80, 100)
        assert all(m or not w for m, w in zip(may, want, strict=True))


def test_sketch_counts_every_shingle(spark):
    docs = spark.createDataFrame([(k, "the same five words " + " ".join(f"w{k}x{j}" for j in range(30))) for k in range(400)], "id long, text string")
    tagged = jaccard.profile(docs, 1, "space", 16)
    levels = jaccard.sketch(tagged, 16)
    sets = next(jaccard._sets(pa.array(["the same five words"]), "space", 1))
    assert (levels[(sets >> np.uint64(48)).astype(int)] > 0).all() and (levels > 0).sum() == 4


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, long_text(0), "x"), (2, long_text(0) + " end", "y"), (3, long_text(0), "x"), (3, long_text(0), "x"), (None, "a b c d e f", "z"), (4, "a b c d e f", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4


def test_packing_keeps_documents_whole_and_deals_evenly(spark):
    rng = random.Random(4)
    texts = [" ".join("word" for _ in range(int(min(6000, rng.lognormvariate(5, 1))))) for _ in range(1500)] + [long_text(0)]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    rows = packing.pack(docs, tokenizer_path(), id_col="row", step_tokens=1 << 16).collect()
    pieces = Counter(r["row"] for r in rows)
    too_long = {r["row"] for r in rows if r["doc_tokens"] > 4096}
    assert sum(n > 1 for k, n in pieces.items() if k not in too_long) < 0.15 * len(texts)
    windows = {r["sequence_id"]: (r["tier"], r["step_group"]) for r in rows}
    groups = Counter(windows.values())
    for tier in packing.TIERS:
        dealt = [groups.get((tier, g), 0) for g in range(max(g for _, g in groups) + 1)]
        assert max(dealt) - min(dealt) <= 1
    full = Counter()
    for r in rows:
        full[r["sequence_id"]] += r["length"]
    assert sum(full[k] != windows[k][0] for k in full) <= 1


@pytest.mark.parametrize("values", [20, 6000])
def test_shards_equal_the_sorted_order(spark, values):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, "", "same", f"text {k}" * (k % 7)]), "ab"[k % 2], f"s{rng.randrange(values):05d}", 1) for k in range(7000)] + [(7, "twice", "a", "s", 2)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot int")
    got = sharding.hilbert_shards(docs).collect()
    texts = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    from rangeflow.llm.store import Scratch

    bins = docs.select("source", sharding.bins(docs, "source", Scratch(spark)).alias("bin")).distinct().collect()
    ordered = [r["bin"] for r in sorted(bins, key=lambda r: r["source"])]
    assert ordered == sorted(ordered) and len(set(ordered)) == 16
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1


def naive_chunks(data):
    gear, out, a = [int(g) for g in fingerprint._GEAR], [], 0
    while a < len(data):
        cut = len(data)
        if len(data) - a > fingerprint.SMALLEST:
            for i in range(a + fingerprint.SMALLEST, len(data)):
                h = sum(gear[data[j]] << (i - j) for j in range(i - 31, i + 1)) & 0xFFFFFFFF
                mask = int(fingerprint._BEFORE if i < a + fingerprint.NORMAL else fingerprint._AFTER)
                if h & mask == 0 or i + 1 - a == fingerprint.LARGEST:
                    cut = i + 1
                    break
        out.append(bytes(data[a:cut]))
        a = cut
    return out


def test_chunks_equal_a_naive_chunker(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc dé") for _ in range(rng.randint(0, 1500))) for _ in range(20)] + ["", "x" * 700]
    data, offsets = text.string_buffers(pa.array(texts))
    for t, got in zip(texts, fingerprint.chunk_sets(data, offsets), strict=True):
        chunks = set(naive_chunks(t.encode()))
        assert sorted((got & np.uint64(0xFFFF)).tolist()) == sorted(map(len, chunks))
    rows = [(f"k{k:02d}", t, "c") for k, t in enumerate(texts)] + [("k05", texts[5], "c")] * 2 + [("z", long_text(9), "c")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, fingerprint string")
    got = fingerprint.compare_with_next(docs.repartition(5)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    chunks = {k: set(naive_chunks(t.encode())) for k, t, _ in rows[:22]}
    for r in got:
        k = r["doc_id"]
        if k in ("k05", "k21", "z"):
            continue
        a, b = chunks[k], chunks[f"k{int(k[1:]) + 1:02d}"]
        want = sum(map(len, a & b)) / sum(map(len, a)) if a else float(not b)
        assert abs(r["near_next"] - want) < 1e-12


PATHS = {("start", "system"): 0, ("start", "user"): 0, ("start", "assistant"): 1, ("system", "user"): 0, ("system", "assistant"): 1,
         ("user", "assistant"): 0, ("user", "user"): 1, ("assistant", "user"): 0, ("assistant", "assistant"): 1}
CLOSING = {"system": 2, "user": 1, "assistant": 0}


def enumerated_cost(seen):
    best = float("inf")
    for roles in itertools.product(("system", "user", "assistant"), repeat=len(seen)):
        label = sum(0 if r == s else 0.5 if s is None else 3 if "system" in (r, s) else 2 for r, s in zip(roles, seen, strict=True))
        for merges in itertools.product((False, True), repeat=len(seen)):
            cost, last = label, "start"
            for role, merge in zip(roles, merges, strict=True):
                if merge:
                    cost += 1 if role == last else float("inf")
                else:
                    cost += 1.5 * PATHS.get((last, role), float("inf"))
                last = role
            best = min(best, cost + 1.5 * CLOSING[last])
    return best


def test_chat_repair_equals_enumeration_and_cuts_repeated_turns(spark):
    names = ["system", "user", "assistant", None]
    ids = {None: 0, "system": chat.SYSTEM, "user": chat.USER, "assistant": chat.ASSISTANT}
    for seen in itertools.chain.from_iterable(itertools.product(names, repeat=n) for n in (1, 2, 3)):
        got = chat.repair(tuple(ids[s] for s in seen))
        cost = sum(0 if ids[s] == r else 0.5 if s is None else 3 if chat.SYSTEM in (r, ids[s]) else 2 for s, (r, _, _) in zip(seen, got, strict=True))
        cost += sum(m + 1.5 * len(a) for _, m, a in got) + 1.5 * len(chat._CLOSE[got[-1][0]])
        assert abs(cost - enumerated_cost(seen)) < 1e-9, seen
    rows = [(1, 0, "user", "same", "c")] * 500 + [(1, 1, "assistant", long_text(0), "c"), (2, 0, "user", "x", "c")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string").repartition(7)).collect()
    assert len(out) == len(rows) and sum(r["rendered"].count("<|im_start|>user") for r in out if r["conv_id"] == 1) == 1


def test_planted_identifiers_are_found(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    near = ("call", "ring us at", "telephone", "mobile")
    texts, planted = [], set()
    for k in range(600):
        body = f"{word()} {word()} {rng.choice(near)} "
        if k % 3 == 0:
            planted.add(k)
            texts.append(body + f"212 555 {k:04d} {word()}")  # no plus sign: not of a base format
        else:
            texts.append(body + f"+1 212 555 {k:04d} {word()}")
    texts += [f"{word()} order {k:07d} {word()}" for k in range(200)]
    got = {r["doc_id"] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r["spans"] and not r["n_phone"]}
    assert len(got & planted) / len(planted) > 0.95 and len(got & planted) / max(1, len(got)) > 0.99


def test_contexts_are_whole_words():
    t = "a" * 100 + " " * 50 + "12345678" + " " * 60 + "b" * 90
    at = t.index("1")
    assert pii._Context(t).patterns(at, at + 8) == ["l " + "a" * 100, "r " + "b" * 90]


def test_samples_are_bounded(spark):
    one = spark.range(5000).selectExpr("1L as doc_id", "'same text' as text", "'en' as lang")
    assert linear.sampled(one, "doc_id", "text", 100, 5000, "sample").count() <= 200
    both = one.unionByName(spark.createDataFrame([(2, "le chat noir", "fr"), (3, long_text(0), "fr")], "doc_id long, text string, lang string"))
    machines = langid.train(both)
    assert machines is None or len(machines.langs) <= 2


def test_label_model_equals_plain_expectation_maximisation():
    rng = np.random.default_rng(8)
    n = len(quality.LABELLERS)
    codes = np.unique(rng.integers(0, 3**n, 40))
    counts = rng.integers(1, 50, len(codes)).astype(float)
    model = quality.LabelModel(codes, counts, rounds=5)
    votes = [[(c // 3**k) % 3 for k in range(n)] for c in codes.tolist()]
    share = [0.85, 0.05, 0.05, 0.05]
    names = [name for name, *_ in quality.LABELLERS]
    p = [[0.05] * n] + [[0.7 if name in seen else 0.2 for name in names] for seen in quality._SEEN_BY]

    def classes(v):
        a = list(share)
        for c in range(4):
            for k, x in enumerate(v):
                if x != quality.ABSTAIN:
                    a[c] *= p[c][k] if x == quality.POOR else 1 - p[c][k]
        return [x / sum(a) for x in a]

    for _ in range(5):
        post = [classes(v) for v in votes]
        start = (0.85, 0.05, 0.05, 0.05)
        share = [(20 * start[c] + sum(x * q[c] for x, q in zip(counts, post, strict=True))) / (counts.sum() + 20) for c in range(4)]
        for c in range(4):
            for k in range(n):
                poor, fine = (1 + sum(x * q[c] for x, q, v in zip(counts, post, votes, strict=True) if v[k] == kind) for kind in (quality.POOR, quality.CLEAN))
                p[c][k] = poor / (poor + fine)
    first = share.index(max(share))
    assert np.allclose(model.posterior(codes), [classes(v)[first] for v in votes])


def test_erring_labellers_are_found_out():
    """A labeller that cries wolf on a quarter of the clean texts does not decide, though any one vote would under an OR."""
    rng = np.random.default_rng(1)
    n, m = len(quality.LABELLERS), 4000
    kind = rng.choice(4, m, p=[0.8, 0.08, 0.06, 0.06])
    wrong = np.full(n, 0.01)
    wrong[8] = 0.25
    votes = np.where(rng.random((m, n)) < wrong, quality.POOR, quality.CLEAN)
    for c, seen in enumerate(quality._SEEN_BY, 1):
        for k, (name, *_) in enumerate(quality.LABELLERS):
            rows = kind == c
            votes[rows, k] = np.where(rng.random(rows.sum()) < (0.8 if name in seen else 0.05), quality.POOR, quality.CLEAN)
    codes, counts = np.unique(votes @ quality._BASE, return_counts=True)
    model = quality.LabelModel(codes, counts.astype(float))
    called = model.posterior(votes @ quality._BASE) < 0.5
    known = model.accuracies()
    assert abs(known["variety"][0] - 0.75) < 0.05 and known["symbols"][0] > 0.97 and abs(model.clean - 0.8) < 0.05
    assert called[kind == 0].mean() < 0.02 < 0.2 < (votes == quality.POOR).any(axis=1)[kind == 0].mean() and called[kind > 0].mean() > 0.8


def test_contamination_in_passes_equals_one_pass(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(2))
    items = [" ".join(word() for _ in range(rng.choice((3, 9, 15, 30)))) for _ in range(40)]
    items += items[:3]
    docs = [(k, " ".join([word() for _ in range(20)] + (items[k % 43].split()[: rng.randint(3, 30)] if k % 2 else []) + [word() for _ in range(5)]), "x") for k in range(60)]
    docs += [docs[1], (None, None, "x"), (61, "", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, d1 string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = lambda f: sorted((tuple(map(str, r)) for r in f.select("doc_id", "text", "d1", *[own(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]).collect()))
    one = rows(decontam.with_contamination(d, b))
    assert one == rows(decontam.with_contamination(d, b, block_bytes=300)) and len(one) == 63 and sum(r[4] != "0" for r in one) > 20


def test_shared_windows_are_one_pattern():
    text = " ".join(f"w{k}" for k in range(13))
    known = decontam.Patterns(list(range(5000)), [text] * 5000)
    assert len(known.groups[13]["keys"]) == 1 and len(known.items(13, np.array([0]))) == 5000


def test_contamination_of_odd_rows(spark):
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(1, long_text(0) + item, "a"), (2, item, "b"), (2, item, "b"), (3, "clean", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, contaminated string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, item + " x"), (None, item), (4, None)], "item_id long, text string")
    got = decontam.with_contamination(docs, bench).select("doc_id", own("n_hit").alias("h"), own("n_items").alias("i"), own("contaminated").alias("c")).collect()
    assert sorted(map(tuple, got)) == [(1, 20, 3, False), (2, 20, 3, True), (2, 20, 3, True), (3, 0, 0, False)]
