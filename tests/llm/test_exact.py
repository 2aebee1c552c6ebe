"""Operators with an exact answer, against brute force, with nulls, empty and repeated rows, and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rangeflow.llm import chat, decontam, fingerprint, jaccard, packing, pii, sharding
from rangeflow.llm.queries import tokenizer_path
from rangeflow.llm.rows import own
from rangeflow.llm.text import Words, byte_table, text_pieces, window_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, start=0):
    rows = [(start + k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 5))) for _ in range(n))


@pytest.mark.parametrize("kind, pattern", [("alnum", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ("space", r"[^\x20\x09-\x0D]+")])
def test_words_equal_the_regex(kind, pattern):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB9é. \n\t-ß世\x00'") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "x"]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = {}
    for a, b, data, offsets in text_pieces(pa.array(texts), 64):
        w = Words(data, offsets, byte_table(kind))
        h = w.hashes()
        for k in range(b - a):
            want = re.findall(pattern, texts[a + k].translate(lower))
            assert w.row[k + 1] - w.row[k] == len(want)
            for x, v in zip(want, h[w.row[k] : w.row[k + 1]].tolist(), strict=True):
                assert seen.setdefault(x, v) == v
    assert len(set(seen.values())) == len(seen)


def test_window_hashes_are_by_position():
    h = np.arange(1, 8, dtype=np.uint64)
    got, bounds = window_hashes(h, np.array([0, 0, 3, 7]), 3)
    assert np.diff(bounds).tolist() == [0, 1, 2] and len(set(got.tolist())) == 3


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_components(rows):
    sets = {k: shingles(t) for k, t in rows}
    name = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            if name[a] != low or name[b] != low:
                name[a] = name[b] = low
                changed = True
    return {k: (len(sets[k]), name[k]) for k in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "one two", "One two", "one two three"]
    base = [prose(rng, 60).split() for _ in range(6)]
    for b in base:
        for _ in range(12):  # near copies around the threshold, which chain
            w = list(b)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(" ".join(w))
    passage = prose(rng, 40)
    texts += [f"{passage} {prose(rng, rng.randint(1, 12))}" for _ in range(80)]  # one passage in many texts
    texts += [prose(rng, 30) for _ in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_components(rows)


def test_link_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNT_SETS", 4)  # many parts
    rng = random.Random(12)
    texts = [None, "", "one two", "One two", "one two three"]
    for size in (60, 14, 300):
        base = prose(rng, size).split()
        for _ in range(20):
            w = base[: rng.randint(size - size // 5, size)]
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(" ".join(w))
    texts += [texts[-1]] * 3 + [texts[10]] + [prose(rng, 30) for _ in range(5)]
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    names = brute_components(list(enumerate(texts)))
    linked = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    want = {k: (*names[k], sum(j != k and bool(linked(s, t)) for j, t in enumerate(sets))) for k, s in enumerate(sets)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.link_counts(frame(spark, texts)).collect()}
    assert got == want
    assert jaccard.link_counts(frame(spark, []).limit(0)).count() == 0


def test_near_duplicates_of_nothing_and_of_repeats(spark):
    assert jaccard.near_duplicates(frame(spark, []).limit(0)).count() == 0
    docs = frame(spark, ["a b c d e f"]).unionByName(frame(spark, ["a b c d e f"])).unionByName(frame(spark, ["A b c d e f", None], 1))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2]


def brute_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    w, hit, names = words(text), set(), set()
    for item, body in items:
        v = words(body)
        m = min(13, len(v))
        for k in range(len(v) - m + 1 if m else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == v[k : k + m]:
                    hit |= set(range(i, i + m))
                    names.add(str(item))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [16 << 20, 400])
def test_contamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rng = random.Random(3)
    items = [(k, prose(rng, n)) for k, n in enumerate([5, 13, 14, 30, 30, 1, 40])] + [(90, None), (91, "..."), (92, "")]
    items.append((93, items[3][1]))
    texts = [None, "", prose(rng, 50)]
    for _ in range(30):
        body = items[rng.randrange(7)][1].split()
        a = rng.randrange(len(body))
        texts.append(" ".join([prose(rng, rng.randint(0, 60)), " , ".join(body[a : a + rng.randint(1, 20)]).upper().replace("É", "é"), prose(rng, 5)]))
    docs = frame(spark, texts).withColumnRenamed("source", "n_hit")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.with_contamination(docs, bench)
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    rows = {r["doc_id"]: tuple(r[n] for n in names) for r in got.select("doc_id", *[own(n).alias(n) for n in names]).collect()}
    assert rows == {k: brute_contamination(t, items) for k, t in enumerate(texts)}
    assert decontam.with_contamination(docs.limit(0), bench).count() == 0


def test_packing_is_lossless_and_tight(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = [None, "", "x"] + [prose(rng, rng.randint(1, 700)) for _ in range(60)] + ["don't <|endoftext|> 世界 " * 3]
    docs = frame(spark, texts).withColumnRenamed("lang", "tier")
    rows = packing.pack(docs.repartition(3), tokenizer_path()).collect()
    library = Tokenizer.from_file(tokenizer_path())
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    windows, covered = {}, Counter()
    for r in rows:
        own_ids = ids[r["doc_id"]]
        piece = np.array(own_ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(own_ids)
        covered[r["doc_id"]] += r["length"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == Counter({k: len(v) for k, v in ids.items()})
    padding = 0
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 4096
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_personal_data(spark):
    texts = [
        None, "", "mail a@b.c.de, x@y, +1 (212) 555-0188 and 10.0.0.1", "card 4111 1111 1111 1111 or 4111111111111112", "1.2.3.4.5.6.7.8 999.1.1.1 a@b.c@d.e", "é +12345678 " * 3,
    ]
    base = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def fine(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and sum((int(c) * (1 + k % 2) - 9 * (int(c) * (1 + k % 2) > 9)) for k, c in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    got = {r["doc_id"]: r for r in pii.find(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        want = sorted((m.start(), n, m.end(), kind) for n, (kind, p) in enumerate(base.items()) for m in re.finditer(p, t or "") if fine(kind, m.group()))
        text = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert got[k]["spans"] == text and got[k]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, texts)).collect()}
    assert clean[0] is None and clean[2] == "mail <EMAIL>, x@y, <PHONE> and <IP>"


def test_patterns_discover_identifiers(spark):
    rng = random.Random(5)
    texts = [f"{prose(rng, 5)} please call {'+1 212 555 %04d' % rng.randrange(10_000)} {prose(rng, 4)}" for _ in range(60)]
    texts += [f"{prose(rng, 5)} please call 2125550{k} {prose(rng, 4)}" for k in (100, 101)] + [f"{prose(rng, 5)} in 1987 4567 of 8"]
    got = {r["doc_id"]: r["spans"] for r in pii.find(frame(spark, texts)).collect()}
    assert all(got[k].startswith("phone:") for k in (60, 61)) and got[62] == ""


def test_secrets_beside_the_same_words_are_found(spark):
    rng = random.Random(11)
    secret = lambda n, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(n))
    rows, planted = [], {}
    for k in range(120):
        before = prose(rng, 6)
        s = secret(40) if k < 80 else secret(24, "ABCDEFGHJKLMNPQRSTUVWXYZ23456789") if k < 100 else secret(5) + "7" + secret(5) + "1942"
        rows.append(f"{before} {'token' if k % 3 else 'TOKEN'} = \"{s}\" {prose(rng, 3)}")
        planted[k] = (len(before) + 10 - 0, len(s))
    clean = [f"{prose(rng, 8)} model x{rng.randrange(100000)} {prose(rng, 4)}" for _ in range(60)] + [f"{prose(rng, 3)} {secret(40)} {prose(rng, 3)}" for _ in range(3)]
    got = {r["doc_id"]: r for r in pii.find(frame(spark, rows + clean)).collect()}
    caught = sum(any(x == f"secret:{planted[k][0]}:{planted[k][0] + planted[k][1]}" for x in got[k]["spans"].split(",")) for k in planted)
    assert caught >= 0.95 * len(planted)
    assert not any("secret" in got[k]["spans"] for k in range(len(rows), len(rows) + len(clean)))
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got.values())  # secrets have no format
    hidden = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows)).collect()}
    assert "<SECRET>" in hidden[0] and rows[0][planted[0][0] : sum(planted[0])] not in hidden[0]


def test_personal_data_of_odd_rows(spark):
    long = prose(random.Random(2), 30_000) + " a@b.cd"
    rows = [(1, long, "s"), (2, None, "s"), (2, None, "s"), (3, "a@b.cd", "s"), (3, "a@b.cd", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mentions string")
    got = pii.find(docs).collect()
    assert len(got) == 5 and sum(r["n_email"] for r in got) == 3 and pii.find(docs.limit(0)).count() == 0
    out = pii.redact(docs)
    assert out.columns == docs.columns and sorted(str(r["text"])[-7:] for r in out.collect()) == ["<EMAIL>"] * 3 + ["None", "None"] and pii.redact(docs.limit(0)).count() == 0


def test_discovery_goes_on_until_nothing_is_new(spark):
    phone = lambda k: f"2125550{k}"
    half = [f"please call {'+1 212 555 %04d' % k} {'abcdefgh'[k % 8]}" for k in range(20)] + [f"please call {phone(100 + k)}" for k in range(20)]
    hops = [f"{word} {phone(100 + k)}" for word, at in (("ring", range(20)), ("reach", range(20, 40))) for k in at]
    hops += [f"ring {phone(100 + k)}" for k in range(20, 40)] + [f"reach {phone(100 + k)}" for k in range(40, 60)]
    other = [f"order {phone(300 + k)}" for k in range(20)]
    texts = half + hops + other
    got = [r["spans"] for r in sorted(pii.find(frame(spark, texts)).collect(), key=lambda r: r["doc_id"])]
    assert all(s.startswith("phone:") for s in got[: len(half) + len(hops)]) and not any(got[len(half) + len(hops) :])


def test_shards_are_even_and_follow_the_curve(spark):
    rng = random.Random(6)
    docs = frame(spark, [None, ""] + ["same text"] * 40 + [prose(rng, rng.randint(1, 50)) for _ in range(61)])
    rows = sharding.hilbert_shards(docs).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == 103 and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert sharding.hilbert_shards(docs.limit(0)).count() == 0


def test_curve_steps_to_a_neighbour(spark):
    from pyspark.sql import functions as F

    points = spark.range(512).selectExpr("id % 8 x", "cast(id / 8 as int) % 8 y", "cast(id / 64 as int) z")
    rows = points.withColumn("h", sharding.hilbert_index([F.col(c) for c in "xyz"], 3)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(512))
    assert all(sum(abs(a[k] - b[k]) for k in range(3)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_edited_texts_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 2000)
    rng = random.Random(7)
    texts = [None, "", "é", "ab"] + [prose(rng, rng.randint(1, 300)) for _ in range(40)]
    texts[10] = texts[9]
    rows = {r["doc_id"]: r for r in fingerprint.compare_with_next(frame(spark, texts).repartition(4)).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        t, y = t or "", texts[(k + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + y[:half]
        assert rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and rows[k]["n_chars"] == len(t)
    assert rows[9]["fingerprint"] == rows[10]["fingerprint"] and rows[9]["near_next"] == 1.0
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(frame(spark, texts)).collect()}
    assert plain == {k: r["fingerprint"] for k, r in rows.items()}
    assert fingerprint.compare_with_next(frame(spark, []).limit(0)).count() == 0


def test_chunks_resist_a_shift():
    rng = random.Random(8)
    text = prose(rng, 3000).encode()
    a, b = (fingerprint.chunk_sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (text, b"inserted " + text))
    assert fingerprint.containment(a, b) > 0.95


def brute_cost(seen):
    best = {0: 0.0}
    for s in seen:
        new = {}
        for before, cost in best.items():
            for step in chat._STEPS[s]:
                if step[0] == before:
                    new[step[1]] = min(new.get(step[1], 1e9), cost + step[2])
        best = new
    return min(c + chat._END[s] for s, c in best.items())


def test_chat_repair_is_legal_and_least_cost(spark):
    rng = random.Random(9)
    names = ["system", "user", "assistant", "tool", None, "Human"]
    rows = [(c, t, rng.choice(names), rng.choice([None, "", f"t{t}"])) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(1000, t, rng.choice(names[:3]), "x") for t in range(400)] + [(None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {}
    for r in chat.format_chats(df.repartition(5)).collect():
        out.setdefault(r["conv_id"], []).append(r)
    seen = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        seen.setdefault(c, []).append(role)
    for c, turns in out.items():
        turns.sort(key=lambda r: r["turn"])
        assert len(turns) == len(seen[c])
        roles, cost = [], 0.0
        for r, s in zip(turns, seen[c], strict=True):
            state = chat.state_of(s)
            target = {v: k for k, v in chat.ROLES.items()}[r["role"]]
            merged = "merge" in r["action"]
            cost += 0 if target == state else chat.NAME_UNKNOWN if not state else chat.RELABEL_SYSTEM if chat.SYSTEM in (state, target) else chat.RELABEL
            cost += chat.MERGE * merged + chat.INSERT * (len(r["inserted"]) + len(r["appended"]))
            roles += [*r["inserted"], *([] if merged else [r["role"]]), *r["appended"]]
        text = "".join(r["rendered"] for r in turns)
        assert re.findall(r"<\|im_start\|>(\w+)", text) == roles and text.count("<|im_end|>") == len(roles)
        body = roles[1:] if roles[0] == "system" else roles
        assert body == ["user", "assistant"] * (len(body) // 2) and body
        assert abs(cost - brute_cost([chat.state_of(s) for s in seen[c]])) < 1e-9
    assert chat.format_chats(df.limit(0)).count() == 0
