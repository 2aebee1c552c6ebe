"""Fitted operators on held-out rows, and the pipeline's stages."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rangeflow.llm import langid, quality, toxicity
from rangeflow.llm.queries import QUERIES
from rangeflow.llm.rows import own

DIR = "/root/testdata/sf0.01"


def test_quality_keeps_clean_texts(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    rows = {r["doc_id"]: r["keep"] for r in QUERIES["op1_quality"](spark, DIR).collect()}
    clean = [rows[k] for k, q in labels.items() if q == 1]
    poor = [rows[k] for k, q in labels.items() if q == 0]
    assert sum(clean) / len(clean) > 0.99 and 1 - sum(poor) / len(poor) > 0.9


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "word", "c"), (3, "word", "c")], "doc_id long, text string, score string")
    rows = quality.with_quality(docs).select("doc_id", own("keep").alias("keep")).collect()
    assert len(rows) == 4 and all(r["keep"] for r in rows if r["doc_id"] < 3)
    assert quality.with_quality(docs.limit(0)).count() == 0


def test_toxic_words_are_found_with_their_places(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abdeg") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for k in range(300):
        w = [word() for _ in range(rng.randint(5, 60))]
        bad = k % 3 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["zloty", "zlorp", "quix"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    field = toxicity.train(docs, known.where("doc_id < 200"))
    got = {r["doc_id"]: (r["score"], r["spans"]) for r in toxicity.with_toxicity(docs, field).select("doc_id", own("score").alias("score"), own("spans").alias("spans")).collect()}
    right = sum((got[k][0] >= 0.5) == bool(y) for k, y in labels if k >= 200)
    assert right >= 97
    k, text = next((k, t) for k, t in rows if k >= 200 and k % 3 == 0 and got[k][1])
    assert any(text[s["start"] : s["end"]] in ("zloty", "zlorp", "quix") for s in got[k][1])
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert all(r["s"] < 0.5 for r in toxicity.with_toxicity(empty, field).select(own("score").alias("s")).collect())


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    f = toxicity.Field()
    f.move = np.array([-1.0, 0.3, 0.8])
    for n in (1, 2, 9):
        w = np.exp(rng.normal(size=n))
        total, marginal = 0.0, np.zeros(n)
        a = np.array([[1.0, np.exp(-1.0)], [np.exp(0.3), np.exp(0.8)]])
        for y in itertools.product((0, 1), repeat=n):
            p, before = 1.0, 0
            for t in range(n):
                p *= a[before, y[t]] * (w[t] if y[t] else 1.0)
                before = y[t]
            total += p
            marginal += p * np.array(y)
        assert np.allclose(f.marginals(w, np.array([0, n]))[0], marginal / total)
    long = np.exp(rng.normal(size=300))
    both = f.marginals(np.concatenate([long, long[:7]]), np.array([0, 0, 300, 307]))[0]
    assert np.allclose(both[300:], f.marginals(long[:7], np.array([0, 7]))[0])


def test_languages(spark):
    rows = QUERIES["op6_language_id"](spark, DIR).where("held_out").join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %"), (4, "é")], "doc_id long, text string")
    machines = langid.train(spark.read.parquet(f"{DIR}/documents.parquet"))
    got = {r["doc_id"]: (r["l"], r["s"]) for r in langid.with_language(odd, machines).select("doc_id", own("lang_pred").alias("l"), own("score").alias("s")).collect()}
    assert [got[k][0] for k in (1, 2, 3)] == ["und"] * 3 and got[4][0] != "und"
    assert {r["l"] for r in langid.with_language(odd, None).select(own("lang_pred").alias("l")).collect()} == {"und"}


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_odd_rows(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).unionByName(odd)
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert {10**9, 10**9 + 1} <= {r["doc_id"] for r in out.select("doc_id").collect()}
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_offsets_of_a_very_long_toxic_text(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    field = toxicity.train(docs.select("doc_id", "text"), labels)
    toxic = docs.join(labels.where("toxic = 1"), "doc_id")
    spans = toxicity.with_toxicity(toxic, field).where(F.size(own("spans")) > 0).select("text", own("spans").alias("s")).first()
    words = spans["text"][spans["s"][0]["start"] : spans["s"][0]["end"]]
    long = f"é {words} {spans['text'][:200]} " * (720_000 // (len(words) + 204))
    began = time.time()
    got = toxicity.with_toxicity(spark.createDataFrame([(1, long)], "doc_id long, text string"), field).select(own("spans").alias("s")).first()["s"]
    assert time.time() - began < 20 and len(got) > 1000
    at = [(x["start"], x["end"]) for x in got]
    assert at == sorted(at) and all(long[a - 1] == " " and not long[a:b].startswith(" ") and not long[a:b].endswith(" ") for a, b in at if a)


def test_odd_rows_of_toxicity_and_language(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    field, machines = toxicity.train(docs, labels), langid.train(docs)
    long = " ".join(["und der die das nicht gleh"] * 40_000)
    odd = spark.createDataFrame([(1, long, 0.1), (1, long, 0.1), (2, None, 0.2), (3, "", 0.3)], "doc_id long, text string, score double")
    for out in (toxicity.with_toxicity(odd, field), langid.with_language(odd, machines)):
        rows = out.select("doc_id", "score", own("score").alias("s")).collect()
        assert len(rows) == 4 and sorted(r["score"] for r in rows) == [0.1, 0.1, 0.2, 0.3] and len({r["s"] for r in rows if r["doc_id"] == 1}) == 1
    assert toxicity.with_toxicity(odd.limit(0), field).count() == 0 and langid.with_language(odd.limit(0), machines).count() == 0


def test_held_out_rows_are_not_learned_from(spark):
    """The query's predictions stay the same when the held-out rows' own language and label say otherwise."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    twisted = docs.withColumn("lang", F.when(part == 1, "xx").otherwise(F.col("lang")))
    one, two = (langid.train(d.where(part != 1)) for d in (docs, twisted))
    assert one.langs == two.langs and all(np.array_equal(one.pairs[k][0], two.pairs[k][0]) for k in one.pairs)


def test_languages_of_only_long_texts_are_learned(spark):
    rows = [(k, "der die das und nicht " * 5, "de") for k in range(30)] + [(100, "le la les et pas " * 5000, "fr"), (101, "le la les et pas " * 4000, "fr")]
    machines = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert machines.langs == ["de", "fr"]
    many = [(k, f"{'abcdefghijklmnopqrstuvwxyz'[k % 26] * 5} " * 10, f"{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{k:03d}") for k in range(150)]
    assert len(langid.train(spark.createDataFrame(many, "doc_id long, text string, lang string")).langs) == 150


def test_label_model_differs_from_any_one_vote(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    model, _, _ = quality.train(docs)
    right = model.accuracies()
    assert 0.7 < model.clean < 0.95 and all(clean > 0.9 for clean, _ in right.values()) and any(clean < 0.999 for clean, _ in right.values())


def test_the_whole_pipeline_packs_what_the_stages_keep(spark):
    """``run`` gives the pieces of exactly the documents that the stages keep one after another, whole and gapless."""
    folder = "/root/testdata/sf0.001"
    pieces = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    kept = {r["doc_id"] for r in docs.collect()}
    per_doc: dict[int, list] = {}
    for r in pieces:
        per_doc.setdefault(r["doc_id"], []).append(r)
    assert set(per_doc) == kept and 0 < len(kept) < 200
    for rows in per_doc.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == rows[0]["doc_tokens"]
    windows: dict[int, list] = {}
    for r in pieces:
        windows.setdefault(r["sequence_id"], []).append(r)
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "word " * 9000, "c"), (4, "one two", "d")], "doc_id long, text string, start string")
    rows = corpus_pipeline.packing(spark, docs, "").collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4} and {r["doc_tokens"] for r in rows if r["doc_id"] < 3} == {1}
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) > 4096 and corpus_pipeline.packing(spark, docs.limit(0), "").count() == 0
