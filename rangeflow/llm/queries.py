"""Queries of the operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer file, found where the package is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeflow.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s), g AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, near) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.near)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.near) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""


@query("op9_ngram_jaccard", OP9_SQL)
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeflow.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), iw AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark
), it AS (
  SELECT item_id, least(13, len(ws)) AS m, unnest([array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') FOR i IN range(1, greatest(1, len(ws) - 12) + 1)]) AS win
  FROM iw WHERE len(ws) > 0
), ms AS (SELECT DISTINCT m FROM it),
cand AS (
  SELECT doc_id, m, unnest([{'i': i, 'win': array_to_string(ws[i:i + m - 1], ' ')} FOR i IN range(1, len(ws) - m + 2)]) AS u FROM dw, ms WHERE len(ws) >= m
), hit AS (SELECT c.doc_id, c.u.i AS i, c.m, it.item_id FROM cand c JOIN it ON it.m = c.m AND it.win = c.u.win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY 1),
its AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(cov.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(its.names, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AND 20 * coalesce(cov.n_hit, 0) >= len(d.ws) AS contaminated
FROM dw d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op3_decontamination", OP3_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeflow.llm.decontam import with_contamination
    from rangeflow.llm.rows import own

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *[own(c).alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeflow.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeflow.llm.quality import with_quality
    from rangeflow.llm.rows import own

    scored = with_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", *[own(c).alias(c) for c in ("posterior", "score", "keep")])


@query("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeflow.llm.sharding import hilbert_shards

    return hilbert_shards(table(spark, sf_dir, "documents"))


@query("op10_fingerprints")
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeflow.llm.fingerprint import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeflow.llm.rows import own
    from rangeflow.llm.toxicity import train, with_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    field = train(docs, table(spark, sf_dir, "labels").where(part != 0))
    scored = with_toxicity(docs, field)
    return scored.select(
        "doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), own("score").alias("score"), (own("score") >= 0.5).cast("int").alias("predicted"), own("spans").alias("spans")
    )


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeflow.llm.langid import train, with_language
    from rangeflow.llm.rows import own

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    machines = train(docs.where(part != 1))
    found = with_language(docs.select("doc_id", "text"), machines)
    return found.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), own("lang_pred").alias("lang_pred"), own("score").alias("score"))


@query("op5_chat_formatting")
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeflow.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH t AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM t a JOIN t c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeflow.llm.negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text <> ''
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
o AS (
  SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase FROM w, (VALUES (1), (2), (3)) AS ks(k) WHERE len(ws) >= k
), f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM o GROUP BY ALL),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= 10),
x AS (SELECT lang, phrase, a, ws, k, unnest(range(1, k)) AS cut FROM c),
y AS (
  SELECT x.lang, x.phrase, x.a, x.cut, fl.a AS l, fr.a AS r, ((1000000::HUGEINT * x.a * x.a) // (fl.a::HUGEINT * fr.a))::BIGINT AS score
  FROM x JOIN f fl ON fl.lang = x.lang AND fl.phrase = array_to_string(x.ws[1:x.cut], ' ') JOIN f fr ON fr.lang = x.lang AND fr.phrase = array_to_string(x.ws[x.cut + 1:x.k], ' ')
  QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, x.cut) = 1
), i AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL
)
SELECT y.lang, row_number() OVER (PARTITION BY y.lang ORDER BY y.score DESC, y.a DESC, encode(y.phrase))::BIGINT AS rank, y.phrase, y.a, y.l, y.r, n.n, y.score
FROM y JOIN n ON n.lang = y.lang LEFT JOIN i ON i.lang = y.lang AND i.phrase = y.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * y.a
QUALIFY row_number() OVER (PARTITION BY y.lang ORDER BY y.score DESC, y.a DESC, encode(y.phrase)) <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeflow.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents").select("text", "lang")).withColumn("rank", F.col("rank").cast("long"))


OP13_SQL = r"""
WITH t AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM t q JOIN t c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


@query("op13_exact_topk", OP13_SQL)
def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rangeflow.llm.exact_topk import top_products

    return top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
