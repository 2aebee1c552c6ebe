"""A corpus from raw documents: drop poor texts, near-duplicates and benchmark copies, redact personal data, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
documents.  All but the last keep the columns of their input.  Empty and null texts are kept by every stage (they are neither
poor, nor copies, nor contaminated) and pack as their end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.llm.decontam import with_contamination
from rangeflow.llm.jaccard import keep_one
from rangeflow.llm.packing import pack
from rangeflow.llm.pii import redact
from rangeflow.llm.quality import with_quality
from rangeflow.llm.queries import table, tokenizer_path
from rangeflow.llm.rows import own
from rangeflow.llm.store import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return with_quality(docs).where(own("keep")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows are less than a twentieth."""
    return with_contamination(docs, table(spark, sf_dir, "benchmark")).where(~own("contaminated")).select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind, and ``n_chars`` brought up to date."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(dict(docs.dtypes)["n_chars"]), "n_chars"))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in context windows."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("packing", packing),
]

#: The quality classifier is fitted, which SQL cannot express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of a folder of tables."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
