"""Scans and sinks of occurrence, reference and summary tables (SRC1 to SRC9, SRC13 to SRC15)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeflow.functions.text import slug

#: The occurrence table's fields.
OCCURRENCE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("observation_id", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("scientific_name", T.StringType()), T.StructField("genus", T.StringType()), T.StructField("observed_on", T.StringType()),
    T.StructField("latitude", T.StringType()), T.StructField("longitude", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("country", T.StringType()), T.StructField("sequence_id", T.StringType()), T.StructField("updated_at", T.StringType()),
])
PRIVATE_FIELDS = ("fingerprint", "seed")


def typed(df: DataFrame) -> DataFrame:
    """Text columns of an occurrence table as their types; other columns as they are."""
    kinds = {"id": "bigint", "latitude": "double", "longitude": "double", "observed_on": "date", "updated_at": "date"}
    return df.withColumns({c: F.expr(f"try_cast({c} as {t})") for c, t in kinds.items() if c in df.columns and dict(df.dtypes)[c] == "string"})


def read_occurrences(spark: SparkSession, path: str, max_rows: int | None = None, since: str | None = None) -> DataFrame:
    """SRC1, SRC2: the eligible records; pages of the source become partitions, predicates reach the scan."""
    df = spark.read.parquet(path)
    if since is not None:
        df = updated_since(df, since)
    return df if max_rows is None else df.limit(max_rows)


def read_occurrences_jdbc(spark: SparkSession, url: str, table: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """SRC1: the same scan of a SQL source, one id range per partition."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="id", lowerBound=low, upperBound=high, numPartitions=partitions)
    return reader.options(**options).load()


def updated_since(df: DataFrame, since: str, column: str = "updated_at") -> DataFrame:
    """SRC2: rows updated on or after a date (``YYYY-MM-DD``, checked)."""
    date.fromisoformat(since)
    return df.where(F.col(column) >= F.lit(since).cast("date"))


def page_after(df: DataFrame, after: int, rows: int, id_col: str = "id") -> DataFrame:
    """SRC1: one keyset page, for callers that still page: the first rows after an id, in its order."""
    return df.where(F.col(id_col) > after).orderBy(id_col).limit(rows)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = OCCURRENCE_SCHEMA) -> DataFrame:
    """SRC3: tab-separated text with a header and no quoting, every column as text, then typed by name."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.schema(text).csv(path, sep="\t", header=True, quote="", escape="", enforceSchema=False)
    return typed(raw)


def write_tsv_gz(df: DataFrame, path: str) -> None:
    """SRC4: gzip tab-separated text, nulls as empty."""
    df.write.csv(path, sep="\t", header=True, compression="gzip", nullValue="", emptyValue="", quote="", escape="")


def write_json(df: DataFrame, path: str) -> None:
    """SRC4: JSON lines with nulls kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def narrowed(df: DataFrame, bytes_: tuple[str, ...] = (), shorts: tuple[str, ...] = ()) -> DataFrame:
    """SRC4: columns in their smallest signed types."""
    return df.withColumns({c: F.col(c).cast("tinyint") for c in bytes_} | {c: F.col(c).cast("smallint") for c in shorts})


def write_compact(df: DataFrame, path: str) -> None:
    """SRC4: Parquet with zstd."""
    df.write.parquet(path, compression="zstd")


def guild_table(raw: DataFrame, genus: str = "GENUS", lifestyle: str = "primary_lifestyle") -> DataFrame:
    """SRC5: genus -> lifestyle; blanks and genera with two lifestyles dropped."""
    rows = raw.select(F.trim(genus).alias("genus"), F.trim(lifestyle).alias("lifestyle")).where("genus <> '' and lifestyle <> ''")
    return rows.groupBy("genus").agg(F.min("lifestyle").alias("lifestyle"), F.count_distinct("lifestyle").alias("kinds")).where("kinds = 1").drop("kinds")


def id_list(text: DataFrame, column: str = "value") -> DataFrame:
    """SRC6: ids of a comma list or of lines; ``#`` starts a comment."""
    parts = text.select(F.explode(F.split(F.regexp_replace(column, "#.*$", ""), ",")).alias("id"))
    return parts.select(F.trim("id").alias("id")).where("id rlike '^[0-9]+$'").select(F.col("id").cast("long").alias("id")).distinct()


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: the list of a file, one id or comma list per line."""
    return id_list(spark.read.text(path))


def cell_bands(cells: DataFrame, layers: DataFrame, wanted: list[str]) -> DataFrame:
    """SRC7: a cell table cut to the bands of some layers (``layers``: band, layer); other bands are never read."""
    bands = [r["band"] for r in layers.where(F.col("layer").isin(wanted)).select("band").orderBy("band").collect()]
    keys = [c for c in ("cell", "cell_id", "x", "y") if c in cells.columns]
    return cells.select(*keys, *[b for b in bands if b in cells.columns])


def checklist_rows(rows: DataFrame, origin: str, taxon: str = "taxon") -> DataFrame:
    """SRC8: a checklist's rows as text: a page address per taxon, shares as whole percents."""
    page = F.concat(F.lit(origin.rstrip("/") + "/taxa/"), F.replace(F.url_encode(F.col(taxon)), F.lit("+"), F.lit("%20")))
    percents = {c: F.concat(F.bround(100 * F.col(c)).cast("int").cast("string"), F.lit("%")) for c in rows.columns if c.endswith("_share")}
    return rows.withColumns(percents).withColumn("page", page).select(*[F.col(c).cast("string") for c in [*rows.columns, "page"]])


def write_checklist(rows: DataFrame, path: str) -> None:
    """SRC8: one CSV file with a byte-order mark, CRLF line ends and all text quoted (checklists are small)."""
    first = rows.columns[0]
    marked = rows.withColumnRenamed(first, "﻿" + first).coalesce(1)
    marked.write.option("lineSep", "\r\n").csv(path, header=True, quoteAll=True)


def checklist_filename(region: str | None, taxon: str | None) -> str:
    """SRC8: the file's name from its region and taxon."""
    import re

    parts = [re.sub("[^a-z0-9]+", "-", p.lower()).strip("-") for p in ("checklist", region or "", taxon or "") if p]
    return "-".join(parts) + ".csv"


def place_index(ranks: DataFrame, min_rank: int = 50, partitions: int | None = None) -> DataFrame:
    """SRC9: (cell, model, rank) rows of at least a rank, ranged by cell and sorted, so that row groups stand for offsets."""
    kept = ranks.where(F.col("rank") >= min_rank).select("cell", "model", F.col("rank").cast("tinyint").alias("rank"))
    ranged = kept.repartitionByRange(partitions, "cell") if partitions else kept.repartitionByRange("cell")
    return ranged.sortWithinPartitions("cell", F.desc("rank"), "model")


def pull_summary(taxa: DataFrame, waterfall: DataFrame) -> DataFrame:
    """SRC13: the publishable counts of a pull: records, taxa, localities and the waterfall's ends; no private columns."""
    counts = taxa.agg(F.sum("records").cast("long").alias("records"), F.count("*").alias("taxa"), F.sum("localities").cast("long").alias("localities"))
    ends = waterfall.agg(F.max("total").cast("long").alias("total"), F.max("used").cast("long").alias("used"))
    return counts.crossJoin(F.broadcast(ends))  # one row by one row


def _public(kind: T.DataType, value: Column, private: tuple[str, ...]) -> Column:
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if f.name not in private]
        return F.when(value.isNotNull(), F.struct(*[_public(f.dataType, value[f.name], private).alias(f.name) for f in kept])) if kept else F.lit(None)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(value, lambda v: _public(kind.elementType, v, private))
    return value


def public_fields(df: DataFrame, private: tuple[str, ...] = PRIVATE_FIELDS) -> DataFrame:
    """SRC14: private fields dropped from the table and from nested structures at any depth."""
    return df.select(*[_public(f.dataType, F.col(f.name), private).alias(f.name) for f in df.schema.fields if f.name not in private])


def public_json(text: Column | str, schema: T.StructType, private: tuple[str, ...] = PRIVATE_FIELDS) -> Column:
    """SRC14: JSON text without the private fields."""
    return F.to_json(_public(schema, F.from_json(text, schema), private))


def read_summary(spark: SparkSession, path: str, schema: T.StructType, release_col: str = "release_id") -> DataFrame:
    """SRC15: the latest release of a published summary, schema given; earlier partitions are not read."""
    full = T.StructType([*schema.fields, T.StructField(release_col, T.StringType())])
    df = spark.read.schema(full).parquet(path)
    latest = df.agg(F.max(release_col)).first()[0]
    return df.where(F.col(release_col) == latest)


def served_waterfall(waterfall: DataFrame, total: str = "total", removed: str = "removed", used: str = "used") -> DataFrame:
    """SRC15: a waterfall's rows only where its total less what was removed is what was used."""
    return waterfall.where(F.col(total) - F.col(removed) == F.col(used))


def slugged(df: DataFrame, column: str, as_: str = "slug") -> DataFrame:
    """File-safe ids of a text column."""
    return df.withColumn(as_, slug(column))
