"""Tables that cut lineage, in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is made only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="rangeflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Written tables of one job: readable from every executor, so a lost executor costs a re-read, not a re-run."""

    _left: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/rangeflow-{uuid.uuid4().hex}"
        Scratch._left.append((spark, self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete_path(self.spark, f"{self.root}/{name}")


@atexit.register
def _clean() -> None:
    for spark, root in Scratch._left:
        try:
            delete_path(spark, root)
        except Exception:  # the session may be gone at exit
            return
