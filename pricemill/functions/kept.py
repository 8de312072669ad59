"""Tables written once to the folder that all executors share, so that later stages need not go back further."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where the session names no such folder, a local master (tests) gets a
    temporary one; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="panel-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/panel/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Kept:
    """A stored table: rows reads it, drop removes it."""

    rows: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.rows.sparkSession
        own = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def keep(df: DataFrame, name: str) -> Kept:
    """The rows of df, written and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return Kept(df.sparkSession.read.schema(df.schema).parquet(path), path)
