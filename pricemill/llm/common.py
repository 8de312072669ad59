"""What the corpus operators share: tables that cut lineage, and the reading of a session's settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricemill.functions.workers import let_workers_import

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; only Spark opens the path."""
    return let_workers_import(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which all executors share.

    Where the session names no such folder, a local master (tests) gets a temporary one; on a cluster
    that is an error, as each executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/corpus/{name}-{uuid.uuid4().hex}"


#: Paths of the stored tables that are still there, in the order they were made.
_MADE: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: later stages
    survive the loss of any executor without computing df again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _MADE.append(path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
    if path in _MADE:
        _MADE.remove(path)


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing will read again."""
    for df in tables:
        _remove(df.sparkSession, df.stored_at)


def mark() -> int:
    """A place to which release goes back."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Removes the tables that were stored since the mark, but those to keep. A result that an operator
    returned reads such tables, so it must have been written before."""
    kept = {df.stored_at for df in keep}
    for path in _MADE[since:]:
        if path not in kept:
            _remove(spark, path)


def free_name(name: str, *tables: DataFrame) -> str:
    """The name, with underscores before it until no table has such a column (in any case of letters)."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
