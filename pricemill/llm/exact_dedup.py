"""Exact deduplication by a tree of merges of sorted digest runs.

Each input partition makes one run: its digests in order, each with the identifier to keep and the
number of rows it stands for. Runs are cut into digest ranges, as many as the measured number of rows
asks for, so no task ever holds a whole run of the corpus. In round r, the runs whose numbers agree
above the lowest r digits (base FAN) are exchanged and merge into one, range by range. Sorting and
merging is done by Spark's sorter, which spills; equal digests, now neighbours, collapse at each level
in a stream of batches, so a task's memory depends neither on the rows nor on the copies it sees.
Rows are only ever collapsed where the whole SHA-256 and the length in bytes agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, partitions, stored, table

#: Runs that one node merges; rows of a digest range on average.
FAN, RANGE_ROWS = 16, 1_000_000
_RUN = "shard int, run int, digest binary, n_bytes long, keep_id long, group_size long"
_NAMES = ("shard", "run", "digest", "n_bytes", "keep_id", "group_size")
_KEYS = ("shard", "run", "digest", "n_bytes")


def _words(column: pa.Array) -> np.ndarray:
    """SHA-256 digests as rows of four numbers."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
    return raw.reshape(len(column), 32).view("<u8")


def _collapsed(keep: str):
    """Neighbours that agree in (shard, run, digest, n_bytes) as one row: the identifier to keep, the sum of
    the sizes. Of each batch the last row is held back, as the next one may go on with it."""
    best = {"smallest": np.minimum, "largest": np.maximum}[keep]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not len(b):
                continue
            b = pa.RecordBatch.from_arrays(b.columns, names=_NAMES)
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            shard, run, n_bytes, ids, sizes = (b.column(c).to_numpy() for c in ("shard", "run", "n_bytes", "keep_id", "group_size"))
            digest = _words(b.column("digest"))
            new = np.ones(len(b), bool)
            new[1:] = (shard[1:] != shard[:-1]) | (run[1:] != run[:-1]) | (n_bytes[1:] != n_bytes[:-1]) | (digest[1:] != digest[:-1]).any(axis=1)
            firsts = np.flatnonzero(new)
            columns = [b.column(c).take(pa.array(firsts)) for c in _KEYS]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(best.reduceat(ids, firsts)), pa.array(np.add.reduceat(sizes, firsts))], names=_NAMES)
            held = out.slice(len(out) - 1)
            if len(out) > 1:
                yield out.slice(0, len(out) - 1)
        if held is not None:
            yield held

    return make


def exact_groups(digests: DataFrame, keep: str = "smallest", range_rows: int = RANGE_ROWS) -> DataFrame:
    """(digest binary, n_bytes, keep_id, group_size) of the rows (doc_id, digest, n_bytes), the digests of
    32 bytes.

    keep: "smallest" or "largest" doc_id of a group. An empty table gives no rows; repeated rows
    count each time. Null doc_ids are not identifiers and must be removed first.
    """
    spark = digests.sparkSession
    rows, last = digests.select(F.spark_partition_id().alias("run")).agg(F.count("*"), F.max("run")).first()
    ranges = max(partitions(spark), -(-rows // range_rows))
    rounds = max(1, math.ceil(math.log((last or 0) + 1, FAN) - 1e-9))
    # the first 32 bits of a digest, scaled to the number of ranges
    shard = F.floor(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("double") * ranges / F.lit(float(1 << 32))).cast("int")
    runs = (
        digests.select(shard.alias("shard"), (F.spark_partition_id() % FAN**rounds).alias("run"), "digest", "n_bytes", F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        .sortWithinPartitions(*_KEYS)
        .mapInArrow(_collapsed(keep), _RUN)
    )
    for _ in range(rounds):
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / FAN).cast("int"))
            .repartition(ranges, "shard", "run")
            .sortWithinPartitions(*_KEYS)
            .mapInArrow(_collapsed(keep), _RUN)
        )
    return runs.select("digest", "n_bytes", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the smallest (or largest) doc_id stays; every repeated row of that doc_id is marked
    kept. A null doc_id gets null keep_id, group_size 0 and kept false. Other columns of docs are
    not looked at and not returned. The result reads a stored table of digests (see common.release).
    """
    low = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    digests = docs.select("doc_id", F.unhex(F.sha2(low, 256)).alias("digest"), F.octet_length(low).cast("long").alias("n_bytes"))
    digests = stored(digests, "digests")
    groups = exact_groups(digests.where("doc_id is not null"), keep)
    joined = digests.join(groups.hint("merge"), ["digest", "n_bytes"], "left")
    known = F.col("doc_id").isNotNull()
    return joined.select(
        "doc_id",
        F.when(known, F.col("keep_id")).alias("keep_id"),
        F.when(known, F.col("group_size")).otherwise(F.lit(0)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row and whole text of documents; of equal texts the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
