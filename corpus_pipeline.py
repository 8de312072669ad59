"""The corpus pipeline: stages over documents, each one operator of pricemill.llm.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; all but the last return the
columns of documents. Near-duplicate and shingle work takes five words and a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricemill.llm.common import discard, mark, release, stored, table
from pricemill.llm.decontaminate import decontaminate
from pricemill.llm.language import drop_unidentified, sample
from pricemill.llm.line_dedup import remove_boilerplate
from pricemill.llm.near_dedup import drop_near_copies
from pricemill.llm.packing import measured, pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without a letter go."""
    return drop_unidentified(docs, sample(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; those of which nothing is left go."""
    return remove_boilerplate(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least doc_id."""
    return drop_near_copies(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in bins."""
    return pack(measured(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express language identification by parsing or the packing; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each one's rows written and read again; what a stage stored on its
    way is removed once its rows are written, and so are the rows before them."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        at = mark()
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, at, keep=(docs,))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
