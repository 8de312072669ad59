"""Best-fit packing of documents into training sequences under conflict constraints.

The room of a document is its number of words, or of token ids where these are given (`tokenised`); then
`sequences` puts the ids of each bin together. Documents are dealt by hash into shards of a bounded
number of pieces, so a hot source or a large group of copies spreads over all of them; a shard is
packed by itself. Within a shard the pieces come by falling length. Bins are ordered by what is left of them, and each carries a bitmap of its
duplicate clusters and one bitmap a level of its sources (level i: sources it holds i times at least).
The search begins at the tightest bin that is large enough and goes on to the next larger until one
has no conflict; if none has, a new bin opens.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table
from .token_store import encoder_of
from .words import blank_separated, steps, utf8, words

#: Words of a bin, pieces of one source in a bin at most, pieces of a shard on average.
CAPACITY, PER_SOURCE, SHARD_PIECES = 2048, 4, 4096


def best_fit(pieces: Iterable[tuple[int, int, int]], capacity: int, per_source: int = PER_SOURCE) -> Iterator[tuple[int, int]]:
    """(bin, offset) for each piece (length, source, cluster), in the order given; sources and clusters
    are small numbers, lengths between 1 and capacity."""
    order: list[tuple[int, int]] = []  # (left, bin), by what is left
    clusters: list[int] = []
    sources: list[list[int]] = []
    for length, source, cluster in pieces:
        one_source, one_cluster = 1 << source, 1 << cluster
        at = bisect_left(order, (length, -1))
        while at < len(order):
            number = order[at][1]
            if not (clusters[number] & one_cluster or sources[number][-1] & one_source):
                break
            at += 1
        if at < len(order):
            left, number = order.pop(at)
        else:
            left, number = capacity, len(clusters)
            clusters.append(0)
            sources.append([0] * per_source)
        clusters[number] |= one_cluster
        levels = sources[number]
        for i in range(per_source):
            if not levels[i] & one_source:
                levels[i] |= one_source
                break
        yield number, capacity - left
        if left > length:
            insort(order, (left - length, number))


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = utf8(b.column("text"))
        counts = [np.empty(0, np.int64)]
        for first, last in steps(offsets):
            lo, hi = offsets[first], offsets[last]
            counts.append(words(data[lo:hi], offsets[first : last + 1] - lo, blank_separated(), hashed=False).counts)
        rest = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(np.concatenate(counts))], names=[*rest, "length"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cluster, length) of documents: the length in words, the cluster of equal texts
    (A-Z lower-cased). A null text has length 0, a null source counts as one source."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select("doc_id", source.alias("source"), F.xxhash64(ascii_lower(F.coalesce("text", F.lit("")))).alias("cluster"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_lengths, f"doc_id {kind}, source string, cluster long, length long")


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, by_words: bool = False) -> DataFrame:
    """(doc_id, source, cluster, length, tokens) of documents: the ids of the whole text and end_id, little-endian
    unsigned 32-bit, and their number. A null text has the end alone."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select("doc_id", source.alias("source"), F.xxhash64(ascii_lower(F.coalesce("text", F.lit("")))).alias("cluster"), "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, by_words)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for first in range(0, len(b), 256):
                part = b.slice(first, 256)
                ids = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                wide = [(x if encoder.width == 4 else np.frombuffer(x, "<u2").astype("<u4").tobytes()) + end for x in ids]
                rest = [part.column(c) for c in ("doc_id", "source", "cluster")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array([len(x) // 4 for x in wide], pa.int64()), pa.array(wide, pa.binary())], names=["doc_id", "source", "cluster", "length", "tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(make, f"doc_id {kind}, source string, cluster long, length long, tokens binary")


def near_clustered(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with the near-duplicate group of each doc_id (doc_id, component_id) as its cluster; documents
    without a group keep theirs."""
    own = groups.where("component_id is not null").select("doc_id", F.xxhash64("component_id").alias("__group")).distinct()
    joined = docs.join(own, "doc_id", "left")
    return joined.select(*(F.coalesce("__group", "cluster").alias(c) if c == "cluster" else F.col(c) for c in docs.columns))


def sequences(packed: DataFrame, tokens: DataFrame) -> DataFrame:
    """(bin_id, ids, boundaries) of each bin of pack(tokens): the ids of its pieces in the order of their
    offsets, and for each piece (doc_id, piece, offset, n). A bin holds no more than its capacity, so the
    grouping is bounded. doc_ids must be distinct; pieces without room are in no bin."""
    four = F.lit(4).cast("long")
    own = packed.where("bin_id is not null").join(tokens.select("doc_id", "tokens"), "doc_id")
    ids = F.substring("tokens", (F.col("first_word") * four + 1).cast("int"), (F.col("n_words") * four).cast("int"))
    piece = F.struct("bin_offset", "doc_id", "piece", F.col("n_words").alias("n"), ids.alias("raw"))
    bins = own.groupBy("bin_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [b"".join(x["raw"] for x in bin_) for bin_ in b.column("pieces").to_pylist()]
            ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in raw], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("bin_id"), ids, b.column("boundaries")], names=["bin_id", "ids", "boundaries"])

    bounds = F.transform("pieces", lambda x: F.struct(x.doc_id.alias("doc_id"), x.piece.alias("piece"), x.bin_offset.alias("offset"), x.n.alias("n")))
    kind = "array<struct<doc_id:bigint,piece:bigint,offset:bigint,n:bigint>>"
    return bins.withColumn("boundaries", bounds.cast(kind)).mapInArrow(make, f"bin_id long, ids array<int>, boundaries {kind}")


_OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int64())])
_OUT_SQL = "doc_id long, piece long, first_word long, n_words long, bin_id long, bin_offset long"


def _pack(capacity: int, per_source: int):
    def packed(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        sources: dict = {}
        clusters: dict = {}
        pieces = [(n, sources.setdefault(s, len(sources)), clusters.setdefault(c, len(clusters))) for _, _, n, s, c in rows]
        places = list(best_fit(pieces, capacity, per_source))
        out = [(i, p, p * capacity, n, (shard << 32) | b, at) for (i, p, n, _, _), (b, at) in zip(rows, places)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT.types)], schema=_OUT)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("shard", "doc_id", "piece", "n_words", "source", "cluster"))
            for own, *row in zip(*columns):
                if own != shard:
                    if rows:
                        yield packed(shard, rows)
                    shard, rows = own, []
                rows.append(row)
        if rows:
            yield packed(shard, rows)

    return make


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece of a document: doc_id, piece, first_word, n_words, bin_id, bin_offset.

    docs has doc_id, source, cluster and length. A document longer than the capacity is cut into
    pieces of it, the last one shorter. No bin holds two pieces of a cluster, nor more than per_source
    of a source. A document of length 0 or null takes no room: one row with n_words 0 and null bin_id.
    Ties of length are placed by doc_id and piece (null first). Repeated rows are documents of their
    own (and of one cluster). An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "cluster", F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    docs = stored(docs, "lengths")
    # where many rows share a doc_id, or have none, their places in the table spread them over the shards
    docs = docs.withColumn("copy", F.monotonically_increasing_id())
    count = docs.agg(F.sum(F.ceil(F.col("length") / capacity))).first()[0] or 0
    shards = max(1, -(-int(count) // shard_pieces))
    last = F.floor((F.col("length") - 1) / capacity)
    pieces = docs.where("length > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("length") - F.col("piece") * capacity))
    dealt = (
        pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(shards)))
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", F.desc("n_words"), "doc_id", "piece", "source", "cluster")
        .select("shard", "doc_id", "piece", "n_words", "source", "cluster")
    )
    empty = docs.where("length <= 0").selectExpr("doc_id", "0L as piece", "0L as first_word", "0L as n_words", "cast(null as long) as bin_id", "0L as bin_offset")
    return dealt.mapInArrow(_pack(capacity, per_source), _OUT_SQL).unionByName(empty)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents in bins of CAPACITY words."""
    return pack(measured(table(spark, sf_dir, "documents")))
