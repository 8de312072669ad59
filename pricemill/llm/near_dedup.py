"""Near-duplicate groups by a chosen-path set similarity join.

Every set is embedded as T minimum hashes. In a tree, a node is the path of (position, minimum hash)
choices that its documents share; which positions a node branches on is drawn from a hash of its
path, 1/threshold of them on average, so a pair at the threshold keeps one common child a level and
survives with a probability that falls off only slowly with depth. Trees repeat until the pairs that
all of them lose, and those that the comparison of sketches loses, are below 1 - recall; as all trees
draw from one sketch, that is reckoned by the number of positions on which a pair agrees.

Nodes that still hold many documents branch as many levels further as the trees are planned for, and
are then compared in blocks, which loses nothing; small ones are compared exhaustively. Most
documents of a node are copies of each other, so each node is first compared as a star around one
member, and only documents that those links leave in different components are compared with each
other: first by sketches, and those that may have a link by their full sets. So a node yields a link
for each component that a member reaches, never all pairs of a group. Exact copies of a set are one
document here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table
from .graph import components
from .words import mix, new_key, shingle_sets

#: Minimum hashes of a set; documents and shingles of a small node at most; levels below the first
#: after which nodes that are still large are compared in blocks; plan() counts on no more of them.
POSITIONS, SMALL_NODE, NODE_SHINGLES, MORE_LEVELS = 128, 4096, 2_000_000, 2
#: Identifiers that are broadcast at most, to pick their texts; more are joined by a shuffle.
SENT_IDS = 2_000_000
RECALL = 0.9999
_U = np.uint64
_RNG = np.random.default_rng(20170605)
_SEED = _RNG.integers(1, 1 << 63, POSITIONS, dtype=np.uint64)
_ODD = _RNG.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * _U(2) + _U(1)
_DRAW = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64)
_PRINTS = "doc_id long, n int, hi long, lo long, sig binary"
_PAIRS = "a long, b long"


def minimum_hashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By set (row) and position the upper half of the least mixed hash; 0 for an empty set."""
    out = np.zeros((len(counts), POSITIONS), np.uint32)
    full = counts > 0
    if full.any():
        at = (np.cumsum(counts) - counts)[full]
        mixed = np.empty_like(hashes)
        for i in range(POSITIONS):
            np.bitwise_xor(hashes, _SEED[i], out=mixed)
            np.multiply(mixed, _ODD[i], out=mixed)
            out[full, i] = np.minimum.reduceat(mixed, at) >> _U(32)
    return out


def _prints(k: int, key: bytes):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for first, hashes, counts in shingle_sets(b.column("text"), k, key=key):
                full, at = counts > 0, np.cumsum(counts) - counts
                marks = np.zeros((2, len(counts)), np.uint64)
                for j in range(2):
                    if full.any():
                        marks[j, full] = np.add.reduceat(mix(hashes ^ _DRAW[j]), at[full])
                sig = minimum_hashes(hashes, counts)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(counts)), pa.array(counts.astype(np.int32)), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["doc_id", "n", "hi", "lo", "sig"],
                )

    return make


def survival(depth: int, threshold: float, agree: float | None = None) -> float:
    """Probability that a pair shares a node `depth` levels down a tree, if it agrees on this share of
    positions (by default the threshold)."""
    extra, lost, agree = 1 / threshold - 1, 0.0, threshold if agree is None else agree
    for _ in range(depth):
        one = 1 - agree * (1 - lost)
        lost = (1 - extra) * one + extra * one * one
    return 1 - lost


def agreeing(threshold: float) -> list[float]:
    """Probability that a pair at the threshold agrees on 0, 1, ... POSITIONS positions."""
    return [math.comb(POSITIONS, a) * threshold**a * (1 - threshold) ** (POSITIONS - a) for a in range(POSITIONS + 1)]


def least_agreeing(threshold: float, recall: float = RECALL) -> int:
    """Positions that a pair at the threshold falls short of with half of the misses allowed at most."""
    chance = agreeing(threshold)
    return next(a for a in range(POSITIONS + 1) if sum(chance[: a + 1]) > (1 - recall) / 2)


def missed(depth: int, trees: int, threshold: float, recall: float = RECALL) -> float:
    """Probability that a pair at the threshold has too few agreeing positions, or no node in common."""
    least, chance = least_agreeing(threshold, recall), agreeing(threshold)
    return sum(chance[:least]) + sum(chance[a] * (1 - survival(depth, threshold, a / POSITIONS)) ** trees for a in range(least, POSITIONS + 1))


def plan(sets: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(levels that every document branches at once, trees): so deep that unrelated documents, of
    which one in twenty agrees on a position, leave small nodes; so many trees that pairs at the
    threshold are found with the recall asked for MORE_LEVELS deeper still, where branching ends."""
    depth, trees = max(1, round(math.log(max(sets, 2)) / math.log(20))), 1
    while missed(depth + MORE_LEVELS, trees, threshold, recall) > 1 - recall:
        trees += 1
    return depth, trees


def branch(sig: np.ndarray, owner: np.ndarray, path: np.ndarray, extra: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of (document, path) rows one level down."""

    def child(rows, paths, position):
        return mix(paths * _DRAW[2] + (position << _U(32)) + sig[rows, position.astype(np.int64)].astype(np.uint64))

    first = mix(path ^ _DRAW[3]) % _U(POSITIONS)
    more = (mix(path ^ _DRAW[4]) >> _U(40)).astype(np.float64) < extra * (1 << 24)
    second = (first[more] + _U(1) + mix(path[more] ^ _DRAW[5]) % _U(POSITIONS - 1)) % _U(POSITIONS)
    return np.concatenate((owner, owner[more])), np.concatenate((child(owner, path, first), child(owner[more], path[more], second)))


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), POSITIONS)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of distinct sets with their sketch: the low byte of each minimum hash."""
    for b in batches:
        low = np.ascontiguousarray(_signatures(b.column("sig")).view(np.uint8)[:, ::4])
        sketch = pa.array([r.tobytes() for r in low], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns, sketch], names=[*b.schema.names, "sketch"])


def _members(depth: int, trees: int, extra: float):
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * _DRAW[6])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), 2048):
                b = whole.slice(first, 2048)
                sig, ids, sizes = _signatures(b.column("sig")), b.column("rep").to_numpy(), b.column("n").to_numpy()
                owner = np.tile(np.arange(len(b)), trees)
                path = np.repeat(roots, len(b))
                for _ in range(depth):
                    owner, path = branch(sig, owner, path, extra)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[owner]), pa.array(sizes[owner])], names=["path", "rep", "n"])

    return make


def _deeper(extra: float):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            owner, path = branch(_signatures(b.column("sig")), np.arange(len(b)), b.column("path").to_numpy().view(np.uint64), extra)
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *(b.column(c).take(rows) for c in ("rep", "n", "label"))], names=["path", "rep", "n", "label"])

    return make


def _fit(a, b, num: int, den: int):
    """Whether two sets of these sizes can reach the threshold num / den."""
    return (a * den >= b * num) & (b * den >= a * num)


def _minority(label: np.ndarray) -> np.ndarray:
    """Places of the members outside the node's most frequent component; every pair that matters has one."""
    names, inverse, often = np.unique(label, return_inverse=True, return_counts=True)
    return np.flatnonzero(inverse != np.argmax(often)) if len(names) > 1 else np.empty(0, np.int64)


def _likely(num: int, den: int, least: int):
    """Of each node (members with sketches) those that may reach the threshold, by size and sketch (at
    least so many agreeing positions), with a member of another component."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, node in zip(b.column("path").to_pylist(), b.column("node")):
                rows = node.values
                sketch = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(-1, POSITIONS)
                n, label = (rows.field(c).to_numpy().astype(np.int64) for c in ("n", "label"))
                picked = np.zeros(len(n), bool)
                few = _minority(label)
                for first in range(0, len(few), 32):
                    i = few[first : first + 32]
                    ok = (label[i][:, None] != label) & _fit(n[i][:, None], n, num, den)
                    x, y = np.nonzero(ok)
                    good = (sketch[i[x]] == sketch[y]).sum(axis=1) >= least
                    picked[i[x[good]]] = True
                    picked[y[good]] = True
                if picked.any():
                    at = pa.array(np.flatnonzero(picked))
                    out.append([pa.array(np.full(len(at), path)), *(rows.field(c).take(at) for c in ("rep", "n", "label"))])
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out)], names=["path", "rep", "n", "label"])

    return make


def common_counts(few: np.ndarray, items: np.ndarray, owner: np.ndarray, members: int) -> np.ndarray:
    """Sizes of the intersections of the sets of the members `few` with all members' sets."""
    found, column, often = np.unique(items, return_inverse=True, return_counts=True)
    shared = often > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, row = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(few), members), np.float32)
    for first in range(0, int(shared.sum()), 2048):
        lo, hi = np.searchsorted(column, (first, first + 2048))
        part = np.zeros((members, 2048), np.float32)
        part[row[lo:hi], column[lo:hi] - first] = 1
        out += part[few] @ part.T
    return out


def _confirmed(num: int, den: int):
    """Links of each node (members with full sets) that join its components: exhaustive and exact, one
    link for each component that a member reaches."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_out, b_out = [], []
            for node in b.column("node"):
                rows = node.values
                ids, label = rows.field("rep").to_numpy(), rows.field("label").to_numpy()
                few = _minority(label)
                sets = rows.field("items")
                n = sets.value_lengths().to_numpy().astype(np.int64)
                items = sets.flatten().to_numpy()
                common = common_counts(few, items, np.repeat(np.arange(len(n)), n), len(n)).astype(np.int64)
                link = (common * den >= (n[few][:, None] + n - common) * num) & (label[few][:, None] != label)
                for x in np.flatnonzero(link.any(axis=1)):
                    ends = np.flatnonzero(link[x])
                    ends = ends[np.unique(label[ends], return_index=True)[1]]
                    a_out += [int(ids[few[x]])] * len(ends)
                    b_out += ids[ends].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return make


def _agreement(a, b):
    import pandas as pd

    if not len(a):
        return pd.Series([], dtype="int64")
    left, right = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, POSITIONS) for x in (a, b))
    return pd.Series((left == right).sum(axis=1))


def _sets(k: int, key: bytes):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("rep")
            for first, hashes, counts in shingle_sets(b.column("text"), k, key=key):
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(counts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], names=["rep", "items"])

    return make


class _Confirmer:
    """Confirms candidate pairs on full sets; the sets it has taken from texts are kept as a table."""

    def __init__(self, docs: DataFrame, reps: DataFrame, k: int, key: bytes, num: int, den: int, least: int):
        self.docs, self.reps, self.k, self.key, self.num, self.den, self.least, self.sets = docs, reps, k, key, num, den, least, None
        self.scratch: list[DataFrame] = []

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """Of the distinct pairs (a, b), those whose sketches agree enough."""
        own = self.reps.select("rep", "sketch")
        agreement = F.pandas_udf(_agreement, "long")
        both = pairs.join(own.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")).hint("merge"), "a")
        both = both.join(own.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")).hint("merge"), "b")
        return both.where(agreement("sa", "sb") >= self.least).select("a", "b")

    def take(self, ids: DataFrame) -> None:
        """Makes the sets of these rows (rep) known."""
        ids = ids.distinct() if self.sets is None else ids.distinct().join(self.sets.select("rep"), "rep", "left_anti")
        ids = stored(ids, "ids")
        self.scratch.append(ids)
        few = ids.count() <= SENT_IDS
        texts = self.docs.select(F.col("doc_id").alias("rep"), "text").join(F.broadcast(ids) if few else ids, "rep", "left_semi")
        new = stored(texts.mapInArrow(_sets(self.k, self.key), "rep long, items array<long>"), "sets")
        self.sets = new if self.sets is None else self.sets.unionByName(new)
        self.scratch.append(new)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those whose full sets reach the threshold."""
        pairs = stored(pairs, "pairs")
        self.scratch.append(pairs)
        self.take(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))))
        left = self.sets.select(F.col("rep").alias("a"), F.col("items").alias("ia"))
        right = self.sets.select(F.col("rep").alias("b"), F.col("items").alias("ib"))
        both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        common = F.size(F.array_intersect("ia", "ib"))
        return stored(both.where(common * self.den >= (F.size("ia") + F.size("ib") - common) * self.num).select("a", "b"), "links")

    def node_links(self, members: DataFrame) -> DataFrame:
        """Links between the components of each node of members (path, rep, label)."""
        members = stored(members, "likely")
        self.scratch.append(members)
        self.take(members.select("rep"))
        full = members.select("path", "rep", "label").join(self.sets.hint("merge"), "rep")
        nodes = full.groupBy("path").agg(F.collect_list(F.struct("rep", "label", "items")).alias("node"))
        return stored(nodes.select("node").mapInArrow(_confirmed(self.num, self.den), _PAIRS).distinct(), "links")


def _sized(members: DataFrame) -> DataFrame:
    """Members of nodes that hold two documents at least, with the node's size and its first member
    in the order of a hash, around which it is compared first."""
    first = F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "n")).alias("first")
    nodes = members.groupBy("path").agg(F.count("*").alias("size"), first).where("size > 1")
    return _with_nodes(members, nodes.select("path", "size", F.col("first.rep").alias("pivot"), F.col("first.n").alias("pivot_n")))


def _with_nodes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """members joined to the sums of their nodes, stored. The sums are a table by then, so that Spark can
    split the members of a node that holds a large part of all rows."""
    nodes = stored(nodes, "nodes")
    out = stored(members.join(nodes.hint("merge"), "path"), "members")
    discard(nodes)
    return out


def _mixed(members: DataFrame) -> DataFrame:
    """Members of nodes that hold documents of two components at least, with the node's size and shingles."""
    nodes = members.groupBy("path").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return _with_nodes(members, nodes.where("lo <> hi").select("path", "size", "weight"))


def _likely_members(members: DataFrame, reps: DataFrame, num: int, den: int, least: int) -> DataFrame:
    """Of small nodes, the members that may have a link to another component of theirs."""
    full = members.join(reps.select("rep", "sketch").hint("merge"), "rep")
    nodes = full.groupBy("path").agg(F.collect_list(F.struct("rep", "n", "label", "sketch")).alias("node"))
    return nodes.mapInArrow(_likely(num, den, least), "path long, rep long, n int, label long")


def _counted(large: DataFrame) -> DataFrame:
    """Members of large nodes with the node's most frequent component, and the size and shingles of the rest."""
    often = large.groupBy("path", "label").agg(F.count("*").alias("often"), F.sum("n").alias("shingles"))
    top = F.max(F.struct("often", "shingles", "label"))
    nodes = often.groupBy("path").agg(top.alias("top"), F.sum("often").alias("size"), F.sum("shingles").alias("weight"))
    nodes = nodes.select("path", F.col("top.label").alias("most"), (F.col("size") - F.col("top.often")).alias("few"), (F.col("weight") - F.col("top.shingles")).alias("few_weight"))
    return _with_nodes(large, nodes)


def _blocks(members: DataFrame) -> DataFrame:
    """Large nodes as small ones that hold every pair of two components. Where most members are of one
    component, blocks of the others meet blocks of all; else blocks of all meet each other."""

    def parts(size: str, weight: str):
        return F.greatest(F.lit(1), F.ceil(F.greatest(F.col(size) / (SMALL_NODE // 2), F.col(weight) / (NODE_SHINGLES // 2)))).cast("long")

    count, few = parts("size", "weight"), parts("few", "few_weight")
    block, few_block = (F.pmod(F.xxhash64("rep", F.lit(i)), n) for i, n in ((1, count), (2, few)))
    zero = F.lit(0).cast("long")
    met = F.transform(F.sequence(zero, few - 1), lambda i: i * count + block)
    meets = F.when(F.col("label") != F.col("most"), F.transform(F.sequence(zero, count - 1), lambda j: few_block * count + j))
    among = F.transform(F.sequence(zero, count - 1), lambda j: F.least(block, j) * count + F.greatest(block, j))
    places = F.when(2 * F.col("few") < F.col("size"), F.array_distinct(F.concat(met, F.coalesce(meets, F.array().cast("array<bigint>"))))).otherwise(among)
    dealt = members.select("rep", "n", "label", "path", F.explode(places).alias("place"))
    return dealt.select("rep", "n", "label", F.xxhash64("path", "place").alias("path"))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, recall: float = RECALL, key: bytes | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) runs without ASCII white space; a document's set holds its distinct
    runs of k words, or all its words as one run if they are fewer. Documents are linked when
    100 * common >= percent * union, and form the components of these links; component_id is the
    least doc_id of a component. Null and wordless texts have an empty set and no link. Rows that
    share a doc_id share its component. A row with a null doc_id has a null component_id and is not
    kept. Other columns are not looked at; an empty table gives no rows. Words are compared by hashes
    under a key that is drawn for this call (or given, to have the same random choices again), so texts
    cannot be made to collide.
    """
    num, den, key = percent, 100, key or new_key()
    threshold = num / den
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = stored(docs.mapInArrow(_prints(k, key), _PRINTS), "prints")
    known = prints.where("n > 0 and doc_id is not null")
    reps = known.groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig"))
    reps = stored(reps.mapInArrow(_sketches, "hi long, lo long, n int, rep long, sig binary, sketch binary"), "sets")
    depth, trees = plan(reps.count(), threshold, recall)
    extra = 1 / threshold - 1
    least = least_agreeing(threshold, recall)
    confirmer = _Confirmer(docs, reps, k, key, num, den, least)

    members = reps.select("rep", "n", "sig").mapInArrow(_members(depth, trees, extra), "path long, rep long, n int")
    members = stored(members, "members")
    nodes = _sized(members)
    discard(members)
    stars = nodes.where((F.col("rep") != F.col("pivot")) & _fit(F.col("n").cast("long"), F.col("pivot_n").cast("long"), num, den))
    stars = stars.select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct()
    links = confirmer.links(confirmer.sketched(stars))
    labels = stored(components(links), "labels")

    named = nodes.where("size > 2").select("path", "rep", "n").join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
    named = stored(named.select("path", "rep", "n", F.coalesce("label", "rep").alias("label")), "named")
    open_nodes = _mixed(named)
    discard(nodes, labels, named)
    likely, opened = None, [open_nodes]
    for level in range(MORE_LEVELS + 1):
        is_small = (F.col("size") <= SMALL_NODE) & (F.col("weight") <= NODE_SHINGLES)
        small, large = open_nodes.where(is_small), open_nodes.where(~is_small)
        last = level == MORE_LEVELS or large.isEmpty()
        small = small.select("path", "rep", "n", "label")
        if level == MORE_LEVELS and not large.isEmpty():
            opened.append(_counted(large))
            small = small.unionByName(_blocks(opened[-1]))
        found = _likely_members(small, reps, num, den, least)
        likely = found if likely is None else likely.unionByName(found)
        if last:
            break
        split = large.join(reps.select("rep", "sig").hint("merge"), "rep").select("path", "rep", "n", "label", "sig")
        split = stored(split.mapInArrow(_deeper(extra), "path long, rep long, n int, label long"), "split")
        open_nodes = _mixed(split)
        discard(split)
        opened.append(open_nodes)
    links = links.unionByName(confirmer.node_links(likely))
    labels = stored(components(links).withColumnRenamed("node", "rep"), "labels")
    discard(*opened, *confirmer.scratch)

    classes = reps.select("hi", "lo", F.col("n"), "rep").join(labels, "rep", "left").select("hi", "lo", "n", F.coalesce("label", "rep").alias("label"))
    out = prints.select("doc_id", "n", "hi", "lo").join(classes.hint("merge"), ["hi", "lo", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents of a near-duplicate group but that of the least doc_id; its repeated
    rows stay, and so do rows without a doc_id or without words."""
    gone = near_groups(docs, k, percent).where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of two-word shingles reach a Jaccard similarity of 0.8."""
    return near_groups(table(spark, sf_dir, "documents"), k=2, percent=80)
