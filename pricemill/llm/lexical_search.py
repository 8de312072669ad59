"""Exact top-k lexical search of many queries by three rounds over term-partitioned posting lists (TPUT).

1. The head of each list, its k highest contributions, gives partial sums; the documents of the highest ones
   are scored exactly, and a query's k-th highest of these is a lower bound of its k-th highest score.
2. A document that reaches the bound has, in at least one of the query's m lists, a contribution of at least
   bound / m: every list is read down to that threshold (and somewhat deeper, see DEEPER). Better lower bounds come
   of it, and upper bounds from the threshold and the head of the lists in which a document was not met.
3. The documents whose upper bound reaches the k-th lower bound are looked up and scored exactly.

No document that belongs to a result is lost, so the results are exact. Lists are dealt by ranges of (term,
contribution), so the list of a frequent term lies over many partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, partitions, stored, table
from .words import steps, utf8

#: Bytes of the queries' distinct terms, and terms of all queries, up to which they go to every task; more
#: are joined by shuffles of the postings instead.
VOCABULARY_BYTES, QUERY_TERMS = 16 << 20, 1_000_000
#: Documents of the heads that are scored exactly for an item, in multiples of k; pairs of an item and a list entry that one
#: numpy step takes.
HEAD_DOCUMENTS, PAIRS_TOGETHER = 5, 1 << 21
#: How far below bound / m lists are read. At bound / m itself what a document may have in lists where it was not met
#: is as much as the bound asks for, so nothing could be left out; a quarter of it leaves a quarter of the bound open.
DEEPER = 4
#: Letters of a term: ASCII digits and letters and all beyond ASCII.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ROWS = "row long, doc_id long, n long, terms array<string>, tfs array<long>"
_SUMS = pa.schema([(c, pa.int64()) for c in ("item", "row", "doc_id", "score", "upper")])
_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])


def _counted(wanted: frozenset[bytes] | None):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            _, offsets = utf8(b.column(1))
            for first, last in steps(offsets):
                rows = []
                for doc_id, text in zip(b.column(0)[first:last].to_pylist(), b.column(1)[first:last].to_pylist()):
                    found = Counter((text or "").encode("utf-8").translate(_LETTERS).split())
                    n = found.total()
                    terms = list(found if wanted is None else found.keys() & wanted)
                    rows.append((row, doc_id, n, [t.decode("utf-8") for t in terms], [found[t] for t in terms]))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    return make


def counted(docs: DataFrame, wanted: frozenset[bytes] | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n, terms, tfs), stored: a number for each row of docs, the terms in its whole text with repeats, and
    the distinct terms (only the wanted ones, unless None) with their occurrences."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(_counted(wanted), _ROWS), "terms")


def query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, item_id, term, times), stored: a number for each row of items, its terms and how often it has them."""
    numbered = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text")), "items")
    terms = numbered.select("item", "item_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(_TERM), F.lit(0))).alias("term"))
    return stored(terms.groupBy("item", "item_id", "term").agg(F.count("*").alias("times")), "queries")


class Postings:
    """Posting lists of the terms that some queries hold, and the documents' terms for exact look-ups.

    A term weighs floor(1000 ln((2N + 2) / (2df + 1))); a document contributes weight * (10**9 tf div
    (1000 tf + 12 m)) with m = 75 + (25 n N) div L. N counts the documents with a term, L all their terms.
    """

    def __init__(self, docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        self.small, wanted = self._wanted(queries)
        every = counted(docs, wanted, doc_id, text)
        held = every.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("row", "doc_id", "n", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
        if not self.small:  # all terms of all documents: a semi-join by term keeps those of the queries
            held = stored(held.join(queries.select("term").distinct(), "term", "left_semi"), "postings")
        self.held = held
        facts = every.agg(F.count_if(F.col("n") > 0).alias("N"), F.sum("n").alias("L")).first()
        self.N, self.L = facts["N"], facts["L"] or 0
        weight = F.floor(1000 * F.log((F.lit(2.0 * self.N + 2)) / (2.0 * F.col("df") + 1)))
        self.weights = stored(held.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.cast("long").alias("w")).where("w > 0"), "weights")

    @staticmethod
    def _wanted(queries: DataFrame) -> tuple[bool, frozenset[bytes] | None]:
        """The queries' terms, if they are few enough to travel with the code."""
        terms = queries.select("term").distinct()
        size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0)).alias("b")).first()["b"]
        if size > VOCABULARY_BYTES or queries.count() > QUERY_TERMS:
            return False, None
        return True, frozenset(r["term"].encode("utf-8") for r in terms.collect())

    def _by_term(self, df: DataFrame) -> DataFrame:
        """A table of a row a term (or a query's term), sent to all tasks where its size was checked."""
        return F.broadcast(df) if self.small else df

    def values(self, held: DataFrame) -> DataFrame:
        """(row, doc_id, term, value) of rows with n and tf: what a term adds to a document's score, for a
        query that holds it once; terms that every document has add nothing and are left out."""
        if not self.L:
            return held.select("row", "doc_id", "term", F.lit(0).cast("long").alias("value")).limit(0)
        value = F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 12L * (100L - 25L + ((25L * n * {self.N}L) div {self.L}L))))")
        return held.join(self._by_term(self.weights), "term").select("row", "doc_id", "term", value.alias("value")).where("value > 0")

    def exact(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """(item, row, doc_id, score) of stored pairs of an item and a document: every one of its terms is looked up."""
        looked = self.held.join(pairs.select("row").distinct(), "row", "left_semi")
        parts = self.values(looked).join(pairs, "row").join(self._by_term(queries.select("item", "term", "times")), ["item", "term"])
        return parts.groupBy("item", "row").agg(F.sum(F.col("times") * F.col("value")).alias("score"), F.first("doc_id").alias("doc_id"))

    def lists(self) -> DataFrame:
        """The posting lists, stored by ranges of (term, falling value): a list is sorted, and a long one lies over
        several partitions."""
        order = [F.col("term"), F.col("value").desc(), F.col("row")]
        spread = self.values(self.held).repartitionByRange(2 * partitions(self.held.sparkSession), *order).sortWithinPartitions(*order)
        return stored(spread, "lists")


def _ranked(rows: DataFrame, by: str, score: str, k: int) -> DataFrame:
    """The k highest rows of each group with their rank; equal scores by doc_id (null last), then row."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col("doc_id").asc_nulls_last(), F.col("row"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bounds(sums: DataFrame, k: int) -> DataFrame:
    """(item, bound, last): the k-th highest lower bound of each item and the place of that document among ties; items
    with fewer documents have none."""
    kth = _ranked(sums, "item", "score", k).where(F.col("rank") == k)
    return kth.select("item", F.col("score").alias("bound"), F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("last"))


def _sums_by_join(down: DataFrame, cut: DataFrame) -> DataFrame:
    """(item, row, doc_id, score, upper) of the list entries that reach their item's threshold: the sum of a
    document's entries and what it can have at most; documents that can't reach the bound are left out."""
    met = down.join(cut, "term").where("value >= least")
    sums = met.groupBy("item", "row").agg(F.sum(F.col("times") * F.col("value")).alias("score"), F.sum("cap").alias("met"), F.first("doc_id").alias("doc_id"), F.first("bound").alias("bound"))
    caps = cut.groupBy("item").agg(F.sum("cap").alias("caps"))
    upper = F.col("score") + F.col("caps") - F.col("met")
    return sums.join(caps, "item").withColumn("upper", upper).where("upper >= bound").select(*_SUMS.names)


def _sums_by_task(down: DataFrame, cut: DataFrame) -> DataFrame:
    """The same where the queries' terms go to every task: entries are dealt by document, and neither the pairs of
    an item and a document nor their parts are shuffled."""
    lists = cut.orderBy("term", "item").toArrow()  # at most QUERY_TERMS rows, counted before
    codes = lists["term"].combine_chunks().dictionary_encode()
    place = {t: i for i, t in enumerate(codes.dictionary.to_pylist())}
    starts = np.searchsorted(codes.indices.to_numpy(), np.arange(len(place) + 1))
    items, item_of = np.unique(lists["item"].to_numpy(), return_inverse=True)
    times, least, cap = (lists[c].to_numpy() for c in ("times", "least", "cap"))
    caps, bound = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    np.add.at(caps, item_of, cap)
    bound[item_of] = lists["bound"].to_numpy()

    def summed(rows: np.ndarray, docs: pa.Array, terms: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole documents, whose entries follow each other."""
        n = starts[terms + 1] - starts[terms]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        pairs = np.concatenate((np.add.reduceat(n, first), [0]))
        at = 0
        while at < len(first):  # some documents at a time, so that their pairs stay few
            upto = max(at + 1, int(np.searchsorted(np.cumsum(pairs[at:]), PAIRS_TOGETHER, "right")) + at)
            upto = min(upto, len(first))
            lo, hi = first[at], first[upto] if upto < len(first) else len(rows)
            entry = np.repeat(np.arange(lo, hi), n[lo:hi])
            pair = np.arange(len(entry)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi]) + starts[terms[entry]]
            good = values[entry] >= least[pair]
            entry, pair = entry[good], pair[good]
            doc = np.searchsorted(first, entry, "right") - 1
            key = doc * len(items) + item_of[pair]
            order = np.argsort(key, kind="stable")
            key = key[order]
            begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
            if len(begins):
                score = np.add.reduceat((values[entry] * times[pair])[order], begins)
                doc, item = key[begins] // len(items), key[begins] % len(items)
                upper = score + caps[item] - np.add.reduceat(cap[pair][order], begins)
                good = upper >= bound[item]
                found = first[doc[good]]
                columns = [pa.array(items[item[good]]), pa.array(rows[found]), docs.take(pa.array(found)), pa.array(score[good]), pa.array(upper[good])]
                yield pa.RecordBatch.from_arrays(columns, schema=_SUMS)
            at = upto

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def parts(entries: pa.Table):
            codes = entries["term"].combine_chunks().dictionary_encode()
            known = np.array([place[t] for t in codes.dictionary.to_pylist()], np.int64)
            return entries["row"].to_numpy(), entries["doc_id"].combine_chunks(), known[codes.indices.to_numpy()], entries["value"].to_numpy()

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            ids = b.column("row").to_numpy()
            if ids[0] == ids[-1]:
                continue  # perhaps one document so far
            entries = pa.Table.from_batches(held)
            rows = entries["row"].to_numpy()
            whole = int(np.flatnonzero(rows != rows[-1])[-1]) + 1  # the last document may go on
            yield from summed(*parts(entries.slice(0, whole)))
            held = entries.slice(whole).to_batches()
        if held:
            yield from summed(*parts(pa.Table.from_batches(held)))

    dealt = down.select("row", "doc_id", "term", "value").repartition(partitions(down.sparkSession), "row").sortWithinPartitions("row")
    return dealt.mapInArrow(make, "item long, row long, doc_id long, score long, upper long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest positive score for each item, all where
    there are fewer; equal scores by ascending doc_id.

    Each row of items is a query and each row of docs a document, repeated rows too (a doc_id of two rows can
    appear twice; null doc_ids count, and come last among ties). A null or empty text has no terms; items
    without a term that scores have no rows, so an empty table on either side gives an empty result.
    Columns beside those named are not looked at.
    """
    queries = query_terms(items, item_id, text)
    postings = Postings(docs, queries, doc_id, text)
    lists = postings.lists()

    # first round: list heads. The documents of the highest partial sums are scored exactly, which raises the bound
    heads = stored(_ranked(lists, "term", "value", k), "heads")
    tops = heads.where(F.col("rank") == 1).select("term", F.col("value").alias("top"))
    own = queries.join(postings._by_term(tops), "term").withColumn("most", F.col("times") * F.col("top"))
    partial = heads.join(postings._by_term(own.select("item", "term", "times")), "term")
    sums = partial.groupBy("item", "row").agg(F.sum(F.col("times") * F.col("value")).alias("score"), F.first("doc_id").alias("doc_id"))
    known = postings.exact(queries, stored(_ranked(sums, "item", "score", HEAD_DOCUMENTS * k).select("item", "row"), "best"))
    # an item with fewer than k such documents has bound 1: every positive score may count
    sizes = own.groupBy("item").agg(F.count("*").alias("m"))
    bounds = sizes.join(_bounds(known, k).select("item", "bound"), "item", "left").withColumn("bound", F.coalesce("bound", F.lit(1).cast("long")))

    # second round: every list down to the uniform threshold, bound / (DEEPER m) of the item
    cut = own.join(bounds, "item").select("item", "term", "times", "bound", F.expr(f"(bound + {DEEPER} * m * times - 1) div ({DEEPER} * m * times)").alias("least"), F.expr(f"least(most, (bound - 1) div ({DEEPER} * m))").alias("cap"))
    cut = stored(cut, "thresholds")
    lowest = cut.groupBy("term").agg(F.min("least").alias("lowest"))
    down = lists.join(postings._by_term(lowest), "term").where("value >= lowest").drop("lowest")
    lower = stored(_sums_by_task(down, cut) if postings.small else _sums_by_join(down, cut), "lower")
    kth, place = _bounds(lower, k), F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    may = lower.join(kth, "item", "left").where(F.col("bound").isNull() | (F.col("upper") > F.col("bound")) | ((F.col("upper") == F.col("bound")) & (place <= F.col("last"))))

    # third round: exact scores of the documents that are left
    best = _ranked(postings.exact(queries, stored(may.select("item", "row"), "candidates")), "item", "score", k)
    names = queries.select("item", "item_id").distinct()
    return best.join(names, "item").select(F.col("item_id").alias(item_id), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM documents),
asked AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
facts AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tfs, facts GROUP BY term),
parts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total)))) AS value
  FROM tfs JOIN sizes USING (doc_id) JOIN weights USING (term), facts),
scores AS (SELECT item_id, doc_id, CAST(sum(times * value) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""
