"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

The automaton reads words, not characters: each distinct word of the benchmark is spelled with two letters
of its alphabet. Its patterns are the items cut into blocks of half a window (five words of ten), side by side:
any window holds a whole block, so only the places of a text that hold a found block can begin a window,
and these are looked up in a sorted table of the distinct windows and compared word by word. That takes
two nodes a word of the benchmark, where a pattern for each window would take ten. A document is scanned
once, in time linear in its words.

The benchmark is measured before it is sent to the executors: up to PART_BYTES of text make one
automaton, a larger benchmark is dealt into parts of that size, each scanned in turn.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stored, table

#: Bytes of benchmark text that one automaton takes (measured: about 18 bytes of memory for each).
PART_BYTES = 32 << 20
WINDOW = 10
_UNKNOWN = "\0\0"

_KEPT = {*range(48, 58), *range(97, 123), *range(128, 256)}
#: A-Z to a-z; all other ASCII but digits and letters to a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))
_SPANS = "array<struct<start:int,end:int>>"
_HITS = f"doc_id long, n_words long, hit array<int>, items array<string>, spans {_SPANS}"
_HIT_TYPE = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def normalised_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


class Scanner:
    """The automaton of some items' blocks, the table of their windows, and the search of both in a text."""

    def __init__(self, items: tuple[tuple[str, str], ...], window: int = WINDOW):
        self.window, self.block = window, (window + 1) // 2
        self.numbers: dict[bytes, int] = {}
        self.names: list[str] = []
        begins: list[int] = []
        codes = array("i")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        places: dict[int, list[np.ndarray]] = {}  # by length of the window
        blocks: list[tuple[int, int]] = []
        for item, text in items:
            own = [self.numbers.setdefault(w, len(self.numbers)) for w in normalised_words(text)]
            if not own:
                continue
            self.names.append(item)
            begins.append(len(codes))
            length, size = min(window, len(own)), min(self.block, len(own))
            places.setdefault(length, []).append(np.arange(len(codes), len(codes) + len(own) - length + 1))
            blocks += ((len(codes) + k, size) for k in range(0, len(own) - size + 1, size))
            codes.extend(own)
        # two letters a word, as a node finds its next one by going through all it has
        base = isqrt(len(self.numbers)) + 1
        self.letters = {w: chr(1 + i // base) + chr(1 + base + i % base) for w, i in self.numbers.items()}
        by_number = list(self.letters.values())
        for p, size in blocks:
            self.automaton.add_word("".join(map(by_number.__getitem__, codes[p : p + size])), size)
        self.codes = np.array(codes, np.int32)
        self.empty = not places
        if self.empty:
            return
        self.automaton.make_automaton()
        # a block lies within a run of known words at least as long as the shortest block
        self.runs = re.compile("[^\0]{%d,}" % (2 * min(self.block, min(places))))
        begin_array = np.array(begins, np.int64)
        while True:  # until no two windows have one key, which the first draw nearly always gives
            self.factors = np.random.default_rng().integers(0, 1 << 63, (2, window), np.uint64) << np.uint64(1) | np.uint64(1)
            made = {length: self._windows(np.concatenate(own), length, begin_array) for length, own in places.items()}
            if all(made.values()):
                self.tables = made
                return

    def _keys(self, codes: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
        """A 64-bit key of the words codes[p : p + length] of each place."""
        key = np.zeros(len(places), np.uint64)
        for i in range(length):
            mixed = codes[places + i].astype(np.uint64) * self.factors[0, i]
            key += (mixed ^ mixed >> np.uint64(32)) * self.factors[1, i]
        return key

    def _windows(self, places: np.ndarray, length: int, begins: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """The distinct windows of a length: sorted keys, one place of each, where its items begin and the
        items by window; None if different windows have one key."""
        keys = self._keys(self.codes, places, length)
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        same = keys[1:] == keys[:-1]
        left, right = places[:-1][same], places[1:][same]
        if any((self.codes[left + i] != self.codes[right + i]).any() for i in range(length)):
            return None
        new = np.concatenate(([True], ~same))
        item = np.searchsorted(begins, places, "right").astype(np.int32) - 1
        kept = new.copy()  # of a window that an item repeats, the item once
        kept[1:] |= item[1:] != item[:-1]
        firsts = np.append(np.flatnonzero(new[kept]), kept.sum())
        return keys[new], places[new].astype(np.int32), firsts, item[kept]

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, places of the hit words, items with a window in the text. The time is linear in
        the text, whatever repeats in it or in the items: each place is looked up once for each length."""
        found = normalised_words(text)
        none = len(found), np.empty(0, np.int32), set()
        if self.empty or not found:
            return none
        spelled = "".join(map(self.letters.get, found, repeat(_UNKNOWN)))
        blocks: dict[int, list[int]] = {}  # starts by size
        for run in self.runs.finditer(spelled):
            before = run.start() + 1
            for end, size in self.automaton.iter(run[0]):
                blocks.setdefault(size, []).append((before + end) // 2 - size)
        if not blocks:
            return none
        own = np.fromiter(map(self.numbers.get, found, repeat(-1)), np.int32, len(found))
        border, items = np.zeros(len(found) + 1, np.int32), []
        for length, (keys, places, firsts, held) in self.tables.items():
            size = min(self.block, length)
            starts = np.array(blocks.get(size, []), np.int64)
            if length == self.window:  # any window holds a whole block, at one of these distances
                starts = (starts[:, None] - np.arange(length - size + 1)).ravel()
            starts = np.unique(starts[(starts >= 0) & (starts <= len(found) - length)])
            key = self._keys(own, starts, length)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            on = keys[at] == key
            for i in range(length):
                on &= own[starts + i] == self.codes[places[at] + i]
            starts = starts[on]
            border[starts] += 1
            border[starts + length] -= 1
            items += [held[firsts[k] : firsts[k + 1]] for k in np.unique(at[on]).tolist()]
        if not items:
            return none
        names = {self.names[i] for i in np.unique(np.concatenate(items)).tolist()}
        return len(found), np.flatnonzero(np.cumsum(border[:-1]) > 0).astype(np.int32), names


def word_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as character offsets of the text as it was given, in linear time."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = np.frombuffer(raw.tobytes().translate(_BYTES), np.uint8) != 32
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    cut = np.flatnonzero(np.diff(hit) != 1)
    firsts, lasts = hit[np.concatenate(([0], cut + 1))], hit[np.append(cut, len(hit) - 1)]
    return [{"start": a, "end": b} for a, b in zip(before[starts[firsts]].tolist(), before[ends[lasts]].tolist())]


@lru_cache(maxsize=2)
def _scanner(items: tuple[tuple[str, str], ...], window: int) -> Scanner:
    return Scanner(items, window)


def _scan(items, window: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(items.value, window)
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                n, hit, held = scanner.scan(text)
                rows.append((i, n, hit.tolist(), sorted(held), word_spans(text, hit) if len(hit) else []))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _HIT_TYPE.types)], schema=_HIT_TYPE)

    return make


def _clean(items, window: int, most_share: float):
    """Only the rows whose share of hit words is low enough, all columns as they are."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(items.value, window)
        for b in batches:
            keep = []
            for text in b.column(b.schema.get_field_index("text")).to_pylist():
                n, hit, _ = scanner.scan(text)
                keep.append(len(hit) <= n * most_share)
            yield b.filter(pa.array(keep, pa.bool_()))

    return make


def _parts(benchmark: DataFrame, part_bytes: int) -> tuple[DataFrame, int]:
    """(item, text) of the benchmark, and in how many automata it goes by its measured size."""
    texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 64)).first()[0] or 0
    return texts, max(1, -(-size // part_bytes))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (sorted as strings), spans.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one
    window. A word of a document inside any occurrence of a window is hit; spans are the runs of hit
    words in characters of the original text. Null and wordless texts have no words and no hits, null
    and wordless items no windows, an empty benchmark hits nothing. Items with a null id are kept
    under the id "null". Repeated rows each get their row; other columns are not looked at.
    """
    spark = docs.sparkSession
    texts, parts = _parts(benchmark, part_bytes)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if parts == 1:
        found = source.mapInArrow(_scan(_sent(spark, texts), window), _HITS)
        return found.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), "items", "spans")
    # beyond the bound: one scan for each part, then the hit places of a row together
    source = stored(source.withColumn("row", F.monotonically_increasing_id()), "texts")
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))
    keyed = source.select(F.col("row").alias("doc_id"), "text")
    scans = None
    for part in range(parts):
        one = keyed.mapInArrow(_scan(_sent(spark, dealt.where(F.col("part") == part).drop("part")), window), _HITS)
        scans = one if scans is None else scans.unionByName(one)
    whole = scans.groupBy(F.col("doc_id").alias("row")).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    spans = F.pandas_udf(lambda t, h: t.combine(h, lambda text, hit: word_spans(text, np.asarray(hit, np.int32)) if len(hit) else []), _SPANS)
    return source.join(whole, "row").select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), "items", spans("text", "hit").alias("spans"))


def _sent(spark: SparkSession, texts: DataFrame):
    """Items of a checked size, to every executor."""
    return spark.sparkContext.broadcast(tuple(sorted((r["item"], r["text"]) for r in texts.collect())))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_share: float = 0.0, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs whose share of hit words is at most most_share, with the columns of docs,
    whatever they are called. Null and wordless texts stay, and so does everything beside an empty
    benchmark; repeated rows are rows of their own. With a benchmark of several parts the hits of all
    parts are gathered by row first."""
    texts, parts = _parts(benchmark, part_bytes)
    if parts == 1:
        return docs.mapInArrow(_clean(_sent(docs.sparkSession, texts), window, most_share), docs.schema)
    row = free_name("__row", docs)
    marked = stored(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    hits = benchmark_hits(marked.select(F.col(row).alias("doc_id"), "text"), benchmark, window, part_bytes)
    bad = hits.where(F.col("n_hit") > F.col("n_words") * F.lit(most_share)).select(F.col("doc_id").alias(row))
    return marked.join(bad, row, "left_anti").select(*docs.columns)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every benchmark item in every whole text of documents."""
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item, n, i FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
