"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of a bounded sample of labelled text holds every substring of
it. A new text is parsed from left to right into the longest phrases that occur in the sample; the
better the sample fits, the fewer phrases. The number of phrases, times the bits it takes to point
into the sample, over the text's length, estimates the cross entropy; the lowest wins.

The automata become dense transition tables, in which a missing transition already leads to where
the next phrase stands after its first symbol; those of languages with many letters become sorted
transitions instead. Every language has an alphabet of its own, of all letters of its sample. All texts of a batch are parsed side by side, one
numpy step a symbol, in blocks of BLOCK symbols; every block is parsed from the root, and all of the
text is parsed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .words import steps, utf8

#: Bound of the sample: texts of a language at most, and symbols of a language at most.
SAMPLE_TEXTS, SAMPLE_SYMBOLS = 200, 25_000
#: Symbols that are parsed as one piece; letters of an alphabet up to which its table is dense.
BLOCK, ALPHABET = 512, 250
_ROOT_PHRASE = np.int32(-(1 << 31))


@lru_cache(maxsize=1)
def symbol_maps() -> tuple[np.ndarray, np.ndarray]:
    """By code point of the basic plane: the lower-case letter or a blank; whether it is a letter."""
    lower, letter = np.full(65536, 32, np.uint16), np.zeros(65536, bool)
    for c in range(65536):
        s = chr(c)
        if unicodedata.category(s)[0] == "L":
            letter[c] = True
            low = s.lower()
            lower[c] = ord(low) if len(low) == 1 and ord(low) < 65536 else c
    return lower, letter


def symbols(text: str) -> np.ndarray:
    """Lower-case letters as 16-bit numbers, each run of anything else as one blank (32), none at the ends.
    Letters beyond the basic plane count as the letter U+FFFF."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lower, letter = symbol_maps()
    out = lower[np.minimum(raw, 65535)]
    if len(raw) and raw.max() > 65535:
        for i in np.flatnonzero(raw > 65535):
            out[i] = 65535 if unicodedata.category(chr(raw[i]))[0] == "L" else 32
    keep = out != 32
    keep[1:] |= out[:-1] != 32
    out = out[keep]
    if len(out) and out[0] == 32:
        out = out[1:]
    return out[:-1] if len(out) and out[-1] == 32 else out


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings, state 0 the empty one."""
    edges: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in text.tolist():
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        new, p = len(edges) - 1, last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                copy = len(edges) - 1
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return edges


class Parser:
    """The dense transition table of one language: entry [state * width + symbol] is the next state times
    width, with the top bit set where a new phrase begins."""

    def __init__(self, name: str, text: np.ndarray):
        self.name, self.bits = name, float(np.log2(max(2, len(text))))
        found = np.unique(text)
        width = len(found) + 2  # 0: past the end, then the letters, last: unknown
        self.code = np.full(65536, width - 1, np.int32)
        self.code[0] = 0
        self.code[found] = np.arange(1, width - 1)
        edges = suffix_automaton(text)
        root = np.full(width, _ROOT_PHRASE, np.int32)  # a symbol the sample lacks is a phrase by itself
        for c, to in edges[0].items():
            root[self.code[c]] = to * width | _ROOT_PHRASE
        flat = np.tile(root, (len(edges), 1))
        for state, own in enumerate(edges[1:], 1):
            for c, to in own.items():
                flat[state, self.code[c]] = to * width
        flat[:, 0] = 0
        self.next = flat.ravel()

    def phrases(self, columns: np.ndarray) -> np.ndarray:
        """Phrases by lane; columns[i] has the i-th symbol of every lane, 0 past its end."""
        at, count = np.zeros(columns.shape[1], np.int32), np.zeros(columns.shape[1], np.int32)
        mask = np.int32(0x7FFFFFFF)
        for symbol in columns:
            step = self.next[at + self.code[symbol]]
            count += step < 0
            np.bitwise_and(step, mask, out=at)
        return count


class SortedParser:
    """The same for a language with more letters than a dense table has room for: the transitions of
    all states but the root, sorted by state and symbol."""

    def __init__(self, name: str, text: np.ndarray):
        self.name, self.bits = name, float(np.log2(max(2, len(text))))
        edges = suffix_automaton(text)
        self.root = np.zeros(65536, np.int64)
        self.root[list(edges[0])] = list(edges[0].values())
        rows = sorted((state << 16 | c, to) for state, own in enumerate(edges[1:], 1) for c, to in own.items())
        self.keys, self.to = np.array([*rows, (1 << 62, 0)], np.int64).T.copy()

    def phrases(self, columns: np.ndarray) -> np.ndarray:
        at, count = np.zeros(columns.shape[1], np.int64), np.zeros(columns.shape[1], np.int32)
        for symbol in columns:
            key = at << 16 | symbol
            place = np.searchsorted(self.keys, key)
            on = self.keys[place] == key
            count += ~on & (symbol != 0)
            at = np.where(on, self.to[place], self.root[symbol])
        return count


class Model:
    """Parsers of all learned languages."""

    def __init__(self, samples: dict[str, list[str]], most: int = SAMPLE_SYMBOLS):
        texts = {}
        for name in sorted(samples):
            taken, size = [], 0
            for text in samples[name]:
                own = symbols(text)
                if len(own) and size + len(own) <= most:
                    taken += [own, np.array([32], np.uint16)]
                    size += len(own) + 1
            if taken:
                texts[name] = np.concatenate(taken)
        self.parsers = [(Parser if len(np.unique(text)) <= ALPHABET else SortedParser)(name, text) for name, text in texts.items()]

    def entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits a symbol, by text and language; 0 for a text without symbols."""
        lengths = np.array([len(t) for t in texts], np.int64)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        sizes = np.full(len(owner), BLOCK, np.int64)
        last = np.cumsum(blocks)[blocks > 0] - 1
        sizes[last] = (lengths - (blocks - 1) * BLOCK)[blocks > 0]
        out = np.zeros((len(texts), len(self.parsers)))
        if not len(owner):
            return out
        lanes = np.zeros((len(owner), BLOCK), np.uint16)
        lanes[np.arange(BLOCK) < sizes[:, None]] = np.concatenate(texts)
        columns = np.ascontiguousarray(lanes.T)
        for k, parser in enumerate(self.parsers):
            out[:, k] = np.bincount(owner, parser.phrases(columns), len(texts)) * parser.bits
        return out / np.maximum(lengths, 1)[:, None]

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, float | None]]:
        """(language, score, bits a symbol); ("und", 0, None) without a letter or a learned language."""
        own = [symbols(t or "") for t in texts]
        bits = self.entropies(own)
        for i, row in enumerate(bits):
            if not len(own[i]) or not len(row):
                yield "und", 0.0, None
                continue
            best = int(np.argmin(row))
            rest = np.delete(row, best)
            second = float(rest.min()) if len(rest) else float("inf")
            score = 1.0 if not np.isfinite(second) else second / (second + float(row[best]))
            yield self.parsers[best].name, score, float(row[best])


def sample(docs: DataFrame, texts: int = SAMPLE_TEXTS, most: int = SAMPLE_SYMBOLS) -> dict[str, list[str]]:
    """Up to `texts` distinct texts of each label of docs (text, lang), in the order of a hash of the text.

    Of a longer text its first quarter of `most` characters is taken, so texts * most / 4 characters
    a language bound what reaches the driver, beside the number of languages. Copies of a text count
    once: the hashes are made distinct first, and only texts with one of the least hashes are gathered.
    Null labels and null or empty texts teach nothing; an empty table gives an empty sample.
    """
    fit = docs.where("lang is not null and text != ''").select("lang", F.substring("text", 1, most // 4).alias("text"), F.xxhash64("lang", F.substring("text", 1, most // 4)).alias("h"))
    # the least hashes of each of 64 parts of a language first, so that the last step has at most 64 times as many
    part, order = F.pmod("h", F.lit(64)), lambda *keys: Window.partitionBy(*keys).orderBy("h")
    least = fit.select("lang", "h").distinct().withColumn("part", part)
    for keys in (("lang", "part"), ("lang",)):
        least = least.withColumn("n", F.row_number().over(order(*keys))).where(F.col("n") <= texts).drop("n")
    taken = fit.join(F.broadcast(least.select("h")), "h", "left_semi")
    out: dict[str, list[str]] = {}
    for r in taken.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


_FOUND = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]


def _label(model, prefix: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = _model(model)
        for b in batches:
            at = b.schema.get_field_index("text")
            _, offsets = utf8(b.column(at))
            for first, last in steps(offsets, 1 << 21):
                part = b.slice(first, last - first)
                found = list(learned.predict(part.column(at).to_pylist()))
                names = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *names], names=[*b.schema.names, *(prefix + f.name for f in _FOUND)])

    return make


_MODELS: dict[int, Model] = {}


def _model(sent) -> Model:
    """The model of a broadcast sample, built once in each Python worker."""
    key = hash(tuple((k, tuple(v)) for k, v in sent.value.items()))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(sent.value)
    return _MODELS[key]


def _identified(docs: DataFrame, samples: dict[str, list[str]], prefix: str) -> DataFrame:
    """docs with the columns lang_pred, score and bits, their names after the prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(samples)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + f.name, f.dataType) for f in _FOUND)])
    return docs.mapInArrow(_label(sent, prefix), schema)


def identify(docs: DataFrame, samples: dict[str, list[str]], key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, lang_pred, score (0 to 1; 0.5 is a tie), bits a symbol.

    A null text or one without a letter is `und` with score 0; so is every text when nothing was
    learned. Of languages that tie, the first by name wins. Repeated rows each get their row; only
    the key and text are read.
    """
    return _identified(docs.select(key, "text"), samples, "").select(key, *(f.name for f in _FOUND))


def drop_unidentified(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """The rows and columns of docs, whatever they are called, without the texts that are `und`: null
    texts, texts without a letter, and all texts when nothing was learned. Repeated rows stay repeated."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return _identified(docs, samples, prefix).where(F.col(prefix + "lang_pred") != "und").select(*(F.col(f"`{c}`") for c in docs.columns))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, sample(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")
