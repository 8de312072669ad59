"""Byte-pair encoding and decoding of whole texts, with the merges done in numpy for many words at once.

Symbols of all words lie in one flat array. Each pair of neighbours within a word has a rank, found by
binary search among the sorted keys of the pairs that merge. In a round every word merges its pair of the
lowest rank, wherever the word has it; ranks are looked up anew only beside a merge, and words without a
pair that merges leave the array. As a symbol only enters merges of higher rank than the one that makes it
(checked when a vocabulary is read), a round's merges are those that a queue by rank and place would do next.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .words import steps, utf8

#: Bytes of text that are cut and merged together; chunks whose ids a Python worker remembers (about 200 bytes each).
TOGETHER, CACHE_CHUNKS = 1 << 20, 500_000
_NEVER = np.int32(np.iinfo(np.int32).max)

#: Byte-level vocabularies spell the bytes that have no printable Latin-1 character with those after 255.
_PRINTED = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
_SPELLING = [chr(b) if b in _PRINTED else chr(256 + i) for b, i in zip(range(256), np.cumsum([b not in _PRINTED for b in range(256)]) - 1)]
_BYTE_OF = {ord(c): chr(b) for b, c in enumerate(_SPELLING)}

_BLANKS = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
#: The public pattern of the vocabulary that drops white space; fixed value.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What it and lower-casing come to in ASCII, a blank being a match of its own.
_ASCII_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+| ")


class Merges:
    """The pairs that merge, by sorted key, with their ranks and what they become."""

    def __init__(self, vocabulary: dict[str, int], pairs: list[tuple[str, str]]):
        self.size = max(vocabulary.values()) + 1
        left, right = (np.array([vocabulary[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        rank_of = np.full(self.size, -1, np.int64)
        rank_of[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(rank_of[left], rank_of[right]) >= np.arange(len(made))).any():
            raise ValueError("a merge uses a symbol that a later one makes, or two make the same symbol")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NEVER for those that don't merge."""
        if not len(self.keys):
            return np.full(len(left), _NEVER)
        wanted = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NEVER)

    def merged(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and lengths of all words after every merge, in the order given; no word is empty."""
        n = len(lengths)
        if not n:
            return symbols.astype(np.int32), lengths.astype(np.int64)
        symbols, lengths, words = symbols.astype(np.int32), lengths.astype(np.int64), np.arange(n)
        ranks = np.full(len(symbols), _NEVER)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[np.cumsum(lengths) - 1] = _NEVER
        final, out = np.zeros(n, np.int64), []
        while len(words):
            starts = np.cumsum(lengths) - lengths
            least = np.minimum.reduceat(ranks, starts)
            done = least == _NEVER
            if done.any():
                of = np.repeat(done, lengths)
                out.append((words[done], symbols[of]))
                final[words[done]] = lengths[done]
                keep = ~of
                symbols, ranks, words, lengths, least = symbols[keep], ranks[keep], words[~done], lengths[~done], least[~done]
                if not len(words):
                    break
            own = np.repeat(np.arange(len(words)), lengths)
            hits = np.flatnonzero(ranks == least[own])
            # a run of neighbouring hits is one symbol over and over: every second pair of it merges
            first = np.ones(len(hits), bool)
            first[1:] = hits[1:] != hits[:-1] + 1
            place = np.arange(len(hits))
            hits = hits[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            symbols[hits] = self.made[ranks[hits]]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            lengths = lengths - np.bincount(own[hits], minlength=len(words))
            symbols, ranks, own = symbols[keep], ranks[keep], own[keep]
            hits = hits - np.arange(len(hits))
            beside = np.zeros(len(symbols), bool)
            beside[hits] = beside[np.maximum(hits - 1, 0)] = True
            near = np.flatnonzero(beside)
            after = np.minimum(near + 1, len(symbols) - 1)
            inside = (after > near) & (own[near] == own[after])
            ranks[near] = np.where(inside, self.rank(symbols[near], symbols[after]), _NEVER)
        to = np.cumsum(final) - final
        flat = np.empty(int(final.sum()), np.int32)
        for of, part in out:
            size = final[of]
            flat[np.repeat(to[of] - (np.cumsum(size) - size), size) + np.arange(len(part))] = part
        return flat, final


class Vocabulary:
    """A byte-level BPE vocabulary in the tokenizers library's file format.

    The file's normaliser and splitter cut texts into words by the library; where the file drops white space,
    ASCII texts are cut by one pattern and the ids of blank-separated chunks are remembered. Special tokens in
    a text get their own ids, as the library gives them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            facts = json.load(f)
        model, added = facts["model"], facts["added_tokens"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"no byte-level BPE vocabulary, or with {', '.join(odd)}")
        self.library = Tokenizer.from_file(path)
        vocabulary, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.merges = Merges(vocabulary, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.inside = np.array([vocabulary[c] for c in _SPELLING], np.int32)
        self.last = np.array([vocabulary[c + end] for c in _SPELLING], np.int32)
        self.special = {t["content"]: np.array([t["id"]], "<i4").tobytes() for t in added}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        names = {i: t for t, i in vocabulary.items()} | {t["id"]: t["content"] for t in added}
        self.spelled = (facts.get("decoder") or {}).get("type") == "ByteLevel"
        if facts.get("decoder") and not self.spelled:
            raise ValueError("no decoder but the byte-level one is known")
        self.names = [names.get(i) for i in range(max(names) + 1)]
        self.names = [None if t is None else self._bytes(t) if self.spelled else t.encode("utf-8") for t in self.names]
        split = [p for p in (facts["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        self.by_chunks = bool(split) and split[0]["pattern"].get("Regex") == _WORD_PATTERN and split[0]["invert"] and split[0]["behavior"] == "Removed"
        self.known: dict[bytes, bytes] = {b"": b""}

    @staticmethod
    def _bytes(spelled: str) -> bytes:
        """The bytes that a byte-level spelling stands for; other text (a special token) as UTF-8."""
        raw = spelled.translate(_BYTE_OF)
        return raw.encode("latin-1") if all(ord(c) in _BYTE_OF for c in spelled) else spelled.encode("utf-8")

    def _cut(self, text: str) -> list[bytes]:
        """A text's words by the library."""
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [w.translate(_BYTE_OF).encode("latin-1") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _cut_chunks(self, chunks: list[bytes]) -> list[list[bytes]]:
        """The words of each blank-separated chunk: those in ASCII by one pattern, the others by the library,
        together and parted by a mark; chunks that hold the mark go one by one."""
        out: list[list[bytes]] = [[] for _ in chunks]
        plain = [i for i, c in enumerate(chunks) if c.isascii()]
        other = [i for i, c in enumerate(chunks) if not c.isascii()]
        marked = [i for i in other if b"\x01" in chunks[i]]
        other = [i for i in other if b"\x01" not in chunks[i]]
        parts = (
            (plain, b" ", _ASCII_WORDS.findall(b" ".join(chunks[i] for i in plain).lower())),
            (other, b"\x01", self._cut(b" \x01 ".join(chunks[i] for i in other).decode("utf-8")) if other else []),
        )
        for of, mark, found in parts:
            at = 0
            for w in found:
                if w == mark:
                    at += 1
                else:
                    out[of[at]].append(w)
        for i in marked:
            out[i] = self._cut(chunks[i].decode("utf-8"))
        return out

    def _merged(self, cut: list[list[bytes]]) -> list[bytes]:
        """Ids of each list of words, as little-endian 32-bit integers; each distinct word is merged once."""
        place: dict[bytes, int] = {}
        for own in cut:
            for w in own:
                place.setdefault(w, len(place))
        lengths = np.fromiter(map(len, place), np.int64, len(place))
        letters = np.frombuffer(b"".join(place), np.uint8)
        symbols = self.inside[letters]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[letters[ends]]
        ids, sizes = self.merges.merged(symbols, lengths)
        raw, to = ids.astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        of = [raw[a:b] for a, b in zip([0, *to], to)]
        return [of[place[own[0]]] if len(own) == 1 else b"".join([of[place[w]] for w in own]) for own in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text, as little-endian 32-bit integers."""
        cut = [self.specials.split(t) if self.specials and any(s in t for s in self.special) else [t] for t in texts]
        if not self.by_chunks:
            plain = [p for own in cut for p in own[::2]]
            ids = iter(self._merged([self._cut(p) for p in plain]))
            return [b"".join(self.special[p] if i % 2 else next(ids) for i, p in enumerate(own)) for own in cut]
        chunks = [[p if i % 2 else p.encode("utf-8").translate(_BLANKS).split(b" ") for i, p in enumerate(own)] for own in cut]
        new = set().union(*(p for own in chunks for p in own[::2])).difference(self.known)
        if new := list(new):
            self.known.update(zip(new, self._merged(self._cut_chunks(new))))
        find = self.known.__getitem__
        out = [b"".join(map(find, own[0])) if len(own) == 1 else b"".join(self.special[p] if i % 2 else b"".join(map(find, p)) for i, p in enumerate(own)) for own in chunks]
        if len(self.known) > CACHE_CHUNKS:
            for c in new:
                del self.known[c]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of some ids, special tokens included; ids that the vocabulary lacks are left out.
        Without a decoder in the file, tokens stand as they are spelled, parted by blanks."""
        top = len(self.names)
        found = [self.names[i] for i in ids.tolist() if 0 <= i < top]
        found = [t for t in found if t is not None] if None in found else found
        if self.spelled:  # bytes that are no UTF-8 become replacement marks, as in the library
            return b"".join(found).decode("utf-8", "replace").encode("utf-8")
        return b" ".join(found)


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


def _replaced(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """df's schema without any column of that name (in any case of letters), and with one at its end."""
    return T.StructType([f for f in df.schema.fields if f.name.lower() != name.lower()]).add(name, kind)


def _with_column(df: DataFrame, source: str, name: str, kind: T.DataType, made) -> DataFrame:
    """df with a column that `made` gives for slices of source, some rows at a time."""
    schema = _replaced(df, name, kind)
    kept = [f.name for f in schema.fields[:-1]]
    # the source may be a column that the new one replaces, so it travels beside
    carried = df.select(*(F.col(f"`{c.replace('`', '``')}`") for c in kept), F.col(source).alias("__source"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(b.num_columns - 1)
            sizes = utf8(own)[1] if pa.types.is_string(own.type) or pa.types.is_large_string(own.type) else 4 * np.concatenate(([0], np.cumsum(own.value_lengths().fill_null(0).to_numpy())))
            for first, last in steps(sizes, TOGETHER):
                new = made(own.slice(first, last - first))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(first, last - first) for i in range(len(kept))), new], names=[*kept, name])

    return carried.mapInArrow(make, schema)


def encoded(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of each whole text's ids (array of int, replacing any column of that name).
    A null or empty text has none; a text of any length is encoded whole, in the row's own task. Rows are
    neither moved nor merged, so repeated rows and null keys stay as they are, and an empty table stays empty.
    vocabulary is a path that every executor can read."""

    def made(column: pa.Array) -> pa.Array:
        parts = vocabulary_of(vocabulary).encode([t or "" for t in column.to_pylist()])
        ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))

    return _with_column(docs, text, ids, T.ArrayType(T.IntegerType()), made)


def decoded(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of a column of ids (replacing any column of that name), special tokens included.
    No ids and null give an empty text; ids that the vocabulary lacks, and null ids, are left out."""

    def made(column: pa.Array) -> pa.Array:
        find = vocabulary_of(vocabulary)
        flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())))
        return pa.array([find.decode(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.binary()).cast(pa.string())

    return _with_column(df, ids, text, T.StringType(), made)


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text of documents and decodes the ids again; digests of both."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    out = decoded(docs, path)
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
