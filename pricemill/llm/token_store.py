"""Token ids in seekable binary files.

A file is a run of independent zstandard frames, each holding the ids of some consecutive documents
as little-endian unsigned integers of 16 or 32 bits, as the vocabulary needs; then one skippable frame
with this width and the documents' identifiers and lengths; last the seek table of the public seekable format (a skippable frame of 12 bytes a frame:
compressed size, decompressed size, low half of the XXH64 of the decompressed bytes). A reader takes
the seek table from the end of the file, finds the frames of the documents asked for, and decompresses
and verifies only those.

Documents are dealt to files by ranges of doc_id. Spark's own committer writes the files, so any
file system that Spark reaches will do and a lost executor's attempt leaves nothing behind.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_folder, stored, table
from .words import steps, utf8

#: Fixed values of the seekable format: magic numbers of a skippable frame and of the seek table's end.
SKIPPABLE, SEEK_MAGIC = 0x184D2A50, 0x8F92EAB1
SEEK_FRAME = SKIPPABLE + 0xE
#: Bytes of ids in a frame at least, bytes of ids in a file at least; one document is never cut.
FRAME_BYTES, FILE_BYTES = 1 << 18, 8 << 20
#: Remembered chunks of a Python worker (about 200 bytes each), and bytes of text that are encoded together.
CACHE_CHUNKS, TOGETHER = 500_000, 600_000
#: Punctuation that is encoded apart from the word it follows.
_MARKS = b".,!?#%&$*;:"
_LOWER_BLANK = bytes(32 if b == 10 else b + 32 if 65 <= b <= 90 else b for b in range(256))


#: A run of lower-case ASCII and Latin-1 letters, which every step before the model leaves as it is.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Byte-level vocabularies spell the bytes that have no printable Latin-1 character with those after 255.
_SPELLING = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def _ends_in_letter(chunk: bytes) -> bool:
    """Whether the last character is an ASCII letter or digit, or a letter of the Latin-1 block."""
    last = chunk[-1]
    return 97 <= last <= 122 or 48 <= last <= 57 or (len(chunk) > 1 and chunk[-2] == 0xC3 and last not in (0x97, 0xB7))


class Encoder:
    """Ids of whole texts by the tokenizers library.

    With by_words, the library encodes each distinct blank-separated chunk once and its ids are
    remembered. That is exact for vocabularies that lower-case, drop white space and part letters
    from marks, as no token then spans a blank or such a place; for others leave it off.
    """

    def __init__(self, path: str, by_words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words
        self.known: dict[bytes, bytes] = {b"": b""}
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        own = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.mark = own[0] if len(own) == 1 else None
        trial = ["abandon", "déjàvu", "straße", "ñandú", "êéîôÿ", "zzxq"]
        self.direct = self._library(trial) == [self._word(t.encode("utf-8")) for t in trial]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: bytes) -> bytes:
        """Ids of a run of lower-case letters, by the library's model alone."""
        spelled = word.decode("ascii") if word.isascii() else word.decode("latin-1").translate(_SPELLING)
        return array("H" if self.width == 2 else "I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _learn(self, new: list[bytes]) -> None:
        """Ids of new chunks: plain words by the model, where it agrees with the whole library; the others in
        one call, parted by the mark's id."""
        if self.direct:
            rest = []
            for c in new:
                if _LETTERS.fullmatch(c):
                    self.known[c] = self._word(c)
                else:
                    rest.append(c)
            new = rest
        if not new:
            return
        raw = self._library([b" \x01 ".join(new).decode("utf-8")])[0]
        cuts = (np.flatnonzero(np.frombuffer(raw, f"<u{self.width}") == self.mark) * self.width).tolist()
        self.known.update(zip(new, [raw[a:b] for a, b in zip([0, *(c + self.width for c in cuts)], [*cuts, len(raw)])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words or self.mark is None:
            return self._library(texts)
        # a text with the mark or with what may be a special token is left to the library as it is
        odd = [i for i, t in enumerate(texts) if "\x01" in t or "<|" in t]
        chunks = [t.encode("utf-8").translate(_LOWER_BLANK).split(b" ") for t in texts]
        for i in odd:
            chunks[i] = []
        known = self.known
        new = set().union(*chunks).difference(known)
        bases, ended = set(), []
        for c in new:
            base = c.rstrip(_MARKS)
            if len(base) < len(c) and base and _ends_in_letter(base):
                ended.append((c, base, c[len(base) :]))
                bases.update(ended[-1][1:])
            else:
                bases.add(c)
        if bases := list(bases.difference(known)):
            self._learn(bases)
        for c, base, marks in ended:
            known[c] = known[base] + known[marks]
        out = [b"".join(map(known.__getitem__, own)) for own in chunks]
        if len(known) > CACHE_CHUNKS:
            for c in (*new, *bases):
                known.pop(c, None)
        for i, ids in zip(odd, self._library([texts[i] for i in odd]) if odd else ()):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder_of(path: str, by_words: bool) -> Encoder:
    return Encoder(path, by_words)


def _skippable(payload: bytes, magic: int = SKIPPABLE) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


def build_file(docs: Iterable[tuple[int, bytes]], width: int = 4, frame_bytes: int = FRAME_BYTES, level: int = 3) -> bytes:
    """One file of the (doc_id, ids) pairs, in the order given; an id takes `width` bytes."""
    compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    body, seek, held, size = [], [], [], 0
    ids, lengths = [], []

    def close() -> None:
        raw = b"".join(held)
        body.append(compressor.compress(raw))
        seek.append(struct.pack("<III", len(body[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        held.clear()

    for doc_id, tokens in docs:
        held.append(tokens)
        size += len(tokens)
        ids.append(doc_id)
        lengths.append(len(tokens) // width)
        if size >= frame_bytes:
            close()
            size = 0
    if held:
        close()
    index = struct.pack("<QQ", width, len(ids)) + np.array(ids, "<i8").tobytes() + np.array(lengths, "<u4").tobytes()
    for frame in (_skippable(index),):
        body.append(frame)
        seek.append(struct.pack("<III", len(frame), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
    table_ = b"".join(seek) + struct.pack("<IBI", len(seek), 0x80, SEEK_MAGIC)
    return b"".join(body) + _skippable(table_, SEEK_FRAME)


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, blob: bytes):
        self.blob = blob
        n, flags, magic = struct.unpack("<IBI", blob[-9:])
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        entries = np.frombuffer(blob, "<u4", 3 * n, len(blob) - 9 - 12 * n).reshape(n, 3)
        self.sums = entries[:, 2]
        self.at = np.concatenate(([0], np.cumsum(entries[:, 0].astype(np.int64))))
        self.out = np.concatenate(([0], np.cumsum(entries[:, 1].astype(np.int64))))
        index = blob[self.at[-2] + 8 : self.at[-1]]
        self.width, count = struct.unpack("<QQ", index[:16])
        self.ids = np.frombuffer(index, "<i8", count, 16)
        self.lengths = np.frombuffer(index, "<u4", count, 16 + 8 * count).astype(np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.lengths * self.width)))
        self.decompressed = 0
        self._last: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self.blob[self.at[k] : self.at[k + 1]])
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} fails its checksum")
            self._last = (k, raw)
            self.decompressed += 1
        return self._last[1]

    def tokens(self, i: int) -> bytes:
        """Ids of the file's i-th document, as little-endian 32-bit integers; a document lies within one frame."""
        begin, end = int(self.begins[i]), int(self.begins[i + 1])
        if begin == end:
            return b""
        k = int(np.searchsorted(self.out, begin, "right")) - 1
        own = self._frame(k)[begin - self.out[k] : end - self.out[k]]
        return own if self.width == 4 else np.frombuffer(own, "<u2").astype("<u4").tobytes()


_FILE = pa.schema([("first_id", pa.int64()), ("blob", pa.binary())])


def _files(path: str, end_id: int, by_words: bool, file_bytes: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, by_words)
        held: list[tuple[int, bytes]] = []
        size = 0

        def closed() -> pa.RecordBatch:
            blob = build_file(held, encoder.width)
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([blob], pa.binary())], schema=_FILE)

        end = end_id.to_bytes(encoder.width, "little")
        for b in batches:
            _, offsets = utf8(b.column("text"))
            for first, last in steps(offsets, TOGETHER):
                part = b.slice(first, last - first)
                for i, tokens in zip(part.column("doc_id").to_pylist(), encoder.encode([t or "" for t in part.column("text").to_pylist()])):
                    held.append((i, tokens + end))
                    size += len(tokens) + encoder.width
                    if size >= file_bytes:
                        yield closed()
                        held, size = [], 0
        if held:
            yield closed()

    return make


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int, by_words: bool = False, file_bytes: int = FILE_BYTES) -> str:
    """Encodes every row of docs (doc_id not null, text; null text: empty), appends end_id to each, and
    writes the files to folder in ascending order of doc_id. Rows of one doc_id follow each other.
    An empty table writes no file. Other columns are not looked at."""
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = (
        texts.repartitionByRange(4 * partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_files(vocabulary, end_id, by_words, file_bytes), "first_id long, blob binary")
    )
    # the writer of text files ends each row with this separator: as the last byte of a seek table is
    # always the same, it is left to the separator, and the file is byte for byte the blob
    body = files.select(F.expr("substring(blob, 1, octet_length(blob) - 1)").cast("string").alias("value"))
    body.write.option("encoding", "ISO-8859-1").option("lineSep", chr(SEEK_MAGIC >> 24)).option("maxRecordsPerFile", 1).text(folder)
    return folder


_PLACES = [("file", pa.string()), ("first_id", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64())]
_DOC = pa.schema([*_PLACES, ("tokens", pa.binary())])
_DIGEST = pa.schema([*_PLACES, ("ids_crc32", pa.int64())])
_PLACES_SQL = "file string, first_id long, place long, doc_id long, before long, n_tokens long"


def _documents(wanted: frozenset | None, schema: pa.Schema, of_tokens=lambda tokens: tokens):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, blob in zip(b.column("path").to_pylist(), b.column("content")):
                read = TokenFile(blob.as_py())
                before, first_id = (read.begins // read.width).tolist(), int(read.ids[0])
                ids, lengths = read.ids.tolist(), read.lengths.tolist()
                take = [i for i in range(len(ids)) if wanted is None or ids[i] in wanted]
                for first in range(0, len(take), 512):
                    rows = [(path, first_id, i, ids[i], before[i], lengths[i], of_tokens(read.tokens(i))) for i in take[first : first + 512]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return make


def _stored_files(spark: SparkSession, *paths: str) -> DataFrame:
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(list(paths))
    return files.select("path", "content")


_INDEX_SQL = "path string, first_id long, last_id long"
_INDEX = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def index_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(path, first_id, last_id) of the files of a folder, stored; made once, it lets read_tokens open only
    the files that can hold the documents asked for."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, blob in zip(b.column("path").to_pylist(), b.column("content")):
                ids = TokenFile(blob.as_py()).ids
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, int(ids[0]), int(ids[-1])), _INDEX.types)], schema=_INDEX)

    return stored(_stored_files(spark, folder).mapInArrow(make, _INDEX_SQL), "index")


def read_tokens(spark: SparkSession, folder: str, doc_ids: Iterable[int] | None = None, index: DataFrame | None = None) -> DataFrame:
    """Rows (file, first_id, place in the file, doc_id, ids before it in the file, n_tokens, tokens as
    little-endian unsigned 32-bit integers); with doc_ids, only frames that hold those are decompressed,
    and with an index too, only files that can hold them are opened."""
    wanted = None if doc_ids is None else frozenset(doc_ids)
    files = _stored_files(spark, folder)
    if wanted and index is not None:
        ids = spark.createDataFrame([(i,) for i in sorted(wanted)], "id long")
        held = index.join(F.broadcast(ids), (F.col("id") >= F.col("first_id")) & (F.col("id") <= F.col("last_id")), "left_semi")
        paths = [r["path"] for r in held.select("path").collect()]  # as many as documents asked for, or few more
        files = _stored_files(spark, *paths) if paths else files.limit(0)
    return files.mapInArrow(_documents(wanted, _DOC), f"{_PLACES_SQL}, tokens binary")


def file_starts(sums: DataFrame, groups: int = 512) -> DataFrame:
    """(file, offset): ids in all files before each file of (file, first_id, last_id, total). The files are
    parted by first_id into groups of about the same number; one running total goes over the groups,
    which are few, and one over the files of each, so no task holds all files."""
    bounds = sums.agg(F.percentile_approx("first_id", [i / groups for i in range(1, groups)], 10_000)).first()[0] or []
    of = F.array_size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda x: x <= F.col("first_id"))) if bounds else F.lit(0)
    own = sums.withColumn("part", of)
    before = own.groupBy("part").agg(F.sum("total").alias("whole")).selectExpr("part", "coalesce(sum(whole) over (order by part rows between unbounded preceding and 1 preceding), 0) as passed")
    inside = own.selectExpr("file", "part", "coalesce(sum(total) over (partition by part order by first_id, last_id, file rows between unbounded preceding and 1 preceding), 0) as inside")
    return inside.join(F.broadcast(before), "part").select("file", (F.col("passed") + F.col("inside")).alias("offset"))


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = stored(_stored_files(spark, folder).mapInArrow(_documents(None, _DIGEST, zlib.crc32), f"{_PLACES_SQL}, ids_crc32 long"), "digests")
    # one row a file: the running total over files gives each file's start
    sums = stored(rows.groupBy("file").agg(F.min("first_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("n_tokens").alias("total")), "files")
    return rows.join(file_starts(sums), "file").select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, writes and reads back every whole text of documents."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    folder = write_tokens(docs, shared_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, by_words=True)
    return token_digests(spark, folder)
