"""Byte-pair coding, filter audit and ranked search against the library, plain Python and awkward inputs."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pricemill.llm import byte_pairs, filter_audit, lexical_search, registry
from pricemill.llm.common import table

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
PIECES = [*"abcABC '''stredvml012!?.\n\t\x1c\x01\x00\x85\xa0", "'ll", "'re", "'S", "é", "É", "é", "H̱", "̱", "Σ", "İ", "ß", "中", "한", "가", "🙂", "½", "٣", "‍", "　", "हि", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "aaaaaaaa", "ǅ", "Ⅷ"]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_texts_equal_the_library(name):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(public_tokenizers.path(name)), byte_pairs.Vocabulary(public_tokenizers.path(name))
    rng = random.Random(3)
    texts = ["", *("".join(rng.choices(PIECES, k=rng.randint(1, 60))) for _ in range(1500)), "a" * 3001, "".join(rng.choices("etaoin", k=5000))]
    found = [x for i in range(0, len(texts), 50) for x in own.encode(texts[i : i + 50])]
    for t, f in zip(texts, found):
        ids = np.frombuffer(f, "<i4")
        expected = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == expected, repr(t)
        assert own.decode(ids).decode("utf-8") == library.decode(expected, skip_special_tokens=False)


def test_merges_are_those_of_a_queue():
    rng = random.Random(4)
    vocabulary, pairs = {c: i for i, c in enumerate("abc")}, []
    while len(pairs) < 40:
        a, b = rng.choice(list(vocabulary)), rng.choice(list(vocabulary))
        if a + b not in vocabulary and len(a + b) < 9:
            vocabulary[a + b] = len(vocabulary)
            pairs.append((a, b))
    words = ["".join(rng.choices("abc", k=rng.choice([1, 2, 3, 7, 30]))) for _ in range(300)] + ["a" * n for n in range(1, 20)]

    def queue(word):
        parts = list(word)
        rank = {p: i for i, p in enumerate(pairs)}
        while best := min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None):
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        return [vocabulary[p] for p in parts]

    flat = np.array([vocabulary[c] for w in words for c in w])
    ids, sizes = byte_pairs.Merges(vocabulary, pairs).merged(flat, np.array([len(w) for w in words]))
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == [queue(w) for w in words]
    with pytest.raises(ValueError):
        byte_pairs.Merges({"a": 0, "aa": 1, "aaa": 2}, [("aa", "a"), ("a", "a")])


def test_coding_of_awkward_tables(spark):
    path = public_tokenizers.path(FILES[0])
    rows = [(1, None, "x"), (2, "", "x"), (3, "Two words", "x"), (3, "Two words", "x"), (None, "a<|endoftext|>B", "x"), (5, "word " * 40000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    coded = byte_pairs.encoded(docs, path)
    assert coded.columns == ["doc_id", "text", "ids"]
    back = {(r["doc_id"], r["text"]): (len(r["ids"]), r["decoded"]) for r in byte_pairs.decoded(coded, path).collect()}
    assert coded.count() == len(rows) and len(back) == 5
    assert back[1, None] == back[2, ""] == (0, "") and back[3, "Two words"] == (2, "two</w> words</w>")
    assert back[None, "a<|endoftext|>B"] == (3, "a</w> <|endoftext|> b</w>") and back[5, "word " * 40000][0] == 40000
    assert byte_pairs.decoded(byte_pairs.encoded(docs.limit(0), path), path).count() == 0
    odd = spark.createDataFrame([([320, None, 10**6, -1, 320],), (None,), ([],)], "ids array<int>")
    assert sorted(r["decoded"] for r in byte_pairs.decoded(odd, path).collect()) == ["", "", "a</w> a</w>"]


def test_every_document_is_coded_as_by_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = registry.QUERIES["op11_byte_pairs"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_audit_equals_filters_applied_in_turn(spark):
    rng = random.Random(5)
    rows = [(i % 150, rng.choice(["p", "p", "p", "q", None, ""]), rng.randrange(8), rng.choice([True, False, None]), rng.choice("xyz") * rng.randrange(3)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, bits int, good boolean, text string").repartition(7)
    seen = filter_audit.repeats(docs.withColumn("digest", F.sha2("text", 256)), "doc_id", "digest", "again")
    failures = {c: F.col("bits").bitwiseAND(1 << i) > 0 for i, c in enumerate("KLM")} | {"N": F.col("again")}
    found = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(seen, failures, F.col("source"), {"good": F.col("good")}).collect()}

    first = {}
    for i, _, _, _, t in rows:
        first[t] = min(i, first.get(t, i))
    plain = [(s or "", {c for k, c in enumerate("KLM") if b >> k & 1} | ({"N"} if i > first[t] else set()), bool(g)) for i, s, b, g, t in rows]
    assert len(found) == 3 * 24 * 4
    for part in ("p", "q", ""):
        shapley = Counter()
        for order in permutations("KLMN"):
            left = [(f, g) for p, f, g in plain if p == part]
            for step, c in enumerate(order, 1):
                gone = [(f, g) for f, g in left if c in f]
                left = [(f, g) for f, g in left if c not in f]
                r = found[part, "".join(order), step]
                failing = [f for p, f, _ in plain if p == part and c in f]
                assert (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"]) == (len(left), len(gone), len(failing) - len(gone), failing.count({c}), sum(g for _, g in gone))
                shapley[c] += len(gone)
        assert all(r["shapley"] == shapley[r["filter_order"][r["step"] - 1]] for r in found.values() if r["part"] == part)


def test_audit_of_awkward_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "a"), (1, "a"), (2, "a"), (3, None), (4, None)], "doc_id long, digest string").withColumn("first", F.lit("clash"))
    rows = filter_audit.repeats(docs, "doc_id", "digest", "again").orderBy("doc_id").collect()
    assert [r["again"] for r in rows] == [False, False, False, False, True, True, True]  # null digests are equal to none
    assert filter_audit.audit(docs.limit(0), {"A": F.lit(True)}, F.col("first"), {}).count() == 0
    one = filter_audit.audit(docs, {"A": F.lit(None).cast("boolean")}, F.lit(None), {}).first()
    assert (one["part"], one["kept"], one["removed"], one["shapley"]) == ("", 7, 0, 0)
    for failures, labels in (({}, {}), ({c: F.lit(True) for c in "ABCDEFGH"}, {}), ({"AB": F.lit(True)}, {}), ({"A": F.lit(True)}, {"kept": F.lit(True)})):
        with pytest.raises(ValueError):
            filter_audit.audit(docs, failures, F.lit("x"), labels)


def _best(docs, items, k):
    """The k best documents of each item by scoring every document."""
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    total, n_docs = sum(b.total() for _, b in bags), sum(bool(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 75 + 25 * b.total() * n_docs // total if total else 0
            score = sum(weight[t] * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in cut(text) if b[t])
            scored += [(-score, i is None, i or 0, i)] if score > 0 else []
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("few", [True, False])
def test_search_equals_scoring_every_document(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(lexical_search, "VOCABULARY_BYTES", 0)
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 10, 60])))) for i in range(240)]
    docs += [(1000 + i, docs[3][1].upper()) for i in range(60)] + [(7, docs[7][1]), (None, docs[5][1]), (None, None), (900, ""), (901, "-- ..")]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 8, 30])))) for i in range(25)]
    items += [(30, docs[3][1]), (31, None), (32, ""), (33, "unheard"), (34, words[0] + " " + words[0] + " unheard"), (None, docs[5][1])]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"term": F.lit(1), "row": F.lit("x")}).repartition(5)
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(0)).repartition(3)
    for k in (1, 5, 20):
        rows = [tuple(r) for r in lexical_search.search(left, right, k).select("item_id", "rank", "doc_id", "score").collect()]
        key = lambda r: tuple((v is None, v or 0) for v in r)
        assert sorted(rows, key=key) == sorted(_best(docs, items, k), key=key)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "d"), (4, "e")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "b c")], "item_id string, text string")
    assert [tuple(r) for r in lexical_search.search(docs, items).select("item_id", "rank", "doc_id").orderBy("rank").collect()] == [("x", 1, 2), ("x", 2, 1)]
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
