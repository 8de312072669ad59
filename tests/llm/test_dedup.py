"""Exact, near and line deduplication against brute force and SQL, with the awkward inputs."""

import random
import re

import numpy as np
import pytest
from pricemill.llm import exact_dedup, graph, line_dedup, near_dedup, registry, words
from pricemill.llm.common import table

AWKWARD = [(1, None), (2, ""), (3, "One two three"), (3, "One two three"), (4, "ONE TWO THREE"), (5, "one  two\tthree"), (6, "word"), (7, "WORD"), (8, "é è"), (9, "É è"), (None, "One two three"), (10, "x " * 30000)]


def _docs(spark, rows=AWKWARD):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, digest string")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(name, spark, sf_dir, same_rows):
    same_rows(registry.QUERIES[name](spark, sf_dir), registry.SQL[name])


def test_exact_dedup_on_awkward_rows(spark):
    for keep, pick in (("largest", max), ("smallest", min)):
        rows = exact_dedup.exact_dedup(_docs(spark).repartition(5), keep).collect()
        assert len(rows) == len(AWKWARD)
        low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        text = dict(AWKWARD)
        for r in rows:
            if r["doc_id"] is None:
                assert r["keep_id"] is None and not r["kept"] and r["group_size"] == 0
                continue
            group = [i for i, t in AWKWARD if i is not None and low(t) == low(text[r["doc_id"]])]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (pick(group), len(group), r["doc_id"] == pick(group))
    assert exact_dedup.exact_dedup(_docs(spark).limit(0)).count() == 0


def test_runs_merge_over_many_partitions(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('t', id % 700) as text").repartition(60)
    rows = exact_dedup.exact_dedup(docs).groupBy("keep_id", "group_size").count().collect()
    assert len(rows) == 700 and all(r["group_size"] == r["count"] and r["keep_id"] < 700 for r in rows)


def _sets(rows, k):
    out = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def _brute(rows, k, percent):
    ids = [i for i, _ in rows]
    sets, label = _sets(rows, k), {i: i for i in ids}
    changed = True
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[ids[a]], label[ids[b]])
            changed |= label[ids[a]] != low or label[ids[b]] != low
            label[ids[a]] = label[ids[b]] = low
    return label, [len(s) for s in sets]


@pytest.mark.parametrize("k", [2, 5])
def test_near_groups_match_brute_force(spark, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 8, 60, 150]))]
        for _ in range(rng.randint(1, 6)):
            copy = [w if rng.random() > rng.choice([0, 0.01, 0.03]) else rng.choice(vocabulary) for w in base]
            rows.append((len(rows), " ".join(copy)))
    hub = [rng.choice(vocabulary) for _ in range(100)]
    rows += [(len(rows) + i, " ".join(w if rng.random() > 0.03 else rng.choice(vocabulary) for w in hub)) for i in range(60)]
    rows += [(1000, None), (1001, "  "), (1002, "W1"), (1003, "w1"), (1004, "a\0b c d"), (1005, "a b c d"), (1006, "A\0B c d"), (1007, "\0"), (1008, "\0\0")]
    label, sizes = _brute(rows, k, 80)
    found = {r["doc_id"]: r for r in near_dedup.near_groups(_docs(spark, rows), k, 80).collect()}
    assert {i: r["component_id"] for i, r in found.items()} == label
    assert [found[i]["n_shingles"] for i, _ in rows] == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.values())


def test_near_groups_of_awkward_rows(spark):
    rows = near_dedup.near_groups(_docs(spark), 2).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(AWKWARD)
    assert by[4]["component_id"] == by[5]["component_id"] == 3 and by[7]["component_id"] == 6 and by[1]["component_id"] == 1 and by[9]["component_id"] == 9
    assert by[None]["component_id"] is None and not by[None]["kept"]
    assert near_dedup.near_groups(_docs(spark).limit(0), 2).count() == 0
    kept = [r["doc_id"] for r in near_dedup.drop_near_copies(_docs(spark), 2).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 3, 6, 8, 9, None, 10], key=str)


def test_large_nodes_branch_and_fall_back_to_blocks(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.05 else f"w{rng.randint(0, 500)}" for w in base)) for i in range(80)]
    label, _ = _brute(rows, 2, 80)
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 8)
    monkeypatch.setattr(near_dedup, "MORE_LEVELS", 2)
    found = near_dedup.near_groups(_docs(spark, rows), 2, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == label


def test_recall_plan():
    depth, trees = near_dedup.plan(1_000_000, 0.8)
    assert (1 - near_dedup.survival(depth, 0.8)) ** trees <= 1e-4
    assert near_dedup.plan(0, 0.8)[0] >= 1


def test_trees_find_pairs_at_the_threshold_where_branching_ends():
    """With the real branching, all trees drawing from one sketch."""
    rng, pairs = np.random.default_rng(3), 30_000
    depth, trees = near_dedup.plan(500_000, 0.8)
    left = rng.integers(0, 1 << 32, (pairs, near_dedup.POSITIONS), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.8, left, left + np.uint32(1))
    found = np.zeros(pairs, bool)
    for tree in range(1, trees + 1):
        open_ = np.flatnonzero(~found)
        roots = np.full(len(open_), tree * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        nodes = []
        for sig in (left[open_], right[open_]):
            owner, path = np.arange(len(open_)), words.mix(roots)
            for _ in range(depth + near_dedup.MORE_LEVELS):
                owner, path = near_dedup.branch(sig, owner, path, 0.25)
            nodes.append(words.mix(path + owner.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
            last = owner
        found[open_[np.unique(last[np.isin(nodes[1], nodes[0])])]] = True
    assert (~found).sum() <= 9  # 3 at a recall of 0.9999
    assert near_dedup.missed(depth + near_dedup.MORE_LEVELS, trees, 0.8) <= 1e-4


@pytest.mark.parametrize("others", [3, 60])
def test_blocks_hold_every_pair_of_two_components(spark, monkeypatch, others):
    monkeypatch.setattr(near_dedup, "SMALL_NODE", 16)
    rows = [(7, i, 10, i if i < others else 1000, 100, 1000) for i in range(100)]
    large = spark.createDataFrame(rows, "path long, rep long, n int, label long, size long, weight long")
    nodes = {}
    for r in near_dedup._blocks(near_dedup._counted(large)).collect():
        nodes.setdefault(r["path"], []).append(r["rep"])
    pairs = {(a, b) for own in nodes.values() for a in own for b in own}
    assert all((a, b) in pairs for a in range(others) for b in range(100) if a != b)
    assert max(map(len, nodes.values())) < 48 and all(len(set(own)) == len(own) for own in nodes.values())
    assert others > 50 or sum(map(len, nodes.values())) < 200


def test_near_query_equals_brute_force_over_the_table(spark, sf_dir):
    """Every document of the small tables: sets and components by comparing all pairs that share a shingle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sets, ids = _sets(rows, 2), [i for i, _ in rows]
    root = dict(zip(ids, ids))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    unique = {}
    for i, s in zip(ids, sets):  # equal sets are linked; the others are compared once
        if s:
            first = unique.setdefault(frozenset(s), i)
            root[max(top(i), top(first))] = min(top(i), top(first))
    own = sorted(unique.items(), key=lambda x: len(x[0]))
    holders, pairs = {}, 0
    for s, i in own:
        shared = {}
        for x in s:
            for j, n in holders.get(x, ()):
                shared[j, n] = shared.get((j, n), 0) + 1
        for (j, n), common in shared.items():
            if 100 * common >= 80 * (len(s) + n - common):
                pairs += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        # a pair at 0.8 shares one of the rarest shingles, but all are kept: no filter is trusted here
        for x in s:
            holders.setdefault(x, []).append((i, len(s)))
    found = {r["doc_id"]: r for r in registry.QUERIES["op5_minhash_near_dedup"](spark, sf_dir).collect()}
    assert pairs > 0 and {i: found[i]["component_id"] for i in ids} == {i: top(i) for i in ids}
    assert [found[i]["n_shingles"] for i in ids] == list(map(len, sets))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.values())


def test_lines_beside_columns_of_the_same_names(spark):
    docs, _ = _lines(spark)
    own = docs.withColumns({c: line_dedup.F.lit("own") for c in ("__r", "__r2", "__stays", "h", "__n_lines")})
    out = line_dedup.dedup_lines(own)
    assert sorted(out.columns) == sorted([*own.columns, "__n_removed"])
    left = lambda df: sorted(map(str, df.select("doc_id", "text", "__n_lines", "__n_removed").collect()))
    assert left(out) == left(line_dedup.dedup_lines(docs)) and out.select("__stays").distinct().collect() == [("own",)]


def test_runs_collapse_across_batches_and_ranges(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        docs = spark.range(2000).selectExpr("id as doc_id", "concat('t', id % 13) as text").repartition(40)
        digests = docs.selectExpr("doc_id", "unhex(sha2(text, 256)) as digest", "3L as n_bytes")
        rows = exact_dedup.exact_groups(digests, "largest", range_rows=100).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["keep_id"], r["group_size"]) for r in rows) == sorted((max(range(i, 2000, 13)), len(range(i, 2000, 13))) for i in range(13))


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 200) if i % 50 != 49] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    label = {r["node"]: r["label"] for r in graph.components(df).collect()}
    assert all(label[i] == i // 50 * 50 for i in range(200)) and all(label[1000 + i] == 1000 for i in range(300))
    assert graph.components(df.limit(0)).count() == 0


def _lines(spark):
    rows = [(i, f"Cookie NOTICE\nunique {i}\n\n", f"site{i % 12}") for i in range(24)]
    rows += [(100 + i, "rare line\r\nown " + str(i), f"site{i % 9}") for i in range(30)]
    rows += [(200, None, "site0"), (201, "", "site1"), (202, "cookie notice ", None), (202, "cookie notice ", None), (203, "Cookie Notice\nCookie Notice", "site3")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_boilerplate_by_sites(spark):
    docs, rows = _lines(spark)
    out = {(r["doc_id"]): r for r in line_dedup.dedup_lines(docs).collect()}
    assert out[0]["text"] == "Cookie NOTICE\nunique 0\n\n" and out[0]["__n_removed"] == 0  # the first one stays
    assert out[5]["text"] == "unique 5\n\n" and out[5]["__n_lines"] == 4
    assert out[100]["text"] == "rare line\r\nown 0"  # nine sites are too few
    assert out[200]["text"] is None and out[201]["text"] == "" and out[202]["text"] == "" and out[203]["__n_removed"] == 2
    every = line_dedup.dedup_lines(docs, keep_first=False).where("doc_id = 0").first()
    assert every["text"] == "unique 0\n\n"
    left = line_dedup.remove_boilerplate(docs)
    assert left.columns == docs.columns and {202, 203}.isdisjoint(r["doc_id"] for r in left.collect())
    assert left.where("doc_id in (200, 201)").count() == 2
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_near_the_threshold_are_counted_exactly(spark, monkeypatch):
    rows = [(n * 1000 + i, f"line {n}", f"s{i}") for n in (8, 9, 10, 11, 12) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lines = line_dedup.line_table(docs, "source")
    assert line_dedup.widespread(lines, 10).count() == 3
    assert line_dedup.widespread(lines, 10, registers_log2=4).count() == 3
    monkeypatch.setattr(line_dedup, "SENT_LINES", 0)
    assert line_dedup.widespread(lines, 10).count() == 3


def test_words_cannot_be_made_to_collide(spark):
    """Two words that an unkeyed hash of eights of bytes gave one value, and what differs in the highest bit of an eight."""
    a, b = "zxdmytanabcdefgh", "yidodfzz*c=g@2|z"
    docs = spark.createDataFrame([(1, f"{a} {a}"), (2, f"{b} {b}"), (3, f"{a} {a}")], "doc_id long, text string")
    rows = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs, k=2).collect()}
    assert rows == {1: 1, 2: 2, 3: 1}
    rng = np.random.default_rng(3)
    for _ in range(50):
        word = rng.integers(33, 127, 16, dtype=np.uint8)
        others = [word]
        for bit in (7, 34 // 8 * 8 - 1):
            other = word.copy()
            other[7] ^= 128
            other[8 + bit // 8] ^= 1 << bit % 8
            others.append(other)
        data = np.concatenate(others)
        starts = np.arange(len(others)) * 16
        for key in (words.new_key(), words.PUBLIC_KEY):
            assert len(set(words.word_hashes(data, starts, starts + 16, key).tolist())) == len(others)
    # words of different lengths, by the known constants of another key
    data = np.frombuffer(b"abcdefgabcdefgh", np.uint8)
    one, two = (words.word_hashes(data, np.array([0, 7]), np.array([7, 15]), k) for k in (b"1", b"2"))
    assert len({*one.tolist(), *two.tolist()}) == 4
