"""How filters interact: what each one removes in every order, from counts of which filters a document fails.

A document's mask has a bit for each filter that it fails. Per part, documents are counted by mask (and those
of each label too); the subset-zeta transform turns these counts into the documents that survive each set of
filters: as many rounds as there are filters, each adding to a set's count that of the set without one
element. A step of an order is then the difference between two neighbouring sets, for the labels likewise, so
all orders come from one small row a part and the documents are counted once.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

#: Filters whose orders are written out at most (5040 orders for each part).
MOST_FILTERS = 7
#: White space of the contract: 20, 09-0D.
_WORD = r"[^\x20\x09-\x0D]+"


def repeats(docs: DataFrame, doc_id: str, digest: str, into: str) -> DataFrame:
    """docs with a boolean column: whether a row of a smaller doc_id has the same digest (equal for equal contents).

    The least doc_id of each digest is found by partial aggregates, then looked up by digest and doc_id
    together, so a group of copies of any size is dealt over all tasks. Rows without a doc_id have no
    smaller one and are smaller than none; repeated rows of the least doc_id are all first.
    """
    first, of = free_name("first", docs), free_name("of", docs)
    least = docs.groupBy(F.col(digest).alias(of)).agg(F.min(doc_id).alias(first)).where(F.col(first).isNotNull())
    found = docs.join(least, (F.col(digest) == F.col(of)) & (F.col(doc_id) == F.col(first)), "left")
    return found.select(*docs.columns, (F.col(doc_id).isNotNull() & F.col(first).isNull()).alias(into))


def masks(docs: DataFrame, failures: dict[str, Column], into: str) -> DataFrame:
    """docs with the sum of 2 ** i over the filters, in the order given, whose failure condition holds (null: it doesn't)."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures.values())]
    return docs.withColumn(into, sum(bits[1:], bits[0]))


def survivors(masked: DataFrame, part: str, mask: str, n: int, labels: dict[str, Column]) -> DataFrame:
    """One row a part: part; mask_counts, documents by mask; all and each label: by set of filters, the documents
    (with that label) that fail none of the set. Counted by partial aggregates, so a part that holds
    most rows is no task's burden."""
    names = ["all", *labels]
    kinds = [F.lit(True), *labels.values()]
    by = masked.groupBy(part, mask).agg(*(F.count_if(k).alias(f"__{name}") for name, k in zip(names, kinds)))
    places = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    maps = by.groupBy(part).agg(*(F.map_from_entries(F.collect_list(F.struct(F.col(mask).cast("int"), F.col(f"__{name}")))).alias(name) for name in names))
    rows = maps.select(part, *(_dense(name, places).alias(name) for name in names))
    out = rows.withColumn("mask_counts", F.col("all"))
    # each round is a projection of its own: as one expression, rounds would be written out within each other
    for i in range(n):
        out = out.withColumns({name: _round(name, 1 << i) for name in names})
    # sums over the masks within the complement are what survives a set
    return out.withColumns({name: F.reverse(name) for name in names})


def _dense(name: str, places: Column) -> Column:
    """A map of counts as an array with a count, 0 where the map has none, for each place."""
    return F.transform(places, lambda i: F.coalesce(F.try_element_at(F.col(name), i), F.lit(0).cast("long")))


def _round(name: str, bit: int) -> Column:
    """One round of the subset-zeta transform of an array of counts by mask."""
    return F.transform(name, lambda x, at: F.when(at.bitwiseAND(bit) != 0, x + F.get(F.col(name), at - bit)).otherwise(x))


def audit(docs: DataFrame, failures: dict[str, Column], part: Column, labels: dict[str, Column]) -> DataFrame:
    """What each filter removes in every order of the filters, by part.

    failures: the condition under which a document fails each filter, by a letter of its own; labels: a
    condition on docs by name (null: not so). Returns (part, filter_order, step, kept, removed, redundant,
    unique_fails, <label>_lost..., shapley): documents kept after the step and removed by it, failing its
    filter but removed earlier, failing it alone, removed with each label, and removed by this filter at
    any step summed over all orders. A null part counts as the empty string; an empty table has no parts
    and so no rows; repeated rows count as often as they stand there.
    """
    n, letters = len(failures), "".join(failures)
    if not 1 <= n <= MOST_FILTERS or len(letters) != n:
        raise ValueError(f"1 to {MOST_FILTERS} filters, each named by one letter")
    taken = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "shapley", "all", "mask_counts", "__mask")
    if clash := sorted(set(labels) & set(taken)):
        raise ValueError(f"labels named as columns of the result: {', '.join(clash)}")
    flags = {f"__l{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(labels.values())}
    masked = masks(docs, failures, "__mask").select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), "__mask", *(c.alias(k) for k, c in flags.items()))
    sets = survivors(masked, "part", "__mask", n, dict(zip(labels, map(F.col, flags))))

    left = lambda of, s: F.get(F.col(of), s.cast("int") if isinstance(s, Column) else F.lit(s))
    shares = []
    for i in range(n):
        others = [s for s in range(1 << n) if not s >> i & 1]
        terms = [F.lit(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) * (left("all", s) - left("all", s | 1 << i)) for s in others]
        shares.append(sum(terms[1:], terms[0]))
    sets = sets.withColumn("__shares", F.array(*shares))

    steps = []
    for order in permutations(range(n)):
        before = 0
        for k, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(letters[j] for j in order), "step": k, "__filter": i, "__before": before, "__after": before | 1 << i})
            before |= 1 << i
    kind = "array<struct<filter_order string, step int, __filter int, __before int, __after int>>"
    # a literal of at most 5040 orders of 7 steps, written out for each part
    rows = sets.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))
    f, before, after = F.col("__filter"), F.col("__before"), F.col("__after")
    removed = left("all", before) - left("all", after)
    alone = F.element_at(F.array(*(F.lit(1 << i) for i in range(n))), f + 1)
    failing = left("all", 0) - left("all", alone)
    return rows.select(
        "part", "filter_order", "step", left("all", after).alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"),
        left("mask_counts", alone).alias("unique_fails"), *((left(name, before) - left(name, after)).alias(f"{name}_lost") for name in labels), F.get("__shares", f).alias("shapley"),
    )


def text_filters(docs: DataFrame, text: str, into: str) -> DataFrame:
    """docs with the mask of four filters of a text that is not null: few words, few distinct words, many capitals, markup."""
    words, capitals = free_name("words", docs), free_name("capitals", docs)
    cut = docs.withColumn(words, F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))).withColumn(capitals, F.length(F.regexp_replace(text, "[^A-Z]+", "")))
    failures = {
        "A": F.size(words) < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.col(capitals) > 2 * F.length(text), "D": F.col(text).rlike("[#$%&*|]"),
    }
    return masks(cut, failures, into).drop(words, capitals)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over whole documents, by source, with the labels of quality and toxicity."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text"))
    # a text's own filters are settled where it is read: what moves on is a mask, a digest and the keys
    small = text_filters(docs, "text", "fails").select("doc_id", "source", "fails", F.sha2("text", 256).alias("content"))
    marks = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    seen = repeats(small, "doc_id", "content", "repeated").join(marks, "doc_id", "left")
    failures = {k: F.col("fails").bitwiseAND(1 << i) != 0 for i, k in enumerate("ABCD")} | {"E": F.col("repeated")}
    return audit(seen, failures, F.col("source"), {"good": F.col("good"), "toxic": F.col("toxic")})


_LETTERS = "ABCDE"
_STEPS = ", ".join(f"('{''.join(o)}', {k + 1}, {1 << _LETTERS.index(o[k])}, {sum(1 << _LETTERS.index(c) for c in o[:k])})" for o in permutations(_LETTERS) for k in range(5))
#: Every order and step against every mask, without sets: what a filter removes is counted anew for each.
OP12_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM worded LEFT JOIN marks USING (doc_id)),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, mask),
steps(filter_order, step, bit, earlier) AS (VALUES {_STEPS}),
each_step AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted CROSS JOIN steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM each_step
"""
