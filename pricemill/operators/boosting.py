"""Gradient-boosted trees with a Poisson loss and a log link, grown best-first from histograms.

Rows are binned once. A histogram is a grouped sum of gradients and hessians by (node, feature, bin), as many
rows as nodes x features x bins however large the table is, so the driver looks for splits among numbers of
fixed size. Only the smaller child of a split is summed; its sibling is the parent less it. The children of all
leaves that may still be split are summed in one job, so a tree takes about as many jobs as it is deep, and the
splits are then taken in the order of their gain, as one by one. Trees are scored by column functions.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricemill.functions.kept import keep

#: Least sum of hessians in a leaf; weight that draws a category's gradient to zero where categories are ordered.
LEAST_HESSIAN, CATEGORY_WEIGHT = 1e-3, 10.0
#: Gains that differ by less, in proportion, are equal: the first feature and the lowest bin win.
_EQUAL = 1e-9


@dataclass(frozen=True)
class Feature:
    """How a column is cut: numbers at edges (bin i holds edge[i - 1] < x <= edge[i]), categories by their
    levels. The last bin is for nulls, NaN and levels not listed."""

    column: str
    edges: tuple[float, ...] = ()
    levels: tuple[str, ...] = ()
    category: bool = False

    @property
    def missing(self) -> int:
        return len(self.levels) if self.category else len(self.edges) + 1

    def bin(self) -> Column:
        x = F.col(self.column)
        if self.category:
            place = F.array_position(F.array(*map(F.lit, self.levels)), x) if self.levels else F.lit(0)
            return F.when(F.coalesce(place, F.lit(0)) > 0, place - 1).otherwise(F.lit(self.missing)).cast("short")
        below = F.size(F.filter(F.array(*map(F.lit, self.edges)), lambda e: e < x)) if self.edges else F.lit(0)
        return F.when(x.isNull() | F.isnan(x), F.lit(self.missing)).otherwise(below).cast("short")


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    at: int = 0
    missing_left: bool = False
    bins: tuple[int, ...] = ()
    n_left: int = 0


@dataclass
class Node:
    """sums: by feature and bin, gradient, hessian and rows."""

    sums: np.ndarray | None
    split: Split | None = None
    children: tuple[Node, Node] | None = None
    value: float = 0.0
    wanted: int | None = field(default=None, compare=False)


_NODES = "array<struct<f: int, a: int, m: int, s: array<int>, l: int, r: int, v: double, w: int>>"


def walked(nodes: list[dict], bins: str) -> Column:
    """The leaf of a tree that a row's bins lead to: from the root as many steps as the tree is deep. The tree is one
    literal and the steps a loop, so that code does not grow with the tree, as nested conditions would."""
    depth = [0] * len(nodes)
    for i, n in enumerate(nodes):  # children come after their parent
        for child in {n["l"], n["r"]} - {i}:
            depth[child] = depth[i] + 1
    tree = F.from_json(F.lit(json.dumps(nodes)), _NODES)

    def step(at: Column, _: Column) -> Column:
        node = F.get(tree, at)
        b = F.get(F.col(bins), node.f).cast("int")
        left = (b <= node.a) | (b == node.m) | F.array_contains(node.s, b)
        return F.when(left, node.l).otherwise(node.r)

    if max(depth) == 0:
        return F.get(tree, F.lit(0))
    return F.get(tree, F.aggregate(F.sequence(F.lit(1), F.lit(max(depth))), F.lit(0), step))


def free_column(name: str, df: DataFrame) -> str:
    """A name that df has no column of."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def numeric_features(rows: DataFrame, columns: list[str], bins: int) -> list[Feature]:
    """Edges at the distinct approximate quantiles of each column, from one pass with bounded sketches."""
    shares = [i / bins for i in range(1, bins)]
    real = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    found = rows.agg(*(F.percentile_approx(x, shares, 10_000).alias(c) for c, x in real.items()), *(F.max(x).alias(f"__top_{c}") for c, x in real.items())).first()
    # no edge at the greatest value: nothing would be beyond it
    return [Feature(c, edges=tuple(sorted({e for e in found[c] or () if e < found[f"__top_{c}"]}))) for c in columns]


def category_features(rows: DataFrame, columns: list[str], bins: int) -> list[Feature]:
    """The most frequent levels of each column, at most as many as bins; the others share the last bin."""
    out = []
    for c in columns:
        top = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level").limit(bins)
        out.append(Feature(c, levels=tuple(sorted(r["level"] for r in top.collect())), category=True))
    return out


class PoissonTrees:
    """A boosted model of a non-negative target: exp(base + the sum of trees)."""

    def __init__(self, rounds: int = 400, rate: float = 0.06, leaves: int = 63, least_rows: int = 40, l2: float = 1.0, bins: int = 64):
        self.rounds, self.rate, self.leaves, self.least_rows, self.l2, self.bins = rounds, rate, leaves, least_rows, l2, bins
        self.features: list[Feature] = []
        self.trees: list[dict[str, Any]] = []
        self.base = 0.0

    def fit(self, rows: DataFrame, numbers: list[str], categories: list[str], target: str) -> PoissonTrees:
        """Fits rows with the columns named; those without a target are left out. Raises ValueError where
        there is no row or the mean target is not positive."""
        rows = rows.where(F.col(target).isNotNull())
        self.features = [*numeric_features(rows, numbers, self.bins), *category_features(rows, categories, self.bins)]
        binned = F.array(*(f.bin() for f in self.features)).alias("bins")
        start = keep(rows.select(binned, F.col(target).cast("double").alias("y")), "binned")
        mean = start.rows.agg(F.avg("y")).first()[0]
        if mean is None or mean <= 0:
            start.drop()
            raise ValueError("a Poisson model needs rows with a positive mean")
        self.base, self.trees = math.log(mean), []
        state = keep(start.rows.withColumn("raw", F.lit(self.base)), "boosting")
        start.drop()
        for k in range(self.rounds):
            root = self._grow(state.rows)
            self.trees.append(self._plain(root))
            if k + 1 < self.rounds:
                after = keep(state.rows.withColumn("raw", F.col("raw") + self._by_bins(root)), "boosting")
                state.drop()
                state = after
        state.drop()
        return self

    def _sums(self, state: DataFrame, node: Column) -> dict[int, np.ndarray]:
        """Histograms of the nodes that rows are in; rows of no node are not looked at."""
        mean = F.exp("raw")
        cells = state.select(node.alias("node"), (mean - F.col("y")).alias("g"), mean.alias("h"), "bins").where("node is not null")
        cells = cells.select("node", "g", "h", F.posexplode("bins").alias("feature", "bin")).groupBy("node", "feature", "bin")
        out: dict[int, np.ndarray] = {}
        width = max(f.missing for f in self.features) + 1
        # at most nodes x features x bins rows
        found = cells.agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).toPandas()
        for k, own in found.groupby("node"):
            out[k] = np.zeros((len(self.features), width, 3))
            out[k][own["feature"], own["bin"]] = own[["g", "h", "n"]]
        return out

    def _settle(self, node: Node) -> None:
        """The node's value and best split."""
        g, h, n = node.sums[0].sum(axis=0)
        node.value = -self.rate * g / (h + self.l2)
        best = None
        for i, f in enumerate(self.features):
            for split in best_splits(f, i, node.sums[i, : f.missing + 1], g, h, n, self.l2, self.least_rows):
                if split.gain > 0 and (best is None or split.gain > best.gain * (1 + _EQUAL)):
                    best = split
        node.split = best

    def _grow(self, state: DataFrame) -> Node:
        root = Node(self._sums(state, F.lit(0))[0])
        self._settle(root)
        while wanted := self._open(root):
            small = {}
            for k, node in enumerate(wanted):
                node.children = (Node(None), Node(None))
                side = 0 if 2 * node.split.n_left <= node.sums[0, :, 2].sum() else 1
                node.children[side].wanted, small[k] = k, side
            sums = self._sums(state, self._place(root))
            for k, node in enumerate(wanted):
                one, other = node.children[small[k]], node.children[1 - small[k]]
                one.wanted, one.sums = None, sums[k]
                other.sums = node.sums - one.sums
                for child in node.children:
                    self._settle(child)
                node.sums = None
        self._prune(root)
        return root

    def _walk(self, root: Node) -> tuple[list[Node], list[Node], int]:
        """Splits by falling gain as far as children are known: (the nodes split, leaves with a gain that are left,
        the number of leaves)."""
        heap, tick, taken, leaves = [(-root.split.gain, 0, root)] if root.split else [], 1, [], 1
        while heap and leaves < self.leaves and heap[0][2].children is not None:
            node = heapq.heappop(heap)[2]
            taken.append(node)
            leaves += 1
            for child in node.children:
                if child.split:
                    heapq.heappush(heap, (-child.split.gain, tick, child))
                    tick += 1
        return taken, [x[2] for x in sorted(heap, key=lambda x: x[:2])], leaves

    def _open(self, root: Node) -> list[Node]:
        """Leaves with a gain whose children are not known, as long as the tree needs any of them. All are summed at once, also those
        that may not be split in the end: each row is in one leaf, so a job reads the rows once, however many there are."""
        _, rest, leaves = self._walk(root)
        if leaves >= self.leaves or not rest:
            return []
        return [n for n in rest if n.children is None]

    def _prune(self, root: Node) -> None:
        """Takes back the splits that were tried but come after the last leaf."""
        taken = {id(n) for n in self._walk(root)[0]}
        stack = [root]
        while stack:
            node = stack.pop()
            if id(node) not in taken:
                node.children = node.split = None
            else:
                stack += node.children
            node.sums = None

    def _flat(self, node: Node | dict[str, Any], rows: list[dict] | None = None) -> list[dict]:
        """A tree as the rows that walked() reads, a node's children after it. A leaf leads to itself."""
        rows = [] if rows is None else rows
        own, at = {}, len(rows)
        rows.append(own)
        plain = isinstance(node, dict)
        inner = "value" not in node if plain else node.children is not None
        if not inner:
            value = node["value"] if plain else node.value
            own |= {"f": 0, "a": -1, "m": -1, "s": [], "l": at, "r": at, "v": value, "w": None if plain else node.wanted}
            return rows
        s = Split(node["gain"], node["feature"], node["at"], node["missing_left"], tuple(node["bins"])) if plain else node.split
        f = self.features[s.feature]
        # of a category no bin is at most -1, so only the set says what goes left
        own |= {"f": s.feature, "a": -1 if f.category else s.at, "m": f.missing if s.missing_left else -1, "s": list(s.bins), "v": 0.0, "w": None}
        left, right = (node["left"], node["right"]) if plain else node.children
        own["l"] = len(rows)
        self._flat(left, rows)
        own["r"] = len(rows)
        self._flat(right, rows)
        return rows

    def _place(self, root: Node) -> Column:
        """The number of the wanted node that a row of bins is in, or null."""
        return walked(self._flat(root), "bins").w

    def _by_bins(self, root: Node) -> Column:
        return walked(self._flat(root), "bins").v

    def _plain(self, node: Node) -> dict[str, Any]:
        if node.children is None:
            return {"value": node.value}
        s = node.split
        return {"feature": s.feature, "at": s.at, "missing_left": s.missing_left, "bins": list(s.bins), "gain": s.gain, "left": self._plain(node.children[0]), "right": self._plain(node.children[1])}

    def predicted(self, df: DataFrame, column: str) -> DataFrame:
        """df with the expected target of each row, from the columns that were fitted."""
        bins = free_column("bins", df)
        raw = F.lit(self.base)
        binned = df.withColumn(bins, F.array(*(f.bin() for f in self.features)))
        for tree in self.trees:
            raw = raw + walked(self._flat(tree), bins).v
        return binned.withColumn(column, F.exp(raw)).drop(bins)

    def gains(self) -> dict[str, float]:
        """Sum of the gains of each feature's splits."""
        out = {f.column: 0.0 for f in self.features}
        stack = list(self.trees)
        while stack:
            t = stack.pop()
            if "value" not in t:
                out[self.features[t["feature"]].column] += t["gain"]
                stack += [t["left"], t["right"]]
        return out

    def facts(self) -> dict[str, Any]:
        """What from_facts makes the model of again, as plain values."""
        settings = {k: getattr(self, k) for k in ("rounds", "rate", "leaves", "least_rows", "l2", "bins")}
        features = [{"column": f.column, "edges": list(f.edges), "levels": list(f.levels), "category": f.category} for f in self.features]
        return {"settings": settings, "base": self.base, "features": features, "trees": self.trees}

    @classmethod
    def from_facts(cls, facts: dict[str, Any]) -> PoissonTrees:
        model = cls(**facts["settings"])
        model.base, model.trees = facts["base"], facts["trees"]
        model.features = [Feature(f["column"], tuple(f["edges"]), tuple(f["levels"]), f["category"]) for f in facts["features"]]
        return model


def best_splits(f: Feature, i: int, sums: np.ndarray, g: float, h: float, n: float, l2: float, least_rows: int) -> list[Split]:
    """The best split of a feature's bins, missing values right and then left; none where no side holds enough."""
    found = []
    if f.category:  # in the order of their mean gradient, categories are cut as numbers are
        present = np.flatnonzero(sums[:, 2] > 0)
        order = present[np.argsort(sums[present, 0] / (sums[present, 1] + CATEGORY_WEIGHT), kind="stable")]
        sides = [(np.cumsum(sums[order], axis=0)[:-1], False)]
    else:
        upto = np.cumsum(sums[:-1], axis=0)
        sides = [(upto, False)]
        if sums[-1, 2] > 0:
            sides.append((upto[:-1] + sums[-1], True))
    for left, missing_left in sides:
        if not len(left):
            continue
        right = np.array([g, h, n]) - left
        valid = (left[:, 2] >= least_rows) & (right[:, 2] >= least_rows) & (left[:, 1] >= LEAST_HESSIAN) & (right[:, 1] >= LEAST_HESSIAN)
        if not valid.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(valid, left[:, 0] ** 2 / (left[:, 1] + l2) + right[:, 0] ** 2 / (right[:, 1] + l2) - g * g / (h + l2), -np.inf)
        at = int(np.argmax(gain >= gain.max() - _EQUAL * abs(gain.max())))
        bins = tuple(sorted(order[: at + 1].tolist())) if f.category else ()
        found.append(Split(float(gain[at]), i, at, missing_left, bins, int(left[at, 2])))
    return found
