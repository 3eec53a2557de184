"""Isolation forest (Liu, Ting and Zhou 2008)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.detectors.base import RAW, Detector
from barloom.session import cut_lineage

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"
MOST_NODES = 20_000_000
TOLERANCE = 1e-12
# Equal rows that one task unfolds.
RUN = 100_000


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, path); a leaf has feature -1."""
    nodes: list[list] = [[-1, 0.0, -1, -1, 0.0]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or not len(varying):
            nodes[at][4] = depth + expected_path(len(rows))
            continue
        feature = int(rng.choice(varying))
        threshold = float(rng.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:  # rounding must not leave the right side empty
            threshold = float(low[feature])
        goes_left = part[:, feature] <= threshold
        left, right = len(nodes), len(nodes) + 1
        nodes[at] = [feature, threshold, left, right, 0.0]
        nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
        todo += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return [tuple(n) for n in nodes]


class Forest:
    """All trees as flat arrays with child links into the whole array."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"])
        first = nodes.groupby("tree").size().cumsum().shift(fill_value=0)
        offset = nodes["tree"].map(first).to_numpy()
        leaf = nodes["feature"].to_numpy() < 0
        own = np.arange(len(nodes))
        # a right child follows its left one; a leaf is its own child, as nothing is above infinity
        self.feature = np.where(leaf, 0, nodes["feature"].to_numpy())
        self.threshold = np.where(leaf, np.inf, nodes["threshold"].to_numpy())
        self.child = np.where(leaf, own, nodes["left"].to_numpy() + offset)
        self.path = nodes["path"].to_numpy()
        self.roots = first.to_numpy()
        self.steps = [self.height(root) for root in self.roots]

    def height(self, root: int) -> int:
        """Steps from the root to the deepest leaf of a tree."""
        at, steps = np.array([root]), 0
        while True:
            inner = at[self.child[at] != at]
            if not len(inner):
                return steps
            at, steps = np.concatenate([self.child[inner], self.child[inner] + 1]), steps + 1

    def mean_path(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        flat, base = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for root, steps in zip(self.roots, self.steps):
            at = np.full(len(x), root)
            for _ in range(steps):
                right = flat.take(base + self.feature.take(at)) > self.threshold.take(at)
                at = self.child.take(at) + right
            total += self.path.take(at)
        return total / len(self.roots)


class IsolationForest(Detector):
    """Every tree learns from a few hundred rows, so fitting moves only a small sample.

    Each tree draws its own rows from the whole table by a seeded hash, which gives the same
    forest however the table is partitioned.
    """

    kind = "isolation_forest"
    defaults = {"n_estimators": 100, "max_samples": 256, "contamination": None, "random_state": 42}

    def learn(self, df: DataFrame) -> None:
        trees, seed = int(self.params["n_estimators"]), int(self.params["random_state"])
        size = self.size
        rows_per_tree = min(int(self.params["max_samples"]), size)
        if 2 * rows_per_tree * trees > MOST_NODES:
            raise ValueError("n_estimators * max_samples is too large for a forest that every task holds")
        drawn = self.drawn(df, size, rows_per_tree, trees, seed)
        limit = max(1, math.ceil(math.log2(max(rows_per_tree, 2))))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            order = pd.util.hash_array((pdf["_h"].to_numpy() ^ np.int64(tree * 7919 + seed)).astype(np.int64))
            x = np.stack(pdf["_x"].to_numpy())
            x = x[np.lexsort((*x.T, order))][:rows_per_tree]
            nodes = grow(x, np.random.default_rng([seed, tree]), limit)
            out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "path"])
            out.insert(0, "node", np.arange(len(out)))
            out.insert(0, "tree", tree)
            return out

        self.nodes = cut_lineage(drawn.groupBy("tree").applyInPandas(build, NODE_SCHEMA))
        self.state["normaliser"] = expected_path(rows_per_tree)
        self.load_forest()
        scored = cut_lineage(self.raw_scores(df).select(RAW))
        self.note_training_scores(scored, self.params["contamination"], 0.5)

    def is_flagged(self, raw: Column) -> Column:
        """Averaging equal path lengths must not lift a row over the cut by a last bit."""
        return raw > F.lit(float(self.state["threshold"]) + TOLERANCE)

    def drawn(self, df: DataFrame, size: int, rows_per_tree: int, trees: int, seed: int) -> DataFrame:
        """About twice the rows each tree keeps, drawn for every tree from all rows by hash; each tree keeps its smallest.

        Rows are known by (Symbol, Date) or ``_row``, else by their features and a number among rows with the same
        ones, so the forest doesn't depend on how the table is partitioned.
        """
        x = self.vector(df)
        key = ["Symbol", "Date"] if {"Symbol", "Date"} <= set(df.columns) else [c for c in ["_row"] if c in df.columns]
        if key:
            rows = df.select(x.alias("_x"), F.xxhash64(F.lit(seed), *key).alias("_h"))
        else:
            # equal rows are counted first and unfolded in runs, so that no task numbers them all
            counted = df.select(x.alias("_x")).groupBy("_x").agg(F.count(F.lit(1)).alias("n"))
            runs = counted.select("_x", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN))).alias("first")).repartition("_x", "first")
            copies = runs.select("_x", F.explode(F.sequence("first", F.least(F.col("first") + RUN, "n") - 1)).alias("copy"))
            rows = copies.select("_x", F.xxhash64(F.lit(seed), "_x", "copy").alias("_h"))
        keep = int(min(1.0, 2 * rows_per_tree / size) * (1 << 62))
        draw = lambda t: F.shiftrightunsigned(F.xxhash64(F.lit(seed), t, F.col("_h")), 2)
        if trees > 1:
            # few rows are drawn by any tree; compiled code finds them, then only these are asked tree by tree
            rows = rows.filter(F.least(*[draw(F.lit(t)) for t in range(trees)]) < keep)
        chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < keep)
        return rows.select("_x", "_h", F.explode(chosen).alias("tree"))

    def load_forest(self) -> None:
        # bounded by MOST_NODES, whatever the size of the data
        self.forest = Forest(self.nodes.toPandas())

    def raw_scores(self, df: DataFrame) -> DataFrame:
        forest = df.sparkSession.sparkContext.broadcast(self.forest)
        normaliser = self.state["normaliser"] or 1.0

        @F.pandas_udf("double")
        def score(x: pd.DataFrame) -> pd.Series:
            return pd.Series(np.power(2.0, -forest.value.mean_path(x.to_numpy(np.float64)) / normaliser))

        # columns of numbers reach Python faster than an array a row
        columns = [F.get(self.vector(df), F.lit(i)).alias(f"f{i}") for i in range(len(self.feature_columns))]
        return df.withColumn(RAW, score(F.struct(*columns)))

    def tables(self) -> dict[str, DataFrame]:
        return {"nodes": self.nodes}

    def restore(self, tables: dict[str, DataFrame]) -> None:
        self.nodes = tables["nodes"]
        self.load_forest()

