"""Exact k nearest neighbours without comparing all pairs.

A small sample of the reference fixes a tree of median splits, whose leaves hold similar
numbers of rows. Every query is compared with its own leaf first; the distance of its k-th
neighbour there then rules out all leaves whose bounding box is further away. Only
the others are visited, those of one bough of the tree together. What a leaf or bough receives
is split into portions of bounded size, so that a popular one is the work of many tasks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage

LEAF_ROWS = 1024
MOST_LEAVES = 1 << 14
SAMPLE_PER_LEAF = 32
PORTION_ROWS = 4096
#: Leaves of one node so many levels up are visited together, so that a query travels once to all of them.
BOUGH = 3
NEAR = "array<struct<d2:double,id:bigint,w:bigint>>"


class SplitTree:
    """Median splits of a sample; node i has the children 2i+1 and 2i+2, leaves come last."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(2**depth - 1, dtype=np.int64)
        self.cut = np.full(2**depth - 1, np.inf)
        parts = [sample]
        for node in range(2**depth - 1):
            part = parts[node]
            left = right = part[:0]
            if len(part):
                spread = part.max(axis=0) - part.min(axis=0)
                self.axis[node] = int(np.argmax(spread))
                if spread.max() > 0:
                    along = part[:, self.axis[node]]
                    cut = float(np.median(along))
                    if cut == along.max():  # keep the right side from being empty
                        cut = float(along[along < cut].max())
                    self.cut[node] = cut
                    left, right = part[along <= cut], part[along > cut]
                else:
                    left = part
            parts += [left, right]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.axis[node]] > self.cut[node])
        return node - (2**self.depth - 1)


def nested(boxes: pd.DataFrame, leaves: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounding boxes of all nodes from those of the leaves; an empty box is infinitely far."""
    low, high = np.full((2 * leaves - 1, dims), np.inf), np.full((2 * leaves - 1, dims), -np.inf)
    for leaf, lo, hi in zip(boxes["leaf"], boxes["low"], boxes["high"]):
        low[leaves - 1 + leaf], high[leaves - 1 + leaf] = lo, hi
    for node in range(leaves - 2, -1, -1):
        low[node] = np.minimum(low[2 * node + 1], low[2 * node + 2])
        high[node] = np.maximum(high[2 * node + 1], high[2 * node + 2])
    return low, high


def squared_distances(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Distances of the listed pairs of rows."""
    total = np.zeros(len(row))
    for j in range(a.shape[1]):
        total += (a[row, j] - b[col, j]) ** 2
    return total


def rough_distances(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs by a matrix product in single precision, and per query how far they may be off.

    Where numbers leave that precision, the bound is infinite.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = (q - r[0]).astype(np.float32), (r - r[0]).astype(np.float32)
        a2, b2 = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        d2 = a @ (b.T * np.float32(-2))
        d2 += a2[:, None]
        d2 += b2[None, :]
        few = np.finfo(np.float32)
        reach = a2.astype(np.float64) + float(b2.max())
        off = 4 * (q.shape[1] + 8) * (few.eps * reach + few.tiny)
        off[~(reach < few.max / 8)] = np.inf
    return d2, off


def nearest(queries: pd.DataFrame, reference: pd.DataFrame, k: int, skip_self: bool) -> list[list]:
    """Per query its k nearest as (squared distance, id, weight), ties by id; with a ``radius`` (squared), of those it holds.

    Rough distances of all pairs leave few whose distance is then taken exactly.
    """
    if not len(reference):
        return [[] for _ in range(len(queries))]
    reference = reference.sort_values("id")
    r_id, r_w, r = reference["id"].to_numpy(), reference["w"].to_numpy(), stacked_vectors(reference["x"])
    q_id, q = queries["id"].to_numpy(), stacked_vectors(queries["x"])
    radius = queries["radius"].to_numpy() if "radius" in queries else np.full(len(q), np.inf)
    found: list[list] = []
    step = max(1, 4_000_000 // max(1, len(r)))
    for at in range(0, len(q), step):
        some = slice(at, at + step)
        rough, off = rough_distances(q[some], r)
        if skip_self:
            rough[q_id[some, None] == r_id[None, :]] = np.inf
        edge = radius[some].copy()
        open_ = np.flatnonzero(np.isinf(edge) & np.isfinite(off))
        if len(open_) and len(r) > k:
            edge[open_] = np.partition(rough[open_], k - 1, axis=1)[:, k - 1] + off[open_]
        edge += off
        # as no float32 is nearer to the edge than the next one above it, none at the edge is lost; a NaN stays, too
        with np.errstate(over="ignore"):
            top = np.nextafter(edge.astype(np.float32), np.float32(np.inf))
        row, col = np.nonzero(~(rough > top[:, None]))
        value = squared_distances(q[some], r, row, col)
        keep = np.isfinite(value) & (value <= radius[some][row])
        if skip_self:
            keep &= q_id[some][row] != r_id[col]
        row, col, value = row[keep], col[keep], value[keep]
        order = np.lexsort((col, value, row))
        row, col, value = row[order], col[order], value[order]
        bounds = np.searchsorted(row, np.arange(len(rough) + 1))
        for i in range(len(rough)):
            own = slice(bounds[i], min(bounds[i + 1], bounds[i] + k))
            near = zip(value[own], r_id[col[own]], r_w[col[own]])
            found.append([{"d2": float(v), "id": int(n), "w": int(w)} for v, n, w in near])
    return found


def stacked_vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def portions(visits: Column) -> Column:
    return F.ceil(visits / PORTION_ROWS)


def dealt(queries: DataFrame, reference: DataFrame, key: str, columns: list[str]):
    """Queries and reference rows that meet by ``key``, cogrouped.

    A group with many queries is copied once per portion of them. The query count per
    group is one row per group, of at most MOST_LEAVES.
    """
    sizes = queries.groupBy(key).agg(portions(F.count(F.lit(1))).alias("_portions"))
    asked = queries.join(F.broadcast(sizes), key).withColumn("_portion", F.pmod(F.xxhash64("id"), F.col("_portions")))
    held = reference.join(F.broadcast(sizes), key).select(
        *[F.col(c).alias(c) for c in dict.fromkeys([key, "leaf", "id", "x", "w"])],
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_portions") - 1)).alias("_portion"),
    )
    asked = asked.select(*columns, key, "_portion")
    return asked.groupBy(key, "_portion").cogroup(held.groupBy(key, "_portion"))


def probe(queries: DataFrame, reference: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """Compare (id, x, home, leaf) rows with the reference rows of their leaf."""

    def compare(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return pd.DataFrame({"id": [], "x": [], "home": [], "near": []})
        near = nearest(q, r, k, skip_self)
        return pd.DataFrame({"id": q["id"], "x": q["x"], "home": q["home"], "near": near})

    met = dealt(queries, reference, "leaf", ["id", "x", "home"])
    return met.applyInPandas(compare, f"id bigint, x array<double>, home bigint, near {NEAR}")


def visit(visits: DataFrame, reference: DataFrame, k: int, skip_self: bool) -> DataFrame:
    """Compare (id, x, home, radius, bough) rows with the leaves of a bough but their own, where the radius reaches them.

    Rows (id, near): one for every leaf that holds something.
    """

    def compare(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": np.empty(0, np.int64), "near": np.empty(0, object)})]
        if len(q) and len(r):
            x, home, radius = stacked_vectors(q["x"]), q["home"].to_numpy(), q["radius"].to_numpy()
            for leaf, rows in r.groupby("leaf"):
                inside = stacked_vectors(rows["x"])
                some = np.flatnonzero((outside(x, inside.min(axis=0), inside.max(axis=0)) <= radius) & (home != leaf))
                if len(some):
                    near = pd.Series(nearest(q.iloc[some], rows, k, skip_self))
                    any_ = near.map(len).to_numpy() > 0
                    out.append(pd.DataFrame({"id": q["id"].to_numpy()[some][any_], "near": near[any_].to_numpy()}))
        return pd.concat(out)

    boughs = reference.withColumn("bough", F.shiftright("leaf", BOUGH))
    return dealt(visits, boughs, "bough", ["id", "x", "home", "radius"]).applyInPandas(compare, f"id bigint, near {NEAR}")


def outside(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of rows to a box."""
    return ((np.maximum(low - x, 0) + np.maximum(x - high, 0)) ** 2).sum(axis=1)


def box_finder(low: np.ndarray, high: np.ndarray, leaves: int, k: int, within: float):
    """Find, per row, the boughs with other leaves that may hold one of its k nearest, closer than ``within``."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, home = stacked_vectors(batch["x"]), batch["home"].to_numpy()
            # a hair more than the distance, so that rounding loses no tie
            radius = np.array([n[k - 1]["d2"] if len(n) >= k else np.inf for n in batch["near"]]) * (1 + 1e-12)
            radius = np.minimum(radius, within**2)
            hits: dict[int, np.ndarray] = {}
            todo = [(0, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if not np.isfinite(low[node]).all():
                    continue
                rows = rows[outside(x[rows], low[node], high[node]) <= radius[rows]]
                if not len(rows):
                    continue
                if node >= leaves - 1:
                    leaf = node - (leaves - 1)
                    hits.setdefault(leaf >> BOUGH, np.zeros(len(x), bool))[rows[home[rows] != leaf]] = True
                else:
                    todo += [(2 * node + 1, rows), (2 * node + 2, rows)]
            for bough, rows in hits.items():
                if rows.any():
                    some = batch[rows]
                    yield pd.DataFrame({"id": some["id"], "x": some["x"], "home": some["home"], "radius": radius[rows], "bough": bough})

    return find


class NeighbourIndex:
    """A reference table made ready for any number of searches: the tree, the rows by leaf and the boxes of the leaves.

    The table has ``id`` (bigint, unique), ``x`` (array of doubles, no nulls) and a weight ``w``. It is read here, and
    later only in the leaves that a search visits.
    """

    def __init__(self, reference: DataFrame):
        spark = reference.sparkSession
        size, self.dims = reference.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        if not size:
            raise ValueError("no reference rows to search")
        depth = 0 if size <= LEAF_ROWS else math.ceil(math.log2(min(MOST_LEAVES, size / LEAF_ROWS)))
        self.leaves = 2**depth
        wanted = self.leaves * SAMPLE_PER_LEAF
        # the rows with the smallest hashes: the same sample however the table is partitioned
        hashed = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 20))
        share = math.ceil((1 << 20) * min(1.0, 2 * wanted / size))
        picked = reference.filter(hashed < share).orderBy(F.xxhash64(F.lit(7), "id")).select("x").limit(wanted)
        sample = stacked_vectors(picked.toPandas()["x"]) if depth else np.zeros((0, self.dims))
        tree = spark.sparkContext.broadcast(SplitTree(sample, depth))

        @F.pandas_udf("bigint")
        def leaf_of(x: pd.Series) -> pd.Series:
            return pd.Series(tree.value.leaf(stacked_vectors(x)) if len(x) else np.zeros(0, dtype=np.int64))

        self.leaf_of = leaf_of
        held = reference.select("id", "x", "w", leaf_of("x").alias("leaf"))
        self.held = cut_lineage(held) if depth else held

    @functools.cached_property
    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        corners = [f(F.col("x")[j]) for f in (F.min, F.max) for j in range(self.dims)]
        boxes = self.held.groupBy("leaf").agg(F.array(*corners[: self.dims]).alias("low"), F.array(*corners[self.dims :]).alias("high"))
        return nested(boxes.toPandas(), self.leaves, self.dims)

    def search(self, queries: DataFrame, k: int, skip_self: bool = False, within: float = math.inf) -> DataFrame:
        """Rows (id, near): the k nearest reference rows of every query, ties by id, of those closer than ``within``.

        The queries have ``id`` and ``x`` as the reference has. ``near`` holds squared distances, nearest first.
        """
        asked = queries.select("id", "x", self.leaf_of("x").alias("leaf")).withColumn("home", F.col("leaf"))
        near = probe(asked, self.held, k, skip_self)
        if self.leaves > 1:
            near = cut_lineage(near)
            find = box_finder(*self.boxes, self.leaves, k, within)
            visits = cut_lineage(near.mapInPandas(find, "id bigint, x array<double>, home bigint, radius double, bough bigint"))
            near = near.select("id", "near").unionByName(visit(visits, self.held, k, skip_self))
        best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
        near = near.groupBy("id").agg(best.alias("near"))
        if math.isinf(within):
            return near
        return near.withColumn("near", F.filter("near", lambda one: one["d2"] < within**2))


def k_nearest(queries: DataFrame, reference: DataFrame, k: int, skip_self: bool = False, within: float = math.inf) -> DataFrame:
    """One search of a reference table, see ``NeighbourIndex``."""
    return NeighbourIndex(reference).search(queries, k, skip_self, within)
