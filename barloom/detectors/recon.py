"""Reconstruction error: linear (principal components) or a small dense autoencoder."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.detectors.base import RAW, Detector, moments
from barloom.operators.evaluate import number_in_order
from barloom.session import cut_lineage

VARIANCE = 0.9
#: Partial sums that the driver takes at once; more tasks are summed in groups first.
DRIVER_SUMS = 64
#: Steps that the curvature is estimated from, and halvings of a step that does not lower the loss.
MEMORY, HALVINGS = 10, 6


class Autoencoder(Detector):
    """Scores rows by the mean squared error of their reconstruction from few numbers.

    ``mode="pca"`` keeps ``encoding_dim`` principal components (None: enough for 90% of the
    variance), the optimum of a linear autoencoder (Baldi and Hornik 1989). ``mode="mlp"``
    trains dense layers. Both standardise with training moments and cut at a
    quantile of the training errors.

    Dense layers learn from gradients summed over all rows, one job for each, by limited-memory BFGS: the same
    algorithm and the same sums at every size and partitioning. ``epochs`` bounds these passes, ``learning_rate`` is
    the most a weight moves in the first step, before any curvature is known, and dropped units are fixed per row by a
    seeded hash, so that all passes have one loss. ``batch_size`` has no effect on sums over all rows; it is accepted
    for configurations that name it.
    """

    kind = "autoencoder"
    defaults = {
        "mode": "mlp",
        "encoding_dim": 10,
        "hidden_layers": [20, 10],
        "dropout_rate": 0.2,
        "learning_rate": 0.001,
        "epochs": 50,
        "batch_size": 32,
        "validation_split": 0.1,
        "patience": 5,
        "contamination": 0.05,
        "random_state": 42,
    }

    def learn(self, df: DataFrame) -> None:
        means, spreads = moments(df, self.feature_columns)
        self.state["scaling"] = [means, spreads]
        if self.params["mode"] == "pca":
            self.learn_components(df)
        elif self.params["mode"] == "mlp":
            self.learn_layers(df)
        else:
            raise ValueError(f"unknown mode {self.params['mode']!r}")
        scored = cut_lineage(self.raw_scores(df).select(RAW))
        self.note_training_scores(scored, self.params["contamination"], None)

    def scaled(self, df: DataFrame) -> Column:
        means, spreads = self.state["scaling"]
        shift = F.array(*[F.lit(m) for m in means])
        width = F.array(*[F.lit(s) for s in spreads])
        return F.zip_with(F.zip_with(self.vector(df), shift, lambda a, b: a - b), width, lambda a, b: a / b)

    def learn_components(self, df: DataFrame) -> None:
        """Fewer components than independent directions, or every error would be zero."""
        size = len(self.feature_columns)
        if size < 2:
            raise ValueError("mode='pca' needs at least two features")
        z = df.select(array_to_vector(self.scaled(df)).alias("z"))
        fitted = PCA(k=size, inputCol="z", outputCol="p").fit(z)
        share = fitted.explainedVariance.toArray()
        independent = int((share > 1e-12).sum())
        wanted = self.params["encoding_dim"]
        if wanted is None:
            wanted = int(np.searchsorted(np.cumsum(share), VARIANCE) + 1)
        kept = max(1, min(int(wanted), independent - 1))
        self.state["components"] = fitted.pc.toArray()[:, :kept].tolist()

    def learn_layers(self, df: DataFrame) -> None:
        """Limited-memory BFGS; the last rows by date validate.

        Training stops when they stop improving and returns to the best weights. A pass sends one packed row of sums
        per task; beyond ``DRIVER_SUMS`` tasks these are added in groups, so that the driver takes as many as the
        square root of the tasks.
        """
        p, seed = self.params, int(self.params["random_state"])
        z = self.scaled(df)
        by_date = [F.col(c) for c in ("Date", "Symbol") if c in df.columns]
        order = [*by_date, F.xxhash64(F.lit(seed), z), z]
        # numbered rows are materialised, so dropped units and validation rows stay the same
        numbered = cut_lineage(number_in_order(df.select(z.alias("z"), *df.columns), order, "_nth").select("z", "_nth"))
        size = numbered.count()
        train_rows = size - math.floor(size * float(p["validation_split"]))
        data = numbered.select("z", F.xxhash64(F.lit(seed), "_nth").alias("key"), (F.col("_nth") > train_rows).alias("held_out"))
        sizes = layer_sizes(len(self.feature_columns), p["hidden_layers"], int(p["encoding_dim"] or 10))
        dropped = [i for i in range(len(sizes) - 2) if i != len(p["hidden_layers"])]  # all but the code layer
        drop = float(p["dropout_rate"])

        def evaluate(weights: np.ndarray) -> tuple[float, np.ndarray, float]:
            """Training loss, its gradient and the validation loss, of one pass."""
            sums = summed(data, partial_sums(weights, sizes, dropped if drop else [], drop), len(weights) + 4)
            loss, rows, held_loss, held_rows = sums[:4]
            return loss / max(rows, 1), sums[4:] / max(rows, 1), held_loss / held_rows if held_rows else math.nan

        best = minimise(evaluate, initial_weights(sizes, seed), int(p["epochs"]), float(p["learning_rate"]), int(p["patience"]))
        self.state["layers"] = {"sizes": sizes, "weights": best.tolist()}

    def raw_scores(self, df: DataFrame) -> DataFrame:
        if "components" in self.state:
            basis = np.array(self.state["components"])
            rebuild = lambda z: z @ basis @ basis.T
        else:
            sizes, weights = self.state["layers"]["sizes"], np.array(self.state["layers"]["weights"])
            rebuild = lambda z: forward(z, unpack(weights, sizes))[-1]

        @F.pandas_udf("double")
        def error(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            z = np.stack(x.to_numpy())
            return pd.Series(np.mean((z - rebuild(z)) ** 2, axis=1))

        return df.withColumn(RAW, error(self.scaled(df)))


def layer_sizes(inputs: int, hidden: list[int], code: int) -> list[int]:
    return [inputs, *hidden, code, *reversed(hidden), inputs]


def initial_weights(sizes: list[int], seed: int) -> np.ndarray:
    """Glorot-uniform matrices and zero biases, as one vector."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes, sizes[1:]):
        bound = math.sqrt(6 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
    return np.concatenate(parts)


def unpack(weights: np.ndarray, sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        layers.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return layers


def forward(x: np.ndarray, layers: list, masks: dict[int, np.ndarray] | None = None) -> list[np.ndarray]:
    """Activations of all layers: relu inside, linear at the end."""
    values = [x]
    for i, (matrix, bias) in enumerate(layers):
        y = values[-1] @ matrix + bias
        if i < len(layers) - 1:
            y = np.maximum(y, 0)
            if masks and i in masks:
                y = y * masks[i]
        values.append(y)
    return values


def gradient(x: np.ndarray, layers: list, masks: dict[int, np.ndarray]) -> np.ndarray:
    values = forward(x, layers, masks)
    slope = 2 * (values[-1] - x) / x.size
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(values[i].T @ slope).ravel(), slope.sum(axis=0), *parts]
        if i:
            slope = slope @ layers[i][0].T
            if i - 1 in masks:
                slope = slope * masks[i - 1]
            slope = slope * (values[i] > 0)
    return np.concatenate(parts)


def unit_masks(keys: np.ndarray, sizes: list[int], layers: list[int], drop: float) -> dict[int, np.ndarray]:
    """Which units of a row stay, scaled so that sums keep their size: a hash of the row's key and the unit."""
    masks = {}
    for i in layers:
        unit = np.arange(sizes[i + 1], dtype=np.uint64) + np.uint64(i << 32)
        mixed = (keys.astype(np.uint64)[:, None] ^ (unit[None, :] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        masks[i] = ((mixed >> np.uint64(11)) * 2.0**-53 >= drop) / (1 - drop)
    return masks


def partial_sums(weights: np.ndarray, sizes: list[int], dropped: list[int], drop: float) -> Callable:
    """One packed row per task: loss and rows of training, of validation, then the gradient; all are sums over rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, total = unpack(weights, sizes), np.zeros(len(weights) + 4)
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            x = z[~held]
            if len(x):
                masks = unit_masks(keys[~held], sizes, dropped, drop)
                total[0] += ((forward(x, layers, masks)[-1] - x) ** 2).mean(axis=1).sum()
                total[1] += len(x)
                total[4:] += gradient(x, layers, masks) * len(x)
            y = z[held]
            if len(y):
                total[2] += ((forward(y, layers)[-1] - y) ** 2).mean(axis=1).sum()
                total[3] += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def summed(data: DataFrame, task: Callable, width: int) -> np.ndarray:
    """The packed rows of all tasks added up."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for row in batch.column("sums").to_pylist():
                total += row
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    rows = data.mapInArrow(task, "sums array<double>")
    tasks = data.rdd.getNumPartitions()
    if tasks > DRIVER_SUMS:
        rows = rows.repartition(math.isqrt(tasks)).mapInArrow(add, "sums array<double>")
    return np.sum([r["sums"] for r in rows.collect()], axis=0)


def minimise(evaluate: Callable, weights: np.ndarray, passes: int, first: float, patience: int) -> np.ndarray:
    """Limited-memory BFGS with steps halved until they lower the loss (Nocedal and Wright, chapter 7).

    ``evaluate`` gives loss, gradient and validation loss (NaN without validation rows). At most ``passes`` evaluations
    follow the first one. The weights of the least validation loss come back, or the last ones without it.
    """
    loss, slope, held = evaluate(weights)
    best, best_held, waited, pairs = weights, held, 0, []
    while passes > 0 and waited < patience:
        direction = -curved(slope, pairs)
        steep = float(direction @ slope)
        if not steep < 0:
            break
        step = 1.0 if pairs else first / max(float(np.abs(direction).max()), 1e-300)
        for _ in range(HALVINGS):
            passes -= 1
            tried = weights + step * direction
            new_loss, new_slope, held = evaluate(tried)
            if new_loss <= loss + 1e-4 * step * steep or passes <= 0:
                break
            step /= 2
        if not new_loss < loss:
            break
        moved, turned = tried - weights, new_slope - slope
        if moved @ turned > 1e-12 * (turned @ turned):
            pairs = [*pairs, (moved, turned)][-MEMORY:]
        weights, loss, slope = tried, new_loss, new_slope
        if math.isnan(held) or held < best_held:
            best, best_held, waited = weights, held, 0
        else:
            waited += 1
    return best


def curved(slope: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse curvature that the last steps show."""
    q, shares = slope.copy(), []
    for moved, turned in reversed(pairs):
        share = (moved @ q) / (moved @ turned)
        q -= share * turned
        shares.append(share)
    if pairs:
        moved, turned = pairs[-1]
        q *= (moved @ turned) / (turned @ turned)
    for (moved, turned), share in zip(pairs, reversed(shares)):
        q += moved * (share - (turned @ q) / (moved @ turned))
    return q
