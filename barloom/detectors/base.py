"""What all detectors share: the contract, scaling, the contamination cut, storage."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import name, not_nan, numeric_columns
from barloom.operators.quantiles import exact_quantiles
from barloom.session import cut_lineage

RAW = "_raw_score"


class Detector:
    """``fit`` learns from a table, ``predict`` adds ``anomaly_score`` and ``is_anomaly``.

    Scores run from 0 to 1, 1 being most anomalous.
    """

    kind: ClassVar[str] = ""
    defaults: ClassVar[dict[str, Any]] = {}

    def __init__(self, **params: Any):
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise ValueError(f"unknown parameters for {self.kind}: {sorted(unknown)}")
        self.params = {**self.defaults, **params}
        if self.params.get("contamination") == "auto":
            self.params["contamination"] = None
        self.feature_columns: list[str] = []
        self.state: dict[str, Any] = {}
        self.size = 0
        self.fitted = False

    # what a detector provides
    def learn(self, df: DataFrame) -> None:
        raise NotImplementedError

    def raw_scores(self, df: DataFrame) -> DataFrame:
        """Add ``_raw_score``, higher meaning more anomalous; ``df`` has no null features."""
        raise NotImplementedError

    def tables(self) -> dict[str, DataFrame]:
        return {}

    def restore(self, tables: dict[str, DataFrame]) -> None:
        pass

    # the contract
    def fit(self, df: DataFrame, feature_columns: Sequence[str] | None = None) -> Detector:
        columns = list(feature_columns) if feature_columns is not None else numeric_columns(df)
        if not columns:
            raise ValueError("no feature columns")
        self.check_columns(df, columns)
        usable = df.na.drop(subset=columns)
        self.feature_columns = columns
        self.size, self.state["means"] = self.size_and_means(usable)
        if not self.size:
            raise ValueError("no rows without nulls in the features: nothing to fit on")
        self.learn(usable)
        self.fitted = True
        return self

    def predict(self, df: DataFrame, impute: str = "batch") -> DataFrame:
        """Score a table; scores are scaled over it. ``impute="train"`` fills nulls with training means.

        The raw scores are stored before the range is taken, so each row is scored once.
        """
        self.check_ready(df)
        size, means = self.size_and_means(df)
        if not size:
            raise ValueError("cannot predict on an empty table")
        if impute == "train":
            means = self.state["means"]
        scored = cut_lineage(self.raw_scores(self.complete(df, means)))
        low, high = scored.agg(F.min(RAW), F.max(RAW)).first()
        return self.finish(scored, low, high)

    def predict_stream(self, df: DataFrame) -> DataFrame:
        """Score rows independently: training means fill nulls, the training range scales."""
        self.check_ready(df)
        scored = self.raw_scores(self.complete(df, self.state["means"]))
        low, high = self.state["range"]
        return self.finish(scored, low, high)

    def score_batch(self, df: DataFrame) -> DataFrame:
        """``predict_stream`` for one batch of a stream, for any detector: a batch is a table, so it can be joined."""
        self.check_ready(df)
        scored = cut_lineage(self.raw_scores(self.complete(df, self.state["means"])))
        return self.finish(scored, *self.state["range"])

    def finish(self, scored: DataFrame, low: float, high: float) -> DataFrame:
        flagged = self.is_flagged(F.col(RAW)).cast("int")
        return scored.withColumns(
            {"anomaly_score": minmax(F.col(RAW), low, high), "is_anomaly": flagged}
        ).drop(RAW, *[hidden(c) for c in self.feature_columns])

    def is_flagged(self, raw: Column) -> Column:
        return raw > F.lit(float(self.state["threshold"]))

    # helpers
    def check_columns(self, df: DataFrame, columns: Sequence[str]) -> None:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"feature columns not found: {missing}")

    def check_ready(self, df: DataFrame) -> None:
        if not self.fitted:
            raise ValueError("the detector has not been fitted")
        self.check_columns(df, self.feature_columns)

    def size_and_means(self, df: DataFrame) -> tuple[int, list[float]]:
        """Row count and feature means (0 for a feature without values) in one pass."""
        row = df.agg(F.count(F.lit(1)), *[F.avg(not_nan(name(c))) for c in self.feature_columns]).first()
        return row[0], [float(m) if m is not None else 0.0 for m in row[1:]]

    def complete(self, df: DataFrame, means: Sequence[float]) -> DataFrame:
        """Hidden copies of the features with nulls filled; the shown columns stay as they are."""
        return df.withColumns(
            {hidden(c): F.coalesce(not_nan(name(c)), F.lit(m)) for c, m in zip(self.feature_columns, means)}
        )

    def vector(self, df: DataFrame) -> Column:
        columns = [hidden(c) if hidden(c) in df.columns else c for c in self.feature_columns]
        return F.array(*[name(c).cast("double") for c in columns])

    def note_training_scores(self, scored: DataFrame, contamination: float | None, default: float | None) -> None:
        """Remember the range of the training scores and the cut: a fixed one or a quantile."""
        low, high = scored.agg(F.min(RAW), F.max(RAW)).first()
        self.state["range"] = [float(low), float(high)]
        if contamination is None:
            self.state["threshold"] = default
        else:
            self.state["threshold"] = contamination_cut(scored, RAW, contamination)

    def save(self, path: str, spark: SparkSession) -> str:
        """A folder of parquet tables and one row of JSON; nothing is pickled."""
        if not self.fitted:
            raise ValueError("the detector has not been fitted")
        about = {"kind": self.kind, "params": self.params, "features": self.feature_columns, "state": self.state}
        tables = self.tables()
        about["tables"] = sorted(tables)
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.parquet(f"{path}/about")
        for table, df in tables.items():
            df.write.parquet(f"{path}/{table}")
        return path


def hidden(column: str) -> str:
    return "_f_" + column


def minmax(value: Column, low: float | None, high: float | None) -> Column:
    """Scale to 0..1; 0 throughout when there is no range. Values outside it are clipped."""
    if low is None or high is None or not high > low or math.isnan(high - low):
        return F.when(value.isNotNull(), 0.0)
    scaled = (value - F.lit(float(low))) / F.lit(float(high) - float(low))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))


def minmax_score(df: DataFrame, column: str, out: str = "anomaly_score") -> DataFrame:
    """Scale a column over the whole table."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return df.withColumn(out, minmax(F.col(column), low, high))


def contamination_cut(df: DataFrame, column: str, contamination: float, approx: bool = False) -> float:
    """The value above which the given share of rows lies (linear quantile)."""
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")
    if approx:
        return float(df.agg(F.percentile_approx(column, 1 - contamination, 10_000)).first()[0])
    return float(exact_quantiles(df, [column], [1 - contamination]).first()["quantiles"][0])


def standardise(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """``(x - mean) / population std`` with the moments of ``fitted_on``; a constant divides by 1."""
    means, spreads = moments(fitted_on if fitted_on is not None else df, columns)
    return df.withColumns(
        {c: (name(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(columns, means, spreads)}
    )


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[list[float], list[float]]:
    values = [not_nan(name(c)) for c in columns]
    row = df.agg(*[F.avg(v) for v in values], *[F.stddev_pop(v) for v in values], *[F.min(v) < F.max(v) for v in values]).first()
    d = len(columns)
    means = [float(m) if m is not None else 0.0 for m in row[:d]]
    spreads = [float(s) if varies and s else 1.0 for s, varies in zip(row[d : 2 * d], row[2 * d :])]
    return means, spreads
