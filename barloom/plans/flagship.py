"""Bars, features, isolation forest and ranked report in one flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.detectors.factory import create_detector
from barloom.operators.explain import anomaly_table
from barloom.plans.catalog import STATIONARY, with_returns


def flagship(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    bars = with_returns(spark, sf_dir)
    forest = create_detector("isolation_forest", contamination=0.05)
    return anomaly_table(forest.fit(bars, STATIONARY).predict(bars), STATIONARY, k)
