"""Detectors by name, and from a folder they were saved to."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from barloom.detectors.base import Detector
from barloom.detectors.iforest import IsolationForest
from barloom.detectors.lof import LocalOutlierFactor
from barloom.detectors.recon import Autoencoder
from barloom.operators.evaluate import agreement, compare

KINDS: dict[str, type[Detector]] = {d.kind: d for d in (IsolationForest, LocalOutlierFactor, Autoencoder)}


def create_detector(kind: str, **params: Any) -> Detector:
    if kind not in KINDS:
        raise ValueError(f"unknown detector {kind!r}, choose from {', '.join(KINDS)}")
    return KINDS[kind](**params)


def load_detector(spark: SparkSession, path: str) -> Detector:
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    detector = create_detector(about["kind"], **about["params"])
    detector.feature_columns, detector.state = about["features"], about["state"]
    detector.restore({table: spark.read.parquet(f"{path}/{table}") for table in about["tables"]})
    detector.fitted = True
    return detector


def compare_configurations(
    df: DataFrame, kind: str, configurations: dict[str, dict[str, Any]], features: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Flagged counts per configuration, and how many configurations flag the same rows."""
    scored = {name: create_detector(kind, **p).fit(df, features).predict(df) for name, p in configurations.items()}
    return compare(scored), agreement(scored)
