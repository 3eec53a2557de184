"""Ready-made flows: clean and engineer, analyse a file, compare detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.detectors.base import standardise
from barloom.detectors.factory import create_detector
from barloom.functions.columns import numeric_columns
from barloom.operators.cleaning import auto_clean, clean
from barloom.operators.evaluate import metrics, synthetic_labels, with_split
from barloom.operators.features import drop_missing, engineer, evaluation_features
from barloom.operators.layout import max_rows, merge_blocks
from barloom.session import cut_lineage
from barloom.sources.readers import load_bars


def process(df: DataFrame, method: str = "ffill", engineer_features: bool = True) -> DataFrame:
    """Canonical bars to a feature table. One pass first says how the series are to be laid out.

    The bars are stored for it, so that what they are made of is read and aggregated once.
    """
    df = cut_lineage(df)
    volume = F.count("Volume") if "Volume" in df.columns else F.lit(0)
    per_symbol = df.groupBy("Symbol").agg(F.count(F.lit(1)).alias("rows"), volume.alias("volumes"))
    longest, volumes = per_symbol.agg(F.max("rows"), F.sum("volumes")).first()
    cleaned = clean(df, method, fits=(longest or 0) <= max_rows(df.sparkSession))
    if engineer_features:
        # these fills leave missing values at the ends of a series, the others none but in empty ones
        cleaned = engineer(cleaned, with_volume=bool(volumes), gaps=method in ("pad", "back"))
    return merge_blocks(cleaned)


def analyze(
    spark: SparkSession, path: str, fmt: str | None = None, contamination: float = 0.1, symbol: str | None = None
) -> DataFrame:
    """Load a file, fill its gaps and flag rows with an isolation forest over all numeric columns."""
    bars = load_bars(spark, path, fmt=fmt, require="close", symbol=symbol)
    filled = cut_lineage(merge_blocks(auto_clean(bars)).drop("_row"))
    # a column that is null throughout says nothing and would leave no rows to learn from
    counts = filled.agg(*[F.count(c).alias(c) for c in numeric_columns(filled)]).first().asDict()
    features = [c for c, n in counts.items() if n]
    forest = create_detector("isolation_forest", n_estimators=100, contamination=contamination)
    return forest.fit(filled, features).predict(filled)


def bake_off(df: DataFrame, contamination: float = 0.02, train: float = 0.8, epochs: int = 20, seed: int = 42) -> DataFrame:
    """Precision, recall, F1 and flagged share of the three detectors on the last rows by date.

    Without a ``label`` column seeded pseudo-random labels stand in, which only
    exercises the metrics.
    """
    featured = drop_missing(merge_blocks(evaluation_features(df)))
    features = numeric_columns(featured, exclude=("label",))
    parts = cut_lineage(with_split(featured, train))
    scaled = cut_lineage(standardise(parts, features, fitted_on=parts.filter(F.col("part") == "train")))
    learn, test = (scaled.filter(F.col("part") == p).drop("part") for p in ("train", "test"))
    if "label" not in test.columns:
        test = cut_lineage(synthetic_labels(test, contamination, seed))
    detectors = {
        "IsolationForest": create_detector("isolation_forest", contamination=contamination, random_state=seed),
        "LocalOutlierFactor": create_detector("lof", n_neighbors=20, novelty=True, contamination=contamination),
        "Autoencoder": create_detector(
            "autoencoder", hidden_layers=[16, 8], encoding_dim=4, dropout_rate=0.0, epochs=epochs,
            patience=epochs, contamination=contamination, random_state=seed,
        ),
    }
    results = [
        detector.fit(learn, features).predict(test).select(
            F.lit(model).alias("model"), F.col("is_anomaly").alias("predicted"), "label"
        )
        for model, detector in detectors.items()
    ]
    return metrics(results[0].unionByName(results[1]).unionByName(results[2]))
