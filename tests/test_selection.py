"""Selection by rank instead of sorting: quantiles, splits, labels and percentile ranks."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import evaluate, explain, quantiles
from barloom.plans import catalog

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), 1.0, np.nextafter(1, 0), np.nextafter(1, 2), 8.0, np.nextafter(8, 0), 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 1 / 3, -2.5]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_codes_are_the_bits_of_doubles(spark):
    rng = np.random.default_rng(2)
    values = EDGES + [float(x) for x in rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500)] + [2.0**n for n in range(-1074, 1024, 7)]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", quantiles.order_code(F.col("v")).alias("c")).collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["c"] == (-bits if r["v"] < 0 else bits), r["v"]


@pytest.mark.parametrize("limit", [20, 300])
def test_quantiles_of_heavy_zeros_end_in_four_rounds(spark, tiny_tasks, monkeypatch, limit):
    rng = np.random.default_rng(1)
    parts = {"zeros": np.where(rng.random(4000) < 0.9, 0.0, rng.normal(size=4000)), "close": 1 + rng.integers(0, 2000, 4000) * 2.0**-52, "edges": np.array([x for x in EDGES if np.isfinite(x)] * 40)}
    pdf = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in parts.items()])
    tiny_tasks(limit)
    rounds = []
    real = quantiles.within
    monkeypatch.setattr(quantiles, "within", lambda *a: rounds.append(a[-1]) or real(*a))
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", 0 if limit == 20 else 1000)
    probabilities = [0, 0.05, 0.5, 0.95, 1]
    out = quantiles.exact_quantiles(spark.createDataFrame(pdf).repartition(5), ["v"], probabilities, ["g"])
    assert len(rounds) <= 5 and "percentile_approx" not in plan(out)
    for r in out.collect():
        # the mean of two huge values overflows in numpy's formula as in ours, so compare what is finite
        expect = np.quantile(parts[r["g"]], probabilities)
        assert np.allclose(r["quantiles"], expect, rtol=1e-15, atol=0), r["g"]


@pytest.mark.parametrize("limit", [30, 100_000])
def test_split_and_labels_without_a_global_sort(spark, tiny_tasks, limit):
    pdf = pd.DataFrame({"Symbol": [f"s{i % 90:02}" for i in range(900)], "Date": pd.Timestamp("2024-01-01") + pd.to_timedelta([i // 90 for i in range(900)], unit="D")})
    df = spark.createDataFrame(pdf).repartition(6)
    tiny_tasks(limit)
    split = evaluate.with_split(df, 0.73)
    if limit > 900:
        assert "SinglePartition" not in plan(split)
    got = split.toPandas().sort_values(["Date", "Symbol"])["part"].tolist()
    assert got == ["train"] * 657 + ["test"] * 243
    first, rest = evaluate.chronological_split(df, 0.5)
    assert first.count() == 450 and rest.agg(F.min("Date")).first()[0] == pd.Timestamp("2024-01-06")
    labelled = evaluate.synthetic_labels(df, 0.1)
    once = {(r["Symbol"], r["Date"]) for r in labelled.where("label = 1").collect()}
    again = {(r["Symbol"], r["Date"]) for r in evaluate.synthetic_labels(df.repartition(2), 0.1).where("label = 1").collect()}
    assert len(once) == 90 and once == again
    assert evaluate.with_split(df, 0.0).where("part = 'train'").count() == 0 and evaluate.with_split(df, 1.0).where("part = 'test'").count() == 0
    by_name = evaluate.with_split(df, 0.5, order=("Symbol", "Date"))
    assert by_name.where("part = 'train'").agg(F.max("Symbol")).first()[0] == "s44"


def test_splits_with_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (None, "b", 2.0), (3, "c", None), (4, "d", 4.0)], "Date int, Symbol string, v double")
    first, _ = evaluate.chronological_split(df, 0.5)
    assert sorted(r["Symbol"] for r in first.collect()) == ["a", "b"]
    assert [r["Symbol"] for r in evaluate.chronological_split(df, 0.25, order=("v",))[0].collect()] == ["c"]
    assert evaluate.with_split(df.limit(0)).count() == 0 and evaluate.synthetic_labels(df.limit(0), key=("Symbol",)).count() == 0


def test_a_configuration_votes_once_per_key(spark):
    one = spark.createDataFrame([("a", 1, 1), ("a", 1, 1), ("a", 2, 0)], "Symbol string, Date int, is_anomaly int")
    got = {r["flagged_by"]: r["n_rows"] for r in evaluate.agreement({"x": one, "y": one.limit(1)}).collect()}
    assert got == {2: 1, 0: 1}


def test_explains_any_number_of_rows(spark):
    rows = spark.range(60_000).select(F.lit("A").alias("Symbol"), F.col("id").alias("Date"), (F.col("id") % 997).cast("double").alias("Close"), (F.col("id") % 3 == 0).cast("int").alias("is_anomaly"), (F.col("id") / 60_000).alias("anomaly_score"))
    told = explain.explain_top(rows, ["Close"], None)
    got = told.select("Close", F.col("reasons")[0]["code"].alias("code"), F.col("reasons")[0]["value"].alias("value")).toPandas()
    assert len(got) == 20_000
    closes = pd.Series(np.arange(60_000) % 997.0)
    ranks = closes.rank(method="average", pct=True).groupby(closes).first() * 100
    expect = ranks.loc[got["Close"]].to_numpy()
    high, low = expect > 95, expect < 5
    assert (got["code"] == np.select([high, low], ["price_high", "price_low"], "pattern")).all()
    assert np.allclose(got["value"][high], 100 - expect[high]) and np.allclose(got["value"][low], expect[low])


def test_registered_split_has_no_single_task(spark, sf_dir):
    assert "SinglePartition" not in plan(catalog.chrono_split(spark, sf_dir))
