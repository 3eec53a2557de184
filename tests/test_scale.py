"""Split series give the same results as whole ones, and plans stay as intended."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import cleaning, evaluate, explain, features, layout, quantiles
from barloom.operators.layout import BLOCK, merge_blocks
from barloom.plans import catalog
from barloom.plans.pipeline import process

SORT = ["Symbol", "Date"]


@pytest.fixture(scope="module")
def series(spark):
    """A hot symbol of 1,500 rows, a small one, a two-row one and one without values; gaps anywhere."""
    rng = np.random.default_rng(1)
    parts = []
    for symbol, n in (("hot", 1500), ("small", 40), ("two", 2), ("empty", 30)):
        # uneven times: a burst holds most rows
        steps = np.where(rng.random(n) < 0.9, 1, 5000) + rng.integers(0, 3, n)
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        frame = pd.DataFrame(
            {
                "Symbol": symbol,
                "Date": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(steps), unit="s"),
                "Open": close + 1, "High": close + 2, "Low": close - 2, "Close": close,
                "Volume": rng.integers(1, 50, n).astype(float),
            }
        )
        frame.loc[rng.random(n) < 0.2, "Close"] = np.nan
        if symbol == "hot":
            frame.loc[300:700, "Volume"] = np.nan  # a gap longer than a block
        if symbol == "empty":
            frame[["Open", "High", "Low", "Close", "Volume"]] = np.nan
        parts.append(frame)
    pdf = pd.concat(parts).astype(object).where(lambda d: d.notna(), None)
    schema = "Symbol string, Date timestamp, Open double, High double, Low double, Close double, Volume double"
    return spark.createDataFrame(pdf, schema).repartition(5).cache()


def sorted_frame(df):
    return merge_blocks(df).toPandas().sort_values(SORT).reset_index(drop=True)


OPERATORS = {
    **{m: (lambda m: lambda d: cleaning.fill(d, method=m))(m) for m in cleaning.FILLS},
    "cap": cleaning.cap_outliers,
    "price": features.price_features,
    "volume": features.volume_features,
    "volatility": features.volatility_features,
    "technical": lambda d: features.technical_features(cleaning.fill(d)),
    "macd with gaps": features.macd,
    "ema with gaps": lambda d: features.ema(d, "Close", 40, "E"),
    "all with gaps": lambda d: features.engineer(d, drop_incomplete=False),
    "eda": features.eda_features,
    "evaluation": features.evaluation_features,
    "change": explain.with_change,
    "position": lambda d: layout.with_position(layout.lay_out(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_split_equals_whole(series, tiny_tasks, name):
    run = OPERATORS[name]
    whole = run(series)
    assert BLOCK not in whole.columns
    expected = sorted_frame(whole)
    tiny_tasks(120)
    split = run(series)
    assert BLOCK in split.columns
    got = sorted_frame(split)
    pd.testing.assert_frame_equal(got[expected.columns], expected, rtol=1e-9, atol=1e-9)


def test_blocks_are_balanced(series, tiny_tasks):
    tiny_tasks(120)
    sizes = layout.lay_out(series).groupBy(BLOCK).count().toPandas()["count"]
    assert sizes.max() <= 3 * 120 and len(sizes) >= 8


def test_pipeline_split_equals_whole(series, tiny_tasks):
    doubled = series.withColumn("_row", F.lit(0)).unionByName(
        series.withColumn("Close", F.col("Close") + 1).withColumn("_row", F.lit(1))
    )
    expected = sorted_frame(process(doubled))
    tiny_tasks(200)
    got = sorted_frame(process(doubled))
    assert len(expected) > 1000
    pd.testing.assert_frame_equal(got[expected.columns], expected, rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("limit", [50, 400])
def test_quantiles_by_narrowing(spark, tiny_tasks, limit):
    rng = np.random.default_rng(3)
    heavy = np.concatenate([rng.lognormal(0, 6, 1500), np.full(900, 7.0), [-1e300, 1e300]])
    pdf = pd.DataFrame({"g": "a", "v": heavy, "u": np.arange(len(heavy)) % 3.0})
    pdf = pd.concat([pdf, pd.DataFrame({"g": "b", "v": rng.normal(size=20), "u": 1.0})])
    probabilities = [0, 0.01, 0.25, 0.5, 0.95, 1]
    tiny_tasks(limit)
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf).repartition(7), ["v", "u"], probabilities, ["g"])
    rows = got.collect()
    assert len(rows) == 4
    for r in rows:
        values = pdf.loc[pdf.g == r["g"], r["column"]]
        assert r["n"] == len(values)
        assert np.allclose(r["quantiles"], np.quantile(values, probabilities), rtol=1e-12)


def test_quantiles_from_brackets_need_no_radix_passes(spark, tiny_tasks, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.lognormal(0, 4, 30_000), "b": rng.integers(0, 5, 30_000).astype(float)})
    pdf.loc[::7, "b"] = np.nan
    tiny_tasks(3000)

    def unused(*_):
        raise AssertionError("radix passes over the whole table")

    monkeypatch.setattr(quantiles, "order_statistics", unused)
    got = quantiles.exact_quantiles(spark.createDataFrame(pdf).repartition(6), ["a", "b"], [0.25, 0.5, 0.99])
    for r in got.collect():
        assert np.allclose(r["quantiles"], np.quantile(pdf[r["column"]].dropna(), [0.25, 0.5, 0.99]), rtol=1e-12)


def test_quantiles_that_brackets_miss(spark, tiny_tasks, monkeypatch):
    pdf = pd.DataFrame({"a": np.random.default_rng(6).normal(size=5000)})
    tiny_tasks(300)
    exact = quantiles.bracketed
    monkeypatch.setattr(quantiles, "bracketed", lambda *given: exact(*given).filter("rank % 2 = 0"))
    row = quantiles.exact_quantiles(spark.createDataFrame(pdf).repartition(6), ["a"], [0.1, 0.5, 0.9]).first()
    assert np.allclose(row["quantiles"], np.quantile(pdf["a"], [0.1, 0.5, 0.9]), rtol=1e-12)


def test_numbering_over_parts(spark, tiny_tasks):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    tiny_tasks(100)
    rows = evaluate.number_in_order(df, [F.col("v")]).collect()
    assert all(r["_nth"] == r["v"] + 1 for r in rows)


def test_equal_keys_spread_over_parts(spark, tiny_tasks):
    df = spark.range(900).select((F.col("id") % 3 == 0).cast("int").alias("v"), "id")
    tiny_tasks(100)
    numbered = evaluate.number_in_order(df, [F.col("v")])
    rows = numbered.toPandas().sort_values("_nth")
    assert rows["_nth"].tolist() == list(range(1, 901)) and rows["v"].is_monotonic_increasing


def test_one_date_spreads_over_blocks(spark, tiny_tasks):
    df = spark.range(1000).selectExpr("'A' AS Symbol", "timestamp'2024-01-01' AS Date", "CAST(id AS double) AS Close")
    tiny_tasks(100)
    assert layout.lay_out(df).groupBy(BLOCK).count().agg(F.max("count")).first()[0] <= 300


def test_gap_patterns_split(spark, tiny_tasks):
    days = [0, 1, 1, 2, 10, 11, 30, 31, 32, 33, 60]
    pdf = pd.DataFrame({"Date": pd.Timestamp("2024-01-01") + pd.to_timedelta(days, unit="D"), "is_anomaly": 1})
    df = spark.createDataFrame(pdf)
    expected = (len(days), 6, 7, 4)
    assert tuple(explain.gap_patterns(df).first()) == expected
    tiny_tasks(3)
    assert tuple(explain.gap_patterns(df).first()) == expected


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return sum("Exchange " in line for line in plan(df).splitlines())


def test_engineer_adds_one_exchange(spark, sf_dir):
    bars = catalog.daily(spark, sf_dir)
    assert exchanges(bars) == 1
    assert exchanges(features.engineer(cleaning.clean(bars))) == 2


def test_bars_aggregate_by_hash_and_prune(spark, sf_dir):
    for bars in (catalog.daily(spark, sf_dir), catalog.hourly(spark, sf_dir), catalog.wide(spark, sf_dir)):
        text = plan(bars)
        assert "HashAggregate" in text and "SortAggregate" not in text
        assert "partial_min_by" in text
    text = plan(catalog.daily(spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text


def test_date_range_reaches_the_scan(spark, sf_dir):
    from barloom.sources.readers import date_range

    orders = catalog.table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "Date")
    text = plan(date_range(orders, "1996-01-01", "1997-01-01"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_copies_are_limited_before_the_shuffle(spark, sf_dir):
    events = catalog.table(spark, sf_dir, "events").selectExpr("event_type AS Symbol", "ts AS Date", "event_id AS _row")
    text = plan(cleaning.dedupe_first(events))
    assert text.rindex("WindowGroupLimit") > text.index("Exchange hashpartitioning")


def test_no_window_without_partition(spark, sf_dir):
    text = plan(process(catalog.dirty(spark, sf_dir)))
    assert "SinglePartition" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_process_reads_the_source_once(spark, sf_dir):
    """Bars are stored before their series are counted: nothing after it aggregates the source again."""
    made = process(catalog.wide(spark, sf_dir))
    assert "FileScan" not in made._jdf.queryExecution().executedPlan().toString()
