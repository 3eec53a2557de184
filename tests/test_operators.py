"""Hand-computed cases on small frames."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import to_number, to_timestamp
from barloom.operators import cleaning, evaluate, explain, features, profile, quality
from barloom.sources import mapping, readers, sinks
from barloom.sources.bars import rebucket, to_bars


def bars(spark, closes, symbol="A", volumes=None, start="2024-01-01"):
    n = len(closes)
    day = dt.datetime.fromisoformat(start)
    volumes = volumes or [float(10 + i) for i in range(n)]
    rows = [
        (symbol, day + dt.timedelta(days=i), c, (c or 0) + 1.0, (c or 0) - 1.0, c, v)
        for i, (c, v) in enumerate(zip(closes, volumes))
    ]
    schema = "Symbol string, Date timestamp, Open double, High double, Low double, Close double, Volume double"
    return spark.createDataFrame(rows, schema)


def column(df, name):
    return [r[name] for r in df.orderBy("Symbol", "Date").collect()]


def test_fills(spark):
    df = bars(spark, [None, 2.0, None, None, 8.0, None])
    got = {m: column(cleaning.fill(df, ["Close"], m), "Close") for m in cleaning.FILLS}
    assert got["ffill"] == [2, 2, 2, 2, 8, 8]
    assert got["bfill"] == [2, 2, 8, 8, 8, 8]
    assert got["interpolate"] == [2, 2, 4, 6, 8, 8]
    assert got["mean"] == [5, 2, 5, 5, 8, 5]
    assert got["pad"] == [None, 2, 2, 2, 8, 8]
    assert got["back"] == [2, 2, 8, 8, 8, None]
    with pytest.raises(ValueError):
        cleaning.fill(df, ["Close"], "guess")


def test_fill_stays_within_a_symbol(spark):
    df = bars(spark, [1.0, None]).unionByName(bars(spark, [None, 5.0], "B"))
    assert column(cleaning.fill(df, ["Close"]), "Close") == [1, 1, 5, 5]


def test_dedupe_keeps_the_first(spark):
    df = bars(spark, [1.0]).withColumn("_row", F.lit(2)).unionByName(bars(spark, [9.0]).withColumn("_row", F.lit(1)))
    assert column(cleaning.dedupe_first(df), "Close") == [9]


def test_cap_keeps_rows_and_nulls(spark):
    df = bars(spark, [1.0, 2.0, 3.0, 4.0, None, 100.0])
    # quartiles of 1 2 3 4 100 are 2 and 4
    assert column(cleaning.cap_outliers(df, ["Close"]), "Close") == [1, 2, 3, 4, None, 7]
    assert column(cleaning.cap_outliers(df, ["Close"], approx=True), "Close")[-1] == 7


def test_warm_up_is_nineteen_rows(spark):
    closes = [100 + (i * 7 % 11) + i * 0.1 for i in range(40)]
    df = bars(spark, closes, volumes=[float(5 + i * i % 13) for i in range(40)])
    assert features.engineer(df).count() == 40 - 19


def test_missing_volume_keeps_the_table(spark):
    df = bars(spark, [100 + (i * 7 % 11) + 0.5 for i in range(40)]).withColumn("Volume", F.lit(None).cast("double"))
    made = features.engineer(df)
    assert made.count() == 21 and "Volume_Change" not in made.columns


def test_rsi_edges(spark):
    assert column(features.rsi(bars(spark, [float(i) for i in range(1, 31)])), "RSI") == [None] * 13 + [100.0] * 17
    assert column(features.rsi(bars(spark, [5.0] * 30)), "RSI") == [None] * 30


def test_constant_window_has_no_correlation(spark):
    df = bars(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], volumes=[3.0] * 6)
    assert column(features.volume_features(df), "Price_Volume_Corr") == [None] * 6
    df = bars(spark, [1.0, 2.0, 3.0, 4.0, 5.0], volumes=[2.0, 4.0, 6.0, 8.0, 10.0])
    assert column(features.volume_features(df), "Price_Volume_Corr")[-1] == pytest.approx(1)


def test_zero_close_gives_null_not_infinity(spark):
    df = features.price_features(bars(spark, [1.0, 0.0, 2.0]))
    assert column(df, "Daily_Return") == [None, -1.0, None]
    assert column(df, "Log_Return") == [None, None, None]


def test_true_range_is_null_first(spark):
    assert column(features.volatility_features(bars(spark, [10.0, 20.0])), "TR") == [None, 11.0]


@pytest.mark.parametrize("span", [1, 2, 9, 26, 200])
def test_ema_matches_recursion(spark, span):
    rng = np.random.default_rng(span)
    closes = (100 + np.cumsum(rng.normal(0, 1, 2500))).tolist()
    expected = pd.Series(closes).ewm(span=span, adjust=False).mean()
    got = column(features.ema(bars(spark, closes), "Close", span, "E"), "E")
    assert np.allclose(got, expected, rtol=1e-12)


@pytest.mark.parametrize("span", [1, 2, 9, 26, 200])
@pytest.mark.parametrize("missing", [0.05, 0.5, 0.98])
def test_ema_passes_gaps_as_pandas_does(spark, span, missing):
    rng = np.random.default_rng(span)
    closes = 100 + np.cumsum(rng.normal(0, 1, 3000))
    closes[rng.random(3000) < missing] = np.nan
    closes[:5], closes[1000:1400] = np.nan, np.nan
    expected = pd.Series(closes).ewm(span=span, adjust=False).mean()
    got = column(features.ema(bars(spark, [None if np.isnan(x) else float(x) for x in closes]), "Close", span, "E"), "E")
    assert got[:5] == [None] * 5
    assert np.allclose(np.array(got, dtype=float), expected, rtol=1e-10, equal_nan=True)


def test_macd_of_one_missing_close(spark):
    closes = [100 + (i * 7 % 11) + 0.5 for i in range(60)]
    whole = column(features.macd(bars(spark, closes)), "MACD_Signal")
    closes[20] = None
    frame = pd.Series(closes, dtype=float)
    line = frame.ewm(span=12, adjust=False).mean() - frame.ewm(span=26, adjust=False).mean()
    got = column(features.macd(bars(spark, closes)), "MACD_Signal")
    assert np.allclose(got, line.ewm(span=9, adjust=False).mean()) and np.allclose(got[:20], whole[:20])
    assert column(features.engineer(bars(spark, closes), drop_incomplete=False), "MACD_Signal") == pytest.approx(got)


def test_date_features(spark):
    row = features.date_features(bars(spark, [1.0], start="2024-05-05")).first()
    assert (row["day_of_week"], row["month"], row["quarter"]) == (6, 5, 2)


def test_coercion(spark):
    df = spark.createDataFrame([(" $1,234.50 ",), ("nan",), ("n/a",), (None,), ("7",)], "t string")
    assert [r[0] for r in df.select(to_number(F.col("t"))).collect()] == [1234.5, None, None, None, 7.0]
    dates = spark.createDataFrame([("09/12/2025",), ("2025-09-12",), ("2025-09-12 10:30:00",), ("later",)], "t string")
    got = [r[0] for r in dates.select(to_timestamp(F.col("t"))).collect()]
    assert [g and g.isoformat() for g in got] == ["2025-09-12T00:00:00", "2025-09-12T00:00:00", "2025-09-12T10:30:00", None]


def test_mapping(spark):
    df = spark.createDataFrame([("09/12/2025", "$2", 5, "$1", "$3", "$1")], ["Date", "Close/Last", "Volume", "Open", "High", "Low"])
    assert "Close" not in mapping.infer_mapping(df)
    assert mapping.suggest_mapping(df)["Close"] == "Close/Last"
    row = mapping.apply_mapping(df).first()
    assert (row["Close"], row["Adj_Close"], row["Symbol"]) == (2.0, 2.0, "UNKNOWN")
    with pytest.raises(ValueError, match="Open"):
        mapping.apply_mapping(df.drop("Open"))
    assert mapping.apply_mapping(df.select("Date", "Close/Last"), require="close").count() == 1
    assert mapping.find_column(df, "HIGH") == "High"


def test_normalise_keeps_both_of_two_closes(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Close_A", "Close_B", "Adj Close"])
    assert mapping.normalise_columns(df, "X").columns == ["Close", "Close_2", "Adj_Close", "Symbol"]


def test_validate_reports_counts(spark):
    df = spark.createDataFrame([("x", "1"), ("2024-01-01", "y"), (None, None)], "Date string, Close string")
    got = {(r["column"], r["check"]): r["n_bad"] for r in quality.validate(df).collect()}
    assert got[("Date", "unparseable_date")] == 1 and got[("Close", "not_numeric")] == 1
    assert got[("Open", "missing_column")] == -1 and got[("Date", "has_nulls")] == 1
    assert quality.validate(bars(spark, [1.0])).count() == 0


ROWS = [("09/12/2025", "$66.53", 185, "$66.88", "$67.00", "$66.10"), ("09/11/2025", "$65.00", 100, "$64.00", "$66.00", "$63.50")]
NAMES = ["Date", "Close/Last", "Volume", "Open", "High", "Low"]


def test_same_bars_from_every_format(spark, tmp_path):
    records = [dict(zip(NAMES, r)) for r in ROWS]
    (tmp_path / "acme.csv").write_text("\n".join([",".join(NAMES), *[",".join(map(str, r)) for r in ROWS]]))
    (tmp_path / "acme.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "wrapped.json").write_text(json.dumps({"meta": {"n": 2}, "data": records}))
    nested = "".join(
        "<row>" + "".join(f"<{k}>{v}</{k}>" for k, v in zip(["Date", "Volume", "Open", "High", "Low"], [r[0], *r[2:]]))
        + f"<Close><Last>{r[1]}</Last></Close></row>\n" for r in ROWS
    )
    (tmp_path / "acme.xml").write_text(f"<root>\n{nested}</root>")
    results = []
    for f in ("acme.csv", "acme.json", "wrapped.json", "acme.xml"):
        loaded = readers.load_bars(spark, str(tmp_path / f))
        results.append(loaded.orderBy("Date").select("Date", "Open", "High", "Low", "Close", "Volume").collect())
        assert {r["Symbol"] for r in loaded.collect()} == {f.split(".")[0]}
    assert all(r == results[0] for r in results) and results[0][1]["Close"] == 66.53
    assert readers.load_bars(spark, str(tmp_path / "acme.csv"), symbol="ZZ").first()["Symbol"] == "ZZ"
    with pytest.raises(ValueError, match="unsupported"):
        readers.load_bars(spark, str(tmp_path / "acme.xls"))
    (tmp_path / "bad.csv").write_text("Date,Open,High,Low,Close\nx,1,1,1,1\n")
    with pytest.raises(ValueError, match="no valid rows"):
        readers.load_bars(spark, str(tmp_path / "bad.csv"))


def test_vendor_payload(spark, tmp_path):
    payload = {"Meta Data": {"1. Information": "x"}, "Time Series (Daily)": {
        "2023-01-01": {"1. open": "100", "2. high": "110", "3. low": "90", "4. close": "105", "5. volume": "1000"}}}
    (tmp_path / "ACME.json").write_text(json.dumps(payload, indent=2))
    row = readers.read_vendor_payload(spark, str(tmp_path / "ACME.json")).first()
    assert (row["Symbol"], row["Close"], row["Adj_Close"], row["Volume"]) == ("ACME", 105.0, 105.0, 1000.0)


def test_wide_table_with_missing_fields(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0, 2.0, 3.0, None)], "Date string, `Close_A` double, `Adj Close_A` double, `Close_B` double, `Close_C` double")
    rows = {r["Symbol"]: r for r in readers.wide_to_bars(df).collect()}
    assert set(rows) == {"A", "B"} and rows["A"]["Adj_Close"] == 2.0 and rows["B"]["Adj_Close"] is None


def test_ticks_to_bars_and_up(spark):
    ticks = spark.createDataFrame(
        [("A", "2024-01-01 00:10:00", 1, 5.0), ("A", "2024-01-01 00:10:00", 2, 7.0), ("A", "2024-01-01 00:50:00", -3, 2.0),
         ("A", "2024-01-01 01:10:00", 4, 9.0), (None, "2024-01-01 01:10:00", 5, 1.0)],
        "s string, t string, id bigint, p double").withColumn("t", F.col("t").cast("timestamp"))
    hours = to_bars(ticks, "t", "p", "s", "1 hour", order_by=["t", "id"])
    got = [tuple(r)[2:] for r in hours.filter("Symbol = 'A'").orderBy("Date").collect()]
    assert got == [(5.0, 7.0, 2.0, 2.0, 3.0), (9.0, 9.0, 9.0, 9.0, 1.0)]
    assert hours.filter("Symbol = 'UNKNOWN'").count() == 1
    assert tuple(rebucket(hours, "1 day").filter("Symbol = 'A'").first())[2:] == (5.0, 9.0, 2.0, 9.0, 4.0)
    assert to_bars(ticks, "t", "p", "s", "5 minutes", order_by=["id"]).count() == 4


def test_profile(spark):
    df = bars(spark, [1.0, 2.0, 3.0, None])
    d = {r["column"]: r for r in profile.describe(df).collect()}["Close"]
    assert (d["count"], d["mean"], d["q25"], d["q50"], d["max"]) == (3, 2.0, 1.5, 2.0, 3.0)
    info = {r["column"]: r for r in profile.column_info(df).collect()}["Close"]
    assert (info["type"], info["nulls"], info["null_pct"]) == ("double", 1, 25.0)
    h = {r["bin"]: r["n"] for r in profile.histogram(df, "Close", 2).collect()}
    assert h == {1: 1, 2: 2}
    assert profile.histogram(bars(spark, [4.0, 4.0]), "Close").collect()[0]["n"] == 2
    corr = {(r["x"], r["y"]): r["correlation"] for r in profile.correlation_matrix(bars(spark, [4.0, 4.0]), ["Close", "Volume"]).collect()}
    assert corr[("Close", "Volume")] is None and corr[("Volume", "Volume")] == 1.0


def test_reasons(spark):
    closes = [100.0 + i % 7 for i in range(100)] + [500.0]
    df = bars(spark, closes, volumes=[10.0 + i % 5 for i in range(101)]).withColumn("anomaly_score", F.col("Close") / 500)
    df = df.withColumn("is_anomaly", (F.col("Close") > 400).cast("int"))
    row = explain.explain_top(df, ["Close", "Volume"]).first()
    assert row["confidence"] == "High" and [r["code"] for r in row["reasons"]] == ["price_high"]
    assert row["reasons"][0]["text"] == "close is in the highest 0.0% of all rows"
    assert row["change_pct"] == pytest.approx((500 - 101) / 101 * 100)
    assert explain.explain_top(df, []).first()["reasons"][0]["code"] == "pattern"
    assert explain.percentile_ranks(df, "Close", [100.0, 500.0]) == {100.0: pytest.approx((0 + 15 + 1) * 50 / 101), 500.0: 100.0}


def test_metrics_and_best(spark):
    rows = [("m", 1, 1), ("m", 1, 0), ("m", 0, 1), ("m", 0, 0), ("none", 0, 1), ("none", 0, 0)]
    df = spark.createDataFrame(rows, "model string, predicted int, label int")
    got = {r["model"]: r for r in evaluate.metrics(df).collect()}
    assert (got["m"]["precision"], got["m"]["recall"], got["m"]["f1"], got["m"]["flagged_ratio"]) == (0.5, 0.5, 0.5, 0.5)
    assert got["none"]["f1"] == 0
    assert evaluate.best_by_f1(evaluate.metrics(df)).first()["best_model"] == "m"


def test_split_and_labels(spark):
    df = bars(spark, [float(i) for i in range(10)])
    train, test = evaluate.chronological_split(df)
    assert column(train, "Close") == list(range(8)) and column(test, "Close") == [8, 9]
    labelled = evaluate.synthetic_labels(df, 0.3)
    assert sum(column(labelled, "label")) == 3
    assert column(labelled, "label") == column(evaluate.synthetic_labels(df.repartition(4), 0.3), "label")


def test_sinks(spark, tmp_path):
    df = bars(spark, [1.0, 2.0]).withColumn("is_anomaly", F.col("Close").cast("int") - 1)
    for fmt in sinks.FORMATS:
        path = sinks.write_table(df, str(tmp_path / fmt), fmt, only_anomalies=True)
        assert spark.read.schema(df.schema).option("header", True).format(fmt).load(path).count() == 1
    assert len(json.loads(sinks.small_json_array(df))) == 2
    with pytest.raises(ValueError):
        sinks.small_json_array(df, 1)
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "x"), "xls")
