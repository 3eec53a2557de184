"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barloom.detectors.base import contamination_cut, minmax_score, standardise
from barloom.detectors.factory import compare_configurations, create_detector, load_detector
from barloom.functions.columns import name, rounded
from barloom.operators import cleaning, evaluate, explain, features, profile, quality
from barloom.operators.layout import merge_blocks, series_window
from barloom.plans.pipeline import analyze, bake_off, process
from barloom.session import cut_lineage, fresh_folder
from barloom.sources import readers
from barloom.sources.bars import rebucket, to_bars
from barloom.sources.mapping import apply_mapping, find_column, normalise_columns, suggest_mapping
from barloom.sources.sinks import write_table
from barloom.streaming.live import latest_bars, read_parquet_stream, run_available, score_available, stream_bars, stream_revisions, stream_scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
OHLCV = ["Open", "High", "Low", "Close", "Volume"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- tables -------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, of: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{of}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_bars(
        table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "o_orderpriority", order_by=["o_orderkey"]
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return to_bars(events, "ts", "value", "event_type", every="1 hour", order_by=["ts", "event_id"])


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier. Order and line number repeat, so the price in cents ends the order."""
    big = lambda c: F.col(c).cast("decimal(18,0)")
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(12,0)")
    place = big("l_orderkey") * F.lit("100000000000000").cast("decimal(15,0)") + (
        F.col("l_linenumber").cast("decimal(2,0)") * F.lit("1000000000000").cast("decimal(13,0)") + cents
    )
    lines = table(spark, sf_dir, "lineitem").withColumn("_place", place)
    return to_bars(
        lines, "l_shipdate", "l_extendedprice", "l_suppkey", quantity="l_quantity", order_by=["_place"]
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with gaps, spikes and repeated rows."""
    bars = daily(spark, sf_dir)
    bars = bars.withColumn("_k", F.row_number().over(series_window(bars)))
    k = F.col("_k")
    close = F.when(k % 17 == 0, None).when(k % 101 == 0, F.col("Close") * 10).otherwise(F.col("Close"))
    volume = F.when((k % 23 == 0) | (k <= 2), None).otherwise(F.col("Volume"))
    bars = bars.withColumns({"Close": close, "Volume": volume, "_copies": F.when(k % 50 == 0, 2).otherwise(1)})
    copies = bars.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    return copies.withColumns(
        {"Close": F.col("Close") + F.col("_copy"), "_row": (2 * k + F.col("_copy")).cast("bigint")}
    ).drop("_k", "_copies", "_copy")


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.dedupe_first(dirty(spark, sf_dir)).drop("_row")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they come, one series per type: nothing bounds the length of a series."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("Symbol"),
        F.col("ts").cast("timestamp").alias("Date"),
        F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("Close"),
        F.col("event_id").alias("_row"),
    )
    return cleaning.dedupe_first(events).drop("_row")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars scored by the absolute z value of their return; above 2.5 is anomalous."""
    bars = daily(spark, sf_dir)
    returns = features.price_features(bars).select("Symbol", "Date", *OHLCV, "Daily_Return")
    returns = returns.filter(F.col("Daily_Return").isNotNull())
    z = standardise(returns.withColumn("_z", F.col("Daily_Return")), ["_z"]).withColumn("_z", F.abs("_z"))
    return minmax_score(z, "_z").withColumn("is_anomaly", (F.col("_z") > 2.5).cast("int")).drop("_z")


def shown(df: DataFrame, digits: int = 4, *columns: str) -> DataFrame:
    """Date as a day and rounded numbers, without bookkeeping columns."""
    df = df.select(*[name(c) for c in (columns or [c for c in df.columns if not c.startswith("_")])])
    return rounded(df.withColumn("Date", F.col("Date").cast("date")) if "Date" in df.columns else df, digits)


def shown_at(df: DataFrame, digits: int = 4, nudge: float = 0.0) -> DataFrame:
    """As ``shown``, with the time of day as text."""
    df = df.select(*[name(c) for c in df.columns if not c.startswith("_")])
    return rounded(df.withColumn("Date", F.date_format("Date", "yyyy-MM-dd HH:mm:ss.SSSSSS")), digits, nudge=nudge)


def with_new(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return shown(df, digits, "Symbol", "Date", *columns)


# --- bars ---------------------------------------------------------------------------


@query
def bars_daily(spark, sf_dir):
    return shown(daily(spark, sf_dir))


@query
def bars_hourly(spark, sf_dir):
    return shown_at(hourly(spark, sf_dir))


@query
def bars_wide(spark, sf_dir):
    return shown(wide(spark, sf_dir), 2)


@query
def bars_weekly_from_daily(spark, sf_dir):
    return shown(rebucket(daily(spark, sf_dir), "1 week"))


@query
def bars_six_hours(spark, sf_dir):
    return shown_at(rebucket(hourly(spark, sf_dir), "6 hours"))


@query
def breakouts(spark, sf_dir):
    return with_new(features.breakouts(daily(spark, sf_dir)), "Close", "BB_Upper", "BB_Lower")


# --- mapping, coercion, validation --------------------------------------------------


@query
def coerce_money_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = orders.select(
        key,
        F.when(key % 37 == 0, "soon").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("Date"),
        F.when(key % 31 == 0, "n/a").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("Close"),
    )
    return shown(quality.drop_invalid_close(quality.coerce_numbers(quality.coerce_dates(text))), 2)


@query
def map_columns(spark, sf_dir):
    bars = daily(spark, sf_dir)
    renamed = bars.select(
        F.col("Symbol").alias("Ticker"),
        F.date_format("Date", "MM/dd/yyyy").alias("timestamp"),
        F.col("Close").alias("Close/Last"),
        F.col("Open").alias("OPENING"),
        F.col("High").alias("high_price"),
        F.col("Low").alias("Lowest"),
        F.col("Volume").alias("vol"),
        F.lit("x").alias("note"),
    ).withColumnRenamed("Lowest", "low")
    return shown(apply_mapping(renamed, suggest_mapping(renamed)))


@query
def found_column(spark, sf_dir):
    """The first column whose name holds a word, whatever the case around it."""
    bars = daily(spark, sf_dir).select("Symbol", "Date", F.col("Open").alias("Last CLOSED at"), F.col("Close").alias("close"))
    assert find_column(bars, "volume") is None
    return shown(bars.select("Symbol", "Date", name(find_column(bars, "Close")).alias("found")))


@query
def keyword_columns(spark, sf_dir):
    bars = daily(spark, sf_dir).select(
        F.col("Date").alias("Trade Date"),
        F.col("Open").alias("open (usd)"),
        F.col("High").alias("day high"),
        F.col("Low").alias("day low"),
        F.col("Close").alias("last close"),
        F.col("Volume").alias("volume traded"),
    )
    return shown(normalise_columns(bars, "ALL"))


@query
def validate_report(spark, sf_dir):
    bars = dirty(spark, sf_dir)
    text = bars.select(
        F.when(F.col("_row") % 40 == 0, "unknown").otherwise(F.date_format("Date", "yyyy-MM-dd")).alias("Date"),
        "Open",
        "High",
        F.when(F.col("_row") % 90 == 0, "n/a").otherwise(F.col("Close").cast("string")).alias("Close"),
        "Volume",
    )
    return quality.validate(text)


@query
def quality_report(spark, sf_dir):
    report = quality.quality_report(dirty(spark, sf_dir))
    return report.withColumns({c: F.col(c).cast("date") for c in ("first_date", "last_date")})


# --- cleaning -----------------------------------------------------------------------


@query
def dedupe_first(spark, sf_dir):
    return shown(cleaning.dedupe_first(dirty(spark, sf_dir)))


def filled(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(cleaning.fill(deduped(spark, sf_dir), method=method))

    return run


for _method in ("ffill", "bfill", "interpolate", "mean"):
    QUERIES[f"fill_{_method}"] = filled(_method)


@query
def iqr_cap(spark, sf_dir):
    return shown(cleaning.cap_outliers(deduped(spark, sf_dir)))


@query
def auto_clean(spark, sf_dir):
    return shown(cleaning.auto_clean(deduped(spark, sf_dir)))


@query
def full_pipeline(spark, sf_dir):
    made = process(dirty(spark, sf_dir)).select("Symbol", F.col("Date").cast("date").alias("Date"), *OHLCV, *FEATURES)
    return rounded(made, 4, nudge=NUDGE)


@query
def pipeline_wide(spark, sf_dir):
    """The longest table of bars: many series of a few thousand rows."""
    columns = ("Close", "Daily_Return", "Volatility_5d", "ATR_5d", "Price_Momentum_5d")
    made = process(wide(spark, sf_dir)).select("Symbol", F.col("Date").cast("date").alias("Date"), *columns)
    return rounded(made, 4, nudge=NUDGE)


# --- features -----------------------------------------------------------------------

PRICE = (
    "Daily_Return Log_Return MA5 MA10 MA20 Price_Momentum_1d Price_Momentum_5d Price_Gap HL_Range HL_Range_Pct"
).split()
VOLUME = "Volume_Change Volume_MA5 Volume_MA10 Volume_Ratio_MA5 Price_Volume_Corr".split()
VOLATILITY = "Volatility_5d Volatility_10d TR ATR_5d".split()
BANDS = "BB_Middle BB_Std BB_Upper BB_Lower BB_Width".split()
MACD = "MACD MACD_Signal MACD_Hist".split()
NUDGE = 0.0000003
FEATURES = [*PRICE, *VOLUME, *VOLATILITY, "RSI", *MACD, *BANDS]


@query
def price_features(spark, sf_dir):
    return with_new(features.price_features(daily(spark, sf_dir)), *PRICE)


@query
def volume_features(spark, sf_dir):
    return with_new(features.volume_features(daily(spark, sf_dir)), *VOLUME)


@query
def volatility_features(spark, sf_dir):
    return with_new(features.volatility_features(daily(spark, sf_dir)), *VOLATILITY)


@query
def rsi(spark, sf_dir):
    return with_new(features.rsi(daily(spark, sf_dir)), "RSI")


@query
def bollinger(spark, sf_dir):
    return with_new(features.bollinger(daily(spark, sf_dir)), *BANDS)


@query
def ema(spark, sf_dir):
    return with_new(features.ema(daily(spark, sf_dir), "Close", 12, "EMA12"), "EMA12")


@query
def macd(spark, sf_dir):
    return with_new(features.macd(daily(spark, sf_dir)), *MACD)


@query
def macd_gaps(spark, sf_dir):
    """Of closes with missing values, left as they are."""
    return with_new(features.macd(deduped(spark, sf_dir)), *MACD)


@query
def date_features(spark, sf_dir):
    return with_new(features.date_features(daily(spark, sf_dir)), "day_of_week", "month", "quarter")


@query
def eda_returns(spark, sf_dir):
    return with_new(features.eda_features(deduped(spark, sf_dir)), "Returns", "MA7", "MA30")


@query
def eval_features(spark, sf_dir):
    return with_new(features.evaluation_features(daily(spark, sf_dir)), "return", "ma5", "ma20", "volatility")


@query
def tick_features(spark, sf_dir):
    moved = features.price_features(cleaning.fill(ticks(spark, sf_dir)))
    wanted = moved.select("Symbol", "Date", "Close", "Daily_Return", "MA5", "MA20", "Price_Momentum_5d")
    return shown_at(wanted, nudge=NUDGE)


@query
def tick_interpolated(spark, sf_dir):
    return shown_at(merge_blocks(cleaning.fill(ticks(spark, sf_dir), method="interpolate")))


@query
def tick_iqr_cap(spark, sf_dir):
    return shown_at(merge_blocks(cleaning.cap_outliers(ticks(spark, sf_dir))), 6)


# --- profile ------------------------------------------------------------------------


@query
def symbol_list(spark, sf_dir):
    return profile.symbols(daily(spark, sf_dir))


@query
def symbol_slice(spark, sf_dir):
    chosen = profile.symbol_slice(daily(spark, sf_dir), ["1-URGENT", "2-HIGH"])
    return shown(readers.date_range(chosen, "1996-01-01", "1997-01-01"))


@query
def last_year(spark, sf_dir):
    return shown(readers.last_days(daily(spark, sf_dir), 365))


@query
def preview(spark, sf_dir):
    return shown(profile.preview(daily(spark, sf_dir), 20))


@query
def overview_summary(spark, sf_dir):
    summary = profile.overview(daily(spark, sf_dir))
    return rounded(summary.withColumns({c: F.col(c).cast("date") for c in ("first_date", "last_date")}), 4)


@query
def describe(spark, sf_dir):
    return rounded(profile.describe(daily(spark, sf_dir)), 3)


@query
def describe_lineitem(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rounded(profile.describe(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 3)


@query
def missing_values(spark, sf_dir):
    return rounded(profile.missing_values(dirty(spark, sf_dir)), 4)


@query
def column_info(spark, sf_dir):
    return profile.column_info(dirty(spark, sf_dir)).drop("type")


@query
def column_types(spark, sf_dir):
    """Column information of a table as it is stored, types included."""
    return profile.column_info(table(spark, sf_dir, "lineitem"))


@query
def histogram(spark, sf_dir):
    return rounded(profile.histogram(daily(spark, sf_dir), "Close"), 3)


@query
def score_histogram(spark, sf_dir):
    return rounded(profile.histogram(scored(spark, sf_dir), "anomaly_score", by="is_anomaly"), 6)


@query
def plot_series(spark, sf_dir):
    return shown(profile.plot_series(scored(spark, sf_dir), "Close", by="is_anomaly"))


@query
def corr_matrix(spark, sf_dir):
    return rounded(profile.correlation_matrix(daily(spark, sf_dir), OHLCV), 6)


# --- scaling and detectors ----------------------------------------------------------


@query
def zscore_scale(spark, sf_dir):
    return shown(standardise(daily(spark, sf_dir), OHLCV), 6)


@query
def minmax_scores(spark, sf_dir):
    return with_new(minmax_score(daily(spark, sf_dir), "Close"), "anomaly_score", digits=6)


@query
def contamination_flags(spark, sf_dir):
    bars = daily(spark, sf_dir)
    cut = contamination_cut(bars, "Close", 0.05)
    return with_new(bars.withColumn("is_anomaly", (F.col("Close") > cut).cast("int")), "Close", "is_anomaly")


STATIONARY = ["Daily_Return", "HL_Range_Pct", "Volume_Ratio_MA5", "RSI", "BB_Width"]


def with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with stationary features, stored because detectors read them several times."""
    cleaned = cleaning.clean(daily(spark, sf_dir))
    made = features.engineer(cleaned, drop_incomplete=False, with_volume=True).na.drop(subset=STATIONARY)
    return cut_lineage(shown(merge_blocks(made), 9, "Symbol", "Date", *OHLCV, *STATIONARY))


@query
def isolation_forest(spark, sf_dir):
    bars = with_returns(spark, sf_dir)
    forest = create_detector("isolation_forest", contamination=0.05)
    return with_new(forest.fit(bars, STATIONARY).predict(bars), "Close", "anomaly_score", "is_anomaly", digits=6)


@query
def isolation_forest_wide(spark, sf_dir):
    bars = cut_lineage(wide(spark, sf_dir))
    forest = create_detector("isolation_forest", contamination=0.01)
    return with_new(forest.fit(bars, OHLCV).predict(bars), "Close", "anomaly_score", "is_anomaly", digits=6)


@query
def lof_exact(spark, sf_dir):
    bars = cut_lineage(hourly(spark, sf_dir))
    lof = create_detector("lof", n_neighbors=20).fit(bars, OHLCV)
    return shown_at(lof.predict(bars).select("Symbol", "Date", "anomaly_score", "is_anomaly"), 6)


@query
def lof_novelty(spark, sf_dir):
    bars = cut_lineage(hourly(spark, sf_dir))
    known = bars.filter(F.col("Date") < "2024-01-20")
    new = bars.filter(F.col("Date") >= "2024-01-20")
    lof = create_detector("lof", n_neighbors=20, novelty=True).fit(known, OHLCV)
    return shown_at(lof.predict(new).select("Symbol", "Date", "anomaly_score", "is_anomaly"), 6)


@query
def lof_by_symbol(spark, sf_dir):
    bars = cut_lineage(hourly(spark, sf_dir))
    lof = create_detector("lof", n_neighbors=20, partition_by="Symbol").fit(bars, OHLCV)
    return shown_at(lof.predict(bars).select("Symbol", "Date", "anomaly_score", "is_anomaly"), 6)


@query
def lof_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    size = 64
    parts = vectors.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(size)])
    parts = cut_lineage(parts)
    lof = create_detector("lof", n_neighbors=10).fit(parts, [f"e{i}" for i in range(size)])
    return rounded(lof.predict(parts).select("vec_id", "anomaly_score", "is_anomaly"), 5)


@query
def recon_pca(spark, sf_dir):
    bars = with_returns(spark, sf_dir)
    detector = create_detector("autoencoder", mode="pca", encoding_dim=3).fit(bars, STATIONARY)
    return with_new(detector.predict(bars), "anomaly_score", "is_anomaly", digits=6)


@query
def recon_pair(spark, sf_dir):
    """Two features and one component, which SQL can reproduce."""
    bars = cut_lineage(daily(spark, sf_dir))
    detector = create_detector("autoencoder", mode="pca", encoding_dim=1).fit(bars, ["High", "Close"])
    return with_new(detector.predict(bars), "anomaly_score", "is_anomaly", digits=6)


@query
def recon_mlp(spark, sf_dir):
    bars = with_returns(spark, sf_dir)
    detector = create_detector("autoencoder", encoding_dim=3, epochs=10).fit(bars, STATIONARY)
    return with_new(detector.predict(bars), "anomaly_score", "is_anomaly", digits=6)


@query
def saved_detector(spark, sf_dir):
    """Fit, save, load, and score with what was loaded."""
    bars = with_returns(spark, sf_dir)
    fitted = create_detector("isolation_forest", n_estimators=20, contamination=0.05).fit(bars, STATIONARY)
    path = fitted.save(fresh_folder(spark, "detector"), spark)
    return with_new(load_detector(spark, path).predict(bars), "anomaly_score", "is_anomaly", digits=6)


@query
def saved_lof(spark, sf_dir):
    """A detector with its training rows and densities, saved, loaded and applied to new rows."""
    bars = cut_lineage(hourly(spark, sf_dir))
    lof = create_detector("lof", n_neighbors=20, novelty=True).fit(bars.filter(F.col("Date") < "2024-01-20"), OHLCV)
    loaded = load_detector(spark, lof.save(fresh_folder(spark, "lof"), spark))
    return shown_at(loaded.predict(bars.filter(F.col("Date") >= "2024-01-20")).select("Symbol", "Date", "anomaly_score", "is_anomaly"), 6)


@query
def upload_autodetect(spark, sf_dir):
    path = write_table(raw_prices(spark, sf_dir), fresh_folder(spark, "upload"), "csv")
    return with_new(analyze(spark, path, fmt="csv"), "Close", "anomaly_score", "is_anomaly", digits=6)


# --- reports ------------------------------------------------------------------------


@query
def anomaly_summary(spark, sf_dir):
    return rounded(explain.anomaly_summary(scored(spark, sf_dir)), 6)


@query
def top_anomalies(spark, sf_dir):
    return rounded(explain.anomaly_table(scored(spark, sf_dir), ["Close", "Daily_Return"], 20), 6)


@query
def gap_patterns(spark, sf_dir):
    return explain.gap_patterns(scored(spark, sf_dir))


@query
def price_position(spark, sf_dir):
    return rounded(explain.price_position(scored(spark, sf_dir)), 6)


@query
def explain_top(spark, sf_dir):
    told = explain.explain_top(scored(spark, sf_dir), OHLCV, 10)
    reasons = F.array_join(F.transform("reasons", lambda r: r["code"]), "; ").alias("reasons")
    told = told.select("Symbol", "Date", "Close", "anomaly_score", "change_pct", "confidence", reasons)
    return shown(told, 6)


@query
def explain_all(spark, sf_dir):
    """Every anomaly with the numbers and the words of its reasons."""
    told = explain.explain_top(scored(spark, sf_dir), OHLCV, None)
    said = F.transform("reasons", lambda r: F.concat_ws(" ", r["code"], F.format_string("%.3f", r["value"]), r["text"]))
    told = told.withColumn("reasons", F.when(F.get("reasons", F.lit(0))["code"] == "pattern", F.get("reasons", F.lit(0))["text"]).otherwise(F.array_join(said, "; ")))
    return shown(told.select("Symbol", "Date", "anomaly_score", "confidence", "reasons"), 6)


# --- comparison and evaluation ------------------------------------------------------


@query
def compare_configs(spark, sf_dir):
    """Two cuts of the same score."""
    bars = scored(spark, sf_dir)
    cuts = {"loose": 0.2, "strict": 0.4}
    flagged = {c: bars.withColumn("is_anomaly", (F.col("anomaly_score") > v).cast("int")) for c, v in cuts.items()}
    return rounded(evaluate.compare(flagged), 6)


@query
def config_agreement(spark, sf_dir):
    bars = scored(spark, sf_dir)
    cuts = {"loose": 0.2, "middle": 0.3, "strict": 0.4}
    flagged = {c: bars.withColumn("is_anomaly", (F.col("anomaly_score") > v).cast("int")) for c, v in cuts.items()}
    return evaluate.agreement(flagged)


@query
def compare_forests(spark, sf_dir):
    bars = with_returns(spark, sf_dir)
    few, many = {"contamination": 0.02, "n_estimators": 20}, {"contamination": 0.1, "n_estimators": 20}
    return rounded(compare_configurations(bars, "isolation_forest", {"few": few, "many": many}, STATIONARY)[0], 6)


@query
def chrono_split(spark, sf_dir):
    return with_new(evaluate.with_split(daily(spark, sf_dir)), "part")


@query
def synthetic_labels(spark, sf_dir):
    labelled = evaluate.synthetic_labels(daily(spark, sf_dir))
    return labelled.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_labelled"))


@query
def synthetic_label_keys(spark, sf_dir):
    """Which rows are labelled."""
    return with_new(evaluate.synthetic_labels(daily(spark, sf_dir), 0.05, seed=7).filter("label = 1"), "label")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three simple detectors of toxic documents, by length and by quality label."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    rules = F.array(
        F.struct(F.lit("long").alias("model"), (F.col("n_chars") > 3000).cast("int").alias("predicted")),
        F.struct(F.lit("short").alias("model"), (F.col("n_chars") < 500).cast("int").alias("predicted")),
        F.struct(F.lit("quality").alias("model"), (F.col("quality") == 0).cast("int").alias("predicted")),
    )
    return joined.select(F.inline(rules), F.col("toxic").alias("label"))


@query
def metrics_by_model(spark, sf_dir):
    return rounded(evaluate.metrics(predictions(spark, sf_dir)), 6)


@query
def best_model(spark, sf_dir):
    return rounded(evaluate.best_by_f1(evaluate.metrics(predictions(spark, sf_dir))), 6)


@query
def detector_bake_off(spark, sf_dir):
    return rounded(bake_off(cut_lineage(daily(spark, sf_dir)), epochs=5), 6)


# --- files --------------------------------------------------------------------------


def raw_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars as price files hold them: money text, US dates and ``Close/Last``."""
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    return daily(spark, sf_dir).select(
        "Symbol",
        F.date_format("Date", "MM/dd/yyyy").alias("Date"),
        money("Close").alias("Close/Last"),
        F.col("Volume").cast("bigint").alias("Volume"),
        *[money(c).alias(c) for c in ("Open", "High", "Low")],
    )


@query
def json_xml_csv_same_bars(spark, sf_dir):
    raw = cut_lineage(raw_prices(spark, sf_dir))
    nested = raw.withColumn("Close", F.struct(name("Close/Last").alias("Last"))).drop("Close/Last")
    csv, lines, xml, parquet = (fresh_folder(spark, f) for f in ("csv", "jsonl", "xml", "parquet"))
    write_table(raw, csv, "csv")
    write_table(raw, lines, "json")
    nested.write.format("xml").option("rootTag", "root").option("rowTag", "row").save(xml)
    raw.write.parquet(parquet)
    loaded = [
        readers.load_bars(spark, csv, "csv").withColumn("source", F.lit("csv")),
        readers.load_bars(spark, lines, "jsonl").withColumn("source", F.lit("json")),
        readers.load_bars(spark, xml, "xml", row_tag="row").withColumn("source", F.lit("xml")),
        readers.load_bars(spark, parquet, "parquet").withColumn("source", F.lit("parquet")),
    ]
    return shown(readers.union_symbols(*loaded), 2)


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of a symbol and year as one list of records, for files of one document each."""
    price = F.struct(*[F.col(c).alias(c.lower()) for c in ("Open", "High", "Low")], F.struct(F.col("Close").alias("last")).alias("close"))
    day = F.struct(F.date_format("Date", "yyyy-MM-dd").alias("day"), price.alias("price"), F.col("Volume").cast("bigint").alias("volume"))
    return daily(spark, sf_dir).groupBy("Symbol", F.year("Date").alias("year")).agg(F.collect_list(day).alias("days"))


def documents_of(rows: DataFrame, json: str, path: str) -> str:
    """Each row as a file of its own, over several lines as people write JSON."""
    text = F.regexp_replace(F.expr(json), r"([\[{,])", "$1\n  ")
    rows.select(F.concat_ws("-", F.substring("Symbol", 1, 1), "year").alias("file"), text.alias("value")).write.partitionBy("file").text(path)
    return path


NESTED = {"Symbol": "ticker", "Date": "day", "Open": "price.open", "High": "price.high", "Low": "price.low", "Close": "price.close.last", "Volume": "volume"}


@query
def json_nested(spark, sf_dir):
    """Documents of one object that holds a list of records, with objects inside, and values beside the list."""
    whole = "to_json(struct(struct(year) as about, Symbol as ticker, array(1, 2) as codes, days as results))"
    path = documents_of(yearly(spark, sf_dir), whole, fresh_folder(spark, "nested"))
    return shown(readers.load_bars(spark, path, "json", NESTED), 2, "Symbol", "Date", *OHLCV)


@query
def json_records(spark, sf_dir):
    """Documents that are arrays of records."""
    whole = "to_json(transform(days, d -> struct(Symbol as ticker, d.day, d.price, d.volume)))"
    path = documents_of(yearly(spark, sf_dir), whole, fresh_folder(spark, "arrays"))
    return shown(readers.load_bars(spark, path, "json", NESTED), 2, "Symbol", "Date", *OHLCV)


@query
def xml_found_tag(spark, sf_dir):
    """XML whose record tag nobody names, in several files that share a root."""
    path = fresh_folder(spark, "tags")
    raw = raw_prices(spark, sf_dir).withColumn("Close", F.struct(name("Close/Last").alias("Last"))).drop("Close/Last")
    raw.repartition(4, "Symbol", "Date").write.format("xml").option("rootTag", "prices").option("rowTag", "quote").save(path)
    return shown(readers.load_bars(spark, path, "xml"), 2, "Symbol", "Date", *OHLCV)


@query
def parquet_symbols(spark, sf_dir):
    """Symbols that look like numbers, through Parquet without a schema."""
    bars = daily(spark, sf_dir).withColumn("Symbol", F.concat(F.lit("070"), F.substring("Symbol", 1, 1)))
    path = write_table(bars, fresh_folder(spark, "symbols"))
    return shown(readers.load_bars(spark, path, "parquet"), 4, "Symbol", "Date", *OHLCV)


def told_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a price file, with every spelling of dates, some of none, and closes that are missing or no number."""
    key = F.col("o_orderkey")
    spellings = ["yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "dd.MM.yyyy", "d-MMM-yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy/M/d h:mm a", "M/d/yyyy H:mm"]
    date = F.get(F.array(*[F.date_format("o_orderdate", s) for s in spellings]), (key % len(spellings)).cast("int"))
    return table(spark, sf_dir, "orders").select(
        key.alias("_row"),
        F.col("o_orderpriority").alias("Symbol"),
        F.when(key % 41 == 0, "soon").when(key % 43 == 0, None).when(key % 47 == 0, "31/31/1996").otherwise(date).alias("Date"),
        F.when(key % 31 == 0, "n/a").when(key % 37 == 0, " ").otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).alias("Close/Last"),
    )


@query
def date_shapes(spark, sf_dir):
    """Every spelling of a date, read back."""
    dates = quality.coerce_dates(told_dates(spark, sf_dir)).select(F.col("_row").alias("order_key"), F.date_format("Date", "yyyy-MM-dd HH:mm").alias("read"))
    return dates


@query
def rejected_rows(spark, sf_dir):
    """What a load leaves out and why, as it stands in the file."""
    told = told_dates(spark, sf_dir)
    path = write_table(told.withColumnRenamed("_row", "Volume"), fresh_folder(spark, "told"), "csv")
    left_out = readers.load_rejected(spark, path, "csv", require="close")
    return left_out.select(F.col("Volume").cast("bigint").alias("order_key"), "Symbol", "Date", "Close", "reason")


@query
def load_report(spark, sf_dir):
    """How many rows a load read, kept and left out by reason, counted in the pass that loads."""
    path = write_table(told_dates(spark, sf_dir).drop("_row"), fresh_folder(spark, "told"), "csv")
    watch, kept = Observation(), fresh_folder(spark, "kept")
    readers.load_bars(spark, path, "csv", require="close", watch=watch).write.parquet(kept)
    counts = {c: F.lit(int(n)).cast("bigint") for c, n in watch.get.items()}
    report = quality.quality_report(spark.read.parquet(kept)).select("usable_rows", F.col("first_date").cast("date"), F.col("last_date").cast("date"))
    return report.withColumns(counts)


@query
def vendor_payload(spark, sf_dir):
    """One payload per symbol and year, written as text and read back."""
    bars = daily(spark, sf_dir)
    fields = {"1. open": "Open", "2. high": "High", "3. low": "Low", "4. close": "Close", "5. volume": "Volume"}
    bar = F.create_map(*[x for key, c in fields.items() for x in (F.lit(key), F.col(c).cast("string"))])
    days = F.map_from_entries(F.collect_list(F.struct(F.date_format("Date", "yyyy-MM-dd"), bar)))
    payloads = bars.groupBy("Symbol", F.year("Date").alias("year")).agg(days.alias("days"))
    whole = F.struct(
        F.create_map(F.lit("2. Symbol"), F.col("Symbol")).alias("Meta Data"), F.col("days").alias("Time Series (Daily)")
    )
    path = fresh_folder(spark, "payloads")
    payloads.select(F.to_json(whole).alias("value")).write.text(path)
    return shown(readers.read_vendor_payload(spark, path, lines=True))


@query
def wide_to_bars(spark, sf_dir):
    """Fields by ticker in columns, turned back into rows."""
    bars = daily(spark, sf_dir)
    tickers = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    across = bars.groupBy("Date").pivot("Symbol", tickers).agg(*[F.first(c).alias(c) for c in OHLCV])
    renamed = across.select(
        "Date", *[name(f"{t}_{c}").alias(f"{c}_{t}") for t in tickers for c in OHLCV]
    )
    return shown(readers.wide_to_bars(renamed))


@query
def export_anomalies_roundtrip(spark, sf_dir):
    """The flagged rows written in three formats, counted per format after reading back."""
    rows = cut_lineage(scored(spark, sf_dir).drop("Daily_Return"))
    back = []
    for fmt in ("parquet", "csv", "json"):
        path = write_table(rows, fresh_folder(spark, "export"), fmt, only_anomalies=True)
        reader = spark.read.schema(rows.schema)
        read = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
        back.append(read.select("Symbol", "Date", "Close", "is_anomaly").withColumn("source", F.lit(fmt)))
    return shown(readers.union_symbols(*back))


# --- streams ------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return read_parquet_stream(spark, sf_dir, schema, "events.parquet")


@query
def stream_hourly_bars(spark, sf_dir):
    bars = stream_bars(event_stream(spark, sf_dir), "ts", "value", "event_type", order_by=["ts", "event_id"])
    return shown_at(run_available(bars, "stream-bars"))


@query
def stream_weekly_bars(spark, sf_dir):
    """Weeks from Monday, each emitted once it has passed."""
    bars = stream_bars(event_stream(spark, sf_dir), "ts", "value", "event_type", "1 week", order_by=["ts", "event_id"])
    return shown_at(run_available(bars, "stream-weeks"))


def order_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed in four files without regard to their dates, one file a batch: nothing is too late for revisions."""
    landed, orders = fresh_folder(spark, "orders"), table(spark, sf_dir, "orders")
    orders.repartition(4, "o_orderkey").write.parquet(landed)
    return read_parquet_stream(spark, landed, orders.schema, files_per_batch=1)


@query
def stream_monthly_bars(spark, sf_dir):
    """Bars of months from a stream, revised batch by batch, those still open included."""
    bars = stream_revisions(order_stream(spark, sf_dir), "o_orderdate", "o_totalprice", "o_orderpriority", "1 month", order_by=["o_orderdate", "o_orderkey"])
    return shown(latest_bars(bars, "stream-months"))


@query
def stream_all_hours(spark, sf_dir):
    """Hourly bars of a stream with the last ones, which wait for no watermark."""
    bars = stream_revisions(event_stream(spark, sf_dir), "ts", "value", "event_type", "1 hour", order_by=["ts", "event_id"])
    return shown_at(latest_bars(bars, "stream-hours"))


@query
def stream_score(spark, sf_dir):
    bars = cut_lineage(hourly(spark, sf_dir))
    forest = create_detector("isolation_forest", n_estimators=50, contamination=0.05).fit(bars, OHLCV)
    live = stream_bars(event_stream(spark, sf_dir), "ts", "value", "event_type", order_by=["ts", "event_id"])
    flagged = run_available(stream_scores(live, forest), "stream-scores")
    return shown_at(flagged.select("Symbol", "Date", "Close", "anomaly_score", "is_anomaly"), 6)


@query
def stream_lof(spark, sf_dir):
    bars = cut_lineage(hourly(spark, sf_dir))
    lof = create_detector("lof", n_neighbors=20, novelty=True).fit(bars.filter(F.col("Date") < "2024-01-20"), OHLCV)
    landed = fresh_folder(spark, "new-bars")
    new = bars.filter(F.col("Date") >= "2024-01-20")
    new.repartitionByRange(3, "Date").write.parquet(landed)
    live = read_parquet_stream(spark, landed, new.schema, files_per_batch=1)
    flagged = score_available(live, lof, "stream-lof")
    return shown_at(flagged.select("Symbol", "Date", "anomaly_score", "is_anomaly"), 6)
