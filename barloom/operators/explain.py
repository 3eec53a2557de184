"""What was flagged and why: summary, ranking, patterns, reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import name
from barloom.operators.cleaning import fill
from barloom.operators.layout import over_series
from barloom.operators.quantiles import exact_quantiles, ranked_values
from barloom.session import cut_lineage

# Confidence tiers, percentile limits and range multiple of the reason rules.
HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 0.8, 0.6
HIGH_PERCENTILE, LOW_PERCENTILE = 95, 5
RANGE_MULTIPLE = 2
CLUSTER_DAYS = 3
#: What a reason says; the number is its value.
REASON_TEXT = {
    "price_high": "close is in the highest %.1f%% of all rows",
    "price_low": "close is in the lowest %.1f%% of all rows",
    "volume_high": "volume is in the highest %.1f%% of all rows",
    "volume_low": "volume is in the lowest %.1f%% of all rows",
    "wide_range": "high and low are %.1f times as far apart as on average",
    "pattern": "no feature stands out alone, their combination does",
}
EXPLAINED = 10


def anomalies(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_anomaly") == 1)


def anomaly_summary(df: DataFrame) -> DataFrame:
    flagged = F.count_if(F.col("is_anomaly") == 1)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        flagged.alias("flagged"),
        F.coalesce(F.try_divide(flagged * 100, F.count(F.lit(1))), F.lit(0.0)).alias("flagged_pct"),
        (F.count(F.lit(1)) - flagged).alias("normal"),
    )


def ranking(df: DataFrame) -> list[Column]:
    return [F.col("anomaly_score").desc(), *[F.col(c) for c in ("Symbol", "Date") if c in df.columns]]


def ranked(df: DataFrame, k: int | None = 20) -> DataFrame:
    """Flagged rows, most anomalous first; all of them when ``k`` is None."""
    rows = anomalies(df).orderBy(*ranking(df))
    return rows if k is None else rows.limit(k)


def anomaly_table(df: DataFrame, features: Sequence[str] = (), k: int | None = 20) -> DataFrame:
    """Date as text, Close, Volume, score and the features, each column once."""
    wanted = ["Symbol", "Close", "Volume", "anomaly_score", *features]
    kept = list(dict.fromkeys(c for c in wanted if c in df.columns))
    return ranked(df, k).select(F.date_format("Date", "yyyy-MM-dd HH:mm:ss").alias("Date"), *[name(c) for c in kept])


def gap_patterns(df: DataFrame) -> DataFrame:
    """Gaps between consecutive anomalies of the whole table, in days.

    Copies of a date are counted before the dates are put in order, so they add gaps of
    zero days without meeting in one task. ``longest_run`` is the largest group of anomalies
    with no gap of three days or more inside.
    """
    dates = (
        anomalies(df)
        .groupBy(F.col("Date").cast("timestamp").alias("Date"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("Symbol", F.lit("all"))
    )

    def build(d, w):
        seconds = F.unix_micros("Date") - F.unix_micros(F.lag("Date").over(w))
        return d.withColumn("gap_days", F.floor(seconds / 86_400_000_000))

    gaps = over_series(dates, 1, build)
    start = F.when(F.coalesce(F.col("gap_days") >= CLUSTER_DAYS, F.lit(True)), F.col("Date"))
    runs = fill(gaps.withColumn("run", start), ["run"], "pad")
    per_run = runs.groupBy("run").agg(
        F.sum("copies").alias("in_run"),
        F.sum(F.col("copies") - 1 + F.when(F.col("gap_days") < CLUSTER_DAYS, 1).otherwise(0)).alias("close_gaps"),
        F.min("Date").alias("first"),
        F.max("Date").alias("last"),
    )
    span = (F.unix_micros(F.max("last")) - F.unix_micros(F.min("first"))) / 86_400_000_000
    return per_run.agg(
        F.coalesce(F.sum("in_run"), F.lit(0)).alias("n_anomalies"),
        F.floor(F.try_divide(span, F.sum("in_run") - 1)).alias("mean_gap_days"),
        F.coalesce(F.sum("close_gaps"), F.lit(0)).alias("gaps_under_3_days"),
        F.coalesce(F.max("in_run"), F.lit(0)).alias("longest_run"),
    )


def price_position(df: DataFrame) -> DataFrame:
    """Share of anomalies with a close above the 90th or below the 25th percentile of all rows."""
    limits = exact_quantiles(df, ["Close"], [0.25, 0.90])
    low, high = (limits.select(F.col("quantiles")[i].alias("q")).scalar() for i in (0, 1))
    marked = anomalies(df).select(
        (F.col("Close") > high).cast("int").alias("above"), (F.col("Close") < low).cast("int").alias("below")
    )
    share = lambda c: F.coalesce(F.try_divide(F.sum(c) * 100, F.count(F.lit(1))), F.lit(0.0))
    return marked.agg(share("above").alias("high_price_pct"), share("below").alias("low_price_pct"))


def with_percentile_rank(rows: DataFrame, df: DataFrame, column: str, out: str) -> DataFrame:
    """Add to ``rows`` the mean percentile rank of their ``column`` among all rows of ``df``.

    Values of ``df`` are counted and summed up in order once, whatever the number of rows asked about.
    """
    table = ranked_values(df, column)
    total = F.lit(df.agg(F.count(name(column))).first()[0])
    ranks = table.select(F.col("value").alias("_value"), ((F.col("below") + F.col("upto") + 1) * 50.0 / total).alias(out))
    return rows.join(ranks, F.col(column).cast("double") == F.col("_value"), "left").drop("_value")


def percentile_ranks(df: DataFrame, column: str, values: Sequence[float]) -> dict[float, float]:
    """Mean percentile rank among the rows of ``df`` of each of a few values, which need not occur in it."""
    distinct = sorted(set(values))
    counts = [f(F.col(column), F.lit(v)) for v in distinct for f in (lambda c, v: F.count_if(c < v), lambda c, v: F.count_if(c <= v))]
    row = df.agg(F.count(column), *counts).first()
    pairs = {v: (row[1 + 2 * i], row[2 + 2 * i]) for i, v in enumerate(distinct)}
    return {v: (below + upto + (1 if below < upto else 0)) * 50.0 / row[0] for v, (below, upto) in pairs.items()}


def confidence(score: Column) -> Column:
    return F.when(score > HIGH_CONFIDENCE, "High").when(score > MEDIUM_CONFIDENCE, "Medium").otherwise("Low")


def with_change(df: DataFrame) -> DataFrame:
    """Change in percent from the bar before, per Symbol; taken before anything is filtered."""

    def build(d, w):
        before = F.lag("Close").over(w)
        return d.withColumn("change_pct", F.try_divide(F.col("Close") - before, before) * 100)

    return over_series(df, 1, build)


def explain_top(df: DataFrame, features: Sequence[str], k: int | None = EXPLAINED) -> DataFrame:
    """The ``k`` top anomalies, or all of them, with confidence, change and reasons.

    Rules for price, volume and range apply only to selected features.
    """
    uses_volume = "Volume" in features and "Volume" in df.columns
    uses_range = {"High", "Low"} <= set(features) and {"High", "Low"} <= set(df.columns)
    kept = [c for c in ("Symbol", "Date", "Open", "High", "Low", "Close", "Volume", "anomaly_score") if c in df.columns]
    top = cut_lineage(ranked(with_change(df), k).select(*kept, "change_pct"))

    rules = []
    for column, prefix, wanted in (("Close", "price", "Close" in features), ("Volume", "volume", uses_volume)):
        if wanted:
            top = with_percentile_rank(top, df, column, f"_{prefix}")
            rank = F.col(f"_{prefix}")
            rules.append((f"{prefix}_high", rank > HIGH_PERCENTILE, 100 - rank))
            rules.append((f"{prefix}_low", rank < LOW_PERCENTILE, rank))
    if uses_range:
        mean = df.agg(F.avg(F.col("High") - F.col("Low"))).first()[0]
        multiple = F.try_divide(F.col("High") - F.col("Low"), F.lit(mean).cast("double"))
        rules.append(("wide_range", multiple > RANGE_MULTIPLE, multiple))

    found = F.array_compact(
        F.array(
            *[
                F.when(
                    applies,
                    F.struct(
                        F.lit(code).alias("code"),
                        value.alias("value"),
                        F.format_string(REASON_TEXT[code], value).alias("text"),
                    ),
                )
                for code, applies, value in rules
            ]
        )
    )
    generic = F.array(
        F.struct(
            F.lit("pattern").alias("code"),
            F.lit(None).cast("double").alias("value"),
            F.lit(REASON_TEXT["pattern"]).alias("text"),
        )
    )
    reasons = F.when(F.size(found) > 0, found).otherwise(generic) if rules else generic
    told = top.withColumns({"confidence": confidence(F.col("anomaly_score")), "reasons": reasons}).drop("_price", "_volume")
    return told.orderBy(*ranking(told))
