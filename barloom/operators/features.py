"""Indicator columns per Symbol: price, volume, volatility, technical, calendar.

All windows count rows. Every function is ``op(df, ...) -> DataFrame`` and keeps the input
columns. The ``*_columns`` functions only write expressions over a window that the layout
hands them, so ``engineer`` evaluates all groups on one exchange and few passes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barloom.functions.columns import ratio_change, rolling_correlation, rolling_mean, rolling_std
from barloom.operators.averages import with_averages, with_convergence
from barloom.operators.cleaning import fill
from barloom.operators.layout import lay_out, over_series, series_keys, trailing

LONGEST_WINDOW = 30
NEGLIGIBLE = 1e-24


def needs(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def price_columns(df: DataFrame, w: WindowSpec) -> dict[str, Column]:
    close, before = F.col("Close"), F.lag("Close").over(w)
    new = {
        "Daily_Return": ratio_change(close, before),
        "Log_Return": F.ln(F.try_divide(close, before)),
        **{f"MA{n}": rolling_mean(close, trailing(w, n), n) for n in (5, 10, 20)},
        **{f"Price_Momentum_{n}d": close - F.lag("Close", n).over(w) for n in (1, 5)},
    }
    if needs(df, "Open"):
        new["Price_Gap"] = F.col("Open") - before
    if needs(df, "High", "Low"):
        new["HL_Range"] = F.col("High") - F.col("Low")
        new["HL_Range_Pct"] = F.try_divide(F.col("High") - F.col("Low"), close)
    return new


def volume_columns(w: WindowSpec) -> dict[str, Column]:
    volume = F.col("Volume")
    means = {n: rolling_mean(volume, trailing(w, n), n) for n in (5, 10)}
    return {
        "Volume_Change": ratio_change(volume, F.lag("Volume").over(w)),
        **{f"Volume_MA{n}": mean for n, mean in means.items()},
        "Volume_Ratio_MA5": F.try_divide(volume, means[5]),
        "Price_Volume_Corr": rolling_correlation(F.col("Close"), volume, trailing(w, 5), 5),
    }


def range_columns(df: DataFrame, w: WindowSpec) -> dict[str, Column]:
    """True range, null on the first row of a series: greatest() alone would skip the null."""
    if not needs(df, "High", "Low"):
        return {}
    high, low, before = F.col("High"), F.col("Low"), F.lag("Close").over(w)
    reach = F.greatest(high - low, F.abs(high - before), F.abs(low - before))
    return {"TR": F.when(before.isNotNull() & high.isNotNull() & low.isNotNull(), reach)}


def volatility_columns(df: DataFrame, w: WindowSpec) -> dict[str, Column]:
    """Of columns made before: Daily_Return and, where there is one, TR."""
    new = {f"Volatility_{n}d": rolling_std(F.col("Daily_Return"), trailing(w, n), n) for n in (5, 10)}
    if needs(df, "TR"):
        new["ATR_5d"] = rolling_mean(F.col("TR"), trailing(w, 5), 5)
    return new


def delta_column(w: WindowSpec) -> dict[str, Column]:
    """Change of the close; the first of a series counts as 0."""
    return {"_delta": F.coalesce(F.col("Close") - F.lag("Close").over(w), F.lit(0.0))}


def strength_columns(w: WindowSpec, rows: int) -> dict[str, Column]:
    zero, delta = F.lit(0.0), F.col("_delta")
    return {
        "_gain": rolling_mean(F.greatest(delta, zero), trailing(w, rows), rows),
        "_loss": rolling_mean(F.greatest(-delta, zero), trailing(w, rows), rows),
    }


def with_rsi(df: DataFrame) -> DataFrame:
    value = F.when((F.col("_loss") == 0) & (F.col("_gain") > 0), 100.0).otherwise(
        100 - 100 / (1 + F.try_divide("_gain", "_loss"))
    )
    return df.withColumn("RSI", value).drop("_delta", "_gain", "_loss")


def band_columns(w: WindowSpec, rows: int) -> dict[str, Column]:
    close, span = F.col("Close"), trailing(w, rows)
    return {"BB_Middle": rolling_mean(close, span, rows), "BB_Std": rolling_std(close, span, rows)}


def with_bands(df: DataFrame) -> DataFrame:
    middle, deviation = F.col("BB_Middle"), F.col("BB_Std")
    return df.withColumns(
        {
            "BB_Upper": middle + 2 * deviation,
            "BB_Lower": middle - 2 * deviation,
            "BB_Width": F.try_divide((middle + 2 * deviation) - (middle - 2 * deviation), middle),
        }
    )


def decay(span: int) -> float:
    return 1 - 2 / (span + 1)


def ema_reach(span: int) -> int:
    """Rows after which a value's weight in the average is below ``NEGLIGIBLE``."""
    return 1 if span == 1 else math.ceil(math.log(NEGLIGIBLE) / math.log(decay(span)))


def with_slots(df: DataFrame, w: WindowSpec, reach: int) -> DataFrame:
    """Number the rows of a series and cut them into chunks of ``reach`` rows."""
    df = df.withColumn("_at", F.row_number().over(w) - 1)
    return df.withColumns({"_chunk": F.floor(F.col("_at") / reach), "_slot": F.col("_at") % reach})


def blend(df: DataFrame, averages: dict[str, tuple[str, int]], reach: int) -> DataFrame:
    """Exponential averages ``y[0] = x[0]; y[t] = a*x[t] + (1-a)*y[t-1]`` as running sums.

    Chunks are no shorter than the reach of the longest span. Inside one,
    ``y[p] = a * d^p * sum(x[i] * d^-i)`` with d = 1-a; from before it only the end of
    the previous chunk matters, as anything older weighs less than ``NEGLIGIBLE``.
    For closes without gaps, in the one pass of ``engineer``; ``averages`` takes any.
    """
    keys = series_keys(df)
    # the same sort order serves both windows
    within = Window.partitionBy(*keys, "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_chunk", "_at")
    so_far = across.rowsBetween(Window.unboundedPreceding, 0)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)

    local, blended = {}, {}
    for out, (column, span) in averages.items():
        x, d = F.col(column), decay(span)
        if d == 0:
            blended[out] = x
            continue
        weighted = F.when(F.col("_at") == 0, x / (1 - d)).otherwise(x) * F.pow(F.lit(d), -F.col("_slot"))
        local[f"_local_{out}"] = (1 - d) * F.pow(F.lit(d), F.col("_slot")) * F.sum(weighted).over(within)
        own = F.col(f"_local_{out}")
        carried = F.last(F.when(F.col("_slot") == reach - 1, own), ignorenulls=True).over(earlier)
        total = own + F.coalesce(F.pow(F.lit(d), F.col("_slot") + 1) * carried, F.lit(0.0))
        blended[out] = F.when(F.count_if(x.isNull()).over(so_far) == 0, total)
    return df.withColumns(local).withColumns(blended).drop(*local)


SLOTS = ("_at", "_chunk", "_slot")


def slot_window(df: DataFrame) -> WindowSpec:
    """A series in the order the averages need, which is also its order by date."""
    return Window.partitionBy(*series_keys(df)).orderBy("_chunk", "_at")


def with_macd(df: DataFrame, reach: int) -> DataFrame:
    df = blend(df, {"_ema12": ("Close", 12), "_ema26": ("Close", 26)}, reach)
    df = df.withColumn("MACD", F.col("_ema12") - F.col("_ema26"))
    df = blend(df, {"MACD_Signal": ("MACD", 9)}, reach)
    return df.withColumn("MACD_Hist", F.col("MACD") - F.col("MACD_Signal")).drop("_ema12", "_ema26")


MACD_REACH = ema_reach(26) + ema_reach(9)


def price_features(df: DataFrame) -> DataFrame:
    """Returns, moving averages, momentum, gap and range."""
    return over_series(df, LONGEST_WINDOW, lambda d, w: d.withColumns(price_columns(d, w)))


def volume_features(df: DataFrame) -> DataFrame:
    """Volume change, averages and its correlation with price; nothing without Volume."""
    if not needs(df, "Volume"):
        return df
    return over_series(df, LONGEST_WINDOW, lambda d, w: d.withColumns(volume_columns(w)))


def volatility_features(df: DataFrame) -> DataFrame:
    """Return deviation, true range and its average."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumns({"Daily_Return": price_columns(d, w)["Daily_Return"], **range_columns(d, w)})
        return d.withColumns(volatility_columns(d, w))

    return over_series(df, LONGEST_WINDOW, build)


def rsi(df: DataFrame, rows: int = 14) -> DataFrame:
    """Relative strength from simple means of gains and losses."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return with_rsi(d.withColumns(delta_column(w)).withColumns(strength_columns(w, rows)))

    return over_series(df, rows + 1, build)


def bollinger(df: DataFrame, rows: int = 20) -> DataFrame:
    return over_series(df, rows, lambda d, w: with_bands(d.withColumns(band_columns(w, rows))))


def ema(df: DataFrame, column: str, span: int, out: str) -> DataFrame:
    """The exponential average of a column; missing values take no part in it but let time pass."""
    return with_averages(df, column, {out: span})


def macd(df: DataFrame) -> DataFrame:
    """MACD of the closes, its signal line and their difference, over gaps as well."""
    return with_convergence(df)


def technical_features(df: DataFrame) -> DataFrame:
    """RSI, MACD and Bollinger bands."""
    return bollinger(rsi(macd(df)))


def date_features(df: DataFrame) -> DataFrame:
    """Weekday (Monday = 0), month and quarter."""
    date = F.col("Date")
    return df.withColumns(
        {"day_of_week": F.weekday(date), "month": F.month(date), "quarter": F.quarter(date)}
    )


def eda_features(df: DataFrame) -> DataFrame:
    """Percentage returns over forward-filled closes and the 7- and 30-row means."""
    padded = fill(lay_out(df).withColumn("_padded", F.col("Close")), ["_padded"], "pad")

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        change = ratio_change(F.col("_padded"), F.lag("_padded").over(w)) * 100
        means = {f"MA{n}": rolling_mean(F.col("Close"), trailing(w, n), n) for n in (7, 30)}
        return d.withColumns({"Returns": change, **means}).drop("_padded")

    return over_series(padded, LONGEST_WINDOW, build)


def evaluation_features(df: DataFrame) -> DataFrame:
    """Return, two means and return deviation, back-filled; what stays missing is 0."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("return", F.coalesce(ratio_change(F.col("Close"), F.lag("Close").over(w)), F.lit(0.0)))
        return d.withColumns(
            {
                "ma5": rolling_mean(F.col("Close"), trailing(w, 5), 5),
                "ma20": rolling_mean(F.col("Close"), trailing(w, 20), 20),
                "volatility": rolling_std(F.col("return"), trailing(w, 20), 20),
            }
        )

    filled = fill(over_series(df, LONGEST_WINDOW, build), ["ma5", "ma20", "volatility"], "back")
    return filled.na.fill(0.0)


def engineer(
    df: DataFrame, drop_incomplete: bool = True, with_volume: bool | None = None, gaps: bool | None = None
) -> DataFrame:
    """All indicator groups on one exchange, then only complete rows.

    Groups whose inputs are missing are left out. Volume counts as missing when it is null
    throughout (``with_volume``, looked up unless given), so that it does not empty the table.
    Closes with ``gaps`` (looked up unless given) get their averages in passes of their own.
    """
    if gaps is None:
        gaps = not df.filter(F.col("Close").isNull()).isEmpty()
    if with_volume is None:
        with_volume = needs(df, "Volume") and not df.filter(F.col("Volume").isNotNull()).isEmpty()

    reach = ema_reach(26)

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        # narrow rows are sorted once for the averages; every other window takes that order
        d = with_slots(d, w, reach)
        w = slot_window(d)
        d = d.withColumns(
            {
                **price_columns(d, w),
                **(volume_columns(w) if with_volume else {}),
                **range_columns(d, w),
                **delta_column(w),
                **band_columns(w, 20),
            }
        )
        d = d.withColumns({**volatility_columns(d, w), **strength_columns(w, 14)})
        return with_bands(with_rsi(d if gaps else with_macd(d, reach))).drop(*SLOTS)

    featured = over_series(df, LONGEST_WINDOW if gaps else MACD_REACH + LONGEST_WINDOW, build)
    if gaps:
        featured = with_convergence(featured)
    return drop_missing(featured, ignore=[] if with_volume else ["Volume"]) if drop_incomplete else featured


def drop_missing(df: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Drop rows with a null in any column but the ignored ones."""
    return df.na.drop(subset=[c for c in df.columns if c not in (ignore or [])])


def breakouts(df: DataFrame) -> DataFrame:
    """Rows whose close leaves its Bollinger band."""
    outside: Column = (F.col("Close") > F.col("BB_Upper")) | (F.col("Close") < F.col("BB_Lower"))
    return bollinger(df).filter(outside)
