"""Ticks to open/high/low/close/volume bars, and fine bars to coarse ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import not_nan
from barloom.operators.layout import BAR_SECONDS

# Calendar units of date_trunc and a lower bound of their length in seconds.
CALENDAR = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2419200, "quarter": 7776000}
# Unit lengths for multiples such as "5 minutes".
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def interval(every: str) -> tuple[int, str]:
    count, unit = every.split()
    return int(count), unit.rstrip("s")


def bar_start(ts: Column, every: str) -> Column:
    """The start of the bar ``ts`` falls in: calendar units, or multiples as windows."""
    count, unit = interval(every)
    if count == 1 and unit in CALENDAR:
        return F.date_trunc(unit, ts)
    return F.window(ts, every)["start"]


def interval_seconds(every: str) -> int:
    count, unit = interval(every)
    return CALENDAR[unit] if count == 1 and unit in CALENDAR else count * SECONDS[unit]


def arrival(df: DataFrame, order_by: Sequence[str]) -> Column:
    """One sortable value for the tie-break columns.

    Ordering by a struct makes ``min_by`` sort its input; one scalar keeps the hash
    aggregate. So a timestamp and a whole number share one decimal(38,0).
    """
    if len(order_by) == 1:
        return F.col(order_by[0])
    types = [df.schema[c].dataType for c in order_by]
    times = (T.TimestampType, T.TimestampNTZType)
    if len(order_by) == 2 and isinstance(types[0], times) and isinstance(types[1], T.IntegralType):
        micros = F.unix_micros(F.col(order_by[0]).cast("timestamp")).cast("decimal(18,0)")
        # the shift makes every bigint positive and below 10^20
        serial = F.col(order_by[1]).cast("decimal(19,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")
        return micros * F.lit("100000000000000000000").cast("decimal(21,0)") + serial
    return F.struct(*order_by)


def to_bars(
    df: DataFrame,
    ts: str,
    price: str,
    symbol: str,
    every: str = "1 day",
    quantity: str | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Aggregate ticks to bars: first, highest, lowest and last price and the volume.

    Ticks without a time or a price, NaN included, count for nothing. Without ``quantity`` the volume counts ticks. ``order_by`` decides first and last and
    should be unique per bar. Partial aggregation leaves one row per bar and map task, so a
    hot symbol does not skew the shuffle.
    """
    order = arrival(df, order_by or [ts])
    start = bar_start(F.col(ts).cast("timestamp"), every)
    volume = F.sum(F.col(quantity).cast("double")) if quantity else F.count(F.lit(1)).cast("double")
    bars = (
        df.filter(F.col(price).isNotNull() & F.col(ts).isNotNull() & not_nan(F.col(price)).isNotNull())
        .select(
            F.coalesce(F.col(symbol).cast("string"), F.lit("UNKNOWN")).alias("Symbol"),
            start.alias("Date"),
            F.col(price).cast("double").alias("_price"),
            order.alias("_order"),
            *([F.col(quantity)] if quantity else []),
        )
        .groupBy("Symbol", "Date")
        .agg(
            F.min_by("_price", "_order").alias("Open"),
            F.max("_price").alias("High"),
            F.min("_price").alias("Low"),
            F.max_by("_price", "_order").alias("Close"),
            volume.alias("Volume"),
        )
    )
    return note_interval(bars, every)


def note_interval(bars: DataFrame, every: str) -> DataFrame:
    """Record on Date that there is one bar per Symbol and interval."""
    return bars.withMetadata("Date", {BAR_SECONDS: interval_seconds(every)})


def rebucket(bars: DataFrame, every: str) -> DataFrame:
    """Combine bars into longer ones."""
    kept = [c for c in ("Open", "High", "Low", "Close", "Adj_Close", "Volume") if c in bars.columns]
    combine = {
        "Open": F.min_by("Open", "_date"),
        "High": F.max("High"),
        "Low": F.min("Low"),
        "Close": F.max_by("Close", "_date"),
        "Adj_Close": F.max_by("Adj_Close", "_date"),
        "Volume": F.sum("Volume"),
    }
    wide = (
        bars.withColumnRenamed("Date", "_date")
        .groupBy("Symbol", bar_start(F.col("_date").cast("timestamp"), every).alias("Date"))
        .agg(*[combine[c].alias(c) for c in kept])
    )
    return note_interval(wide, every)
