"""How a table of series is spread over tasks.

A series is one ``Symbol`` ordered by ``Date``. While every series is known to be small,
windows run per Symbol: one exchange, one sort. When one Symbol is too long for a task,
``lay_out`` range-partitions the table by (Symbol, Date) into blocks of similar size
and stores it with a ``_block`` column. Operators then work per (Symbol, _block):

* windows that look back a fixed number of rows get those rows copied in from
  the blocks before (``over_series``);
* values carried over any distance travel through a table with one row per block
  (``block_summary``).

Both give the same result as an unsplit window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barloom.session import cut_lineage

BLOCK = "_block"
MAX_ROWS_CONF = "spark.barloom.maxSeriesRows"
MAX_ROWS = 1_000_000
BAR_SECONDS = "bar_seconds"
FITS = "series_rows_at_most"
HOUR = 3600


def max_rows(spark: SparkSession) -> int:
    """Most rows of one series, or of one final sort, that a task may take."""
    return int(spark.conf.get(MAX_ROWS_CONF, str(MAX_ROWS)))


def is_split(df: DataFrame) -> bool:
    return BLOCK in df.columns


def series_keys(df: DataFrame) -> list[str]:
    return ["Symbol", BLOCK] if is_split(df) else ["Symbol"]


def series_window(df: DataFrame) -> WindowSpec:
    """A series by date; rows of one date in file order, where it is known."""
    return Window.partitionBy(*series_keys(df)).orderBy("Date", *(c for c in ["_row"] if c in df.columns))


def trailing(window: WindowSpec, rows: int) -> WindowSpec:
    """The current row and the ``rows - 1`` before it."""
    return window.rowsBetween(-(rows - 1), 0)


def known_to_fit(df: DataFrame) -> bool:
    """Bars of an hour or more (a century per Symbol is under a million rows), or counted before.

    ``to_bars`` notes its interval on the Date column, and one bar per Symbol and
    interval is what its grouping guarantees.
    """
    known, limit = df.schema["Date"].metadata, max_rows(df.sparkSession)
    return known.get(FITS, limit + 1) <= limit or (known.get(BAR_SECONDS, 0) >= HOUR and limit >= MAX_ROWS)


def note_fit(df: DataFrame) -> DataFrame:
    """Record on Date that the series were counted and fit a task, for the steps that follow."""
    known = df.schema["Date"].metadata
    return df.withMetadata("Date", {**known, FITS: max_rows(df.sparkSession)})


def series_fit(df: DataFrame, trusted: bool = True) -> bool:
    """Whether every Symbol fits one task, by proof or else by counting.

    Not ``trusted`` means that rows may repeat, so the interval proves nothing.
    """
    if is_split(df) or (trusted and known_to_fit(df)):
        return True
    longest = df.groupBy("Symbol").count().agg(F.max("count")).first()[0] or 0
    return longest <= max_rows(df.sparkSession)


def lay_out(df: DataFrame) -> DataFrame:
    """``df`` as it is while its series fit, else range-split with a ``_block`` column.

    Expects one row per (Symbol, Date), so a block can end anywhere in a series.
    The split is materialised: block numbers stay the same when tasks run again.
    """
    if series_fit(df):
        return df
    return split(df)


def split(df: DataFrame) -> DataFrame:
    """Range-split a table whose series do not fit, unless it is split already."""
    if is_split(df):
        return df
    blocks = max(2, math.ceil(df.count() / max_rows(df.sparkSession)))
    # rows of one date may part, too: where windows would part them
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    order = [c for c in ("Symbol", "Date", "_row", "_tie") if c in tied.columns]
    ranged = tied.repartitionByRange(blocks, *order).withColumn(BLOCK, F.spark_partition_id())
    return cut_lineage(ranged.drop("_tie"))


def merge_blocks(df: DataFrame) -> DataFrame:
    """Forget the split."""
    return df.drop(BLOCK)


def block_summary(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row per (Symbol, _block) with its size, the rows before it and ``aggregates``.

    Its windows run per Symbol over blocks, not rows: at most one row per range partition.
    """
    order = Window.partitionBy("Symbol").orderBy(BLOCK)
    return (
        df.groupBy("Symbol", BLOCK)
        .agg(F.count(F.lit(1)).alias("_size"), *aggregates)
        .withColumn("_end", F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_before", F.col("_end") - F.col("_size"))
    )


def with_position(df: DataFrame) -> DataFrame:
    """Add ``_pos``, the 1-based place of each row in its whole series."""
    placed = df.withColumn("_pos", F.row_number().over(series_window(df)).cast("bigint"))
    if not is_split(df):
        return placed
    starts = block_summary(df).select("Symbol", BLOCK, "_before")
    return (
        placed.join(starts, ["Symbol", BLOCK])
        .withColumn("_pos", F.col("_pos") + F.col("_before"))
        .drop("_before")
    )


def with_history(df: DataFrame, rows: int) -> DataFrame:
    """Copy into each block the ``rows`` rows before it, marked by ``_halo``."""
    numbered = [F.col("_row").desc_nulls_last()] if "_row" in df.columns else []
    newest_first = Window.partitionBy("Symbol", BLOCK).orderBy(F.col("Date").desc(), *numbered)
    tails = df.withColumn("_from_end", F.row_number().over(newest_first)).filter(F.col("_from_end") <= rows)

    # A block's tail serves every later block that starts fewer than `rows` rows after it:
    # the successors of all blocks ending in [_end, _end + rows - 1].
    order = Window.partitionBy("Symbol").orderBy("_end")
    successor = F.struct(F.lead(BLOCK).over(order).alias("to"), F.col("_end").alias("start"))
    reach = (
        block_summary(df)
        .withColumn("_successor", successor)
        .withColumn("_served", F.collect_list("_successor").over(order.rangeBetween(0, rows - 1)))
        .select("Symbol", BLOCK, "_end", F.explode("_served").alias("_target"))
        .filter(F.col("_target.to").isNotNull())
    )
    halo = (
        tails.join(reach, ["Symbol", BLOCK])
        .filter(F.col("_from_end") + F.col("_target.start") - F.col("_end") <= rows)
        .withColumn(BLOCK, F.col("_target.to"))
        .drop("_from_end", "_end", "_target")
    )
    return df.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))


def over_series(
    df: DataFrame, rows: int, build: Callable[[DataFrame, WindowSpec], DataFrame]
) -> DataFrame:
    """Run ``build(df, window)``, whose windows look back at most ``rows`` rows."""
    df = lay_out(df)
    if not is_split(df):
        return build(df, series_window(df))
    padded = with_history(df, rows)
    return build(padded, series_window(padded)).filter(~F.col("_halo")).drop("_halo")
