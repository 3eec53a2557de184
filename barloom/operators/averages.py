"""Exponential averages over series with gaps.

Missing values take no part, yet time passes: the first value after ``k - 1`` missing rows blends with the average
before at the weights ``d^k`` and ``a`` (``a = 2 / (span + 1)``, ``d = 1 - a``), scaled to add up to one, and a missing row
shows the average so far. Without gaps that is the usual recursion.

Each row thus turns the average before into ``term + keep * average``, and a series is a chain of such steps. ``chain``
adds it up in window sums: inside a chunk every term is scaled back by the product of all ``keep`` before it, and chunks
end when that product has fallen so far (``WIDTH`` nats) that of earlier chunks only the one before is felt. A series
split over blocks is chained the same way twice, over the rows of every block and over one row per block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.layout import BLOCK, is_split, lay_out, series_keys, with_position
from barloom.session import cut_lineage

#: Nats per chunk; a step that keeps less than e^-FORGET of the average keeps nothing.
WIDTH, FORGET = 64, 800
#: Chunks are cut by sums of integers, so many to a nat, which are the same however often they are taken.
COARSE = 1 << 20


def chain(df: DataFrame, keys: list[str], by: str, ones: str, rest: str, term: str, rate: float, out: str) -> DataFrame:
    """Add ``out``: ``y[t] = term[t] + exp(-(ones[t] * rate + rest[t])) * y[t-1]`` along ``by``.

    ``ones`` is 0 or 1. A null term adds nothing; before the first term ``y`` is null. Also adds ``{out}_nats``, the sum
    of the exponents so far, or ``FORGET`` where it is so large that nothing before is felt.
    """
    chunk, since, local, before, first = (f"{out}_{x}" for x in ("chunk", "since", "local", "before", "first"))
    lost = F.col(ones) * F.lit(rate) + F.col(rest)
    upto = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(chunk, F.floor(F.sum(F.floor(lost * COARSE)).over(upto) / F.lit(WIDTH * COARSE)))
    within = Window.partitionBy(*keys, chunk).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*keys).orderBy(chunk, by)
    # the step into a chunk is kept apart, so that sums inside one stay small and exact
    df = df.withColumn(first, ~F.lag(chunk).over(along).eqNullSafe(F.col(chunk)))
    inside = lambda c: F.sum(F.when(F.col(first), F.lit(0.0)).otherwise(F.col(c))).over(within)
    df = df.withColumn(since, inside(ones) * F.lit(rate) + inside(rest))
    df = df.withColumn(local, F.exp(-F.col(since)) * F.sum(F.col(term) * F.exp(since)).over(within))
    # the last row of the chunk before, seen by every row of this one
    df = df.withColumns({before: F.lag(local).over(along), f"{out}_nats": F.col(since) + F.first(lost).over(within)})
    carried = F.exp(-F.col(f"{out}_nats")) * F.first(before).over(within)
    df = df.withColumn(out, plus(F.col(local), carried))
    near = F.when(F.col(chunk) == 0, F.col(f"{out}_nats")).otherwise(float(FORGET))
    return df.withColumn(f"{out}_nats", near).drop(chunk, since, local, before, first)


def plus(a: Column, b: Column) -> Column:
    """The sum of what is there; null when neither is."""
    return F.coalesce(a + b, a, b)


def last_valid(df: DataFrame, column: str) -> Column:
    """The place of the nearest valid value before each row of its block."""
    over = f"OVER (PARTITION BY {', '.join(series_keys(df))} ORDER BY _pos)"
    return F.expr(f"lag(CASE WHEN `{column}` IS NOT NULL THEN _pos END, 1) IGNORE NULLS {over}")


def average(df: DataFrame, column: str, span: int, out: str) -> DataFrame:
    """Add one exponential average to a table that has been laid out and has ``_pos``."""
    share = 2 / (span + 1)
    rate = -math.log1p(-share) if span > 1 else 0.0
    df = df.withColumn("_seen", last_valid(df, column))
    if is_split(df):
        ends = df.groupBy("Symbol", BLOCK).agg(F.max(F.when(F.col(column).isNotNull(), F.col("_pos"))).alias("_end"))
        earlier = Window.partitionBy("Symbol").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("Symbol", BLOCK, F.max("_end").over(earlier).alias("_end"))
        df = df.join(ends, ["Symbol", BLOCK]).withColumn("_seen", F.coalesce("_seen", "_end")).drop("_end")
    x, k = F.col(column), F.col("_pos") - F.col("_seen")
    faded = F.exp(-k * F.lit(rate)) if span > 1 else F.lit(0.0)
    keep = faded / (faded + share)
    lost = F.when(keep > 0, F.least(-F.ln(keep), F.lit(float(FORGET)))).otherwise(float(FORGET))
    valid, first = x.isNotNull(), F.col("_seen").isNull()
    steady = valid & (k == 1) & F.lit(span > 1)
    df = df.withColumns(
        {
            "_ones": F.when(steady, 1).otherwise(0),
            "_rest": F.when(valid & ~first & ~steady, lost).otherwise(0.0),
            "_term": F.when(first, x).when(steady, x * share).otherwise(x * share / (faded + share)),
        }
    ).drop("_seen")
    df = chain(df, series_keys(df), "_pos", "_ones", "_rest", "_term", rate, out)
    if is_split(df):
        df = across_blocks(cut_lineage(df), out)
    return df.drop("_ones", "_rest", "_term", f"{out}_nats")


def across_blocks(df: DataFrame, out: str) -> DataFrame:
    """Add to the averages of each block what the blocks before leave of theirs."""
    nats = f"{out}_nats"
    known = F.when(F.col(out).isNotNull(), F.col("_pos"))
    ends = df.groupBy("Symbol", BLOCK).agg(F.max_by(out, known).alias("_term"), F.max(nats).alias("_rest")).withColumn("_ones", F.lit(0))
    blocks = chain(ends, ["Symbol"], BLOCK, "_ones", "_rest", "_term", 0.0, "_whole")
    prior = blocks.select("Symbol", BLOCK, F.lag("_whole").over(Window.partitionBy("Symbol").orderBy(BLOCK)).alias("_prior"))
    return df.join(prior, ["Symbol", BLOCK]).withColumn(out, plus(F.col(out), F.exp(-F.col(nats)) * F.col("_prior"))).drop("_prior")


def with_averages(df: DataFrame, column: str, spans: dict[str, int]) -> DataFrame:
    """Lay out the table and add an average of ``column`` for each name and span."""
    df = with_position(lay_out(df))
    for out, span in spans.items():
        df = average(df, column, span, out)
    return df.drop("_pos")


def with_convergence(df: DataFrame) -> DataFrame:
    """Add MACD, its signal line and their difference, whatever is missing in Close."""
    df = with_position(lay_out(df))
    df = average(average(df, "Close", 12, "_fast"), "Close", 26, "_slow")
    df = average(df.withColumn("MACD", F.col("_fast") - F.col("_slow")), "MACD", 9, "MACD_Signal")
    return df.withColumn("MACD_Hist", F.col("MACD") - F.col("MACD_Signal")).drop("_fast", "_slow", "_pos")
