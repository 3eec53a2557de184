"""Exact quantiles of groups of any size.

``percentile`` gathers the values of a group in one task. That is fine up to a bound; in
larger groups a sketch first brackets the wanted order statistics, and one pass counts the
values inside the brackets and the rows between them, which gives the exact values. Ranks that a
bracket misses, or whose brackets hold too much for a task, are found by radix selection: every
double has a 64-bit code of the same order, and each pass counts the next 16 bits of the values
that still agree with a wanted rank's. Four passes settle any data; fewer do once what is left
fits a task. Counts add up before their shuffle, so no value or group is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import name, not_nan
from barloom.operators.layout import max_rows
from barloom.session import cut_lineage

#: Bits a pass settles, of 64.
DIGIT = 16
#: Tables of at most so many rows (about 100 bytes each) are broadcast, larger ones joined by shuffle.
BROADCAST_ROWS = 50_000
#: A sketch is off by at most one in so many rows.
SKETCH = 10_000


def long_values(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per non-null number: the keys, ``column`` and ``value``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), not_nan(name(c)).alias("value")) for c in columns])
    return df.select(*keys, F.inline(pairs)).filter(F.col("value").isNotNull())


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles: rows of (keys, column, n, quantiles).

    ``quantiles`` is an array in the order of ``probabilities``.
    """
    values = long_values(df, columns, keys)
    group = [*keys, "column"]
    limit = max_rows(df.sparkSession)
    counts = cut_lineage(df.groupBy(*keys).agg(*[F.count(not_nan(name(c))).alias(f"_{i}") for i, c in enumerate(columns)]))
    largest = counts.agg(F.max(F.greatest(*[f"_{i}" for i in range(len(columns))], F.lit(0)))).first()[0] or 0
    if largest <= limit:
        return within_tasks(values, group, probabilities)
    sizes = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n")) for i, c in enumerate(columns)])
    sizes = counts.select(*keys, F.inline(sizes)).filter(F.col("n") > 0)
    long = sent(cut_lineage(sizes.filter(F.col("n") > limit)))
    if sizes.filter(F.col("n") <= limit).isEmpty():
        return by_narrowing(values, long, group, probabilities, limit)
    small = within_tasks(values.join(long.select(*group), group, "left_anti"), group, probabilities)
    return small.unionByName(by_narrowing(values, long, group, probabilities, limit))


def within_tasks(values: DataFrame, group: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    return values.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("value", F.array(*[F.lit(float(p)) for p in probabilities])).alias("quantiles"),
    )


def by_narrowing(
    values: DataFrame, sizes: DataFrame, group: Sequence[str], probabilities: Sequence[float], limit: int
) -> DataFrame:
    places = F.array(
        *[
            F.struct(F.lit(i).alias("place"), ((F.col("n") - 1) * F.lit(float(p))).alias("at"))
            for i, p in enumerate(probabilities)
        ]
    )
    wanted = sizes.select(*group, "n", F.inline(places))
    # the two order statistics (1-based) that a quantile lies between
    ranks = wanted.select(
        *group,
        F.explode(F.array_distinct(F.array(F.floor("at") + 1, F.ceil("at") + 1))).alias("rank"),
    ).distinct()
    ranks = cut_lineage(ranks)
    found = cut_lineage(bracketed(values, sizes, ranks, group, probabilities, limit))
    missed = ranks.join(found, [*group, "rank"], "left_anti")
    if not missed.isEmpty():
        found = found.unionByName(order_statistics(values, missed, group, limit))
    sides = wanted.select("*", (F.floor("at") + 1).alias("_low"), (F.ceil("at") + 1).alias("_high"))
    low = found.select(*group, F.col("rank").alias("_low"), F.col("value").alias("_lower"))
    high = found.select(*group, F.col("rank").alias("_high"), F.col("value").alias("_upper"))
    share = F.col("at") - F.floor("at")
    between = F.col("_lower") + (F.col("_upper") - F.col("_lower")) * share
    return (
        sides.join(low, [*group, "_low"])
        .join(high, [*group, "_high"])
        .groupBy(*group, "n")
        .agg(F.sort_array(F.collect_list(F.struct("place", between.alias("q")))).alias("_all"))
        .select(*group, "n", F.col("_all.q").alias("quantiles"))
    )


def bracketed(values: DataFrame, sizes: DataFrame, ranks: DataFrame, group: Sequence[str], probabilities: Sequence[float], limit: int) -> DataFrame:
    """Those of the order statistics that brackets from a sketch hold: rows of (group, rank, value), exact.

    Values outside all brackets are only counted, by the cell between edges that they lie in. Cells follow the order
    of the values, and a cell lies wholly inside or outside the brackets.
    """
    # ranks and the sketch's round differently, by less than two rows of a group of more than ``limit``
    reach = 2 / SKETCH + 2 / limit
    lows = [max(0.0, p - reach) for p in probabilities]
    highs = [min(1.0, p + reach) for p in probabilities]
    edges = F.percentile_approx("value", [*lows, *highs], SKETCH)
    known = values.join(sizes.select(*group), group, "left_semi").groupBy(*group).agg(edges.alias("_edges"))
    names = [f"_edge{i}" for i in range(2 * len(probabilities))]
    known = sent(cut_lineage(known.select(*group, *[F.col("_edges")[i].alias(c) for i, c in enumerate(names)])))
    value = F.col("value")
    begun = sum((F.col(c) <= value).cast("int") for c in names[: len(probabilities)])
    ended = sum((F.col(c) < value).cast("int") for c in names[len(probabilities) :])
    placed = values.join(known, group).select(*group, (begun + ended).alias("_cell"), F.when(begun > ended, value).alias("value"))
    counts = cut_lineage(placed.groupBy(*group, "_cell", "value").agg(F.count(F.lit(1)).alias("_n")))
    fit = sent(cut_lineage(counts.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= limit).select(*group)))
    order = Window.partitionBy(*group).orderBy("_cell", "value").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.join(fit, group, "left_semi").withColumn("_upto", F.sum("_n").over(order))
    found = containing(ranks.withColumn("_need", F.col("rank")).join(upto, group))
    return found.filter(value.isNotNull()).select(*group, "rank", "value")


def order_code(value: Column) -> Column:
    """A bigint in the order of the doubles: the bits of IEEE 754, negated below zero. 0.0 and -0.0 share a code."""

    @F.pandas_udf("bigint")
    def code(values: pd.Series) -> pd.Series:
        bits = values.to_numpy(np.float64).view(np.int64)
        codes = np.where(bits < 0, -(bits & np.iinfo(np.int64).max), bits)
        return pd.Series(codes).astype("Int64").mask(values.isna().to_numpy())

    return code(value.cast("double"))


def sent(table: DataFrame) -> DataFrame:
    """Mark a stored table for broadcast while it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def order_statistics(values: DataFrame, ranks: DataFrame, group: Sequence[str], limit: int) -> DataFrame:
    """The ``rank``-th smallest value per group: rows of (group, rank, value).

    Needs ``value``, and orders by ``_code`` where the values bring one. Ranks whose values agree so far share
    one bracket of codes and its counts.
    """
    if "_code" not in values.columns:
        values = values.withColumn("_code", order_code(F.col("value")))
    bracket = [*group, "_prefix"]
    state = cut_lineage(ranks.select(*group, "rank", F.col("rank").alias("_need"), F.lit(0).cast("bigint").alias("_prefix")))
    settled = 64
    while settled:
        inside = within(values, state, bracket, group, settled)
        settled -= DIGIT
        counts = inside.groupBy(*bracket, F.shiftright("_code", settled).alias("_next")).agg(F.count(F.lit(1)).alias("_n"))
        # at most 2^16 rows per bracket
        order = Window.partitionBy(*bracket).orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
        state = cut_lineage(
            containing(state.join(counts.withColumn("_upto", F.sum("_n").over(order)), bracket)).select(
                *group, "rank", (F.col("_need") - (F.col("_upto") - F.col("_n"))).alias("_need"), F.col("_next").alias("_prefix"), "_n"
            )
        )
        widest = state.agg(F.max("_n")).first()[0] or 0
        state = state.drop("_n")
        if widest <= limit:
            break
    copies = within(values, state, bracket, group, settled).groupBy(*bracket, "_code").agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("value"))
    order = Window.partitionBy(*bracket).orderBy("_code").rowsBetween(Window.unboundedPreceding, 0)
    found = containing(state.join(copies.withColumn("_upto", F.sum("_n").over(order)), bracket))
    return found.select(*group, "rank", "value")


def within(values: DataFrame, state: DataFrame, bracket: Sequence[str], group: Sequence[str], settled: int) -> DataFrame:
    """The values whose codes agree with a bracket in all but the last ``settled`` bits."""
    prefix = F.lit(0).cast("bigint") if settled == 64 else F.shiftright("_code", settled)
    brackets = cut_lineage(state.select(*bracket).distinct())
    return values.withColumn("_prefix", prefix).join(sent(brackets), bracket)


def containing(counted: DataFrame) -> DataFrame:
    """The rows whose count takes the running total up to the wanted rank."""
    return counted.filter((F.col("_need") <= F.col("_upto")) & (F.col("_need") > F.col("_upto") - F.col("_n")))


def ranked_values(df: DataFrame, column: str) -> DataFrame:
    """Every distinct value with the rows below it and up to it: (value, below, upto).

    Values are counted first, so copies never meet; the counts are range-partitioned and added up per
    partition, and one row per partition says what lies before it.
    """
    counts = df.select(not_nan(name(column)).alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut_lineage(counts.repartitionByRange("value").withColumn("_part", F.spark_partition_id()))
    order = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sorted(tuple(r) for r in ranged.groupBy("_part").agg(F.sum("_n")).collect())  # one row per partition
    starts, before = [], 0
    for part, n in sizes:
        starts.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    placed = ranged.withColumn("upto", F.sum("_n").over(order)).join(F.broadcast(starts), "_part")
    return placed.select("value", (F.col("upto") - F.col("_n") + F.col("_start")).alias("below"), (F.col("upto") + F.col("_start")).alias("upto"))


def table_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float]:
    """Quantiles of one column of the whole table; empty when it has no value."""
    row = exact_quantiles(df, [column], probabilities).first()
    return list(row["quantiles"]) if row else []
