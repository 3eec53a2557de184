"""Overviews of a table: summary, describe, missing values, histogram, correlation."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import name, numeric_columns
from barloom.operators.quantiles import exact_quantiles


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def symbols(df: DataFrame) -> DataFrame:
    return df.select("Symbol").distinct()


def symbol_slice(df: DataFrame, chosen: str | Sequence[str]) -> DataFrame:
    return df.filter(F.col("Symbol").isin([chosen] if isinstance(chosen, str) else list(chosen)))


def preview(df: DataFrame, n: int = 10, order: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    """The first ``n`` rows in a stable order."""
    return df.orderBy(*order).limit(n)


def overview(df: DataFrame) -> DataFrame:
    """Row count, date range and range of closes of the rows with a date."""
    return df.filter(F.col("Date").isNotNull()).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
        F.min("Close").alias("min_close"),
        F.max("Close").alias("max_close"),
    )


def stacked(df: DataFrame, rows: Sequence[dict[str, Column]]) -> DataFrame:
    """One aggregation pass whose results become several rows."""
    structs = [F.struct(*[value.alias(key) for key, value in row.items()]) for row in rows]
    return df.agg(F.array(*structs).alias("_rows")).select(F.inline("_rows"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max per numeric column."""
    columns = list(columns or numeric_columns(df))
    moments = stacked(
        df,
        [
            {
                "column": F.lit(c),
                "count": F.count(name(c)),
                "mean": F.avg(name(c).cast("double")),
                "std": F.stddev_samp(name(c).cast("double")),
                "min": F.min(name(c).cast("double")),
                "max": F.max(name(c).cast("double")),
            }
            for c in columns
        ],
    )
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "column", *[F.col("quantiles")[i].alias(q) for i, q in enumerate(("q25", "q50", "q75"))]
    )
    # both sides have one row per column
    return moments.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Null count and percentage per column."""
    return stacked(
        df,
        [
            {
                "column": F.lit(c),
                "missing": F.count_if(name(c).isNull()),
                "missing_pct": F.coalesce(F.try_divide(F.count_if(name(c).isNull()) * 100, F.count(F.lit(1))), F.lit(0.0)),
            }
            for c in data_columns(df)
        ],
    )


def column_info(df: DataFrame) -> DataFrame:
    """Type, counts of null and non-null values and null percentage per column."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return stacked(
        df,
        [
            {
                "column": F.lit(c),
                "type": F.lit(types[c]),
                "non_null": F.count(name(c)),
                "nulls": F.count_if(name(c).isNull()),
                "null_pct": F.round(
                    F.coalesce(F.try_divide(F.count_if(name(c).isNull()) * 100, F.count(F.lit(1))), F.lit(0.0)), 2
                ),
            }
            for c in data_columns(df)
        ],
    )


def histogram(df: DataFrame, column: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """Counts per equal-width bin (1-based), by class if asked; the maximum falls in the last bin."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    value = F.col(column).cast("double")
    if low is None:
        low = high = 0.0
    if low == high:
        place = F.lit(1)
    else:
        place = F.least(F.floor((value - F.lit(float(low))) / F.lit(float(high - low)) * bins) + 1, F.lit(bins))
    width = (float(high) - float(low)) / bins
    keys = [place.cast("int").alias("bin"), *([F.col(by)] if by else [])]
    counts = df.filter(value.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("bin_start", F.lit(float(low)) + (F.col("bin") - 1) * F.lit(width))


def plot_series(df: DataFrame, value: str = "Close", by: str | None = None) -> DataFrame:
    """Date, value and class split for a line with markers."""
    chosen = ["Symbol", "Date", F.col(value).alias("value")]
    return df.select(*chosen, *([by] if by else [])).filter(F.col("value").isNotNull())


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of all column pairs in one pass; null where a side is constant."""
    columns = list(columns or numeric_columns(df))
    values, rows = {}, []
    for x, y in itertools.combinations_with_replacement(columns, 2):
        both = name(x).isNotNull() & name(y).isNotNull()
        a, b = F.when(both, name(x).cast("double")), F.when(both, name(y).cast("double"))
        varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
        measured = F.lit(1.0) if x == y else F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
        values[f"{x}|{y}"] = F.when(varies, measured)
        rows += [(x, y, f"{x}|{y}")] if x == y else [(x, y, f"{x}|{y}"), (y, x, f"{x}|{y}")]
    once = df.agg(*[value.alias(pair) for pair, value in values.items()])
    cells = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), name(pair).alias("correlation")) for x, y, pair in rows]
    return once.select(F.inline(F.array(*cells)))

