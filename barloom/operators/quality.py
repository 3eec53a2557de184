"""Coercion, validation and the data quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import DATE_FORMATS, name, not_nan, to_number, to_timestamp
from barloom.operators.cleaning import value_columns

# Canonical columns.
REQUIRED = ("Date", "Open", "High", "Low", "Close")
OPTIONAL = ("Adj_Close", "Volume", "Symbol")
UNKNOWN = "UNKNOWN"
# Why a row is left out, in the order of the checks.
REASONS = ("no_date", "bad_date", "no_close", "bad_close")


def coerce_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Money and number text to doubles; what does not parse is null."""
    numbers = {}
    for c in columns or value_columns(df):
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        numbers[c] = to_number(name(c)) if is_text else not_nan(name(c))
    return df.withColumns(numbers)


def coerce_dates(df: DataFrame, column: str = "Date", formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Text to timestamps; rows whose date does not parse are dropped."""
    kind = df.schema[column].dataType
    parsed = to_timestamp(name(column), formats) if isinstance(kind, T.StringType) else name(column).cast("timestamp")
    return df.withColumn(column, parsed).filter(F.col(column).isNotNull())


def reason(df: DataFrame) -> Column:
    """Why a row of mapped columns can't be used: the first of ``REASONS`` that holds, null for a usable row.

    Text that holds no date or number is told apart from a missing value; blanks are missing.
    """

    def text(c: str) -> Column:
        return F.trim(F.col(c).cast("string"))

    parsed = to_timestamp(F.col("Date")) if isinstance(df.schema["Date"].dataType, T.StringType) else F.col("Date").cast("timestamp")
    number = to_number(F.col("Close")) if isinstance(df.schema["Close"].dataType, T.StringType) else not_nan(F.col("Close"))
    return (
        F.when(F.coalesce(text("Date"), F.lit("")) == "", REASONS[0])
        .when(parsed.isNull(), REASONS[1])
        .when(F.coalesce(text("Close"), F.lit("")).isin("", "NaN"), REASONS[2])
        .when(number.isNull(), REASONS[3])
    )


def watched(df: DataFrame, watch: Observation) -> DataFrame:
    """Count mapped rows by their fate while they pass: ``rows`` and one number for each of ``REASONS``.

    The counts cost no pass of their own; ``watch.get`` has them once an action has read the table.
    """
    why = reason(df)
    counts = [F.count_if(F.coalesce(why == r, F.lit(False))).alias(r) for r in REASONS]
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *counts)


def drop_invalid_close(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Close").isNotNull())


def with_defaults(df: DataFrame, symbol: str = UNKNOWN) -> DataFrame:
    """Add Adj_Close (= Close), Volume (null) and Symbol where absent; name null symbols."""
    new = {}
    if "Adj_Close" not in df.columns and "Close" in df.columns:
        new["Adj_Close"] = F.col("Close")
    if "Volume" not in df.columns:
        new["Volume"] = F.lit(None).cast("double")
    known = F.col("Symbol").cast("string") if "Symbol" in df.columns else F.lit(None).cast("string")
    new["Symbol"] = F.coalesce(known, F.lit(symbol))
    return df.withColumns(new)


def validate(df: DataFrame) -> DataFrame:
    """Warnings as rows ``(column, check, n_bad)``, from the schema and one pass.

    ``n_bad`` counts the rows a check fails for, and is -1 for a missing column.
    """
    checks = [(c, "missing_column", F.lit(-1).cast("bigint")) for c in REQUIRED if c not in df.columns]
    if "Date" in df.columns and isinstance(df.schema["Date"].dataType, T.StringType):
        bad = F.col("Date").isNotNull() & to_timestamp(F.col("Date")).isNull()
        checks.append(("Date", "unparseable_date", F.count_if(bad)))
    for c in value_columns(df):
        if not isinstance(df.schema[c].dataType, T.NumericType):
            text = F.col(c).cast("string")
            checks.append((c, "not_numeric", F.count_if(text.isNotNull() & text.try_cast("double").isNull())))
    checks += [(c, "has_nulls", F.count_if(F.col(c).isNull())) for c in REQUIRED if c in df.columns]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(check).alias("check"), count.alias("n_bad"))
            for c, check, count in checks
        ]
    )
    return df.agg(rows.alias("_checks")).select(F.inline("_checks")).filter(F.col("n_bad") != 0)


def quality_report(df: DataFrame) -> DataFrame:
    """Row count, date range and missing values of a coerced table, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
        F.count_if(F.col("Close").isNull()).alias("missing_close"),
        F.count_if(F.col("Volume").isNull()).alias("missing_volume"),
        F.count_if(F.col("Close").isNotNull()).alias("usable_rows"),
    )
