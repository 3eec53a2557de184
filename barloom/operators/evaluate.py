"""Splits, labels, metrics and comparison of detectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.layout import max_rows
from barloom.operators.quantiles import order_code, order_statistics
from barloom.session import cut_lineage


def number_in_order(df: DataFrame, order: Sequence[Column], column: str = "_nth") -> DataFrame:
    """1-based place of every row in a total order of the whole table.

    Beyond one task's size the table is range-partitioned on the order and stored; a
    row's place is then its place in the partition plus the rows of the partitions before.
    """
    size = df.count()
    named = df.withColumns({f"_by{i}": c for i, c in enumerate(order)})
    by = [f"_by{i}" for i in range(len(order))]
    limit = max_rows(df.sparkSession)
    if size <= limit:
        place = F.row_number().over(Window.orderBy(*by)).cast("bigint")
        return named.withColumn(column, place).drop(*by)
    parts = math.ceil(size / limit)
    # equal keys are spread as well
    by.append("_tie")
    named = named.withColumn("_tie", F.monotonically_increasing_id())
    stored = cut_lineage(named.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    # one row per partition
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = stored.withColumn("_within", within).join(F.broadcast(starts), "_part")
    return placed.withColumn(column, F.col("_within") + F.col("_start")).drop(*by, "_part", "_within", "_start")


def lead_code(df: DataFrame, column: str) -> Column | None:
    """A bigint in the order of a column, nulls first; None where the type has none."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        code = F.unix_micros(F.col(column).cast("timestamp"))
    elif isinstance(kind, T.FloatType | T.DoubleType):
        code = order_code(F.col(column).cast("double"))
    elif isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        code = F.col(column).cast("bigint")
    else:
        return None
    return F.coalesce(code, F.lit(-(1 << 63)))


def mark_first(df: DataFrame, lead: Column, order: Sequence[Column], count: int, column: str) -> DataFrame:
    """Add ``column``: whether a row is among the first ``count`` by ``lead`` (a bigint), then by ``order``.

    The lead of the last of them is found by radix selection; only rows that tie with it are put in order.
    """
    coded = df.withColumn("_code", lead)
    if count <= 0:
        return coded.withColumn(column, F.lit(False)).drop("_code")
    limit = max_rows(df.sparkSession)
    wanted = df.sparkSession.createDataFrame([(count,)], "rank bigint")
    edge = order_statistics(coded.select("_code", F.col("_code").alias("value")), wanted, [], limit).first()
    if edge is None:  # fewer rows than that
        return coded.withColumn(column, F.lit(True)).drop("_code")
    cut = F.lit(edge["value"]).cast("bigint")
    below, tied = coded.agg(F.count_if(F.col("_code") < cut), F.count_if(F.col("_code") == cut)).first()
    apart = coded.filter(F.col("_code") != cut).withColumn(column, F.col("_code") < cut)
    ties = coded.filter(F.col("_code") == cut)
    if below + tied == count:
        ties = ties.withColumn(column, F.lit(True))
    elif tied <= limit:
        ties = ties.withColumn(column, F.row_number().over(Window.partitionBy("_code").orderBy(*order)) <= count - below)
    else:
        ties = number_in_order(ties, order).withColumn(column, F.col("_nth") <= count - below).drop("_nth")
    return apart.unionByName(ties).drop("_code")


def marked_split(df: DataFrame, train: float, order: Sequence[str]) -> DataFrame:
    """Add ``_first``: whether a row is in the first share of all rows in this order."""
    count = math.floor(df.count() * train + 1e-9)
    lead, rest = lead_code(df, order[0]), [F.col(c) for c in order[1:]] or [F.lit(0)]
    if lead is not None:
        return mark_first(df, lead, rest, count, "_first")
    numbered = number_in_order(df, [F.col(c) for c in order])
    return numbered.withColumn("_first", F.col("_nth") <= count).drop("_nth")


def chronological_split(
    df: DataFrame, train: float = 0.8, order: Sequence[str] = ("Date", "Symbol")
) -> tuple[DataFrame, DataFrame]:
    """The first share of rows by date, and the rest."""
    marked = marked_split(df, train, order)
    return marked.filter("_first").drop("_first"), marked.filter("NOT _first").drop("_first")


def with_split(df: DataFrame, train: float = 0.8, order: Sequence[str] = ("Date", "Symbol")) -> DataFrame:
    """Add ``part``, ``train`` or ``test``."""
    marked = marked_split(df, train, order)
    return marked.withColumn("part", F.when(F.col("_first"), "train").otherwise("test")).drop("_first")


def key_text(df: DataFrame, key: Sequence[str]) -> Column:
    """The key as text, times to the microsecond; nulls are empty."""
    parts = []
    for c in key:
        timed = isinstance(df.schema[c].dataType, T.DateType | T.TimestampType | T.TimestampNTZType)
        parts.append(F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if timed else F.col(c).cast("string"), F.lit("")))
    return F.concat_ws("|", *parts)


def synthetic_labels(df: DataFrame, share: float = 0.02, seed: int = 42, key: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    """Label max(1, share of rows) pseudo-random rows 1: those whose seeded key has the smallest MD5.

    The first 60 bits of the digest decide, so any engine can name the same rows.
    """
    wanted = max(1, math.floor(df.count() * share + 1e-9))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key_text(df, key)).cast("binary"))
    hashed = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    marked = mark_first(df, hashed, [F.col(c) for c in key], wanted, "_first")
    return marked.withColumn("label", F.col("_first").cast("int")).drop("_first")


def metrics(df: DataFrame, predicted: str = "predicted", label: str = "label", by: Sequence[str] = ("model",)) -> DataFrame:
    """Precision, recall, F1 (0 on zero division) and flagged share per model."""
    hit, truth = F.col(predicted) == 1, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(hit & truth).alias("tp"),
        F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & truth).alias("fn"),
        F.count(F.lit(1)).alias("n"),
    )
    zero = F.lit(0.0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), zero)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *by,
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + fp, F.col("n")).alias("flagged_ratio"),
    )


def best_by_f1(table: DataFrame) -> DataFrame:
    """The model with the highest F1, the first by name among equals."""
    top = F.struct((-F.col("f1")).alias("_worst"), F.col("model").alias("model"))
    return table.agg(F.min(top).alias("_top")).select(
        F.col("_top.model").alias("best_model"), (-F.col("_top._worst")).alias("f1")
    )


def compare(scored: dict[str, DataFrame]) -> DataFrame:
    """Flagged count and percentage per configuration."""
    tagged = [
        df.select(F.lit(config).alias("config"), F.col("is_anomaly").cast("int").alias("is_anomaly"))
        for config, df in scored.items()
    ]
    stacked = tagged[0]
    for other in tagged[1:]:
        stacked = stacked.unionByName(other)
    flagged = F.sum("is_anomaly")
    return stacked.groupBy("config").agg(
        F.count(F.lit(1)).alias("total"),
        flagged.alias("flagged"),
        F.try_divide(flagged * 100, F.count(F.lit(1))).alias("flagged_pct"),
    )


def agreement(scored: dict[str, DataFrame], key: Sequence[str] = ("Symbol", "Date")) -> DataFrame:
    """How many rows were flagged by how many of the configurations."""
    stacked = None
    for df in scored.values():
        # a configuration has one vote per key, however often the key repeats
        part = df.groupBy(*key).agg(F.max(F.col("is_anomaly").cast("int")).alias("is_anomaly"))
        stacked = part if stacked is None else stacked.unionByName(part)
    votes = stacked.groupBy(*key).agg(F.sum("is_anomaly").alias("flagged_by"))
    return votes.groupBy("flagged_by").agg(F.count(F.lit(1)).alias("n_rows"))
