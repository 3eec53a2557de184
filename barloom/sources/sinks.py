"""Writers. Output is a folder of part files, written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("parquet", "csv", "json")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", only_anomalies: bool = False) -> str:
    """Write as Parquet (in order of Symbol and Date where there are any), CSV with header or JSON lines.

    Symbol stays a column of the files, so ``0700`` remains text, and their number follows the shuffle partitions.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported output format: {fmt}")
    if only_anomalies:
        df = df.filter(F.col("is_anomaly") == 1)
    writer = df.write
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        order = [c for c in ("Symbol", "Date") if c in df.columns]
        (df.repartitionByRange(*order).sortWithinPartitions(*order).write if order else writer).parquet(path)
    return path


def small_json_array(df: DataFrame, limit: int = 10_000) -> str:
    """A report as one JSON array; refuses tables too long for that."""
    rows = df.select(F.to_json(F.struct("*")).alias("j")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write JSON lines instead")
    return "[" + ",".join(r["j"] for r in rows) + "]"
