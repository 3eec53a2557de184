"""Bars and scores from streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.detectors.base import Detector
from barloom.session import fresh_folder
from barloom.functions.columns import name as column, not_nan
from barloom.sources.bars import CALENDAR, arrival, bar_start, interval


def read_parquet_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def usable_ticks(ticks: DataFrame, ts: str, price: str, symbol: str, quantity: str | None, order_by: Sequence[str]) -> DataFrame:
    """Ticks that have a time and a price, under the names the aggregates use."""
    return ticks.filter(F.col(ts).isNotNull() & not_nan(F.col(price)).isNotNull()).select(
        F.coalesce(F.col(symbol).cast("string"), F.lit("UNKNOWN")).alias("Symbol"),
        F.col(ts).cast("timestamp").alias("_ts"),
        F.col(price).cast("double").alias("_price"),
        arrival(ticks, order_by or [ts]).alias("_order"),
        (F.col(quantity).cast("double") if quantity else F.lit(1.0)).alias("_volume"),
    )


def folds() -> list[Column]:
    return [
        F.min_by("_price", "_order").alias("Open"),
        F.max("_price").alias("High"),
        F.min("_price").alias("Low"),
        F.max_by("_price", "_order").alias("Close"),
        F.sum("_volume").alias("Volume"),
    ]


def stream_bars(
    ticks: DataFrame,
    ts: str,
    price: str,
    symbol: str,
    every: str = "1 hour",
    late: str = "1 hour",
    quantity: str | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Bars of tumbling windows, each emitted once the watermark passes its end.

    Ticks later than ``late`` are dropped, as are those without a time or a price. State is one row per open bar. Weeks
    begin on Monday, as in batch; months and quarters have no fixed length, so windows can't close them. Bars still
    open when a stream ends are not emitted: ``stream_revisions`` has them, and months and quarters.
    """
    count, unit = interval(every)
    if unit in ("month", "quarter"):
        raise ValueError(f"bars that close can't last a {unit}: take stream_revisions")
    # windows count from 1970-01-01, a Thursday
    start = "4 days" if (count, unit) == (1, "week") and unit in CALENDAR else None
    return (
        usable_ticks(ticks, ts, price, symbol, quantity, order_by)
        .withWatermark("_ts", late)
        .groupBy("Symbol", F.window("_ts", every, startTime=start).alias("_w"))
        .agg(*folds())
        .select("Symbol", F.col("_w.start").alias("Date"), "Open", "High", "Low", "Close", "Volume")
    )


def stream_revisions(
    ticks: DataFrame,
    ts: str,
    price: str,
    symbol: str,
    every: str = "1 month",
    quantity: str | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Bars of any interval, months and quarters included, each emitted anew in every batch that changes it.

    For update mode: nothing waits for a watermark and no tick is too late, so open bars are there as well, and after
    the last batch the newest revisions are the bars of a batch run. State holds one row per bar ever seen, which
    calendar intervals keep small. ``latest_bars`` runs it and keeps the newest revisions.
    """
    return (
        usable_ticks(ticks, ts, price, symbol, quantity, order_by)
        .groupBy("Symbol", bar_start(F.col("_ts"), every).alias("Date"))
        .agg(*folds())
    )


def latest_bars(revisions: DataFrame, name: str) -> DataFrame:
    """Process what is there and give the newest revision of every bar, from a table in the shared folder.

    A batch writes a folder of its own and overwrites it if it is repeated. The folder holds all revisions; reading
    them takes one aggregation on (Symbol, Date), combined before its shuffle.
    """
    spark = revisions.sparkSession
    out = fresh_folder(spark, name)
    spark.createDataFrame([], revisions.schema).write.parquet(f"{out}/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        revisions.writeStream.foreachBatch(keep)
        .outputMode("update")
        .option("checkpointLocation", out + "-progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = T.StructType([*revisions.schema.fields, T.StructField("batch", T.LongType())])
    values = [c for c in revisions.columns if c not in ("Symbol", "Date")]
    newest = F.max_by(F.struct(*values), "batch").alias("_bar")
    return spark.read.schema(written).parquet(out).groupBy("Symbol", "Date").agg(newest).select("Symbol", "Date", "_bar.*")


def stream_scores(bars: DataFrame, detector: Detector) -> DataFrame:
    """Score each row of a stream by itself with a fitted detector; detectors that join need ``score_available``."""
    return detector.predict_stream(bars)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there, append it to a parquet table in the shared folder and read that."""
    spark = stream.sparkSession
    out = fresh_folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", out + "-progress")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def score_available(stream: DataFrame, detector: Detector, name: str) -> DataFrame:
    """Score what is there, batch by batch, with any fitted detector; the scored rows as a table in the shared folder.

    Every batch has a folder of its own, which a repeated batch overwrites, so each row is there once. The columns are
    the stream's, then ``anomaly_score`` and ``is_anomaly``; a stream without rows gives an empty table.
    """
    spark = stream.sparkSession
    out = fresh_folder(spark, name)
    schema = T.StructType([*stream.schema.fields, T.StructField("anomaly_score", T.DoubleType()), T.StructField("is_anomaly", T.IntegerType())])
    spark.createDataFrame([], schema).write.parquet(f"{out}/batch=-1")

    def score(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            detector.score_batch(batch).select(*[column(c) for c in schema.names]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(score).option("checkpointLocation", out + "-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/batch=*")
