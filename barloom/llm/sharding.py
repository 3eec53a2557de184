"""Shards of equal size, cut from a sampled order of texts.

Records are ordered by a hash of their text, so equal texts are neighbours. A size-weighted sample of keys gives the
quantile boundaries of many small ranges; a key that fills whole quantiles gets a range of its own, and overfull ranges
are subdivided. Sizes are summed per range, so a record's place in the whole order is an offset plus a running sum
within its range, and the shard follows from that place. Groups of equal texts stay in one shard unless they are larger
than ``whole`` of a shard; larger ones are cut where the sizes say.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import tree_search, uniform
from barloom.session import cut_lineage

#: Splitters per range of the size-weighted sample, and the most ranges: both bound what the driver sees.
SAMPLES_PER_RANGE, MOST_RANGES = 16, 4096
#: A range above so many times the mean is subdivided.
OVERFULL = 3.0


def _digest(docs: DataFrame, carry: list[str]) -> DataFrame:
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    return docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("row") if carry else F.lit(None).cast("string").alias("row"),
        F.col("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.xxhash64(F.lit("part"), F.col("doc_id")).alias("spread"),
    )


def _splitters(digest: DataFrame, ranges: int) -> tuple[list[int], list[bool]]:
    """Quantile boundaries of a size-weighted sample, and which of them are keys that fill whole ranges."""
    wanted = ranges * SAMPLES_PER_RANGE
    priority = -F.log(uniform(F.lit("splitter"), F.col("doc_id"), F.col("key"))) / F.col("size")
    ranked = digest.select("key", priority.alias("p"))
    rows, total = digest.agg(F.count(F.lit(1)), F.sum("size")).first()
    if rows > 2 * wanted:
        # about size * bound of a record's priorities lie below the bound, so twice the sample passes at most
        ranked = ranked.where(F.col("p") < 2.0 * wanted / total)
    sample = sorted(ranked.collect(), key=lambda r: (r["p"], r["key"]))[:wanted]
    keys = sorted(r["key"] for r in sample)
    if not keys:
        return [], []
    cuts = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if len(keys) >= ranges else keys
    times: dict[int, int] = {}
    for c in cuts:
        times[c] = times.get(c, 0) + 1
    return list(times), [n > 1 for n in times.values()]


def _placed(digest: DataFrame, cuts: list[int], alone: list[bool]) -> DataFrame:
    """Add ``range``: two numbers per splitter, the even one for a key that has its range to itself."""
    found = tree_search(digest, "key", cuts, "_below")
    own = F.lit(False)
    if any(alone):
        mine = F.array(*[F.lit(c if a else None).cast("long") for c, a in zip(cuts, alone, strict=True)])
        own = F.coalesce(F.get(mine, F.col("_below") - 1) == F.col("key"), F.lit(False))
    return found.withColumn("own", own).withColumn("range", F.col("_below") * 2 + F.when(own, 0).otherwise(1)).drop("_below")


def _parts(placed: DataFrame, counts: list, ranges: int) -> DataFrame:
    """Add ``part``: 0, or one of several within an overfull range."""
    mean = sum(r["bytes"] for r in counts) / ranges
    over = {r["range"]: math.ceil(r["bytes"] / mean) for r in counts if r["bytes"] > OVERFULL * mean}
    if not over:
        return placed.withColumn("part", F.lit(0))
    spark = placed.sparkSession
    split = F.broadcast(spark.createDataFrame(sorted(over.items()), "range int, parts int"))  # at most 2 * MOST_RANGES rows
    # copies of one text spread by document; other texts move as groups
    by = F.when(F.col("own"), F.col("spread")).otherwise(F.xxhash64(F.lit("part"), F.col("key")))
    joined = placed.join(split, "range", "left")
    return joined.withColumn("part", F.coalesce(F.pmod(by, F.col("parts")), F.lit(0)).cast("int")).drop("parts")


def shard_documents(docs: DataFrame, shards: int = 8, whole: float = 0.01, carry: list[str] | None = None) -> DataFrame:
    """Put every document into one of ``shards`` shards of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot (gapless from 0 within its shard), and the columns
    named in ``carry``. Needs doc_id and text; other columns do no harm. A null text has size 1 and equals no empty
    text's group, yet shares its checksum, 0. A null doc_id sorts first. Repeated rows take neighbouring slots. An empty
    table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    carry = [c for c in carry or [] if c in docs.columns]
    digest = cut_lineage(_digest(docs, []))
    ranges = min(MOST_RANGES, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts, alone = _splitters(digest, ranges)
    counts = _placed(digest, cuts, alone).groupBy("range").agg(F.sum("size").alias("bytes")).collect()  # 2 * ranges rows at most
    total = sum(r["bytes"] for r in counts)

    def ordered(rows: DataFrame) -> DataFrame:
        return _parts(_placed(rows, cuts, alone), counts, ranges)

    parts = ordered(digest).groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part, bounded like ranges
    offsets = cut_lineage(
        parts.select(
            "range",
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        )
    )

    def numbered(rows: DataFrame) -> DataFrame:
        group = Window.partitionBy("range", "part", "key")
        run = Window.partitionBy("range", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        run_rows = Window.partitionBy("range", "part").orderBy("key", "doc_id")
        out = (
            ordered(rows)
            .withColumn("upto", F.sum("size").over(run))
            .withColumn("rn", F.row_number().over(run_rows))
            .withColumn("group_bytes", F.sum("size").over(group))
            .withColumn("group_upto", F.max("upto").over(group))
            .join(F.broadcast(offsets), ["range", "part"])
        )
        stays = F.col("group_bytes") <= whole * total / shards
        middle = F.col("bytes_before") + F.when(stays, F.col("group_upto") - F.col("group_bytes") / 2).otherwise(F.col("upto") - F.col("size") / 2)
        shard = F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int")
        return out.select("row", "doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("rn") - 1).alias("place"))

    plain = numbered(digest)
    if not carry:
        plain = cut_lineage(plain)
    first = plain.groupBy("shard").agg(F.min("place").alias("first"))  # one row per shard
    rows = numbered(_digest(docs, carry)) if carry else plain
    made = ["doc_id", "size", "text_crc32", "shard", "slot"]
    kept: list[Column] = [F.col(f"row.`{c}`").alias(c) for c in carry if c not in made]
    return rows.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"), *kept
    )


def op8_sampled_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    from barloom.llm.common import table

    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
