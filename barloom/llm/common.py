"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. ``bytes.split()`` finds the same words.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string")) % folds


def held_out(key: Column, folds: int, remainder: int) -> Column:
    """True for the rows a model must not learn from; a null key counts as one of them."""
    return F.coalesce(fold(key, folds) == remainder, F.lit(True))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order; an empty list for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def byte_words(text: str | None) -> list[bytes]:
    """The same words, with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def uniform(*parts: Column) -> Column:
    """A repeatable number in (0, 1) for a row, from a 64-bit hash of ``parts``."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def tree_search(df: DataFrame, key: str, cuts: list[int], name: str) -> DataFrame:
    """Add ``name``: how many of the sorted ``cuts`` are at most ``key``. A binary search, one small step per level.

    The cuts are one literal and the search one expression, so that a plan stays small however many cuts it holds.
    """
    if not cuts:
        return df.withColumn(name, F.lit(0))
    levels = len(cuts).bit_length()
    top = (1 << 63) - 1
    padded = [*cuts, *[top] * ((1 << levels) - 1 - len(cuts))]
    listed = F.split(F.lit(",".join(map(str, padded))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << level) for level in reversed(range(levels))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= F.col(key), at + step).otherwise(at))
    return df.withColumn(name, F.least(found, F.lit(len(cuts))))


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """A column by name, or a typed null where the table has none."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def keep_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [c for c in names if c in df.columns]


#: A key that holds more than one in so many of all rows is hot; there are fewer such keys than this.
HOT_SHARE = 4096


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join with a table that has one row per key and, in ``size``, how many of the ``total`` left rows hold it.

    Hot keys, fewer than ``HOT_SHARE``, are broadcast, and their rows stay where they are; the others are joined by shuffle,
    where none has more than its small share of the rows. ``size`` is dropped. Null keys join nothing.
    """
    hot = F.col(size) * HOT_SHARE > total
    few, many = right.where(hot).drop(size), right.where(~hot).drop(size)
    here = left.join(F.broadcast(few), keys)
    rest = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many, keys)
    return here.unionByName(rest)
