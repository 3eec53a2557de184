"""File readers: CSV, JSON, XML, Parquet, vendor payloads and wide multi-ticker tables."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import name, not_nan, to_timestamp
from barloom.operators.quality import drop_invalid_close, with_defaults
from barloom.sources.mapping import apply_mapping, rejected

# Extensions and the reader each one means.
FORMATS = {".csv": "csv", ".json": "json", ".xml": "xml", ".parquet": "parquet"}
# Field names of the vendor payload.
VENDOR_FIELDS = {"1. open": "Open", "2. high": "High", "3. low": "Low", "4. close": "Close", "5. volume": "Volume"}
VENDOR_SYMBOL = "2. Symbol"
VENDOR_SERIES = "(?i)time series"


def number_rows(df: DataFrame) -> DataFrame:
    """``_row`` follows file order within a scan, so it is taken before any shuffle."""
    return df.withColumn("_row", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, all columns as text: coercion decides types without a second pass."""
    return spark.read.csv(path, header=True, mode="PERMISSIVE")


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records as an array, one object, an object holding one list of records, or JSON lines.

    Only JSON lines split within a file; a whole-file document is one task per file.
    """
    df = spark.read.option("multiLine", not lines).json(path)
    return flatten(records(df) if not lines and root_is_object(spark, path) else df)


def root_is_object(spark: SparkSession, path: str) -> bool:
    """Whether every document is one object, rather than an array of records."""
    lines = spark.read.text(path).select(
        F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), F.regexp_extract("value", r"^\W*?([{\[])", 1).alias("root")
    )
    roots = lines.where("root <> ''").groupBy("file").agg(F.min_by("root", "line").alias("root"))
    return roots.where("root <> '{'").isEmpty()


def records(df: DataFrame) -> DataFrame:
    """Unfold the first field that is a list of objects, if there is one; single values beside it stay.

    An empty list gives one row without a record.
    """
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            inner = set(kind.elementType.fieldNames())
            beside = [f.name for f in df.schema.fields if f.name not in inner and not isinstance(f.dataType, T.ArrayType | T.StructType)]
            return df.select(*map(name, beside), F.inline_outer(name(field.name)))
    return df


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects to columns named ``outer.inner``."""

    def leaves(schema: T.StructType, path: Sequence[str]):
        for field in schema.fields:
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, [*path, field.name])
            else:
                yield [*path, field.name]

    columns = []
    for path in leaves(df.schema, []):
        column = name(path[0])
        for part in path[1:]:
            column = column.getField(part)
        columns.append(column.alias(".".join(path)))
    return df.select(*columns)


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """One row per record element; nested elements become ``outer.inner`` columns."""
    tag = row_tag or find_row_tag(spark, path)
    return flatten(spark.read.format("xml").option("rowTag", tag).load(path))


def find_row_tag(spark: SparkSession, path: str) -> str:
    """The first element in document order that occurs more than once in a file, else the root.

    All tags of all files are counted where they lie; in a folder, files follow by name.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    tags = F.regexp_extract_all("shown", F.lit(r"<([A-Za-z_][\w.\-]*)"), F.lit(1))
    lines = without_comments(lines).select("file", "line", tags.alias("tags"))
    found = lines.select("file", "line", F.posexplode("tags").alias("at", "tag"))
    by_file = found.groupBy("tag", "file").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "line", "at")).alias("first"))
    first = by_file.groupBy("tag").agg(F.max("n").alias("n"), F.min("first").alias("first"))
    best = first.orderBy((F.col("n") > 1).desc(), "first").first()
    if best is None:
        raise ValueError(f"no XML elements in {path}")
    return best["tag"]


def without_comments(lines: DataFrame) -> DataFrame:
    """Add ``shown``: each line without what lies in comments and character data, which may run over lines.

    A line depends on the ones before only by whether it begins inside: the last mark before it in its file
    says so, found by one window over the few lines that hold a mark.
    """
    marks = F.regexp_extract_all("value", F.lit(r"(<!--|-->|<!\[CDATA\[|\]\]>)"), F.lit(1))
    marked = lines.withColumn("_last", F.try_element_at(marks, F.lit(-1)))
    held = marked.where("_last IS NOT NULL").select("file", "line", "_last")
    if held.isEmpty():
        return lines.withColumn("shown", F.col("value"))
    before = F.lag("_last").over(Window.partitionBy("file").orderBy("line"))
    opened = held.withColumn("_before", before)
    # lines without a mark lie wholly inside when the last mark before them opens
    spans = opened.select("file", F.col("line").alias("_from"), F.lead("line").over(Window.partitionBy("file").orderBy("line")).alias("_to"), "_last")
    inside = spans.where(F.col("_last").isin("<!--", "<![CDATA["))
    own = marked.where("_last IS NOT NULL").join(opened.select("file", "line", "_before"), ["file", "line"])
    text = F.concat(F.when(F.col("_before") == "<!--", "<!--").when(F.col("_before") == "<![CDATA[", "<![CDATA[").otherwise(""), F.col("value"))
    text = F.regexp_replace(text, r"(?s)<!--.*?(-->|$)|<!\[CDATA\[.*?(\]\]>|$)", "")
    own = own.select("file", "line", text.alias("shown"))
    plain = marked.where("_last IS NULL")
    covered = (plain["file"] == inside["file"]) & (plain["line"] > inside["_from"]) & (inside["_to"].isNull() | (plain["line"] < inside["_to"]))
    rest = plain.join(inside, covered, "left_anti").select("file", "line", F.col("value").alias("shown"))
    return own.unionByName(rest)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, row_tag: str | None = None) -> DataFrame:
    """Choose the reader by extension, or by ``fmt``."""
    kind = fmt or FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower())
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, lines=kind == "jsonl")
    if kind == "xml":
        return read_xml(spark, path, row_tag)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file format: {path}")


def load_bars(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    mapping: Mapping[str, str] | None = None,
    require: str = "ohlc",
    symbol: str | None = None,
    row_tag: str | None = None,
    drop_invalid: bool = True,
    watch: Observation | None = None,
) -> DataFrame:
    """Read a file or a glob of files as canonical bars, by default without rows lacking Close.

    Without a Symbol column the symbol is the given one, or else the file's name. ``watch`` counts, in the pass of the
    first action on the result, the rows read and those left out by reason (``quality.REASONS``).
    """
    raw = read_table(spark, path, fmt, row_tag)
    if symbol is None:
        raw = tag_by_file(raw)
    bars = apply_mapping(number_rows(raw), mapping, require, symbol or "UNKNOWN")
    if drop_invalid:
        bars = drop_invalid_close(bars)
    if bars.isEmpty():
        raise ValueError(f"no valid rows in {path}")
    if watch is None:
        return bars
    # only now, as the look for a first row would have been the action that is counted
    counted = apply_mapping(number_rows(raw), mapping, require, symbol or "UNKNOWN", watch)
    return drop_invalid_close(counted) if drop_invalid else counted


def load_rejected(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    mapping: Mapping[str, str] | None = None,
    require: str = "ohlc",
    row_tag: str | None = None,
) -> DataFrame:
    """The rows of a file that ``load_bars`` leaves out: mapped values as they stand there, and the ``reason``."""
    return rejected(number_rows(tag_by_file(read_table(spark, path, fmt, row_tag))), mapping, require)


def tag_by_file(df: DataFrame) -> DataFrame:
    """Symbol from the file name when no column says it."""
    if any(c.lower() in ("symbol", "ticker", "stock", "asset") for c in df.columns):
        return df
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^/]*$", 1)
    return df.withColumn("Symbol", F.when(stem != "", stem))


def tag_symbol(df: DataFrame, symbol: str) -> DataFrame:
    return df.withColumn("Symbol", F.lit(symbol))


def union_symbols(*frames: DataFrame) -> DataFrame:
    """Stack tables; a column missing in one is null there."""
    combined = frames[0]
    for frame in frames[1:]:
        combined = combined.unionByName(frame, allowMissingColumns=True)
    # what was known about the length of the parts does not hold for the whole
    return combined.withMetadata("Date", {}) if "Date" in combined.columns else combined


def date_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """``start <= Date < end``, which reaches a parquet scan as a pushed filter."""
    if start is not None:
        df = df.filter(F.col("Date") >= F.lit(start).cast(df.schema["Date"].dataType))
    if end is not None:
        df = df.filter(F.col("Date") < F.lit(end).cast(df.schema["Date"].dataType))
    return df


def last_days(df: DataFrame, days: int = 365) -> DataFrame:
    """The ``days`` up to the newest date of the table."""
    newest = df.agg(F.max("Date").alias("newest")).scalar()
    return df.filter(F.col("Date") > newest - F.make_dt_interval(F.lit(days)))


def read_vendor_payload(spark: SparkSession, path: str, symbol: str | None = None, lines: bool = False) -> DataFrame:
    """Landed payloads ``{"Time Series (Daily)": {date: {"1. open": "100", ...}}}`` as bars.

    One payload per file, or per line. The symbol is the given one, the one the payload
    names, or else the file's name.
    """
    text = spark.read.text(path, wholetext=not lines)
    parts = text.select(
        F.from_json("value", "map<string,string>").alias("_parts"),
        F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^/]*$", 1).alias("_stem"),
    )
    about = F.from_json(F.try_element_at("_parts", F.lit("Meta Data")), "map<string,string>")
    named = F.coalesce(F.lit(symbol).cast("string"), F.try_element_at(about, F.lit(VENDOR_SYMBOL)), F.col("_stem"))
    days = parts.select(named.alias("Symbol"), F.explode("_parts").alias("_part", "_body")).filter(
        F.col("_part").rlike(VENDOR_SERIES)
    )
    rows = days.select("Symbol", F.explode(F.from_json("_body", "map<string,map<string,string>>")).alias("_when", "_bar"))
    bars = rows.select(
        "Symbol",
        to_timestamp(F.col("_when")).alias("Date"),
        *[
            not_nan(F.try_element_at("_bar", F.lit(key)).try_cast("double")).alias(c)
            for key, c in VENDOR_FIELDS.items()
        ],
    )
    return with_defaults(bars.filter(F.col("Date").isNotNull()))


def wide_to_bars(df: DataFrame, date: str = "Date") -> DataFrame:
    """Columns ``Close_AAA, Close_BBB, Open_AAA, ...`` to one row per Date and Symbol.

    A uniform second level is one symbol. Field names may hold spaces (``Adj Close_AAA``).
    """
    fields: dict[str, dict[str, str]] = {}
    for c in df.columns:
        if c != date and "_" in c:
            field, ticker = c.rsplit("_", 1)
            fields.setdefault(ticker, {})[field.replace(" ", "_")] = c
    wanted = sorted({f for by_field in fields.values() for f in by_field})
    per_ticker = F.array(
        *[
            F.struct(
                F.lit(ticker).alias("Symbol"),
                *[
                    (not_nan(name(by_field[f])) if f in by_field else F.lit(None).cast("double")).alias(f)
                    for f in wanted
                ],
            )
            for ticker, by_field in fields.items()
        ]
    )
    long = df.select(name(date).cast("timestamp").alias("Date"), F.inline(per_ticker))
    return long.na.drop(how="all", subset=wanted)
