"""Dates and record tags as files bring them."""

import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from barloom.functions import columns
from barloom.functions.columns import to_timestamp
from barloom.sources import readers
from barloom.sources.bars import to_bars
from barloom.sources.mapping import find_column
from barloom.sources.sinks import write_table
from barloom.streaming.live import latest_bars, read_parquet_stream, stream_revisions

DATES = {
    "20250912": "2025-09-12 00:00:00", "9/12/25": "2025-09-12 00:00:00", "12.09.2025": "2025-09-12 00:00:00", "9/12/2025 10:00 AM": "2025-09-12 10:00:00",
    "September 12, 2025": "2025-09-12 00:00:00", "2025/09/12 10:30": "2025-09-12 10:30:00", "9/12/2025 12:05:09 am": "2025-09-12 00:05:09", "12 sep 2025 1:00 PM": "2025-09-12 13:00:00",
    "Sept 12, 2025": "2025-09-12 00:00:00", "2025-09-12T10:30:00Z": "2025-09-12 10:30:00", "09/12/2025 23:59:58": "2025-09-12 23:59:58", "may 3 2024": "2024-05-03 00:00:00", "12-Sep-25": "2025-09-12 00:00:00",
    "13/13/2025": None, "9/12/2025 25:00": None, "9/12/2025 13:00 PM": None, "later": None, "": None, "2025": None, None: None,
}


def test_dates_as_people_write_them(spark):
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(DATES)], "i int, d string")
    got = rows.select("d", F.date_format(to_timestamp(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()
    assert {r["d"]: r["t"] for r in got} == DATES


@pytest.mark.parametrize(
    ("text", "tag"),
    [
        ("<root><!-- <c>1</c><c>2</c> --><row><a>1</a></row><row><a>2</a></row></root>", "row"),
        ("<root>\n<!-- <c>\n<c>\n<c/> -->\n<row>\n<a>1</a></row>\n<row><a>2</a></row></root>", "row"),
        ("<root><![CDATA[<c><c>]]><row/><row/></root>", "row"),
        ("<root>\n<!-- open\n<c>\n-->\n<x><c/></x>\n<!-- <x> --><y/></root>", "root"),
        ("<root><row/><row/></root>", "row"),
    ],
)
def test_record_tags_are_not_sought_in_comments(spark, tmp_path, text, tag):
    (tmp_path / "a.xml").write_text(text)
    assert readers.find_row_tag(spark, str(tmp_path / "a.xml")) == tag


def test_formats_of_one_shape_are_tried_in_turn(spark):
    rows = spark.createDataFrame([("25/12/2025",), ("12/25/2025",), ("1/2/2025",), ("40/40/2025",)], "d string")
    got = [str(r.t) if r.t else None for r in rows.select(to_timestamp(F.col("d"), ["M/d/yyyy", "d/M/yyyy"]).alias("t")).collect()]
    assert got == ["2025-12-25 00:00:00", "2025-12-25 00:00:00", "2025-01-02 00:00:00", None]


def test_a_root_that_every_file_has_is_no_record(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.xml").write_text(f"<all><day><a>{i}</a></day><day><a>9</a></day></all>")
    assert readers.find_row_tag(spark, str(tmp_path)) == "day"
    assert readers.read_xml(spark, str(tmp_path)).count() == 6


FILE = """Date,Close,note
2025-01-02,10,kept
,11,no_date
  ,11,no_date
later,n/a,bad_date
2025-01-03,,no_close
2025-01-04,NaN,no_close
2025-01-05,ten,bad_close
2025-01-06,"$1,200.50",kept
"""


def test_rejected_rows_are_shown_and_counted(spark, tmp_path):
    (tmp_path / "ABC.csv").write_text(FILE)
    path = str(tmp_path / "ABC.csv")
    watch = Observation()
    bars = readers.load_bars(spark, path, require="close", watch=watch).collect()
    assert sorted(r["Close"] for r in bars) == [10.0, 1200.5]
    assert {r["Symbol"] for r in bars} == {"ABC"}
    assert watch.get == {"rows": 8, "no_date": 2, "bad_date": 1, "no_close": 2, "bad_close": 1}
    out = readers.load_rejected(spark, path, require="close").orderBy("_row").collect()
    assert [r["reason"] for r in out] == ["no_date", "no_date", "bad_date", "no_close", "no_close", "bad_close"]
    assert out[2]["Date"] == "later" and out[2]["Close"] == "n/a"


def test_rejected_rows_of_typed_tables(spark, tmp_path):
    rows = spark.sql("select * from values (timestamp'2025-01-01', 1d, 'A'), (null, 2d, 'A'), (timestamp'2025-01-02', double('NaN'), 'A'), (timestamp'2025-01-03', null, 'A') as t(Date, Close, Symbol)")
    rows.write.parquet(str(tmp_path / "t"))
    out = readers.load_rejected(spark, str(tmp_path / "t"), "parquet", require="close")
    assert sorted(r["reason"] for r in out.collect()) == ["no_close", "no_close", "no_date"]
    assert readers.load_rejected(spark, str(tmp_path / "t"), "parquet", require="close").where("false").isEmpty()


def test_symbols_that_look_like_numbers_stay_text(spark, tmp_path):
    rows = spark.sql("select * from values (timestamp'2025-01-01', 1d, '0700'), (timestamp'2025-01-01', 2d, '5') as t(Date, Close, Symbol)")
    path = write_table(rows, str(tmp_path / "t"))
    got = readers.load_bars(spark, path, "parquet", require="close").collect()
    assert {(r["Symbol"], r["Close"]) for r in got} == {("0700", 1.0), ("5", 2.0)}


def test_find_column(spark):
    rows = spark.sql("select 1 as a, 2 as `My CLOSE`, 3 as close")
    assert find_column(rows, "Close") == "My CLOSE" and find_column(rows, "volume") is None


@pytest.mark.parametrize("every", ["1 month", "1 quarter", "1 week", "2 hours"])
def test_newest_revisions_are_the_bars_of_a_batch(spark, tmp_path, every):
    """Ticks in no order over many batches, with missing and NaN prices, a null symbol and ties in time."""
    ticks = spark.range(600).select(
        "id",
        F.when(F.col("id") % 50 != 0, F.timestamp_seconds(F.lit(1700000000) + F.pmod(F.xxhash64(F.col("id") % 450), F.lit(20000000)))).alias("ts"),
        F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 11 == 0, float("nan")).otherwise(F.pmod(F.hash("id"), F.lit(1000)).cast("double")).alias("p"),
        F.when(F.col("id") % 3 != 0, F.col("id") % 3).cast("string").alias("s"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 10).alias("q"),
    )
    ticks.repartition(5, "id").write.parquet(str(tmp_path / "in"))
    stream = read_parquet_stream(spark, str(tmp_path / "in"), ticks.schema, files_per_batch=2)
    live = latest_bars(stream_revisions(stream, "ts", "p", "s", every, "q", ["ts", "id"]), "revisions")
    batch = to_bars(spark.read.parquet(str(tmp_path / "in")), "ts", "p", "s", every, "q", ["ts", "id"])
    assert live.columns == batch.columns
    assert sorted(map(tuple, live.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_revisions_of_an_empty_stream(spark, tmp_path):
    spark.sql("select timestamp'2025-01-01' as ts, 1d as p, 'a' as s where false").write.parquet(str(tmp_path / "in"))
    stream = read_parquet_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    assert latest_bars(stream_revisions(stream, "ts", "p", "s", "1 month"), "none").isEmpty()


def test_dates_are_parsed_with_constant_formats(spark):
    """A format computed per row would have its parser made anew in every row."""
    df = spark.createDataFrame([("03/04/2024",), ("Sept 5, 2024 1:02 PM",), ("20240102",), ("soon",)], "d string")
    read = df.select(columns.to_timestamp(F.col("d")).alias("t"))
    assert [str(r["t"]) for r in read.collect()] == ["2024-03-04 00:00:00", "2024-09-05 13:02:00", "2024-01-02 00:00:00", "None"]
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert set(columns.DATE_FORMATS) <= set(re.findall(r"gettimestamp\([^,]*, ([^()]*?), TimestampType", plan))
