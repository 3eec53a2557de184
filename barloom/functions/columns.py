"""Column expressions shared by the operators: null-safe arithmetic and coercion."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

# Date spellings accepted from files, tried in this order.
DATE_FORMATS = (
    "M/d/yyyy",
    "M/d/yy",
    "yyyy/M/d",
    "d.M.yyyy",
    "d.M.yy",
    "d-MMM-yyyy",
    "d-MMM-yy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMM d yyyy",
    "MMMM d yyyy",
    "yyyyMMdd",
)
# A time that may follow a date: hour, minute, second and half of the day.
TIME_TAIL = r"[ T]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?: ([AaPp])[Mm])?$"
# Dates that begin with the year and a dash: an optional time, fraction and zone are read by the cast.
ISO_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}([.][0-9]+)?)? ?(Z|[+-][0-9]{1,2}(:?[0-9]{2})?)?)?$"


def name(column: str) -> Column:
    """The column of exactly this name, dots and slashes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def not_nan(column: Column) -> Column:
    """Missing is always null: NaN would count as a value in aggregates."""
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def to_number(column: Column) -> Column:
    """``"$1,234.50"`` to 1234.5; anything that is no number becomes null."""
    text = F.regexp_replace(F.trim(column.cast("string")), "[,$ ]", "")
    return not_nan(text.try_cast("double"))


# What the letters of a date format stand for in text.
SHAPES = {
    "yyyy": "[0-9]{4}", "yy": "[0-9]{2}", "MMMM": "[A-Za-z]{4,}", "MMM": "(?:[Ss][Ee][Pp][Tt]|[A-Za-z]{3})", "MM": "[0-9]{2}", "dd": "[0-9]{2}",
    **dict.fromkeys(("mm", "ss"), "[0-9]{2}"), **dict.fromkeys("MdHh", "[0-9]{1,2}"), "a": "[AaPp][Mm]", ".": "[.]",
}


def shape(date_format: str) -> str:
    """A pattern for the texts a date format can parse."""
    letters = sorted(SHAPES, key=len, reverse=True)
    return re.sub("|".join(map(re.escape, letters)), lambda m: SHAPES[m.group()], date_format)


def to_timestamp(column: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Dates as people and programs write them: year first, or in one of ``formats``, the first that parses.

    A time may follow, with seconds and with AM or PM. Month names are English, in any case; years of two digits lie in
    2000 to 2099. Nothing parses means null. The shape of a text names its format, so there is one attempt to parse it
    unless formats share a shape; the expression stays small enough to be compiled.
    """
    text = F.trim(column.cast("string"))
    iso = F.when(text.rlike(ISO_DATE), F.regexp_replace(text, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2").try_cast("timestamp"))
    day = F.regexp_replace(F.initcap(F.regexp_replace(text, TIME_TAIL, "")), r"\bSept\b", "Sep")
    by_shape: dict[str, list[str]] = {}
    for f in formats:
        by_shape.setdefault(shape(f), []).append(f)
    tail = "(?:" + TIME_TAIL.removesuffix("$") + ")?$"
    shaped = []
    for nth in range(max(map(len, by_shape.values()))):
        chosen = F.lit(None).cast("string")
        for pattern, among in reversed(by_shape.items()):
            if nth < len(among):
                chosen = F.when(text.rlike(f"^{pattern}{tail}"), among[nth]).otherwise(chosen)
        shaped.append(chosen)

    def parsed(one: Column) -> Column:
        # a parser is made once for a constant format, but anew in every row for a computed one
        dates = []
        for nth in range(len(shaped)):
            branches = [(f, F.try_to_timestamp(one["day"], F.lit(f))) for f in dict.fromkeys(among[nth] for among in by_shape.values() if nth < len(among))]
            date = F.lit(None).cast("timestamp")
            for f, attempt in reversed(branches):
                date = F.when(one[f"format{nth}"] == f, attempt).otherwise(date)
            dates.append(date)
        return F.coalesce(*dates)

    # the lambda binds day and formats, so that they are computed once and the expression stays small
    bound = F.struct(day.alias("day"), *[c.alias(f"format{i}") for i, c in enumerate(shaped)])
    date = F.get(F.transform(F.array(bound), parsed), F.lit(0))
    hour, minute, second, half = (F.regexp_extract(text, TIME_TAIL, i) for i in (1, 2, 3, 4))
    # text without a time is common, and each failing cast of its empty parts costs as much as all the rest
    number = lambda t: F.coalesce(F.when(t != "", t).try_cast("int"), F.lit(0))
    # only hours of 1 to 12 have a half of the day; 12 is the first of it
    in_day = F.when(half == "", number(hour)).when(number(hour).between(1, 12), number(hour) % 12 + F.when(F.upper(half) == "P", 12).otherwise(0))
    clock = F.when((in_day < 24) & (number(minute) < 60) & (number(second) < 60), in_day * 3600 + number(minute) * 60 + number(second))
    return F.coalesce(iso, date + F.make_dt_interval(secs=clock.cast("decimal(18,6)")))


def ratio_change(now: Column, before: Column) -> Column:
    """``now / before - 1``, null on a zero base."""
    return F.try_divide(now, before) - 1


def when_full(value: Column, counted: Column, window: WindowSpec, rows: int) -> Column:
    """``value`` over ``window``, but only where it holds ``rows`` non-null ``counted``."""
    return F.when(F.count(counted).over(window) == rows, value)


def rolling_mean(column: Column, window: WindowSpec, rows: int) -> Column:
    return when_full(F.avg(column).over(window), column, window, rows)


def rolling_std(column: Column, window: WindowSpec, rows: int) -> Column:
    return when_full(F.stddev_samp(column).over(window), column, window, rows)


def rolling_correlation(x: Column, y: Column, window: WindowSpec, rows: int) -> Column:
    """Pearson correlation over full windows; a constant side has none.

    ``corr`` divides by zero on a constant window in ANSI mode, and float noise can
    leave its deviation just above zero, so constancy is read off min and max.
    """
    varies = (F.min(x).over(window) < F.max(x).over(window)) & (
        F.min(y).over(window) < F.max(y).over(window)
    )
    spread = F.stddev_pop(x).over(window) * F.stddev_pop(y).over(window)
    value = F.when(varies, F.try_divide(F.covar_pop(x, y).over(window), spread))
    return when_full(value, F.when(x.isNotNull() & y.isNotNull(), 1), window, rows)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ("anomaly_score", "is_anomaly")) -> list[str]:
    """Names of the numeric columns, without results and bookkeeping."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude and not f.name.startswith("_")
    ]


def rounded(df: DataFrame, digits: int, columns: Sequence[str] | None = None, nudge: float = 0.0) -> DataFrame:
    """Round the double columns, which is how results of two engines are compared.

    Averages of prices in cents can lie exactly between two steps, where the last bit decides;
    a ``nudge`` far below a step moves them to one side.
    """
    chosen = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    # adding 0.0 turns a rounded -0.0 into 0.0
    return df.withColumns({c: F.round(name(c) + F.lit(nudge), digits) + F.lit(0.0) for c in chosen})
