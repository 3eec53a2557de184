"""De-duplication, fills and outlier capping per Symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import numeric_columns
from barloom.operators.layout import (
    BLOCK,
    block_summary,
    is_split,
    lay_out,
    note_fit,
    series_fit,
    series_keys,
    split,
    with_position,
)
from barloom.operators.quantiles import exact_quantiles
from barloom.session import cut_lineage

# The columns fills and caps apply to.
VALUE_COLUMNS = ("Open", "High", "Low", "Close", "Adj_Close", "Volume")
FILLS = ("ffill", "bfill", "interpolate", "mean", "pad", "back")
WHISKER = 1.5


def value_columns(df: DataFrame) -> list[str]:
    return [c for c in VALUE_COLUMNS if c in df.columns]


def dedupe_first(df: DataFrame) -> DataFrame:
    """Keep the first row per (Symbol, Date), by ``_row`` where the loader numbered rows.

    The rank-one filter becomes a group limit ahead of the shuffle, so a hot group of copies
    sends one row per map task.
    """
    others = [c for c in df.columns if c not in ("Symbol", "Date")]
    order = ["_row"] if "_row" in df.columns else others
    if not order:
        return df.distinct()
    w = Window.partitionBy("Symbol", "Date").orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") == 1).drop("_nth")


def fill(df: DataFrame, columns: Sequence[str] | None = None, method: str = "ffill") -> DataFrame:
    """Fill nulls per Symbol.

    ``ffill`` and ``bfill`` fall back to the other direction at the ends; ``pad`` and ``back``
    do not. ``interpolate`` is linear by row position, ends as ``ffill``. ``mean`` takes
    the mean of the Symbol.
    """
    if method not in FILLS:
        raise ValueError(f"unknown fill method {method!r}, choose from {', '.join(FILLS)}")
    columns = list(columns if columns is not None else value_columns(df))
    if not columns:
        return df
    if method == "mean":
        return fill_mean(df, columns)
    df = lay_out(df)
    interpolate = method == "interpolate"
    if interpolate:
        df = with_position(df)
    if is_split(df):
        df = with_neighbour_blocks(df, columns, interpolate)

    found = {}
    for c in columns:
        before, after = nearest(df, c, True), nearest(df, c, False)
        if method == "pad":
            found[c] = before
        elif method == "back":
            found[c] = after
        elif method == "bfill":
            found[c] = F.coalesce(after, before)
        elif method == "ffill":
            found[c] = F.coalesce(before, after)
        else:
            start, end = nearest(df, c, True, True), nearest(df, c, False, True)
            line = before + (after - before) * F.try_divide(F.col("_pos") - start, end - start)
            found[c] = F.coalesce(F.col(c), line, before, after)
    spare = [c for c in df.columns if c.startswith(("_prev_", "_next_", "_prevpos_", "_nextpos_"))]
    return df.withColumns(found).drop("_pos", *spare)


def nearest(df: DataFrame, column: str, backward: bool, position: bool = False) -> Column:
    """The nearest valid value (or its position) at or before, or at or after, each row.

    ``lag`` and ``lead`` that skip nulls walk the series once; an aggregate up to the end of
    the series would start again at every row.
    """
    value = f"CASE WHEN `{column}` IS NOT NULL THEN _pos END" if position else f"`{column}`"
    over = f"OVER (PARTITION BY {', '.join(series_keys(df))} ORDER BY Date)"
    step, side = ("lag", "_prev") if backward else ("lead", "_next")
    found = F.coalesce(F.expr(value), F.expr(f"{step}({value}, 1) IGNORE NULLS {over}"))
    outside = f"{side}{'pos' if position else ''}_{column}"
    return F.coalesce(found, F.col(outside)) if is_split(df) else found


def with_neighbour_blocks(df: DataFrame, columns: Sequence[str], positions: bool) -> DataFrame:
    """Add the nearest valid value (and its position) in the blocks before and after."""
    ends = []
    for c in columns:
        dated = F.when(F.col(c).isNotNull(), F.col("Date"))
        ends += [F.min_by(c, dated).alias("_first_" + c), F.max_by(c, dated).alias("_last_" + c)]
        if positions:
            valid = F.when(F.col(c).isNotNull(), F.col("_pos"))
            ends += [F.min(valid).alias("_firstpos_" + c), F.max(valid).alias("_lastpos_" + c)]
    order = Window.partitionBy("Symbol").orderBy(BLOCK)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(1, Window.unboundedFollowing)
    carried = []
    for suffix in ("", "pos") if positions else ("",):
        for c in columns:
            carried += [
                F.last(f"_last{suffix}_{c}", ignorenulls=True).over(earlier).alias(f"_prev{suffix}_{c}"),
                F.first(f"_first{suffix}_{c}", ignorenulls=True).over(later).alias(f"_next{suffix}_{c}"),
            ]
    around = block_summary(df, *ends).select("Symbol", BLOCK, *carried)
    return df.join(around, ["Symbol", BLOCK])


def per_symbol(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Join per-Symbol ``stats`` to rows.

    In a split table they go by way of the block list, so that the join key is the
    balanced (Symbol, _block) and not a hot Symbol.
    """
    if not is_split(df):
        return df.join(stats, "Symbol", "left")
    placed = df.select("Symbol", BLOCK).distinct().join(stats, "Symbol")
    return df.join(placed, ["Symbol", BLOCK], "left")


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    df = lay_out(df)
    if is_split(df):
        means = df.groupBy("Symbol").agg(*[F.avg(c).alias("_mean_" + c) for c in columns])
        df = per_symbol(df, means)
        return df.withColumns({c: F.coalesce(c, "_mean_" + c) for c in columns}).drop(
            *["_mean_" + c for c in columns]
        )
    whole = Window.partitionBy("Symbol")
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(c).over(whole)) for c in columns})


def cap_outliers(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Clip each column to 1.5 quartile ranges around its Symbol's quartiles; keep all rows."""
    columns = list(columns if columns is not None else value_columns(df))
    df = lay_out(df)
    if approx:
        sketches = [F.percentile_approx(c, [0.25, 0.75], 10_000).alias("_q_" + c) for c in columns]
        df = per_symbol(df, df.groupBy("Symbol").agg(*sketches))
    elif is_split(df):
        long = exact_quantiles(df, columns, [0.25, 0.75], ["Symbol"])
        wide = long.groupBy("Symbol").pivot("column", columns).agg(F.first("quantiles"))
        df = per_symbol(df, wide.withColumnsRenamed({c: "_q_" + c for c in columns}))
    else:
        whole = Window.partitionBy("Symbol")
        quartiles = {"_q_" + c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).over(whole) for c in columns}
        df = df.withColumns(quartiles)

    def clipped(c: str) -> Column:
        q1, q3 = F.col("_q_" + c)[0], F.col("_q_" + c)[1]
        margin = (q3 - q1) * WHISKER
        return F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), q1 - margin), q3 + margin))

    return df.withColumns({c: clipped(c) for c in columns}).drop(*["_q_" + c for c in columns])


def clean(df: DataFrame, method: str = "ffill", cap: bool = True, fits: bool | None = None) -> DataFrame:
    """De-duplicate, fill and cap.

    While every Symbol fits a task (``fits``, counted unless given) the leading exchange on
    Symbol serves all steps. Otherwise copies go first and the rest runs on blocks; each step
    is then stored, as the next one reads it more than once.
    """
    if fits is None:
        fits = series_fit(df, trusted=False)
    if fits:
        filled = fill(note_fit(dedupe_first(df.repartition("Symbol"))), value_columns(df), method)
        return cap_outliers(filled) if cap else filled
    blocks = split(cut_lineage(dedupe_first(df)))
    filled = cut_lineage(fill(blocks, value_columns(df), method))
    return cut_lineage(cap_outliers(filled)) if cap else filled


def auto_clean(df: DataFrame) -> DataFrame:
    """Forward then backward fill of every numeric column, per Symbol by Date."""
    return fill(df, numeric_columns(df), "ffill")
