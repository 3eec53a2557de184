"""From the column names of a file to the canonical ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from barloom.functions.columns import name
from barloom.operators.quality import (
    OPTIONAL,
    REQUIRED,
    coerce_dates,
    coerce_numbers,
    reason,
    watched,
    with_defaults,
)

# Names a column goes by, besides its own.
SYNONYMS = {
    "Date": ["date", "timestamp", "time", "datetime"],
    "Open": ["open", "opening", "open_price"],
    "High": ["high", "highest", "high_price"],
    "Low": ["low", "lowest", "low_price"],
    "Close": ["close", "closing", "close_price"],
    "Adj_Close": ["adj_close", "adjclose", "adjusted_close", "adj close", "adjusted close"],
    "Volume": ["volume", "vol", "trade_volume"],
    "Symbol": ["symbol", "ticker", "stock", "asset"],
}
# Words inside a column name, most telling first.
KEYWORDS = [
    (("adj", "close"), "Adj_Close"),
    (("close",), "Close"),
    (("open",), "Open"),
    (("high",), "High"),
    (("low",), "Low"),
    (("volume",), "Volume"),
    (("date",), "Date"),
    (("symbol",), "Symbol"),
]
# Words that make a column a candidate when no synonym matches.
CANDIDATES = {
    "Date": ["date", "time"],
    "Close": ["close", "price", "last"],
    "Open": ["open"],
    "High": ["high"],
    "Low": ["low"],
    "Volume": ["volume", "vol"],
}
ALWAYS = {"ohlc": REQUIRED, "close": ("Date", "Close")}


def infer_mapping(df: DataFrame) -> dict[str, str]:
    """``{canonical: actual}`` by exact name or synonym, ignoring case."""
    actual: dict[str, str] = {}
    for c in df.columns:
        actual.setdefault(c.lower(), c)
    found = {}
    for canonical in (*REQUIRED, *OPTIONAL):
        for wanted in (canonical.lower(), *SYNONYMS[canonical]):
            if wanted in actual:
                found[canonical] = actual[wanted]
                break
    return found


def find_column(df: DataFrame, keyword: str) -> str | None:
    """The first column whose name contains ``keyword``."""
    return next((c for c in df.columns if keyword.lower() in c.lower()), None)


def suggest_mapping(df: DataFrame) -> dict[str, str]:
    """``infer_mapping``, then the first unused candidate by keyword (``Close/Last``)."""
    found = infer_mapping(df)
    for canonical, words in CANDIDATES.items():
        if canonical not in found:
            options = [c for c in df.columns if any(w in c.lower() for w in words) and c not in found.values()]
            if options:
                found[canonical] = options[0]
    return found


def normalise_columns(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Rename by keyword; a second column of the same meaning gets the suffix ``_2`` and so on."""
    renamed, seen = [], {}
    for c in df.columns:
        target = next((t for words, t in KEYWORDS if all(w in c.lower() for w in words)), c)
        seen[target] = seen.get(target, 0) + 1
        renamed.append(name(c).alias(target if seen[target] == 1 else f"{target}_{seen[target]}"))
    df = df.select(*renamed)
    if "Close" in df.columns and "Adj_Close" not in df.columns:
        df = df.withColumn("Adj_Close", F.col("Close"))
    if symbol and "Symbol" not in df.columns:
        df = df.withColumn("Symbol", F.lit(symbol))
    return df


def mapped(df: DataFrame, mapping: Mapping[str, str] | None = None, require: str = "ohlc") -> DataFrame:
    """The canonical columns as they come, and the loader's ``_row``."""
    mapping = dict(mapping) if mapping is not None else suggest_mapping(df)
    missing = [c for c in ALWAYS[require] if c not in mapping]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    known = [c for c in (*REQUIRED, *OPTIONAL) if c in mapping]
    kept = [name(mapping[c]).alias(c) for c in known]
    if "_row" in df.columns:
        kept.append(F.col("_row"))
    return df.select(*kept)


def apply_mapping(
    df: DataFrame,
    mapping: Mapping[str, str] | None = None,
    require: str = "ohlc",
    symbol: str = "UNKNOWN",
    watch: Observation | None = None,
) -> DataFrame:
    """Project to canonical columns, parse dates and numbers and fill in defaults.

    ``require="close"`` accepts tables with only Date and Close. The loader's ``_row``
    is kept for de-duplication. ``watch`` counts what is left out, see ``quality.watched``.
    """
    chosen = mapped(df, mapping, require)
    if watch is not None:
        chosen = watched(chosen, watch)
    return with_defaults(coerce_numbers(coerce_dates(chosen)), symbol)


def rejected(df: DataFrame, mapping: Mapping[str, str] | None = None, require: str = "ohlc") -> DataFrame:
    """The rows that loading leaves out, with their values as they came and the ``reason``."""
    chosen = mapped(df, mapping, require)
    return chosen.withColumn("reason", reason(chosen)).filter("reason IS NOT NULL")
