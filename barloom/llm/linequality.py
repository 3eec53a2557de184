"""Quality rules from the frequency of lines across documents.

Lines are normalised (A-Z in lower case, a run of digits as one 0, white space runs as one space) and hashed. For every
host, a line is counted in the distinct texts that hold it, so copies of one text count once. Lines in more than
``most_texts`` of them are boilerplate and are removed; a document that loses more than ``most_removed`` percent of its
words so is depleted and rejected, as are texts that fail the base rules: too few words, or too many words in repeated
three-word windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import column_or_null, join_counted, table
from barloom.session import cut_lineage

#: A line in more distinct texts of one host is boilerplate; a document may lose so many percent of its words to such lines.
MOST_TEXTS, MOST_REMOVED = 10, 50
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\v\f\r"
_DIGITS = re.compile(rb"[0-9]+")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def normal_line(line: bytes) -> bytes:
    """What lines are compared by; empty for a line without a word."""
    return _DIGITS.sub(b"0", b" ".join(line.split()).lower())


def line_key(normal: bytes) -> int:
    return int.from_bytes(blake2b(normal, digest_size=8).digest(), "little", signed=True)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window which the text holds twice or more."""
    if len(words) < 4:
        return 0
    index: dict[bytes, int] = {}
    at = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    n = len(index)
    pairs = at[:-1] * n + at[1:]
    if n**3 >= 1 << 63:  # so many words that three numbers don't fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows, back, times = np.unique(pairs[:-1] * n + at[2:], return_inverse=True, return_counts=True)
    if len(windows) == len(back):
        return 0
    again = times[back] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : shift + len(again)] |= again
    return int(inside.sum())


def _measured(text: str) -> tuple[list[int], dict[int, int]]:
    """The base measures of a text, and the words in its lines by line key."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[bytes] = set()
    held: dict[int, int] = {}
    again = 0
    for line in data.split(b"\n"):
        normal = normal_line(line)
        if not normal:
            continue
        again += line in seen
        seen.add(line)
        key = line_key(normal)
        held[key] = held.get(key, 0) + normal.count(b" ") + 1
    measures = [len(words), len(text) - len(data) + len(data.translate(None, BLANKS)), len(data) - len(data.translate(None, SYMBOLS)), again, repeated_words(words)]
    return measures, held


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        got = [_measured(t if isinstance(t, str) else "") for t in rows["text"]]
        out = rows.drop(columns="text").reset_index(drop=True)
        out["doc_id"] = out["doc_id"].astype("Int64")
        for i, name in enumerate(x.split()[0] for x in MEASURES.split(", ")):
            out[name] = [m[i] for m, _ in got]
        out["line_keys"] = [list(h) for _, h in got]
        out["line_words"] = [list(h.values()) for _, h in got]
        yield out


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, text, and hashes of the host and the text; null hosts are one host, null texts equal empty ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.lit("host"), column_or_null(docs, host, "string")).alias("host_key"), F.xxhash64(text).alias("text_key"))


def profile_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """One stored row per document with its hashes, base measures and the hashes and words of its lines."""
    schema = f"doc_id long, host_key long, text_key long, {MEASURES}, line_keys array<long>, line_words array<int>"
    return cut_lineage(_keyed(docs, host).mapInPandas(_profiles, schema)).withColumn("row", F.monotonically_increasing_id())


def frequent_lines(profiles: DataFrame, most_texts: int = MOST_TEXTS) -> DataFrame:
    """host_key, line, texts and rows of the lines that more than ``most_texts`` distinct texts of a host hold."""
    lines = profiles.select("host_key", "text_key", F.explode("line_keys").alias("line"))
    by_text = lines.groupBy("host_key", "line", "text_key").agg(F.count(F.lit(1)).alias("n"))
    return by_text.groupBy("host_key", "line").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows")).where(F.col("texts") > most_texts)


def _removed(profiles: DataFrame, most_texts: int) -> DataFrame:
    """row, line and words of every boilerplate line of every document."""
    frequent = cut_lineage(frequent_lines(profiles, most_texts).drop("texts"))
    total = profiles.agg(F.sum(F.size("line_keys"))).first()[0] or 0
    lines = profiles.select("row", "host_key", F.explode(F.arrays_zip(F.col("line_keys").alias("line"), F.col("line_words").alias("words"))).alias("l"))
    return join_counted(lines.select("row", "host_key", "l.line", "l.words"), frequent, ["host_key", "line"], "rows", total)


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def judge_lines(docs: DataFrame, host: str = "source", most_texts: int = MOST_TEXTS, most_removed: int = MOST_REMOVED) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and n_removed_words, for every row of ``docs``.

    A null text counts as empty and, having too few words, fails; so does an empty one. A null or missing host is a host
    of its own. Null and repeated ids stay, repeated rows are judged alike, other columns are ignored, an empty table
    gives no rows.
    """
    profiles = profile_lines(docs, host)
    sums = _removed(profiles, most_texts).groupBy("row").agg(F.sum("words").alias("gone"))
    n, gone, failed = F.col("n_words"), F.coalesce("gone", F.lit(0)), _base_failed()
    names = [x.split()[0] for x in MEASURES.split(", ")]
    return profiles.drop("line_keys", "line_words").join(sums, "row", "left").select(
        "doc_id", *names, failed.alias("base_failed"), (~failed & (gone * 100 <= n * most_removed)).alias("kept"), gone.cast("long").alias("n_removed_words")
    )


def strip_lines(docs: DataFrame, host: str = "source", most_texts: int = MOST_TEXTS, most_removed: int = MOST_REMOVED) -> DataFrame:
    """The documents that pass, with all their columns and without their boilerplate lines.

    n_chars, where the table has it, counts the new text. Texts that lose nothing stay as they are. Rows are told apart by
    host and text, so null and repeated ids do no harm.
    """
    profiles = profile_lines(docs, host)
    gone = _removed(profiles, most_texts).groupBy("row").agg(F.collect_set("line").alias("gone"), F.sum("words").alias("lost"))  # a text's own lines at most
    held = profiles.drop("line_keys", "line_words").join(gone, "row", "left")
    passed = held.where(~_base_failed() & (F.coalesce("lost", F.lit(0)) * 100 <= F.col("n_words") * most_removed))
    # equal texts of a host have equal verdicts, so one row for each says all
    good = passed.groupBy("host_key", "text_key").agg(F.first("gone").alias("gone"), F.count(F.lit(1)).alias("rows"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for text, keys in zip(texts, lines, strict=True):
            drop = set(keys) if keys is not None else set()
            if drop and isinstance(text, str):
                text = b"\n".join(x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if not (y := normal_line(x)) or line_key(y) not in drop).decode("utf-8", "surrogatepass")
            out.append(text)
        return pd.Series(out, dtype=object)

    keyed = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.lit("host"), column_or_null(docs, host, "string")).alias("host_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    met = join_counted(keyed, cut_lineage(good), ["host_key", "text_key"], "rows", profiles.count()).withColumn("_text", without(F.col("_row.text"), F.col("gone")))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return met.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op11_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdicts of all documents; their source is the host."""
    return judge_lines(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT rid, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS k FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT rid, count(DISTINCT p) AS n FROM twice GROUP BY rid),
split AS (SELECT rid, source, t, string_split(t, chr(10)) AS ls FROM w),
lines AS (SELECT rid, source, t, j, ls[j] AS x, regexp_extract_all(ls[j], '[^\x20\x09-\x0D]+') AS ws FROM split, unnest(range(1, len(ls) + 1)) AS u(j)),
real AS (
  SELECT rid, source, t, j, x, len(ws) AS words, row_number() OVER (PARTITION BY rid, x ORDER BY j) AS nth,
         regexp_replace(translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS normal
  FROM lines WHERE len(ws) > 0),
dups AS (SELECT rid, count(*) AS n FROM real WHERE nth > 1 GROUP BY rid),
frequent AS (SELECT source, normal FROM real GROUP BY source, normal HAVING count(DISTINCT t) > {MOST_TEXTS}),
removed AS (SELECT rid, sum(words) AS n FROM real r WHERE EXISTS (SELECT 1 FROM frequent f WHERE f.source IS NOT DISTINCT FROM r.source AND f.normal = r.normal) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
         CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN removed USING (rid))
SELECT *, n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED} AS base_failed,
       n_words >= {LEAST_WORDS} AND n_repeat_words * 100 <= n_words * {MOST_REPEATED} AND n_removed_words * 100 <= n_words * {MOST_REMOVED} AS kept
FROM m
"""
