"""Token counts as rollups that batches of changes keep up to date.

A rollup has one row per source, language and tokenizer version with the documents and tokens in it. A change is a
signed row: an insert adds a document and its tokens, a delete takes them away, and a revised count is a delete of the
old and an insert of the new. As all totals add up, a batch is summed by group first and then added to the rollup. A
batch is committed under its id: its sums are written to a folder of that name first, and a batch whose folder is
complete is not added again, so replays after a failure change nothing. The rollup is the sum over committed batches;
``compact`` folds them into one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import reduce
from importlib import import_module

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import WORD, table
from barloom.session import cut_lineage, fresh_folder

KEYS = ["source", "lang", "tokenizer"]
#: A piece: a run of letters, a run of digits, or one other mark that isn't ASCII white space.
PIECE = r"\p{L}+|\p{Nd}+|[^\p{L}\p{Nd}\x20\x09-\x0D]"


def words_1(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def pieces_1(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PIECE))


def bpe(ranks_path: str, pattern: str, keep: int = 200_000) -> Callable[[Column], Column]:
    """A counter for a byte-pair vocabulary of ranks (one base64 token and its rank a line), at a path all tasks can read.

    Texts are split by ``pattern`` and each distinct piece is encoded once per task, up to ``keep`` remembered pieces.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder_of, split = import_module("tiktoken").Encoding, import_module("regex").compile(pattern)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        encoder = encoder_of("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        sizes: dict[str, int] = {}
        for texts in batches:
            out = []
            for text in texts:
                total = 0
                for piece in split.findall(text or ""):
                    n = sizes.get(piece)
                    if n is None:
                        n = len(encoder.encode_ordinary(piece))
                        if len(sizes) < keep:
                            sizes[piece] = n
                    total += n
                out.append(total)
            yield pd.Series(out, dtype="int64")

    return lambda text: count(text)


COUNTERS: dict[str, Callable[[Column], Column]] = {"words-1": words_1, "pieces-1": pieces_1}


def measured(docs: DataFrame, counters: dict[str, Callable[[Column], Column]], text: Column, prefix: str = "n") -> DataFrame:
    """Add the tokens of ``text`` by each counter, as ``n0``, ``n1``, ...; a null text has none."""
    return docs.withColumns({f"{prefix}{i}": f(F.coalesce(text, F.lit(""))).cast("long") for i, f in enumerate(counters.values())})


def signed(counted: DataFrame, sign: int, counters: dict[str, Callable[[Column], Column]], prefix: str = "n") -> DataFrame:
    """Signed rows for documents whose tokens are known: source, lang, tokenizer, docs, tokens."""
    # summed before they are laid out by tokenizer, so one row per group and task moves
    sums = [F.sum(sign * F.col(f"{prefix}{i}")).alias(f"n{i}") for i in range(len(counters))]
    summed = counted.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("docs"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(f"n{i}").alias("tokens")) for i, name in enumerate(counters)]))
    return summed.select("source", "lang", rows.alias("r"), "docs").select("source", "lang", "r.tokenizer", (F.col("docs") * sign).cast("long").alias("docs"), "r.tokens")


def changes(docs: DataFrame, sign: int, counters: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Signed rows for documents: source, lang, tokenizer, docs, tokens. A null text has no tokens but is a document."""
    counters = counters or COUNTERS
    return signed(measured(docs.select("source", "lang", "text"), counters, F.col("text")), sign, counters)


def merged(*parts: DataFrame) -> DataFrame:
    """One row per group: the sums of signed rows. Groups without documents and tokens left are gone."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


class Rollup:
    """Totals in a shared folder, one subfolder per committed batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, batch: str):
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch={batch}")

    def committed(self, batch: str) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(batch), "_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add signed rows as a batch; False if it was committed before. An attempt that failed is written anew."""
        if self.committed(batch):
            return False
        merged(rows).coalesce(1).write.mode("overwrite").parquet(str(self._path(batch).toString()))
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName().removeprefix("batch=") for s in files.listStatus(root)] if files.exists(root) else []
        done = [str(self._path(n).toString()) for n in sorted(names) if self.committed(n)]
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        rows = self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)
        return merged(rows)

    def compact(self, folder: str) -> Rollup:
        """The same totals as one batch of another folder."""
        other = Rollup(self.spark, folder)
        other.commit("base", self.totals())
        return other


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by source, language and tokenizer version, after inserts, deletes, revisions and a replay.

    All documents come in; those labelled as of low quality go; toxic ones among the rest are revised to a text of
    words only. Every batch is sent twice.
    """
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    # tokens are counted once and before the joins, so no text moves
    words_only = F.regexp_replace("text", r"[^\p{L}\x20\x09-\x0D]+", "")
    both = measured(measured(docs.select("doc_id", "source", "lang", "text"), COUNTERS, F.col("text")), COUNTERS, words_only, "r")
    counted = cut_lineage(both.drop("text"))
    low = counted.join(marks.where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    toxic = counted.join(marks.where("quality = 1 and toxic = 1").select("doc_id"), "doc_id", "left_semi")
    rollup = Rollup(spark, fresh_folder(spark, "rollup"))
    for _ in range(2):
        rollup.commit("inserts", signed(counted, 1, COUNTERS))
        rollup.commit("deletes", signed(low, -1, COUNTERS))
        rollup.commit("revisions", merged(signed(toxic, -1, COUNTERS), signed(toxic, 1, COUNTERS, "r")))
    return rollup.totals()


OP2_SQL = r"""
WITH marks AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
kept AS (
  SELECT d.source, d.lang,
         CASE WHEN m.quality = 1 AND m.toxic = 1 THEN regexp_replace(d.text, '[^\p{L}\x20\x09-\x0D]+', '', 'g') ELSE d.text END AS text
  FROM documents d LEFT JOIN marks m ON d.doc_id = m.doc_id
  WHERE m.quality IS NULL OR m.quality <> 0),
counted AS (
  SELECT source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'pieces-1', coalesce(len(regexp_extract_all(text, '\p{L}+|\p{Nd}+|[^\p{L}\p{Nd}\x20\x09-\x0D]')), 0) FROM kept)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM counted GROUP BY ALL
"""
