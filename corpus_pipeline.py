"""A corpus from raw documents: identified, joined, decontaminated, mixed and sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows to the shared folder and
reads them again as the next one's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import held_out, table
from barloom.llm.decontaminate import drop_contaminated
from barloom.llm.langid import fit_languages, keep_identified
from barloom.llm.mixing import mix_documents
from barloom.llm.ngramjoin import jaccard_components
from barloom.llm.sharding import shard_documents
from barloom.session import fresh_folder

#: Near duplicates of the pipeline: five words to a shingle, a similarity of 0.8.
WORDS, PERCENT = 5, 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The models and the SQL of stages are no SQL; tests compare run() with its stages by brute force.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter, or too uncertain, go."""
    model = fit_languages(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    return keep_identified(docs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest doc_id; others go.

    Rows with a null doc_id link with nothing and stay. Of rows that repeat a doc_id and its text one stays.
    """
    found = jaccard_components(docs, WORDS, PERCENT)
    # several texts under one doc_id: the document stays if any of them leads its component
    leaders = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(leaders, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return named.unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources as documents: what the blocks take of each, once per time."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in shards of equal bytes: doc_id, size, text_crc32, shard, slot and the columns of documents."""
    return shard_documents(docs, carry=COLUMNS)


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_folder(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
