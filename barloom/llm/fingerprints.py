"""Fingerprints by consistent weighted sampling.

A text is a bag of words; a word's weight is how often it occurs. Every sample k gives each word hashed draws
``r, c ~ Gamma(2, 1)`` and ``b ~ Uniform(0, 1)``, the level ``t = floor(ln(weight) / r + b)`` and the value
``ln a = ln c - r (t - b + 1)``; the least value in the text is the sample. Two texts agree on a sample with a
probability equal to their generalised Jaccard similarity, sum(min) / sum(max) of the weights. A value depends on
nothing but the word, its level and k, so the values stand for (word, level), and 16 bits of their hashes are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import table, tree_search

SAMPLES = 32
#: Ranges of doc_id per shuffle partition, in which neighbours are found.
RANGES_PER_PARTITION = 8
_LEAST = -(1 << 63)


def _draw(word: Column, level_log: Column, k: int) -> Column:
    """ln a of one word for sample k, from 128 hashed bits."""
    x, y = F.xxhash64(word, F.lit(2 * k)), F.xxhash64(word, F.lit(2 * k + 1))
    low = lambda z: z.bitwiseAND((1 << 26) - 1).cast("double") + 0.5
    mid = lambda z: F.shiftright(z, 26).bitwiseAND((1 << 26) - 1).cast("double") + 0.5
    gamma = lambda z: -F.log(low(z) * mid(z) * 2.0**-52)
    top = F.shiftleft(F.shiftrightunsigned(x, 52), 12).bitwiseOR(F.shiftrightunsigned(y, 52))
    b = (top.cast("double") + 0.5) * 2.0**-24
    r = gamma(x)
    return F.log(gamma(y)) - r * (F.floor(level_log / r + b) - b + 1.0)


def fingerprint_texts(df: DataFrame, text: str, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """One row per combination of ``keys`` with ``signature``, an array of ``samples`` 16-bit numbers.

    ``keys`` must tell the rows apart. A text without words, or null, has a null signature.
    """
    hashed = F.sort_array(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: F.when(w != "", F.xxhash64(w))))
    n = F.size("hashes")
    # last position of each run of equal hashes; its length is the weight
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (F.get("hashes", i) != F.get("hashes", i + 1)))
    listed = df.withColumn("hashes", F.filter(hashed, lambda h: h.isNotNull()))
    listed = listed.select(*keys, "hashes", F.when(n > 0, ends).alias("ends"))
    terms = listed.select(*keys, "hashes", "ends", F.posexplode_outer("ends").alias("j", "end"))
    terms = terms.select(
        *keys, F.get("hashes", F.col("end")).alias("word"), F.log((F.col("end") - F.coalesce(F.get("ends", F.col("j") - 1), F.lit(-1))).cast("double")).alias("level_log")
    )
    least = terms.groupBy(*keys).agg(*[F.min(_draw(F.col("word"), F.col("level_log"), k)).alias(f"a{k}") for k in range(samples)])
    parts = [F.xxhash64(f"a{k}").bitwiseAND(0xFFFF).cast("int") for k in range(samples)]
    return least.select(*keys, F.when(F.col("a0").isNotNull(), F.array(*parts)).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of samples two signatures agree on: an estimate of their generalised Jaccard similarity. No words equal no words."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(same)


def as_text(signature: Column) -> Column:
    """Four hexadecimal digits a sample; empty without words."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), ""), F.lit(""))


def _neighbours(docs: DataFrame) -> DataFrame:
    """Documents in ranges of doc_id, numbered, each range ended by a copy (``guest``) of the next one's first document."""
    order = F.coalesce(F.col("doc_id"), F.lit(_LEAST))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), order.alias("ord"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(4096, max(8, RANGES_PER_PARTITION * partitions))
    probabilities = [i / ranges for i in range(1, ranges)]
    cuts = rows.select("ord").stat.approxQuantile("ord", probabilities, 0.25 / ranges)  # a bounded list of numbers
    placed = tree_search(rows, "ord", sorted({int(c) for c in cuts}), "range").withColumn("tie", F.xxhash64("text"))
    # the first document of each range, by its id, then by its text
    starts = placed.groupBy("range").agg(F.min("ord").alias("first"))
    held = placed.join(F.broadcast(starts.withColumnRenamed("range", "of")), (F.col("range") == F.col("of")) & (F.col("ord") == F.col("first")))
    held = held.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("tie"))).where("rank = 1")
    ring = Window.orderBy("range")  # one row per range
    last = F.max("range").over(Window.partitionBy())
    guests = held.withColumn("host", F.coalesce(F.lag("range").over(ring), last))
    guests = guests.select("doc_id", "text", "ord", F.col("host").alias("range"), "tie", F.lit(1).alias("guest"))
    both = placed.select("doc_id", "text", "ord", "range", "tie", F.lit(0).alias("guest")).unionByName(guests)
    walk = Window.partitionBy("range").orderBy("guest", "ord", "tie")
    return both.select("*", F.row_number().over(walk).alias("rn"), F.lead("text").over(walk).alias("next_text"))


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprint every document, its edited text and their likeness, and the likeness to the next document.

    The edited text has its last quarter of code points replaced by as many first ones of the next document in order of
    doc_id, the first after the last. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. A null text counts as empty; a null doc_id comes first; rows that share a doc_id are
    ordered by a hash of their text. Empty fingerprints belong to texts without words. A lone document follows itself.
    An empty table gives no rows. Other columns are ignored.
    """
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substr(text, 1, n_chars - quarter)"), F.expr("substr(coalesce(next_text, ''), 1, quarter)"))
    rows = _neighbours(docs).withColumn("n_chars", n).withColumn("quarter", quarter).withColumn("edited", edited)
    both = rows.select(
        "range", "rn", "guest", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("v"),
    )
    both = both.select("range", "rn", "guest", "doc_id", "n_chars", "edited_sha256", "v.kind", "v.body")
    signed = fingerprint_texts(both, "body", ["range", "rn", "guest", "doc_id", "n_chars", "edited_sha256", "kind"], samples)
    walk = Window.partitionBy("range").orderBy("rn", "kind")
    seen = signed.withColumn("edited_signature", F.lead("signature", 1).over(walk)).withColumn("next_signature", F.lead("signature", 2).over(walk))
    return seen.where("kind = 0 AND guest = 0").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op3_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))
