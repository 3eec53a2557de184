"""Find passages of a benchmark in documents.

Words are runs of letters and digits in lower case. A passage is a window of a document with as many words as the
benchmark item. Windows that share no shingle with any item can't be similar to one, so windows are laid where a shared
shingle puts the item. Their SimHash over weighted shingles (a shingle weighs how often it occurs) meets the items'
through blocks of bits: two fingerprints at most ``radius`` bits apart agree on one of ``radius + 1`` blocks, so no pair
within the radius is missed. The generalised Jaccard similarity of the weighted shingles then decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import table
from barloom.session import cut_lineage

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BITS, RADIUS = 64, 20
#: Up to so many benchmark shingles (about 24 bytes each) go to every task; more are joined by shuffle.
BROADCAST_SHINGLES = 2_000_000


def _listed(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def _shingles(words: str, k: int) -> Column:
    """Hashes of the k-word shingles in order; of the whole list if it has fewer words; none without words."""
    n = F.size(words)
    one = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), one)).otherwise(F.array().cast("array<long>"))


def _bit_sums(df: DataFrame, keys: list[str], shingles: str) -> DataFrame:
    """SimHash of an array of shingles: bit i says whether the shingles, with repeats, have bit i more often than not."""
    terms = df.select(*keys, F.explode(shingles).alias("term")).withColumn("term", F.xxhash64(F.lit("bit"), "term"))
    sums = [F.sum(F.shiftright("term", i).bitwiseAND(1) * 2 - 1).alias(f"s{i}") for i in range(BITS)]
    bits = [F.when(F.col(f"s{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(BITS)]
    return terms.groupBy(*keys).agg(*sums).select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("simhash"))


def _blocks(simhash: str, radius: int) -> Column:
    """``radius + 1`` pieces of the fingerprint, each with its number."""
    count = radius + 1
    edges = [i * BITS // count for i in range(count + 1)]
    piece = lambda i: F.shiftrightunsigned(simhash, edges[i]).bitwiseAND((1 << (edges[i + 1] - edges[i])) - 1)
    return F.explode(F.array(*[F.struct(F.lit(i).alias("no"), piece(i).alias("bits")) for i in range(count)]))


def _similarity(a: str, b: str) -> Column:
    """sum(min) / sum(max) of how often each shingle occurs in two arrays."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def _whole_matches(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """Items of fewer words than a shingle: a window is one shingle of as many words, so it is equal or has nothing in common."""
    words = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("tie"), _listed(F.col("text")).alias("words"))
    found = None
    for m in lengths:
        of = items.where(F.col("m") == m).select("item_id", F.get("item", F.lit(0)).alias("shingle")).distinct()
        rows = words.where(F.size("words") >= m).select("doc_id", "tie", F.posexplode(_shingles("words", m)).alias("start", "shingle"))
        rows = rows.groupBy("doc_id", "tie", "shingle").agg(F.min("start").cast("long").alias("start"))
        some = rows.join(of, "shingle").select("doc_id", "tie", "item_id", "start", F.lit(m).alias("n_words"), F.lit(0).alias("hamming"), F.lit(1.0).alias("similarity"))
        found = some if found is None else found.unionByName(some)
    return found


def find_passages(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The benchmark items that each document holds: doc_id, tie, item_id, start, n_words, hamming, similarity.

    ``start`` is the word where the best window begins, ``tie`` a hash of the text that tells rows of one doc_id apart.
    Null and empty texts hold nothing and are held by nothing. Equally similar windows: the first. Repeated documents
    give one row per item, repeated items one row each. A document shorter than an item is one window. Null ids stay.
    Items of fewer than ``shingle`` words are found where all their words stand together.
    """
    if not 0 <= radius < BITS:
        raise ValueError("radius must be between 0 and 63")
    items = benchmark.select("item_id", _listed(F.col("text")).alias("words")).select("item_id", F.size("words").alias("m"), _shingles("words", shingle).alias("item"))
    items = cut_lineage(items.where("m > 0").distinct())
    short = sorted(r["m"] for r in items.where(F.col("m") < shingle).select("m").distinct().collect())  # fewer than a shingle's words
    every, items = items, items.where(F.col("m") >= shingle).withColumn("item_key", F.xxhash64("item"))
    seeds = items.select("m", "item_key", F.posexplode("item").alias("at", "shingle")).distinct()
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("tie"), _listed(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "tie", F.size("words").alias("n"), _shingles("words", shingle).alias("all"))
    # the outer form keeps the optimizer from testing the list, and so building it, a second time
    at_all = F.posexplode_outer("all").alias("pos", "shingle")
    begin = F.greatest(F.least(F.col("pos") - F.col("at"), F.col("n") - F.col("m")), F.lit(0))
    window = F.slice("all", F.col("start") + 1, F.greatest(F.col("m") - (shingle - 1), F.lit(1)))
    if seeds.count() <= BROADCAST_SHINGLES:
        places = rows.select("*", at_all).join(F.broadcast(seeds), "shingle").withColumn("start", begin)
        found = places.select("doc_id", "tie", "m", "start", "item_key", window.alias("window")).distinct()
    else:
        places = rows.select("doc_id", "tie", "n", at_all).join(seeds, "shingle")
        places = places.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), "m", "item_key", begin.alias("start")).distinct()
        found = rows.join(places, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("doc_id", "tie", "m", "start", "item_key", window.alias("window")).distinct()
    found = cut_lineage(found.withColumn("content", F.xxhash64("window")))
    distinct = found.select("m", "content", "window").dropDuplicates(["m", "content"])  # a passage that many documents share is judged once
    left = _bit_sums(distinct, ["m", "content"], "window")
    right = _bit_sums(items.dropDuplicates(["m", "item_key"]), ["m", "item_key"], "item")
    # a window meets the items it shares a shingle with, others can't be similar, and of these the ones that share a block
    pairs = found.select("m", "content", "item_key").distinct().join(left, ["m", "content"])
    blocked = pairs.select("*", _blocks("simhash", radius).alias("block"))
    against = right.select(F.col("item_key").alias("ik"), F.col("m").alias("im"), F.col("simhash").alias("is"), _blocks("simhash", radius).alias("iblock"))
    met = blocked.join(against, (F.col("m") == F.col("im")) & (F.col("item_key") == F.col("ik")) & (F.col("block") == F.col("iblock")))
    near = met.withColumn("hamming", F.bit_count(F.col("simhash").bitwiseXOR(F.col("is")))).where(F.col("hamming") <= radius)
    near = near.select("m", "content", "item_key", "hamming").distinct()
    whole = items.select(F.col("m").alias("im"), F.col("item_key").alias("k"), "item").dropDuplicates(["im", "k"])
    judged = near.join(distinct, ["m", "content"]).join(whole, (F.col("m") == F.col("im")) & (F.col("item_key") == F.col("k")))
    sure = judged.withColumn("similarity", _similarity("window", "item")).where(F.col("similarity") >= similarity)
    hits = found.select("doc_id", "tie", "m", "start", "content", "item_key").join(sure.select("m", "content", "item_key", "hamming", "similarity"), ["m", "content", "item_key"])
    hits = hits.join(items.select("m", "item_key", "item_id").distinct(), ["m", "item_key"])
    best = Window.partitionBy("doc_id", "tie", "item_id").orderBy(F.desc("similarity"), "start")
    out = hits.withColumn("rank", F.row_number().over(best)).where("rank = 1").select(
        "doc_id", "tie", "item_id", F.col("start").cast("long").alias("start"), F.col("m").alias("n_words"), "hamming", "similarity"
    )
    if not short:
        return out
    both = out.unionByName(_whole_matches(docs, every, short))
    return both.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; null texts stay."""
    hits = find_passages(docs, benchmark, **options).select(F.col("doc_id").alias("d"), F.col("tie").alias("t")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("k"), F.xxhash64("text").alias("h"))
    clean = keyed.join(hits, F.col("k").eqNullSafe(F.col("d")) & (F.col("h") == F.col("t")), "left_anti")
    return clean.select("row.*")


def op6_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    found = find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("tie")
