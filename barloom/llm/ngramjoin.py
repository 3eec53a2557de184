"""Documents that share most of their word n-grams, by a Jaccard self-join on token combinations.

The tokens of a document are its distinct n-word shingles. Two documents of n and m tokens reach the similarity only if
they share enough, so few tokens of either may be missing from the other:

1. Tokens are ordered by hash. The usual prefix holds a shared token of every similar pair; extended by half of itself it
   holds as many shared tokens. A document with fewer tokens in extended prefixes of others has no partner.
2. The tokens of the rest are counted and ordered from rare to frequent. Tokens of no other document use up what may be
   missing. Rare tokens in a prefix are indexed alone. Frequent ones are indexed in combinations of two neighbours within
   a prefix extended so far that a similar pair has two shared tokens next to each other in both documents.
3. Documents of one index entry are compared with one of them first; who is linked is settled. Others are compared with
   every document of the entry that isn't linked to them yet and whose size allows the similarity.

Equal sets are one class throughout. Links between classes are exact, whatever the order of comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import byte_words, table
from barloom.llm.components import connected_components
from barloom.llm.wordtable import WordTable
from barloom.session import cut_lineage

WORDS, PERCENT = 4, 85
#: A token that more classes share is frequent.
FREQUENT = 16
#: Of the entries before one, a class carries the first few: a pair that shares one of them is compared there.
TOLD = 32
#: One class in so many shows which tokens are hot: those of one in ``HOT_PART`` of its classes, so that there are at most
#: ``HOT_PART`` times as many as a class has on average.
HOT_SAMPLE, HOT_PART = 64, 256
#: Classes that survive the first step are marked in a bitmap of so many bits (8 MB); a chance mark costs time only.
MARK_BITS = 1 << 26
#: Documents whose sets a task holds at a time.
SLICE = 256


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(w, digest_size=8).digest(), "little") for w in words], dtype=np.uint64)[:, None]


def _shingle_set(hashes: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a list of word hashes; one for all of a short list."""
    if len(hashes) == 0:
        return np.empty(0, np.int64)
    k = min(words, len(hashes))
    h = np.full(len(hashes) - k + 1, 0x9E3779B97F4A7C15 + k & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for j in range(k):
        h = h * np.uint64(0x5851F42D4C957F2D) + hashes[j : len(hashes) - k + 1 + j]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def _prefix(n: int, percent: int) -> int:
    """So many tokens of a document of n hold one of any partner: all but those that must be shared, and one."""
    return n - -(-n * percent // 100) + 1


def _sets(words: int, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray], list]]:
    lookup = WordTable(_word_hashes)
    for batch in batches:
        # a slice at a time, so that a task never holds the sets of a whole batch of long texts
        for first in range(0, len(batch), SLICE):
            rows = batch.iloc[first : first + SLICE]
            texts = [byte_words(t if isinstance(t, str) else "") for t in rows["text"]]
            sets = [_shingle_set(lookup.rows[at, 0] if len(at) else np.empty(0, np.uint64), words) for at in lookup.look_up(texts)]
            keys = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield rows, sets, keys


def _first_step(words: int, percent: int):
    def run(batches):
        told: set[bytes | None] = set()
        for rows, sets, keys in _sets(words, batches):
            if not len(rows):
                continue
            half = [-(-_prefix(len(s), percent) // 2) for s in sets]
            # copies within a task speak for each other; rows without an id link with nothing and speak for none
            named = rows["doc_id"].notna().to_numpy()
            fresh = [bool(n) and not (k in told or told.add(k)) for n, k in zip(named, keys, strict=True)]
            heads = [s[: _prefix(len(s), percent) + k - 1] if f else s[:0] for s, k, f in zip(sets, half, fresh, strict=True)]
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "n": [len(s) for s in sets], "key": keys, "least": half, "head": heads})

    return run


def _marked_sets(words: int, marks):
    def run(batches):
        bits = np.frombuffer(marks.value, dtype=np.uint8)
        for _, sets, keys in _sets(words, batches):
            out = []
            for s, key in zip(sets, keys, strict=True):
                if key is not None:
                    bit = int.from_bytes(key[:8], "little") % MARK_BITS
                    if bits[bit >> 3] >> (bit & 7) & 1:
                        out.append((key, s))
            if out:
                yield pd.DataFrame({"key": [k for k, _ in out], "tokens": [s for _, s in out]})

    return run


def _bitmap(keys: DataFrame) -> bytes:
    """A bit for every key, by its first eight bytes; as many rows reach the driver as the bitmap has words at most."""
    text = F.hex("key")
    low = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(4))])  # little-endian, low half suffices
    bit = F.conv(low, 16, 10).cast("long") % MARK_BITS
    got = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits")).toPandas()
    out = np.zeros(MARK_BITS // 32, dtype=np.uint32)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return out.tobytes()


def _split_heads(hot):
    """For (class, head): (class, token, 0) for every token that isn't hot, and (class, class, n) for n hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.sort(np.frombuffer(hot.value, dtype=np.int64))
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                rows = batch.slice(first, SLICE)
                classes, heads = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1)
                row = np.repeat(np.arange(len(classes)), heads.value_lengths().to_numpy(zero_copy_only=False))
                tokens = heads.flatten().to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                met = known[at] == tokens if len(known) else np.zeros(len(tokens), bool)
                n = np.bincount(row[met], minlength=len(classes))
                own = classes[n > 0]
                columns = (np.concatenate([classes[row[~met]], own]), np.concatenate([tokens[~met], own]), np.concatenate([np.zeros(int((~met).sum()), np.int64), n[n > 0]]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["class", "token", "hot"])

    return run


def _shared_heads(heads: DataFrame) -> DataFrame:
    """class and k: how many of its tokens other classes have, too.

    ``heads`` holds (class, head) with all tokens of a class in every row of it, or (class, token). One exchange finds the
    shared tokens and their rows. Tokens that a sample of the classes shows to be in many are shared for sure; as few as
    they are, every task knows them and counts those of a class in its row, so that they make no rows of their own.
    """
    if "head" not in heads.columns:
        heads = heads.groupBy("class").agg(F.collect_set("token").alias("head"))
    sample = heads.where(F.pmod(F.xxhash64(F.lit("hot"), "class"), F.lit(HOT_SAMPLE)) == 0).select("class", F.explode("head").alias("token"))
    size = sample.agg(F.countDistinct("class")).first()[0]
    hot = sample.groupBy("token").agg(F.countDistinct("class").alias("k")).where(F.col("k") >= max(4, size // HOT_PART)).select("token")
    known = heads.sparkSession.sparkContext.broadcast(hot.toPandas()["token"].to_numpy(np.int64).tobytes())
    split = heads.select("class", "head").mapInArrow(_split_heads(known), "class long, token long, hot long").withColumn("met", F.col("hot") > 0)
    same = Window.partitionBy("token", "met")
    shared = split.withColumn("other", F.col("met") | (F.min("class").over(same) != F.max("class").over(same))).where("other")
    return shared.groupBy("class").agg((F.countDistinct(F.when(~F.col("met"), F.col("token"))) + F.max("hot")).alias("k"))


def _enough(n1, n2, percent: int):
    """Tokens that sets of n1 and n2 must share to be similar."""
    return F.ceil((n1 + n2) * percent / F.lit(100 + percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    return both.where(F.col("shared") * 100 >= (F.size("ta") + F.size("tb") - F.col("shared")) * percent).select("a", "b")


def _index(sets: DataFrame, percent: int) -> DataFrame:
    """Index entries of every class that can have a partner: entry, id, n, left (its tokens that others have)."""
    postings = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = postings.join(shared, "token")
    docs = known.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked")).withColumn("left", F.size("ranked"))
    must = F.ceil(F.col("n") * percent / 100)
    docs = docs.where(F.col("left") >= must).withColumn("p", (F.col("left") - must + 1).cast("int"))
    # a partner is at most n / similarity long, and may miss so many of its own
    most = F.floor(F.col("n") * (100 - percent) / percent).cast("int") + 1
    docs = cut_lineage(docs.select("id", "n", "left", "p", F.slice("ranked", 1, F.col("p") * 2 + most).alias("ranked")))
    rare = docs.select("id", "n", "left", F.explode(F.slice("ranked", 1, F.col("p"))).alias("t")).where(F.col("t.df") <= FREQUENT)
    rare = rare.select(F.xxhash64(F.lit(1), "t.token").alias("entry"), "id", "n", "left")
    two = F.transform(F.slice("ranked", 1, F.size("ranked") - 1), lambda t, i: F.struct(t.alias("x"), F.get("ranked", i + 1).alias("y")))
    pairs = docs.where(F.size("ranked") > 1).select("id", "n", "left", F.explode(two).alias("t")).where(F.col("t.y.df") > FREQUENT)
    pairs = pairs.select(F.xxhash64(F.lit(2), "t.x.token", "t.y.token").alias("entry"), "id", "n", "left")
    # a lone token is its own combination where nothing stands beside it
    lone = docs.where("size(ranked) = 1").select(F.xxhash64(F.lit(1), F.get("ranked", F.lit(0))["token"]).alias("entry"), "id", "n", "left")
    return rare.unionByName(pairs).unionByName(lone).distinct()


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of class ids that connect all similar classes: every similar pair, or a path of others that are."""
    entries = _index(sets, percent)
    met = entries.groupBy("entry").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(-F.col("left"), "id"))["id"].alias("pivot")).where("size > 1")
    entries = cut_lineage(entries.join(met, "entry"))
    # first every class with one other: the fullest of its largest entry
    star = entries.where("id <> pivot").groupBy("id").agg(F.max(F.struct("size", -F.col("pivot"))).alias("m"))
    star = star.select(F.col("id").alias("a"), (-F.col("m.col2")).alias("b"))
    first = cut_lineage(_verified(star, sets, percent))
    parts = connected_components(first)
    held = entries.join(parts.withColumnsRenamed({"node": "id", "component": "c"}), "id", "left").withColumn("c", F.coalesce("c", "id"))
    sizes = held.groupBy("entry", "c").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("entry").agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_ = cut_lineage(held.join(main, "entry").select("entry", "id", "n", "left", "c", "main"))
    listed = open_.groupBy("id", "n", "left", "c").agg(F.array_sort(F.collect_list(F.struct("entry", "main"))).alias("e"))
    least = listed.withColumn("low", F.slice("e.entry", 1, TOLD))
    rows = least.select("id", "n", "left", "c", "low", F.posexplode("e").alias("i", "e"))
    rows = rows.select("e.entry", "id", "n", "left", "c", "e.main", F.slice("low", 1, F.least("i", F.lit(TOLD))).alias("before"))
    x = rows.where("c <> main").select("entry", F.col("id").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), F.col("c").alias("ca"), F.col("before").alias("ea"))
    y = rows.select("entry", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), F.col("c").alias("cb"), "main", F.col("before").alias("eb"))
    possible = F.least("la", "lb") >= _enough(F.col("na"), F.col("nb"), percent)
    once = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
    pairs = x.join(y, "entry").where(once & possible & ~F.arrays_overlap("ea", "eb"))
    rest = _verified(pairs.select("a", "b").distinct(), sets, percent)
    return first.unionByName(rest)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Documents link when ``100 * shared >= percent * all`` of their distinct ``words``-word shingles; fewer words make one
    shingle. A component is what links reach; its id is its smallest doc_id. Null, empty and wordless texts have no
    shingles and only themselves. Rows with a null doc_id link with nothing and have a null component. Rows that share a
    doc_id share its component if their texts do, else each row has its own. An empty table gives no rows.
    """
    source = docs.select("doc_id", "text")
    schema = "doc_id long, n int, key binary, least int, head array<long>"
    seen = cut_lineage(source.mapInPandas(_first_step(words, percent), schema).withColumn("class", F.xxhash64("key")))
    named = seen.where("key is not null and doc_id is not null")
    counted = _shared_heads(named.where("size(head) > 0").select("class", "head"))
    # a class may be told by several tasks; its rows are equal
    told = named.where("size(head) > 0").select("class", "key", "least").distinct()
    chosen = cut_lineage(counted.join(told, "class").where("k >= least").select("key"))
    marks = docs.sparkSession.sparkContext.broadcast(_bitmap(chosen))
    found = source.where("doc_id is not null").mapInPandas(_marked_sets(words, marks), "key binary, tokens array<long>")
    # one set per class, named by the hash of its key
    sets = cut_lineage(found.dropDuplicates(["key"]).select(F.xxhash64("key").alias("id"), "tokens"))
    parts = connected_components(_links(sets, percent)).withColumnsRenamed({"node": "class"})
    classes = seen.where("key is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("id"))
    named = classes.join(parts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    labels = named.join(least, "component").select(F.col("class").alias("of"), "component_id")
    mine = F.col("doc_id").isNotNull() & F.col("key").isNotNull()
    # rows without a class get one of their own, so that they don't meet in one task
    out = seen.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(mine, F.col("class")).otherwise(F.xxhash64(F.lit("alone"), F.monotonically_increasing_id())).alias("class"), mine.alias("mine"))
    joined = out.join(labels, F.col("mine") & (F.col("class") == F.col("of")), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents whose 4-word shingles are 85% alike."""
    return jaccard_components(table(spark, sf_dir, "documents"))
