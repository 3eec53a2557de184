"""Mix sources to target weights from fixed-length blocks of words.

Each source is one stream of words, cut into blocks of ``block`` words. Its target decides how many block slots it
gets. Output shards hold equal numbers of slots; how many of a shard's slots each source fills is a multinomial draw,
weighted by what the targets still leave, so every shard is a random mix and all shards together meet the targets.
Slot ``j`` of a source, counted over the shards in order, takes block ``j mod n`` of the epoch ``j div n`` under that
epoch's pseudorandom permutation of block numbers, so no block repeats before all were taken. Slots join blocks by number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD, table, words
from barloom.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 256
#: Documents of a source are summed in so many chunks first, so that no source's running sum is one task.
CHUNKS = 1024
#: Sources whose counts one task draws; more sources are first drawn as groups of about so many.
DRAWN_TOGETHER = 4096
#: Slots that one row of the slot table unfolds to.
SLOT_RUN = 4096
SCHEMA = "doc_id long, source string, size long, chunk int, tie long"


def _sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    tie = F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("text"))
    return docs.select(
        "doc_id",
        "source",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.pmod(tie, F.lit(CHUNKS)).cast("int").alias("chunk"),
        tie.alias("tie"),
    )


def _targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """One row per source: its size and target. Excess over ``most`` times a source's size goes to the others by weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    ranked = sizes.select("source", "source_size", weight.alias("weight"))
    # Filled in order of size / weight: a source is held at its cap when its share of what is left would exceed the cap.
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(upto), F.lit(0.0))
    level = left / F.sum("weight").over(rest)
    leveled = ranked.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") > F.col("source_size") * most)
    # the first source that isn't capped sets the level of all after it
    common = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.when(F.col("capped"), F.col("source_size") * most).otherwise(common * F.col("weight"))
    return leveled.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def deal(slots: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of every shard's ``sizes[s]`` places each source fills, one row per shard; the columns sum to ``slots``.

    Shard by shard, a multinomial draw weighted by the slots left. What it draws beyond those is drawn again.
    """
    left, counts = slots.astype(np.int64), np.zeros((len(sizes), len(slots)), dtype=np.int64)
    for shard, places in enumerate(sizes):
        places = int(places)
        while places:
            total = int(left.sum())
            got = left.copy() if places == total else np.minimum(rng.multinomial(places, left / total), left)
            left -= got
            counts[shard] += got
            places -= int(got.sum())
    return counts


def _draw_shards(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """Add ``shard_ends``, for each source the sums of its counts over the shards in order.

    Groups of sources are dealt to the shards first, then the sources of every group to its places in each shard.
    """

    def deal_groups(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pack")
        slots = rows["slots"].to_numpy()
        total = int(slots.sum())
        sizes = total // shards + (np.arange(shards) < total % shards)
        return pd.DataFrame({"pack": rows["pack"], "sizes": deal(slots, sizes, np.random.default_rng([seed, 0])).T.tolist()})

    def deal_sources(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("draw_seed")
        rng = np.random.default_rng([seed, 1, int(rows["pack"].iloc[0])])
        counts = deal(rows["slots"].to_numpy(), np.asarray(rows["sizes"].iloc[0]), rng)
        return rows.drop(columns=["pack", "sizes"]).assign(shard_ends=np.cumsum(counts, axis=0).T.tolist())

    packs = -(-max(1, sources.count()) // DRAWN_TOGETHER)
    packed = sources.withColumn("pack", F.pmod("draw_seed", F.lit(packs)).cast("long"))
    sums = packed.groupBy("pack").agg(F.sum("slots").alias("slots")).withColumn("all", F.lit(0))  # one row per DRAWN_TOGETHER sources
    places = sums.groupBy("all").applyInPandas(deal_groups, "pack long, sizes array<long>")
    schema = "source string, source_size long, target double, blocks long, slots long, draw_seed long, shard_ends array<long>"
    return packed.join(places, "pack").groupBy("pack").applyInPandas(deal_sources, schema)


def _permutation(n: Column, seed: Column) -> Column:
    """The numbers a and b of a pseudorandom permutation ``j -> (a j + b) mod n`` of 0..n-1.

    It is a permutation when a and n share no divisor. Of eight hashed candidates below n the first such is taken, or
    else 1.
    """

    def coprime(k: int) -> Column:
        tries = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: 1 + F.pmod(F.xxhash64(F.lit(k), seed, i), F.greatest(n - 1, F.lit(1))))
        # Euclid's algorithm ends within 92 steps for numbers below 2^63
        gcd = lambda a: F.aggregate(
            F.sequence(F.lit(0), F.lit(92)),
            F.struct(a.alias("a"), n.alias("b")),
            lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % s["b"]).alias("b")),
            lambda s: s["a"],
        )
        return F.coalesce(F.get(F.filter(tries, lambda a: gcd(a) == 1), F.lit(0)), F.lit(1).cast("long"))

    return F.struct(coprime(0).alias("a"), F.pmod(F.xxhash64(F.lit("shift"), seed), n).alias("b"))


def _times(a: Column, j: Column, n: Column) -> Column:
    """a j mod n, in decimals where the product may pass 63 bits."""
    wide = (a.cast("decimal(19,0)") * j.cast("decimal(19,0)")) % n.cast("decimal(19,0)")
    return F.when(n < 1 << 31, F.pmod(a * j, n)).otherwise(wide.cast("long"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.0, most: float = 3.0, block: int = BLOCK_WORDS, shards: int = 64, seed: int = 0):
    """The mix of ``docs``: (placed documents, slots).

    Placed documents: doc_id, source, tie, size, start (the document's first word in its source's stream), source_size,
    target. Slots: source, shard, slot, epoch, block_no: every block the mix takes, one row each time.
    """
    sized = cut_lineage(_sized(docs))
    chunks = sized.groupBy("source", "chunk").agg(F.sum("size").alias("words"))  # CHUNKS rows a source at most
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select("source", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("chunk_start"))
    targets = _targets(chunks.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    blocks = F.ceil(F.col("source_size") / block)
    # the last block may be short, so the slots are counted in words of a mean block
    mean_block = F.col("source_size") / F.greatest(blocks, F.lit(1))
    slots = F.when(blocks > 0, F.least(F.round(F.col("target") * share / mean_block), F.floor(blocks * most))).otherwise(0)
    sources = targets.select("source", "source_size", "target", blocks.cast("long").alias("blocks"), slots.cast("long").alias("slots"), F.xxhash64(F.lit("source"), "source").alias("draw_seed"))
    sources = cut_lineage(_draw_shards(cut_lineage(sources), shards, seed))
    inner = Window.partitionBy("source", "chunk").orderBy("tie", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    s1 = starts.select(F.col("source").alias("s1"), F.col("chunk").alias("c1"), "chunk_start")
    s2 = sources.select(F.col("source").alias("s2"), "source_size", "target")
    facts = s1.join(s2, same("s1", "s2"))  # CHUNKS rows a source at most, so documents join without a hot key
    placed = (
        sized.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(facts, same("source", "s1") & (F.col("chunk") == F.col("c1")))
        .select("doc_id", "source", "tie", "size", (F.col("chunk_start") + F.col("inner")).alias("start"), "source_size", "target")
    )
    # One row per source and epoch carries the permutation; it unfolds into runs, and the runs into slots.
    epochs = sources.where("slots > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, (slots - 1) div blocks)")))
    epochs = epochs.withColumn("perm", _permutation(F.col("blocks"), F.xxhash64(F.lit(seed), "draw_seed", "epoch")))
    runs = epochs.withColumn("first", F.explode(F.expr(f"sequence(epoch * blocks, least((epoch + 1) * blocks, slots) - 1, {SLOT_RUN}L)")))
    runs = runs.repartition(F.col("draw_seed"), F.col("first"))
    slots_out = (
        runs.withColumn("slot", F.explode(F.expr(f"sequence(first, least(first + {SLOT_RUN}L, (epoch + 1) * blocks, slots) - 1)")))
        .withColumn("block_no", (_times(F.col("perm.a"), F.col("slot") - F.col("epoch") * F.col("blocks"), F.col("blocks")) + F.col("perm.b")) % F.col("blocks"))
        .withColumn("shard", F.size(F.filter("shard_ends", lambda e: e <= F.col("slot"))))
    )
    return placed, slots_out.select("source", "shard", "slot", "epoch", "block_no")


def _hits(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """Every stretch of a document that a taken block covers: ``skip`` words of the document, then ``take`` words."""
    spans = placed.where("size > 0").withColumn("block_no", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    taken = slots.withColumnsRenamed({"source": "s", "block_no": "b"})
    first = F.greatest(F.col("start"), F.col("block_no") * block)
    last = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * block)
    joined = spans.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("block_no") == F.col("b")))
    return joined.withColumn("skip", first - F.col("start")).withColumn("take", last - first)


def mix_totals(docs: DataFrame, block: int = BLOCK_WORDS, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and n_shards of every document.

    taken counts the words each time they are taken; n_shards the output shards that hold any of them. A null text has no words. A null source is a source of its own, the last. A null doc_id is a document like others,
    repeated rows are taken alike up to rounding. Documents without words take none. An empty table gives no rows.
    """
    placed, slots = plan_mix(docs, block=block, **options)
    placed = cut_lineage(placed)
    # a block is taken ``most`` times at most, so its shards are few
    times = slots.groupBy("source", "block_no").agg(F.count(F.lit(1)).alias("times"), F.collect_set("shard").alias("shards"))
    held = F.size(F.array_distinct(F.flatten(F.collect_list("shards")))).cast("long")
    got = _hits(placed, times, block).groupBy("source", "start").agg(F.sum(F.col("take") * F.col("times")).alias("taken"), held.alias("n_shards"))
    got = got.select(F.col("source").alias("s"), F.col("start").alias("b"), "taken", "n_shards")
    return placed.join(got, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("b")) & (F.col("size") > 0), "left").select(
        "doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_shards")]
    )


def mix_shards(docs: DataFrame, block: int = BLOCK_WORDS, **options) -> DataFrame:
    """The mix as output shards: shard, source, slot, epoch, doc_id, start, skip, take.

    One row for every stretch of a document in a slot of a shard: after ``skip`` words of the document ``take`` words,
    in the order of the document's place in its source, ``start``. Documents without words are in no slot. Nulls in
    source and doc_id stay; an empty table gives no rows.
    """
    placed, slots = plan_mix(docs, block=block, **options)
    return _hits(cut_lineage(placed), slots, block).select("shard", "source", "slot", "epoch", "doc_id", "start", "skip", "take")


def mix_documents(docs: DataFrame, block: int = BLOCK_WORDS, **options) -> DataFrame:
    """The mix as documents: one row per document and epoch with the words taken, in the columns of ``docs``.

    A document taken whole keeps its text; of others the taken words are joined by single spaces, and n_chars, where
    the table has it, counts the new text. Documents without words are in no block and so not in the mix.
    """
    placed, slots = plan_mix(docs, block=block, **options)
    placed = cut_lineage(placed)
    # rows that repeat in full are told apart by a number
    twin = Window.partitionBy("doc_id", "tie").orderBy("start")
    hits = _hits(placed.withColumn("twin", F.row_number().over(twin)), slots, block)
    stretches = hits.groupBy("doc_id", "tie", "twin", "epoch").agg(
        F.array_sort(F.collect_list(F.struct("skip", "take"))).alias("stretches"), F.sum("take").alias("words"), F.first("size").alias("size")
    )
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("k"), F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("text")).alias("t"))
    keyed = keyed.withColumn("n", F.row_number().over(Window.partitionBy("k", "t").orderBy(F.lit(0))))
    joined = keyed.join(stretches, F.col("k").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tie")) & (F.col("n") == F.col("twin")))
    part = F.array_join(F.flatten(F.transform("stretches", lambda s: F.slice(F.col("all"), (s["skip"] + 1).cast("int"), s["take"].cast("int")))), " ")
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(part)
    out = joined.withColumn("all", F.when(F.col("words") < F.col("size"), words(F.col("row.text")))).withColumn("mixed", text)
    new = {"text": F.col("mixed"), "n_chars": F.char_length("mixed").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op10_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed 5:2:1 by source, as words taken."""
    return mix_totals(table(spark, sf_dir, "documents"))
