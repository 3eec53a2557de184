"""Sharding, fingerprints and decontamination: plain Spark functions only."""

import hashlib
import zlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from barloom.llm.common import table, tree_search
from barloom.llm.decontaminate import drop_contaminated, find_passages
from barloom.llm.fingerprints import fingerprint_documents, op3_weighted_fingerprints
from barloom.llm.sharding import op8_sampled_shards, shard_documents


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plan_of_tree_search_holds_cuts_once(spark):
    """The driver plans thousands of cuts as one literal: not one per cut, nor one list per level."""
    cuts = list(range(10**9, 10**9 + 2000))
    plan = tree_search(spark.range(3), "id", cuts, "n")._jdf.queryExecution()
    for stage in (plan.analyzed().toString(), plan.optimizedPlan().toString()):
        assert stage.count(str(cuts[700])) <= 1 and stage.count("Project") == 1


def test_tree_search_counts_cuts(spark):
    cuts = [-5, 0, 3, 3, 10]
    rows = tree_search(spark.createDataFrame([(x,) for x in range(-8, 13)], "k long"), "k", sorted(set(cuts)), "n").collect()
    assert all(r["n"] == sum(c <= r["k"] for c in set(cuts)) for r in rows)


def test_shards_are_even_gapless_and_keep_groups(spark, sf_dir):
    out = op8_sampled_shards(spark, sf_dir).toPandas()
    docs = table(spark, sf_dir, "documents").toPandas()
    assert sorted(out["doc_id"]) == sorted(docs["doc_id"])
    texts = dict(zip(docs["doc_id"], docs["text"], strict=True))
    assert all(s == len((texts[i] or "").encode()) + 1 and c == zlib.crc32((texts[i] or "").encode()) for i, s, c in out[["doc_id", "size", "text_crc32"]].itertuples(index=False))
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2 * out["size"].max()


def test_a_hot_text_is_cut_over_shards(spark):
    rows = [(i, "the same text over and over") for i in range(600)] + [(i, f"text {i} " * (i % 7)) for i in range(600, 1800)]
    out = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 0.02 * sizes.mean() + 60
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_shards_of_odd_rows(odd, empty, odd_rows):
    out = shard_documents(odd, shards=3, carry=odd.columns).toPandas()
    assert len(out) == len(odd_rows) and {"text", "lang", "source"} <= set(out.columns)
    assert out.loc[out["doc_id"] == 3, "size"].tolist() == [1] and out.loc[out["doc_id"] == 3, "text_crc32"].tolist() == [0]
    for _, part in out.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert shard_documents(empty).count() == 0
    with pytest.raises(ValueError):
        shard_documents(odd, shards=0)


def bag_likeness(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_fingerprints_against_brute_force(spark, sf_dir):
    df = op3_weighted_fingerprints(spark, sf_dir)
    assert "Python" not in plan(df) and "Pandas" not in plan(df)
    out = df.toPandas().sort_values("doc_id").reset_index(drop=True)
    docs = table(spark, sf_dir, "documents").toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = [t or "" for t in docs["text"]]
    errors = []
    for i, text in enumerate(texts):
        follows = texts[(i + 1) % len(texts)]
        q = len(text) // 4
        edited = text[: len(text) - q] + follows[:q]
        assert out["n_chars"][i] == len(text) and out["edited_sha256"][i] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [out["near_edited"][i] - bag_likeness(text, edited), out["near_next"][i] - bag_likeness(text, follows)]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.4
    same = docs.assign(f=out["fingerprint"]).groupby("text")["f"].nunique()
    assert same.max() == 1


def test_fingerprints_of_odd_rows(odd, empty, odd_rows, spark):
    out = fingerprint_documents(odd, samples=8).toPandas()
    assert len(out) == len(odd_rows) and out[["near_edited", "near_next"]].ge(0).all().all() and out[["near_edited", "near_next"]].le(1).all().all()
    assert set(out.loc[out["doc_id"].isin([3, 4, 5]), "fingerprint"]) == {""}
    assert fingerprint_documents(empty).count() == 0
    alone = fingerprint_documents(spark.createDataFrame([(1, "one two")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"one two"[:6] + b"o").hexdigest()


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three four five six"


def passages(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_passages_are_found_whole_and_edited(spark):
    words = ITEM.split()
    edited = " ".join([*words[:28], "changed", *words[29:]])  # 2 of 26 shingles lost on either side
    half = " ".join(words[:15])
    docs, items = passages(spark, ["x " * 50 + ITEM.upper() + "! and more", "start " + edited, half + " and something else entirely follows it here", ITEM, None, "", ITEM[:30]], [ITEM, "too short", None, ""])
    out = find_passages(docs, items).toPandas().sort_values("doc_id")
    assert out["doc_id"].tolist() == [0, 1, 3] and out["similarity"].iloc[[0, 2]].tolist() == [1.0, 1.0]
    assert out["start"].tolist() == [50, 1, 0] and 0.8 <= out["similarity"].iloc[1] < 1
    assert sorted(r["doc_id"] for r in drop_contaminated(docs, items).collect()) == [2, 4, 5, 6]


def test_passages_without_a_broadcast_are_the_same(spark, sf_dir, monkeypatch):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = sorted(map(tuple, find_passages(docs, items).collect()))
    monkeypatch.setattr("barloom.llm.decontaminate.BROADCAST_SHINGLES", 0)
    assert sorted(map(tuple, find_passages(docs, items).collect())) == found and found


def test_passages_of_odd_rows(odd, empty, spark, odd_rows):
    items = spark.createDataFrame([(1, odd_rows[0][1]), (None, "another text with the same number"), (1, odd_rows[0][1])], "item_id long, text string")
    out = find_passages(odd, items).select("doc_id", "item_id").collect()
    # an item without a number is an item like others
    assert Counter(map(tuple, out)) == Counter([(1, 1), (2, 1), (8, None)])
    kept = drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows) - 4
    assert find_passages(empty, items).count() == 0 and find_passages(odd, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_passages(odd, items, radius=64)


def test_blocks_leave_no_pair_within_the_radius(spark):
    from barloom.llm.decontaminate import _blocks

    rows = spark.range(200).select(F.xxhash64("id").alias("simhash")).withColumn("other", F.col("simhash").bitwiseXOR((1 << 3) | (1 << 17) | (1 << 33) | (1 << 62)))
    a = rows.select("simhash", "other", _blocks("simhash", 4).alias("b"))
    b = rows.select(F.col("other").alias("o"), _blocks("other", 4).alias("c"))
    assert a.join(b, (F.col("b") == F.col("c")) & (F.col("other") == F.col("o"))).select("simhash").distinct().count() == 200


def test_short_items_are_found_inside_documents(spark):
    docs = spark.createDataFrame([(1, "one two alpha beta gamma"), (2, "Alpha, beta"), (3, "gamma alpha beta gamma delta alpha beta gamma"), (None, "alpha beta gamma"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta"), (3, "one two alpha beta gamma"), (4, "beta alpha")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start"], r["n_words"]) for r in find_passages(docs, items).collect()}
    assert got == {(1, 1, 2, 3), (3, 1, 1, 3), (None, 1, 0, 3), (3, 2, 4, 1), (1, 3, 0, 5)}


def test_passages_against_all_windows(spark, sf_dir):
    """Every window of every document against every item: what the blocks of bits let pass is all there is."""
    docs, items = table(spark, sf_dir, "documents").toPandas(), table(spark, sf_dir, "benchmark").toPandas()
    split = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    bag = lambda ws: Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4)))
    listed = {i: split(t) for i, t in zip(items["item_id"], items["text"], strict=True)}
    want = set()
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        ws = split(t)
        own = set(bag(ws)) if ws else set()
        for i, item in listed.items():
            need = bag(item)
            if not own & set(need):
                continue
            for at in range(max(1, len(ws) - len(item) + 1)):
                have = bag(ws[at : at + len(item)])
                if sum((have & need).values()) >= 0.8 * sum((have | need).values()):
                    want.add((d, i))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).collect()}
    assert len(want) > 0 and got <= want and len(got) >= 0.99 * len(want)
