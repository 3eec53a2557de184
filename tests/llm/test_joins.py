"""The n-gram join, mixing, token rollups and the pipeline."""

import sys
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import compare
import corpus_pipeline
from barloom.llm import mixing, ngramjoin, tokencounts
from barloom.llm.common import byte_words, table
from barloom.llm.components import connected_components
from barloom.llm.queries import ORACLE, QUERIES


def shingles(text, k):
    w = byte_words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(rows, k=4, percent=85):
    """Brute force: every pair of sets that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    shared = Counter((a, b) for ids in where.values() for a in ids for b in ids if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def joined(df, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(df, **options).collect()}


def test_links_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert joined(docs) == components(rows)


@pytest.mark.parametrize("seed", [0, 1])
def test_many_near_copies_against_brute_force(spark, seed):
    """A large group of copies edited to all degrees, so that many pairs are just similar or just not, and copies of copies."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(120)]
    rows, pool = [], [base]
    for i in range(260):
        words = list(pool[int(rng.integers(len(pool)))])
        for _ in range(int(rng.integers(0, 6))):
            at = int(rng.integers(len(words)))
            if rng.random() < 0.3:
                del words[at]
            else:
                words[at] = f"n{rng.integers(60)}"
        if rng.random() < 0.3:
            pool.append(words)
        rows.append((i, " ".join(words)))
    rows += [(300 + i, " ".join(f"own{i}x{j}" for j in range(100)) + " " + " ".join(base[:50])) for i in range(40)]
    rows += [(400 + i, " ".join(["tiny", "text", str(i % 3), "of", "few"][: 1 + i % 5])) for i in range(20)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == components(rows)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80) == components(rows, 5, 80)


def test_links_of_odd_rows(odd, empty, odd_rows):
    out = ngramjoin.jaccard_components(odd).toPandas()
    assert len(out) == len(odd_rows)
    assert out.loc[out["doc_id"].isin([1, 2]), "component_id"].tolist() == [1, 1, 1]
    assert set(out.loc[out["doc_id"].isin([3, 4, 5]), "n_shingles"]) == {0}
    assert out.loc[out["doc_id"].isna(), "component_id"].isna().all()
    assert ngramjoin.jaccard_components(empty).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 540)]
    rows = [*chain, *star, (7, 7), (9, 8), (8, 9), (None, 3), (160, 1000), (1000, 1001)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = {**{i: 100 for i in [*range(100, 161), 1000, 1001]}, **{i: 500 for i in range(500, 540)}, 8: 8, 9: 8}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def targets(sizes, weights=(5, 2, 1), most=3.0):
    """Water filling by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * sizes[s] + 1e-9}
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def test_mix_against_brute_force(spark, sf_dir):
    out = mixing.op10_block_mix(spark, sf_dir).toPandas()
    docs = table(spark, sf_dir, "documents").toPandas()
    source = dict(zip(docs["doc_id"], docs["source"], strict=True))
    size = {i: len((t or "").encode().split()) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    sums = Counter()
    for i, n in size.items():
        sums[source[i]] += n
    want = targets(sums)
    taken = Counter()
    for r in out.itertuples():
        assert r.size == size[r.doc_id] and r.source_size == sums[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]]) and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS for s in want)
    again = mixing.op10_block_mix(spark.newSession(), sf_dir).toPandas()
    assert sorted(again.itertuples(index=False)) == sorted(out.itertuples(index=False))


def test_small_sources_are_held_at_three_times_their_size(spark):
    rows = [(i, "w " * 40, "big") for i in range(100)] + [(200 + i, "v " * 10, "a") for i in range(3)] + [(300, "u " * 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_totals(docs, block=8).toPandas()
    want = targets({"big": 4000, "a": 30, None: 7})
    for part, name in ((out[out["doc_id"] < 200], "big"), (out[out["doc_id"].between(200, 299)], "a"), (out[out["doc_id"] == 300], None)):
        assert part["target"].iloc[0] == pytest.approx(want[name]) and abs(part["taken"].sum() - want[name]) <= 16 and (part["taken"] <= 3 * part["size"]).all()


def test_slots_take_every_block_before_one_repeats(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "a" if i % 3 else "b") for i in range(90)], "doc_id long, text string, source string")
    _, slots = mixing.plan_mix(docs, block=16, shards=5)
    rows = slots.toPandas()
    for _, part in rows.groupby("source"):
        assert sorted(part["slot"]) == list(range(len(part)))
        for _, epoch in part.groupby("epoch"):
            assert epoch["block_no"].is_unique
        assert part["shard"].between(0, 4).all() and (part.sort_values("slot")["shard"].diff().dropna() >= 0).all()


def test_shards_draw_their_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} " * 50, f"s{i % 40}") for i in range(400)], "doc_id long, text string, source string")
    whole = mixing.plan_mix(docs, block=16, shards=7)[1].toPandas()
    monkeypatch.setattr(mixing, "DRAWN_TOGETHER", 6)
    grouped = mixing.plan_mix(docs, block=16, shards=7)[1].toPandas()
    for rows in (whole, grouped):
        sizes = rows.groupby("shard").size()
        assert len(sizes) == 7 and sizes.max() - sizes.min() <= 1
        # a source's counts in the shards are random, and meet what it is to give in all
        assert rows.groupby("source")["shard"].agg(lambda of: of.value_counts().std()).max() > 0
        assert (rows.groupby("source").size() == whole.groupby("source").size()).all()
    stretches = mixing.mix_shards(docs, block=16, shards=7).toPandas()
    totals = mixing.mix_totals(docs, block=16, shards=7).toPandas().set_index("doc_id")
    by_doc = stretches.groupby("doc_id").agg(taken=("take", "sum"), n_shards=("shard", "nunique"))
    assert (totals.loc[by_doc.index, ["taken", "n_shards"]] == by_doc).all().all() and totals["taken"].sum() == by_doc["taken"].sum()
    assert (stretches.groupby(["source", "slot"])["take"].sum() <= 16).all() and stretches.groupby(["source", "slot"])["shard"].nunique().eq(1).all()
    assert mixing.mix_totals(docs, block=16, shards=1).toPandas()["n_shards"].max() == 1
    assert not mixing.mix_shards(docs, block=16, shards=7, seed=1).toPandas().equals(stretches)


def test_a_shard_draws_by_what_is_left():
    rng = np.random.default_rng(0)
    counts = np.mean([mixing.deal(np.array([50, 20, 10, 0]), np.array([20, 20, 20, 20]), rng) for _ in range(400)], axis=0)
    assert np.allclose(counts.sum(axis=0), [50, 20, 10, 0]) and np.allclose(counts.sum(axis=1), 20)
    assert np.allclose(counts, [[12.5, 5, 2.5, 0]] * 4, atol=0.5)
    assert mixing.deal(np.array([0, 0]), np.array([0, 0]), rng).sum() == 0


def test_products_beyond_63_bits(spark):
    n = 3_000_000_019
    row = spark.range(1).select(mixing._times(F.lit(n - 2), F.lit(n - 5), F.lit(n)).alias("p")).first()
    assert row["p"] == (n - 2) * (n - 5) % n


def test_mixed_documents_hold_what_is_taken(odd, empty, spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).toPandas().set_index("doc_id")["n"]
    want = mixing.mix_totals(docs).toPandas().set_index("doc_id")["taken"]
    assert (want[want > 0].sort_index() == got.sort_index()).all()
    odds = mixing.mix_documents(odd, block=8)
    assert odds.columns == odd.columns
    totals = mixing.mix_totals(odd, block=8).toPandas()
    assert len(totals) == odd.count() and (totals["taken"] <= 3 * totals["size"]).all() and (totals.loc[totals["size"] == 0, "taken"] == 0).all()
    assert sum(len(byte_words(r["text"])) for r in odds.collect()) == totals["taken"].sum()
    assert mixing.mix_totals(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_rollup_batches_count_once(spark, tmp_path, odd, empty):
    rollup = tokencounts.Rollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    assert rollup.commit("one", tokencounts.changes(odd, 1)) and not rollup.commit("one", tokencounts.changes(odd, 1))
    assert rollup.commit("none", tokencounts.changes(empty, 1))
    rows = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}
    assert rows["b", "de", "words-1"] == (3, 15) and rows[None, None, "words-1"] == (2, 0)
    (tmp_path / "r" / "batch=broken").mkdir()  # an attempt that never ended counts for nothing
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()} == rows
    assert rollup.compact(str(tmp_path / "s")).totals().count() == len(rows)
    rollup.commit("back", tokencounts.changes(odd, -1))
    assert rollup.totals().count() == 0
    with pytest.raises(ValueError):
        rollup.commit("../x", tokencounts.changes(odd, 1))


def test_bpe_counts_are_the_library_s(spark, sf_dir):
    import base64

    import tiktoken

    sys.path.insert(0, "/opt/tokenizers")
    try:
        tokenizers = __import__("public_tokenizers")
    except ModuleNotFoundError:
        pytest.skip("no tokenizer files here")
    finally:
        sys.path.remove("/opt/tokenizers")
    path = str(tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").limit(60)
    counter = tokencounts.bpe(path, tokenizers.PATTERN)
    got = {r["text"]: r["n"] for r in docs.select("text", counter(F.col("text")).alias("n")).collect()}
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoder = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(n == len(encoder.encode_ordinary(t)) for t, n in got.items())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, name):
    ours = compare.spark_table(QUERIES[name](spark, sf_dir))
    assert compare.difference(ours, compare.duck_table(compare.connect(sf_dir), ORACLE[name])) is None


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = docs
    stages = dict(corpus_pipeline.STAGES)
    identified = stages["language"](spark, kept, sf_dir)
    assert identified.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    rows = [(r["doc_id"], r["text"]) for r in identified.select("doc_id", "text").collect()]
    single = stages["near_duplicates"](spark, identified, sf_dir)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, (_, c) in components(rows, 5, 80).items() if i == c)
    clean = stages["decontamination"](spark, single, sf_dir)
    assert clean.columns == docs.columns and clean.count() < single.count()
    mixed = stages["mixing"](spark, clean, sf_dir)
    assert mixed.columns == docs.columns
    out = stages["sharding"](spark, mixed, sf_dir).toPandas()
    assert len(out) == mixed.count() and set(out["shard"]) == set(range(8))


def test_pipeline_on_odd_rows(spark, odd, empty, sf_dir):
    named = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (named, named.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.count()


def test_rows_without_an_id_hide_no_link(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " more"
    for rows in ([(None, text), (5, text), (6, text), (7, near)], [(7, near), (5, text), (6, text), (None, text)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = {r["doc_id"]: r["component_id"] for r in ngramjoin.jaccard_components(docs).collect()}
        assert got == {None: None, 5: 5, 6: 5, 7: 5}


def test_sets_are_made_a_slice_at_a_time():
    rows = pd.DataFrame({"doc_id": range(1000), "text": [f"w{i} a b c d e" if i % 9 else None for i in range(1000)]})
    got = list(ngramjoin._sets(4, iter([rows, rows[:0], rows[:10]])))
    assert max(len(part) for part, _, _ in got) <= ngramjoin.SLICE
    assert [i for part, _, _ in got for i in part["doc_id"]] == [*range(1000), *range(10)]
    assert all((key is None) == (not len(s)) for _, sets, keys in got for s, key in zip(sets, keys, strict=True))


@pytest.mark.parametrize("sample,part", [(64, 256), (1, 4)])
def test_shared_heads_with_hot_tokens(spark, monkeypatch, sample, part):
    """Tokens that others have, by brute force, where hot ones are broadcast; rows are exchanged by token once."""
    monkeypatch.setattr(ngramjoin, "HOT_SAMPLE", sample)
    monkeypatch.setattr(ngramjoin, "HOT_PART", part)
    rows = [(c, t) for c in range(40) for t in {0, c % 3, 10 + c % 17, 1000 + c}] + [(7, 0), (7, 0)]
    heads = spark.createDataFrame([*rows, (None, 5)], "class long, token long").where("class is not null")
    got = {r["class"]: r["k"] for r in ngramjoin._shared_heads(heads).collect()}
    classes = {}
    for c, t in rows:
        classes.setdefault(t, set()).add(c)
    want = {c: len({t for d, t in rows if d == c and len(classes[t]) > 1}) for c in range(40)}
    assert got == want
    plan = ngramjoin._shared_heads(heads)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(token#") == 1


@pytest.mark.parametrize("size", [100, 400])
def test_hot_tokens_make_no_rows_of_their_own(spark, monkeypatch, size):
    """A group of near copies: rows beside its shared tokens grow with the classes alone, and every token is counted."""
    monkeypatch.setattr(ngramjoin, "HOT_SAMPLE", 1)
    rows = [(c, [*range(50), 1000 + c, 5000 + c // 2]) for c in range(size)]
    heads = spark.createDataFrame([*rows, rows[0], (-1, [9_000_000])], "class long, head array<long>")
    counted = ngramjoin._shared_heads(heads)
    assert {r["class"]: r["k"] for r in counted.collect()} == {c: 51 for c in range(size)}
    assert "LeftSemi" not in counted._jdf.queryExecution().executedPlan().toString()
    hot = spark.sparkContext.broadcast(np.arange(50).tobytes())
    assert heads.mapInArrow(ngramjoin._split_heads(hot), "class long, token long, hot long").count() == 3 * (size + 1) + 1
    none = spark.sparkContext.broadcast(b"")
    assert heads.mapInArrow(ngramjoin._split_heads(none), "class long, token long, hot long").where("hot = 0").count() == 52 * (size + 1) + 1
