"""Quality rules by line frequency, against plain loops."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from barloom.llm import linequality
from barloom.llm.common import join_counted
from barloom.llm.linequality import judge_lines, normal_line, repeated_words, strip_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, key string, shard string, rejected string"
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]


def judged(rows, most_texts=10, most_removed=50):
    texts = defaultdict(set)
    for _, text, _, host, *_ in rows:
        for line in (text or "").encode().split(b"\n"):
            if normal_line(line):
                texts[host, normal_line(line)].add(text)
    out, left = [], []
    for i, text, _, host, *_ in rows:
        text = text or ""
        data = text.encode()
        words, lines = data.split(), [x for x in data.split(b"\n") if x.split()]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        times = Counter(windows)
        again = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(3)}
        gone = sum(len(x.split()) for x in lines if len(texts[host, normal_line(x)]) > most_texts)
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        kept = not failed and gone * 100 <= most_removed * len(words)
        out.append((i, len(words), sum(len(w.decode()) for w in words), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed, kept, gone))
        if kept:
            left.append((i, "\n".join(x for x in text.split("\n") if len(texts[host, normal_line(x.encode())]) <= most_texts)))
    return sorted(out, key=repr), sorted(left, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    shared = ["All rights reserved 20%d.", "Subscribe to   our news & offers now", "a common line of a third of all rows in here"]
    rows = []
    for i in range(400):
        lines = [" ".join(rng.choice(["alpha", "beta", "Gamma", "déjà", "x#y", "7", "omega", "pi", "rho", f"w{rng.randint(0, 300)}"]) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), shared[0] % rng.randint(10, 99))
        if rng.random() < 0.05:
            lines += [shared[1]] * 3
        if rng.random() < 0.3:
            lines = [shared[2]] * rng.randint(1, 6) + lines[:2]
        rows.append((i, "\n".join(lines), "en", rng.choice(["hot", "hot", "hot", "b", "c", None]), 1, 2, "r", "k", "x", "no"))
    terms = [" ".join(f"t{k}x{j}" for j in range(12)).replace("t", "ab"[k % 2] + "t") + chr(97 + k) for k in range(6)]
    terms = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in x) for x in terms]
    rows += [(2000 + i, "\n".join([*terms, " ".join(f"mine{chr(97 + i)}{chr(97 + k)}" for k in range(40))]), "en", "b", 1, 2, "r", "k", "x", "no") for i in range(14)]
    copy = "\n".join(" ".join(f"copied{chr(97 + k)}{chr(97 + j)}" for j in range(6)) for k in range(20))
    rows += [(1000 + i, copy, "en", "hot", 1, 2, "r", "k", "x", "no") for i in range(200)]
    rng.shuffle(rows)
    return rows


def test_verdicts_against_loops(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    expect, left = judged(rows)
    assert sorted(map(tuple, judge_lines(docs).collect()), key=repr) == expect
    assert any(r[8] for r in expect) and any(r[6] for r in expect) and any(not r[6] and not r[7] for r in expect)
    out = strip_lines(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert got == left and any(t != dict((r[0], r[1]) for r in rows)[i] for i, t in left)


def test_copies_of_one_text_are_no_boilerplate(spark):
    rows = corpus(4)
    out = judge_lines(spark.createDataFrame(rows, SCHEMA)).where("doc_id between 1000 and 1999")
    assert out.where("kept and n_removed_words = 0").count() == 200


def test_odd_rows(odd, empty, odd_rows):
    got = judge_lines(odd)
    assert got.columns == ["doc_id", *MADE]
    assert sorted(map(tuple, got.collect()), key=repr) == judged(odd_rows)[0]
    assert judge_lines(empty).count() == 0 and strip_lines(empty).count() == 0
    assert sorted(r["doc_id"] for r in strip_lines(odd).collect()) == [i for i, _ in judged(odd_rows)[1]]
    assert judge_lines(odd.drop("source")).count() == len(odd_rows)


def test_repeated_words_of_large_vocabularies(monkeypatch):
    words = [f"{i % 700}".encode() for i in range(1000)]
    assert repeated_words(words) == 600 and repeated_words(words[:700]) == 0 and repeated_words([b"a"] * 4) == 4
    assert repeated_words([b"a"] * 3) == 0


def test_hot_keys_are_joined_whole(spark):
    left = spark.range(10_000).select((F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    out = join_counted(left, right, ["k"], "n", 10_000)
    assert out.columns == ["k", "id", "top"] and out.count() == 10_000 and out.where("k = 0 and top = 9999").count() == 3334
    assert linequality.MOST_TEXTS == 10
