"""Language, toxicity, language-model and page operators: held-out accuracy, brute force and gradients."""

import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import htmltext, langid, lmscore, toxicity
from barloom.llm.common import byte_words, table
from barloom.llm.wordtable import WordTable


def fold(i, k):
    return zlib.crc32(str(i).encode()) % k


def log_softmax(z):
    return z - z.max(axis=1, keepdims=True) - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True))


def test_word_table_starts_anew_without_changing_results():
    lookup = WordTable(lambda ws: np.array([[len(w)] for w in ws]), most=3)
    for words in ([b"a", b"bb"], [b"ccc", b"dd", b"a"], [b"eeeee", b"bb"]):
        at = lookup.look_up([words, []])
        assert lookup.rows[at[0], 0].tolist() == [len(w) for w in words] and len(at[1]) == 0


def test_language_on_the_held_out_fold(spark, sf_dir):
    out = langid.op1_subword_language(spark, sf_dir).toPandas()
    docs = table(spark, sf_dir, "documents").toPandas().set_index("doc_id")
    assert (out["held_out"] == [fold(i, 5) == 0 for i in out["doc_id"]]).all() and out["score"].between(0, 1).all()
    held = out[out["held_out"]]
    assert (held["lang_pred"].values == docs.loc[held["doc_id"], "lang"].values).mean() > 0.97


def test_language_of_odd_rows(odd, empty, odd_rows):
    model = langid.train(["the cat sat on the mat with the hat"] * 20 + ["der hund und die katze sind nicht im haus"] * 20, ["en"] * 20 + ["de"] * 20)
    out = langid.predict_languages(odd, model).toPandas()
    assert len(out) == len(odd_rows)
    assert set(out.loc[out["doc_id"].isin([3, 4, 5, 6]), "lang_pred"]) == {"und"} and out.loc[out["doc_id"] == 9, "lang_pred"].tolist() == ["de"]
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and not {3, 4, 5, 6} & {r["doc_id"] for r in kept.collect()}
    assert langid.predict_languages(empty, model).count() == 0
    nothing = langid.fit_languages(empty)
    assert {r["lang_pred"] for r in langid.predict_languages(odd, nothing).collect()} == {"und"}


def test_rejection_keeps_the_error_low():
    rng = np.random.default_rng(0)
    rows = [(np.array([i % 2]), np.array([1.0], np.float32), int(rng.random() < 0.02) ^ (i % 2)) for i in range(400)]
    model = langid._calibrated(langid.LanguageModel(["a", "b"], np.array([[3.0, 0.0], [0.0, 3.0]], np.float32), np.zeros(2, np.float32), 1.0, 0.0), rows)
    assert 0.9 < 1 / (1 + math.exp(-3 / model.temperature)) < 1 and model.least <= 0.5


def test_toxicity_gradients_match_differences():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity._fresh(rng).items()}
    words = [f"w{i}".encode() for i in range(40)]
    features = toxicity._features(words)
    texts = [rng.integers(0, 40, 50).astype(np.int32), rng.integers(0, 40, 7).astype(np.int32)]
    y, weight = np.array([1, 0]), np.array([1.0, 1.0])

    def loss():
        gates = toxicity._inputs(p, features) @ p["in"] + p["gate_bias"]
        at, owner = toxicity._laid(texts)
        q = 1 / (1 + np.exp(-toxicity._logits(p, gates, at).astype(np.float64)))
        none = np.array([np.prod(1 - q[owner == i]) for i in range(2)])
        return -(y * np.log(1 - none) + (1 - y) * np.log(none)).sum()

    toxicity_drop, toxicity.WORD_DROP = toxicity.WORD_DROP, 0.0
    try:
        g = toxicity._gradients(p, texts, y, weight, features, rng)
    finally:
        toxicity.WORD_DROP = toxicity_drop
    for name in p:
        flat_g = g[name].ravel()
        k = int(np.abs(flat_g).argmax())
        old, step = p[name].ravel()[k], 1e-2
        p[name].ravel()[k] = old + step
        up = loss()
        p[name].ravel()[k] = old - step
        down = loss()
        p[name].ravel()[k] = old
        assert (up - down) / (2 * step) == pytest.approx(flat_g[k], rel=0.05, abs=2e-3), name


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 200):
        starts = toxicity._windows(n)
        covered = {s + i for s in starts for i in range(toxicity.WINDOW)}
        assert set(range(n)) <= covered and (n < toxicity.WINDOW or max(covered) == n - 1)


def test_toxicity_learns_words_and_scores_odd_rows(odd, empty, spark, odd_rows):
    rng = np.random.default_rng(0)
    calm = lambda: " ".join(f"calm{rng.integers(40)}" for _ in range(60))
    texts = [calm() for _ in range(120)] + [" ".join([calm(), "vile", "vile", calm()]) for _ in range(60)]
    model = toxicity.train(texts, [0] * 120 + [1] * 60)
    docs = spark.createDataFrame([(0, calm()), (1, calm() + " vile vile"), (2, "vile vile " + calm() + calm())], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert scores[0] < 0.5 < min(scores[1], scores[2])
    out = toxicity.score_toxicity(odd, model).toPandas()
    assert len(out) == len(odd_rows) and out["score"].between(0, 1).all() and out.loc[out["doc_id"].isin([1, 2]), "score"].nunique() == 1
    assert toxicity.score_toxicity(empty, model).count() == 0
    untaught = toxicity.fit_toxicity(odd, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(odd, untaught).count() == len(odd_rows)


def test_language_model_against_brute_force(spark, sf_dir):
    out = lmscore.op4_maxent_scores(spark, sf_dir).toPandas()
    docs = table(spark, sf_dir, "documents").toPandas()
    tokens = {i: [*byte_words(t), b" "] for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    c = Counter(x for i, ws in tokens.items() if fold(i, 7) != 2 for x in ws)
    n, v = sum(c.values()), len(c)
    for r in out.itertuples():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 7) == 2, len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    held = out[out["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_language_model_adds_up_to_one(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "HEAD_WORDS", 8)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(vocabulary[(i * k) % 30] for k in range(1, 12))) for i in range(60)]
    learn = spark.createDataFrame(rows, "doc_id long, text string")
    # every continuation of "w1 w2": each known word, the end, and an unknown word of every class
    probes = [(i, f"w1 w2 {w}") for i, w in enumerate(vocabulary)] + [(100 + i, f"w1 w2 {x}") for i, x in enumerate(f"zz{k}q" for k in range(3000))]
    docs = spark.createDataFrame([*probes, (9999, "w1 w2")], "doc_id long, text string")
    counts = lmscore.count_words(learn)
    v = lmscore._vocabulary(counts)
    w = lmscore._trained(learn, v, 1)
    places = lmscore._places(v.head)
    got = next(lmscore._scorer(v, w)(iter([docs.toPandas()])))
    assert len(got) == len(probes) + 1
    # class probabilities of one context, and the sums within classes
    at = places([b"w1", b"w2"])
    c1, c2, c3 = (np.array([x]) for x in (at[1, 1], at[0, 1], lmscore.START))
    f = lmscore._features(c1.astype(np.int64), c2.astype(np.int64), c3)
    p = np.exp(log_softmax(w.class_bias + w.class_rows[f].sum(axis=0)))[0]
    n = {r["word"].encode(): r["n"] for r in counts.collect()}
    total = 0.0
    for k in range(lmscore.CLASSES):
        inside = [x for x in n if places([x])[0, 2] == k]
        if k < lmscore.FREQUENT_CLASSES:
            g = lmscore._slot_features(np.array([k]), c1.astype(np.int64), c2.astype(np.int64))
            q = np.exp(log_softmax(w.slot_bias[[k]] + w.slot_rows[g].sum(axis=0)))[0]
            total += p[k] * sum(q[places([x])[0, 3]] for x in inside)
        else:
            total += p[k] * (sum(n[x] + 1 for x in inside) + 1) / (v.class_tokens[k] + v.class_types[k] + 1)
    assert total == pytest.approx(1.0, abs=1e-3)


def test_language_model_on_odd_rows(odd, empty, odd_rows):
    out = lmscore.score_documents(odd, odd, rounds=1).toPandas()
    assert len(out) == len(odd_rows) and (out["score"] <= 0).all()
    assert set(out.loc[out["doc_id"].isin([3, 4, 5]), "n_tokens"]) == {1}
    assert lmscore.score_documents(empty, odd, rounds=1).count() == 0
    untaught = lmscore.score_documents(odd, empty, rounds=1).toPandas()
    assert (untaught["n_known"] == 0).all() and (untaught["base_score"] == 0).all()


def article(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", inner)]
    return "\n".join(b for b in blocks if b)


def test_pages_against_their_articles(spark, sf_dir):
    out = htmltext.op5_tree_text(spark, sf_dir).toPandas()
    pages = table(spark, sf_dir, "pages").toPandas().set_index("page_id")
    assert len(out) == len(pages)
    for r in out.itertuples():
        assert r.text == article(pages.loc[r.page_id, "html"]) and r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def page_model():
    rng = np.random.default_rng(3)
    return htmltext.train_pages([(p, htmltext.marked_labels(p)) for p in (htmltext.read_page(htmltext.composed_page(rng)) for _ in range(htmltext.COMPOSED_PAGES))])


def test_composed_pages_held_out(page_model):
    rng, right, n = np.random.default_rng(77), 0, 0
    for _ in range(60):
        page = htmltext.read_page(htmltext.composed_page(rng))
        content, labels = htmltext.marginals(page_model, [page])[0], htmltext.marked_labels(page)
        right += sum((content[at] >= 0.5) == labels[at] for at, _ in page.blocks)
        n += len(page.blocks)
    assert right / n > 0.97


def test_marginals_against_all_labelings(page_model):
    page = htmltext.read_page("<article class='post'><h1>A title</h1><p>Some words here</p></article><nav><ul><li><a>x</a></li></ul></nav>")
    logit = np.array([sum(page_model.weights[k] for k in f) + page_model.bias for f in htmltext._features(page)])
    own = np.stack([-np.logaddexp(0, logit), -np.logaddexp(0, -logit)], axis=1)
    n, total, content = len(page.tags), 0.0, np.zeros(len(page.tags))
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        w = math.exp(sum(own[i, y[i]] for i in range(n)) + page_model.prior[y[0]] + sum(page_model.ties[htmltext._kind(page.tags[i]), y[page.parents[i]], y[i]] for i in range(1, n)))
        total += w
        content += w * np.array(y)
    assert htmltext.marginals(page_model, [page])[0] == pytest.approx(content / total)


def test_odd_pages(spark, page_model):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "no markup &amp; all"), (2, "v", "<p>unclosed <b>bold<p>next<script>var t='</p>';"), (3, "w", "<article><p>" + "long words " * 20000 + "</p></article>"), (4, "x", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = htmltext.extract_text(pages, page_model).collect()
    assert len(out) == len(rows) and out[0]["text"] == out[1]["text"] == "" and out[0]["n_chars"] == 0
    assert next(r for r in out if r["page_id"] == 3)["text"] == " ".join(["long words"] * 20000)
    assert htmltext.extract_text(pages.limit(0), page_model).count() == 0


def test_comments_and_notices_stay_out(page_model):
    page = htmltext.read_page(
        '<body><div class="cookie notice"><p>We use cookies here.</p></div><article><h1>Head</h1><p>One&nbsp;two &lt;b&gt;</p><aside class="related"><p>See also this.</p></aside><p>Three</p></article>'
        '<section class="comments"><div class="comment"><p>Nice post, thanks for it.</p></div></section><footer>Imprint of the page</footer></body>'
    )
    assert htmltext.main_text(page, htmltext.marginals(page_model, [page])[0]) == "Head\nOne two <b>\nThree"


ARTICLE = "<article><h1>Head</h1><p>One <b>two</b> three of it</p><p>Four more words here</p></article>"


@pytest.mark.parametrize(
    "before",
    ["<html><head><title>T</title><body>", "<html><head><meta charset=x><link rel=y>", "<body><datalist><option value=a><option value=b></datalist>", "<body><select><option>1<option>2</select>", "<body><button>Click", "<body><button>Click <div>x</div></button>",
     "<body><iframe src=x>", "<body><object data=x>", "<body><video><p>fallback</p></video>", "<body><noscript><p>Enable it</p></noscript>", "<body><template><div>unseen</div></template>", "<head><script>var a = '<p>x</p>';</script><style>p {}</style>"],
)
def test_unended_elements_lose_no_article(page_model, before):
    page = htmltext.read_page(before + ARTICLE + "</body></html>")
    assert htmltext.main_text(page, htmltext.marginals(page_model, [page])[0]) == "Head\nOne two three of it\nFour more words here"


def test_formulas_and_bare_paragraphs(page_model):
    page = htmltext.read_page("<body><article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be so.</p><p>a<svg><title>no</title></svg>b and more</p></article>")
    assert [words for _, words in page.blocks] == ["Let x=2 be so.", "ab and more"]
    page = htmltext.read_page("<body><p>first bare paragraph here</p><p>second bare one with a few more words in it</p></body>")
    assert htmltext.main_text(page, htmltext.marginals(page_model, [page])[0]) == "first bare paragraph here\nsecond bare one with a few more words in it"


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.createDataFrame(table(spark, sf_dir, "documents").orderBy("doc_id").limit(200).toPandas())
    one, seven = (lmscore.score_documents(docs.repartition(n), docs.repartition(n)).toPandas().sort_values("doc_id").reset_index(drop=True) for n in (1, 7))
    assert np.allclose(one["score"], seven["score"], rtol=1e-6) and (one["base_score"] == seven["base_score"]).all()


def test_every_position_teaches(spark, sf_dir):
    out = lmscore.op4_maxent_scores(spark, sf_dir).toPandas()
    held = out[out["held_out"]]
    assert (held["score"].sum() - held["base_score"].sum()) / held["n_tokens"].sum() > 0.08
    docs = spark.createDataFrame([(i, "a b c d e f g h i j" if i % 2 else "k l m n o p q r s t") for i in range(40)], "doc_id long, text string")
    near, far = (lmscore.score_documents(docs.where("doc_id = 1").withColumn("text", F.lit(t)), docs).first()["score"] for t in ("a b c d e f g h i j", "a l c n e p g r i t"))
    assert near > far + 2


def test_head_words_come_by_count(spark):
    counts = spark.createDataFrame([(" ", 1), ("a", 100), ("b", 50), ("c", 50), *[(f"w{i}", 1) for i in range(30)]], "word string, n long")
    assert lmscore._head_words(counts, 10) == [(" ", 1), ("a", 100), ("b", 50), ("c", 50)]
    assert len(lmscore._head_words(counts, 100)) == 34 and lmscore._head_words(counts, 2) == [(" ", 1), ("a", 100)]


def test_texts_are_read_once_for_training_after_their_words(spark, monkeypatch):
    """Counting tells the positions that the gradient learns from, whole and in order; hence it looks no word up again."""
    texts = ["a b c a zz", None, "", "b \u65e5\u672c a", "c " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v = lmscore._vocabulary(lmscore.count_words(docs))
    monkeypatch.setattr(lmscore, "BATCH", 8)
    rows = pd.concat(lmscore._counter(v)(iter([docs.toPandas()])))
    packed = rows.loc[rows["kind"] == lmscore.POSITIONS, "sums"]
    assert len(packed) > 1
    got = [lmscore._unpacked(x) for x in packed]
    want = lmscore._places(v.head)([w for t in texts for w in [*byte_words(t), b" "]])
    assert (np.concatenate([at[:, 1:] for at, _ in got]) == want[:, 1:]).all()
    sizes = [n for at, firsts in got for n in np.diff(np.append(firsts, len(at)))]
    assert sizes == [len(byte_words(t)) + 1 for t in texts]
    moved = pd.concat(lmscore._gradient(lmscore._initial(v))(iter([pd.DataFrame({"sums": packed})])))
    assert set(moved["kind"]) == {"class", "slot"}


def test_words_outside_the_table_are_told_once_a_text(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "HEAD_WORDS", 1)
    docs = spark.createDataFrame([(1, "x y x x"), (2, None), (3, "y")], "doc_id long, text string")
    v = lmscore._vocabulary(lmscore.count_words(docs))
    got = next(lmscore._scorer(v, lmscore._initial(v))(iter([docs.toPandas()])))
    assert [dict(zip(r, t, strict=True)) for r, t in zip(got["rest"], got["times"], strict=True)] == [{"x": 3, "y": 1}, {}, {"y": 1}]
    out = {r["doc_id"]: (r["n_tokens"], r["n_known"], r["base_score"]) for r in lmscore.score_documents(docs, docs).collect()}
    n = 8 + 3 + 1  # tokens with ends, distinct ones, and one
    want = {1: (5, 5, 3 * math.log10(4) + math.log10(3) + math.log10(4) - 5 * math.log10(n)), 2: (1, 1, math.log10(4 / n)), 3: (2, 2, math.log10(3 / n) + math.log10(4 / n))}
    assert all(out[i][:2] == want[i][:2] and out[i][2] == pytest.approx(want[i][2]) for i in want)
