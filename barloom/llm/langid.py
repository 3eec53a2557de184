"""Language identification from averaged hashed subword embeddings.

A text is the mean of the embeddings of all its words' hashed byte n-grams; a linear softmax turns the mean into
probabilities. Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded sample, on whole
texts and on short stretches of them. A temperature fitted on rows that training didn't see calibrates the
probabilities, and the least probability that keeps the errors among accepted rows below ``max_error`` rejects others.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import held_out, table, uniform
from barloom.llm.wordtable import WordTable, flat, subwords
from barloom.session import cut_lineage

#: Bounds of the training sample, expected: rows per language, and of all languages.
ROWS_PER_LANGUAGE, MOST_ROWS = 700, 100_000
BUCKETS, DIMENSIONS, SIZES = 1 << 16, 16, (2, 3, 4)
EPOCHS, RATE, STRETCHES, MAX_ERROR = 4, 0.5, 3, 0.005


@dataclass
class LanguageModel:
    languages: list[str]
    #: softmax input per bucket; a text's logits are the mean over its subwords, plus bias
    bucket_logits: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bag(words: list[bytes], seen: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares; a long text takes memory for its distinct words only."""
    times = Counter(words)
    for w in times:
        if w not in seen:
            seen[w] = np.array(subwords(w, SIZES, BUCKETS), dtype=np.int32)
    lists = [seen[w] for w in times]
    weights = np.repeat(np.fromiter(times.values(), np.float64, len(times)), [len(x) for x in lists])
    at, back = np.unique(np.concatenate(lists), return_inverse=True)
    n = np.bincount(back, weights)
    return at, (n / n.sum()).astype(np.float32)


def train(texts: list[str], labels: list[str], seed: int = 0) -> LanguageModel:
    """Fit on texts and their languages; every fifth row calibrates. Texts without words teach nothing."""
    rng, seen = np.random.default_rng(seed), {}
    languages = sorted(set(labels))
    code = {x: i for i, x in enumerate(languages)}
    fit: list[tuple[np.ndarray, np.ndarray, int]] = []
    check: list[tuple[np.ndarray, np.ndarray, int]] = []
    for i in rng.permutation(len(texts)):
        words = _words(texts[i])
        if not words:
            continue
        into = check if len(fit) and len(check) < len(fit) / 4 else fit
        into.append((*_bag(words, seen), code[labels[i]]))
        for _ in range(STRETCHES if len(words) > 8 else 0):
            n = int(rng.integers(4, 40))
            start = int(rng.integers(0, max(1, len(words) - n)))
            into.append((*_bag(words[start : start + n], seen), code[labels[i]]))
    seen.clear()
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * max(1, len(fit)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            at, share, y = fit[i]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ emb[at]
            error = _softmax(mean @ out + bias)
            error[y] -= 1
            back = out @ error
            out -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # every subword moves by its share; the scale keeps long texts from learning slower than short ones
            emb[at] -= rate * np.outer(share / share.max(), back)
    logits = (emb @ out).astype(np.float32)
    model = LanguageModel(languages, logits, bias, 1.0, 0.0)
    return _calibrated(model, check or fit)


def _calibrated(model: LanguageModel, rows: list) -> LanguageModel:
    if not rows:
        return model
    z = np.stack([share @ model.bucket_logits[at] + model.bias for at, share, _ in rows])
    y = np.array([r[2] for r in rows])
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.02, 10, 60), key=loss))
    p = _softmax(z / model.temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-best, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
    kept = np.flatnonzero(wrong <= MAX_ERROR)
    # never above one half: what is likelier than not is not rejected
    model.least = float(min(0.5, best[order][kept[-1]] if len(kept) else 0.5))
    return model


def sample(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, most: int = MOST_ROWS) -> DataFrame:
    """About ``rows`` labelled documents of every language, fewer of each where that makes more than ``most``: text, lang.

    Rows are chosen by hash and no language is left out.
    """
    known = docs.where("text is not null and lang is not null")
    counts = cut_lineage(known.groupBy("lang").count())
    each = max(1.0, min(rows, most / max(1, counts.count())))
    shares = counts.select("lang", F.least(F.lit(1.0), F.lit(each) / F.col("count")).alias("share"))
    # one row per language
    joined = known.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang")
    return joined.where(uniform(F.lit("language"), F.col("doc_id"), F.col("text")) < F.col("share")).select("text", "lang")


def fit_languages(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Train on the rows of ``docs`` that may be learned from; the sample stays on an executor, the model comes back."""
    chosen = sample(docs, rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted((g, t) for x in batches for g, t in zip(x["lang"], x["text"], strict=True))
        yield pd.DataFrame({"model": [pickle.dumps(train([t for _, t in got], [x for x, _ in got]))]})

    made = chosen.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(made["model"]) if made else train([], [])


def _predictor(model: LanguageModel):
    def compute(words: list[bytes]) -> np.ndarray:
        numbers, starts = flat([subwords(w, SIZES, BUCKETS) for w in words])
        sums = np.add.reduceat(model.bucket_logits[numbers], starts)
        return np.column_stack([sums, np.diff(np.append(starts, len(numbers)))]).astype(np.float32)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordTable(compute)
        for rows in batches:
            named, scores = [], []
            texts = [t if isinstance(t, str) else "" for t in rows["text"]]
            for start in range(0, len(texts), 256):
                part = texts[start : start + 256]
                for text, at in zip(part, words.look_up([_words(t) for t in part]), strict=True):
                    if not model.languages or not any(map(str.isalpha, text)):
                        named.append("und")
                        scores.append(0.0)
                        continue
                    sums = words.rows[at].sum(axis=0, dtype=np.float64)
                    p = _softmax((sums[:-1] / sums[-1] + model.bias) / model.temperature)
                    best = int(p.argmax())
                    named.append(model.languages[best])
                    scores.append(float(p[best]))
            refused = [n == "und" or s < model.least for n, s in zip(named, scores, strict=True)]
            yield rows.drop(columns="text").assign(lang_pred=named, score=scores, rejected=refused)

    return predict


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (the calibrated probability) and rejected for every row of ``docs``.

    A null or empty text, and one without a letter, is ``und`` with score 0 and rejected. Null and repeated ids stay as
    they are, other columns are ignored, an empty table gives no rows. Without any language learned, all is ``und``.
    """
    return docs.select("doc_id", "text").mapInPandas(_predictor(model), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, with all their columns."""
    return _with_verdict(docs, model).where(~F.col("rejected")).select("row.*")


def _with_verdict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    predict = _predictor(model)

    @F.pandas_udf("boolean")
    def rejected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for out in predict(pd.DataFrame({"text": s}) for s in batches):
            yield out["rejected"]

    return docs.select(F.struct("*").alias("row"), rejected(F.col("text")).alias("rejected"))


def op1_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four of five folds."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    out = predict_languages(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "rejected")
