"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling.

A word enters as its own hashed embedding beside the sum of its hashed byte n-grams' embeddings over the root of their number. Two gated recurrent
layers read every window of a text in both directions, attention pools their states, and the window's logit follows. A
text scores by its worst window; windows overlap by half and cover all words. The network is trained in numpy on a
bounded sample of labelled texts, where a text is toxic if any of its windows is (noisy or), and Platt scaling on rows
that training didn't see, weighted to the shares of the labels, turns logits into scores.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import byte_words, held_out, table, uniform
from barloom.llm.wordtable import WordTable, flat, subwords

#: Bounds of the training sample: expected rows with either label.
TOXIC_ROWS, CLEAN_ROWS = 600, 900
WINDOW, STRIDE = 32, 16
WORD_BUCKETS, PIECE_BUCKETS, SIZES = 1 << 14, 1 << 15, (3, 4, 5)
WIDTH, HIDDEN = 8, 8
EPOCHS, BATCH, RATE, WORD_DROP = 8, 24, 0.02, 0.3
#: Small samples are passed over more often, until so many steps are made.
LEAST_STEPS = 200
#: Windows that are scored at once, and texts that are read at once.
AT_ONCE, TEXTS_AT_ONCE = 4096, 512


@dataclass
class ToxicityModel:
    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(-2 * x)) - 1


def _fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    shapes = {"word": (WORD_BUCKETS, WIDTH), "piece": (PIECE_BUCKETS, WIDTH), "in": (2 * WIDTH, 6 * h), "gate_bias": (6 * h,), "rec_f": (h, 3 * h), "rec_b": (h, 3 * h), "attend": (2 * h,), "out": (2 * h,)}
    out = {k: (rng.normal(0, 0.1 if k in ("word", "piece") else 0.3, s) * (k != "gate_bias")).astype(np.float32) for k, s in shapes.items()}
    out["bias"] = np.array([-3.0], np.float32)
    return out


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, piece buckets, where each word's pieces start, and how many it has."""
    pieces, starts = flat([subwords(w, SIZES, PIECE_BUCKETS) for w in words])
    counts = np.diff(np.append(starts, len(pieces)))
    return pieces[starts] % WORD_BUCKETS, pieces, starts, counts


def _inputs(p: dict[str, np.ndarray], features) -> np.ndarray:
    ids, pieces, starts, counts = features
    return np.hstack([p["word"][ids], np.add.reduceat(p["piece"][pieces], starts) / np.sqrt(counts)[:, None].astype(np.float32)])


def _windows(n: int) -> np.ndarray:
    """Starts of the windows over n words: the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    return np.minimum(starts, n - WINDOW)


def _laid(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all windows of all texts (-1 pads a short text), and the text of each window."""
    parts, owner = [], []
    for i, at in enumerate(rows):
        if len(at) < WINDOW:
            parts.append(np.concatenate([at, np.full(WINDOW - len(at), -1, np.int32)])[None])
        else:
            parts.append(at[_windows(len(at))[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(parts[-1]), i))
    return np.concatenate(parts), np.concatenate(owner)


def _run(gates: np.ndarray, at: np.ndarray, rec: np.ndarray, back: bool, keep: list | None, read) -> None:
    """One direction over all windows; ``read(t, state)`` sees every state, ``keep`` gets what learning needs."""
    h = HIDDEN
    state = np.zeros((len(at), h), np.float32)
    for t in range(WINDOW)[:: -1 if back else 1]:
        g = gates[at[:, t]]
        zr = _sigmoid(g[:, : 2 * h] + state @ rec[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        new = _tanh(g[:, 2 * h :] + (r * state) @ rec[:, 2 * h :])
        after = new + z * (state - new)
        pad = at[:, t] < 0
        if pad.any():
            after[pad] = state[pad]
        if keep is not None:
            keep.append((t, state, z, r, new, pad))
        state = after
        read(t, state)


def _attention(e: np.ndarray, at: np.ndarray) -> np.ndarray:
    e = np.where(at < 0, np.float32(-1e9), e)
    a = np.exp(e - e.max(axis=1, keepdims=True)) * (at >= 0)
    return a / np.maximum(a.sum(axis=1, keepdims=True), 1e-9)


class _Tables:
    """Gate inputs of all words, one contiguous table per gate, with the backward direction's rows after the forward's.

    Row 0 of each direction stands for a pad.
    """

    def __init__(self, gates: np.ndarray):
        h, n = HIDDEN, len(gates)
        self.shift = n + 1
        self.parts = []
        for k in range(3):
            made = np.zeros((2 * (n + 1), h), np.float32)
            made[1 : n + 1], made[n + 2 :] = gates[:, k * h : (k + 1) * h], gates[:, (3 + k) * h : (4 + k) * h]
            self.parts.append(made)


def _logits(p: dict[str, np.ndarray], gates: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logit of every window; a window of pads only has the bias.

    Both directions step together, the forward one in the upper half of every array; all arrays are contiguous and reused.
    """
    h, out, tables = HIDDEN, np.empty(len(at), np.float32), _Tables(gates)
    rec = [[np.ascontiguousarray(p[r][:, k * h : (k + 1) * h]) for k in range(3)] for r in ("rec_f", "rec_b")]
    heads = [np.column_stack([p["attend"][c], p["out"][c]]) for c in (slice(0, h), slice(h, 2 * h))]
    most = min(AT_ONCE, max(1, len(at)))
    room = [np.empty((2 * most, h), np.float32) for _ in range(4)]
    for start in range(0, len(at), AT_ONCE):
        part = at[start : start + AT_ONCE]
        n = len(part)
        state = np.zeros((2 * n, h), np.float32)
        z, r, new, old = (x[: 2 * n] for x in room)
        columns = np.ascontiguousarray(part.T) + 1  # 0 is a pad
        padded = (columns == 0).any(axis=1)
        e, s = np.zeros((WINDOW, n), np.float32), np.zeros((WINDOW, n), np.float32)
        places = np.empty(2 * n, np.int64)
        for t in range(WINDOW):
            back = WINDOW - 1 - t
            places[:n] = columns[t]
            np.add(columns[back], tables.shift, out=places[n:])
            for gate, k in ((z, 0), (r, 1)):
                np.matmul(state[:n], rec[0][k], out=gate[:n])
                np.matmul(state[n:], rec[1][k], out=gate[n:])
                np.take(tables.parts[k], places, axis=0, out=old, mode="clip")
                gate += old
                # the logistic function in place
                np.negative(gate, out=gate)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
            r *= state
            np.matmul(r[:n], rec[0][2], out=new[:n])
            np.matmul(r[n:], rec[1][2], out=new[n:])
            np.take(tables.parts[2], places, axis=0, out=old, mode="clip")
            new += old
            np.tanh(new, out=new)
            np.subtract(state, new, out=old)
            old *= z
            new += old
            if padded[t] or padded[back]:
                pad = np.concatenate([columns[t] == 0, columns[back] == 0])
                new[pad] = state[pad]
            state[:] = new
            for rows, head, place in ((state[:n], heads[0], t), (state[n:], heads[1], back)):
                both = rows @ head
                e[place] += both[:, 0]
                s[place] += both[:, 1]
        out[start : start + n] = (_attention(e.T, part) * s.T).sum(axis=1) + p["bias"][0]
    return out


def _backward(p: dict, g: dict, gates: np.ndarray, at: np.ndarray, rec: str, kept: list, d_states: np.ndarray) -> np.ndarray:
    """Gradient of one direction: adds to g[rec], returns the gradient of the gate inputs of every place."""
    h, u = HIDDEN, p[rec]
    d_gates = np.zeros((*at.shape, 3 * h), np.float32)
    d = np.zeros((len(at), h), np.float32)
    for t, state, z, r, new, pad in reversed(kept):
        d = d + d_states[:, t]
        d_new = d * (1 - z) * (1 - new**2)
        d_rs = d_new @ u[:, 2 * h :].T
        d_z = d * (state - new) * z * (1 - z)
        d_r = d_rs * state * r * (1 - r)
        d_in = np.hstack([d_z, d_r, d_new])
        d_in[pad] = 0
        d_gates[:, t] = d_in
        before = d * z + d_rs * r + d_in[:, : 2 * h] @ u[:, : 2 * h].T
        before[pad] = d[pad]
        g[rec][:, : 2 * h] += state.T @ d_in[:, : 2 * h]
        g[rec][:, 2 * h :] += (r * state).T @ d_in[:, 2 * h :]
        d = before
    return d_gates


def _gradients(p: dict, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, features, rng) -> dict:
    """Gradients of the noisy-or loss of some texts, given as numbers of the words in ``features``."""
    h = HIDDEN
    ids, pieces, starts, counts = features
    x = _inputs(p, features)
    drop = rng.random(len(x)) < WORD_DROP
    x[drop, :WIDTH] = 0
    gates = x @ p["in"] + p["gate_bias"]
    at, owner = _laid(texts)
    states = np.zeros((*at.shape, 2 * h), np.float32)
    kept: dict[str, list] = {"rec_f": [], "rec_b": []}
    for back, rec in ((False, "rec_f"), (True, "rec_b")):
        cut = slice(h * back, h * (1 + back))
        _run(gates[:, 3 * h * back : 3 * h * (1 + back)], at, p[rec], back, kept[rec], lambda t, s, cut=cut: states[:, t, cut].__setitem__(slice(None), s))
    a = _attention(states @ p["attend"], at)
    pooled = (a[:, :, None] * states).sum(axis=1)
    q = _sigmoid(pooled @ p["out"] + p["bias"][0]).astype(np.float64)
    none = np.exp(np.bincount(owner, np.log1p(-np.minimum(q, 1 - 1e-7)), len(texts)))  # no window is toxic
    d_doc = np.where(labels == 1, -none / np.maximum(1 - none, 1e-6), 1.0) * weight
    d_logit = (d_doc[owner] * q).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["bias"][0] = d_logit.sum()
    g["out"] = pooled.T @ d_logit
    d_pooled = d_logit[:, None] * p["out"]
    d_a = (states * d_pooled[:, None, :]).sum(axis=2)
    d_e = a * (d_a - (a * d_a).sum(axis=1, keepdims=True))
    g["attend"] = np.einsum("nt,nth->h", d_e, states)
    d_states = a[:, :, None] * d_pooled[:, None, :] + d_e[:, :, None] * p["attend"]
    d_gates = np.concatenate([_backward(p, g, gates[:, 3 * h * b : 3 * h * (1 + b)], at, rec, kept[rec], d_states[:, :, h * b : h * (1 + b)]) for b, rec in enumerate(("rec_f", "rec_b"))], axis=2)
    places = at.ravel()
    order = np.argsort(places, kind="stable")
    order = order[np.searchsorted(places[order], 0) :]
    first = np.flatnonzero(np.diff(places[order], prepend=-1))
    d_words = np.zeros_like(gates)
    if len(order):
        d_words[places[order][first]] = np.add.reduceat(d_gates.reshape(-1, 6 * h)[order], first)
    g["in"], g["gate_bias"] = x.T @ d_words, d_words.sum(axis=0)
    d_x = d_words @ p["in"].T
    d_x[drop, :WIDTH] = 0
    np.add.at(g["word"], ids, d_x[:, :WIDTH])
    np.add.at(g["piece"], pieces, np.repeat(d_x[:, WIDTH:] / np.sqrt(counts)[:, None], counts, axis=0))
    return g


def train(texts: list[str], labels: list[int], shares: tuple[float, float] | None = None, seed: int = 0) -> ToxicityModel:
    """Fit on texts and 0/1 labels; every fifth row calibrates. ``shares``: rows of the corpus that a row stands for, by label."""
    rng = np.random.default_rng(seed)
    model = ToxicityModel(_fresh(rng))
    words = [byte_words(t) for t in texts]
    y = np.array(labels, dtype=np.int64)
    use = rng.permutation([i for i, w in enumerate(words) if w])
    if len(use) == 0:
        return model
    check, fit = (use[::5], np.array([x for k, x in enumerate(use) if k % 5])) if len(use) >= 10 else (use, use)
    index: dict[bytes, int] = {}
    coded = [np.array([index.setdefault(w, len(index)) for w in ws], dtype=np.int32) for ws in words]
    listed = list(index)
    p = model.weights
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    toxic = max(1, int((y[fit] == 1).sum()))
    weight = np.where(y == 1, len(fit) / (2 * toxic), len(fit) / (2 * max(1, len(fit) - toxic)))
    batches = -(-len(fit) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        shuffled = rng.permutation(fit)
        for start in range(0, len(shuffled), BATCH):
            batch = shuffled[start : start + BATCH]
            used, flat_at = np.unique(np.concatenate([coded[i] for i in batch]), return_inverse=True)
            rows = np.split(flat_at.astype(np.int32), np.cumsum([len(coded[i]) for i in batch])[:-1])
            g = _gradients(p, rows, y[batch], weight[batch] / len(batch), _features([listed[i] for i in used]), rng)
            norm = float(np.sqrt(sum(float((v**2).sum()) for v in g.values())))
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k in p:
                v = g[k] / max(1.0, norm / 5)
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.01 * (v * v - square[k])
                p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    gates = _inputs(p, _features(listed)) @ p["in"] + p["gate_bias"]
    at, owner = _laid([coded[i] for i in check])
    worst = np.full(len(check), -np.inf, np.float32)
    np.maximum.at(worst, owner, _logits(p, gates, at))
    _platt(model, worst.astype(np.float64), y[check], shares or (1.0, 1.0))
    return model


def _platt(model: ToxicityModel, x: np.ndarray, y: np.ndarray, shares: tuple[float, float]) -> None:
    """Slope and shift that make the logits probabilities, by Newton's method with Platt's softened targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.where(y == 1, shares[1], shares[0])
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        e, v = w * (q - target), w * np.maximum(q * (1 - q), 1e-6)
        grad = np.array([(e * x).sum() + 1e-3 * (a - 1), e.sum()])
        hess = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
    if a > 0:
        model.slope, model.shift = float(a), float(b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> ToxicityModel:
    """Train on about ``toxic_rows`` and ``clean_rows`` labelled documents, chosen by hash among all of ``labels``.

    A document with both labels counts as toxic; null labels and ids teach nothing.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marked.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    part = {k: min(1.0, n / counts[k]) for k, n in ((0, clean_rows), (1, toxic_rows)) if counts.get(k)}
    share = F.when(F.col("toxic") == 1, F.lit(part.get(1, 0.0))).when(F.col("toxic") == 0, F.lit(part.get(0, 0.0))).otherwise(0.0)
    chosen = marked.where(uniform(F.lit("toxic"), F.col("doc_id")) < share)
    # about toxic_rows + clean_rows rows
    got = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    shares = (1 / part.get(0, 1.0), 1 / part.get(1, 1.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((int(x), t) for b in batches for x, t in zip(b["toxic"], b["text"], strict=True))
        yield pd.DataFrame({"model": [pickle.dumps(train([t for _, t in rows], [x for x, _ in rows], shares))]})

    # the sample stays on an executor, the model comes back
    made = got.repartition(1).mapInPandas(run, "model binary").first()
    return pickle.loads(made["model"]) if made else train([], [], shares)


def _scorer(model: ToxicityModel):
    p = model.weights

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_of = WordTable(lambda words: (_inputs(p, _features(words)) @ p["in"] + p["gate_bias"]).astype(np.float32), most=100_000)
        for rows in batches:
            # copies within a batch are read once
            index: dict[str, int] = {}
            own = np.fromiter((index.setdefault(t if isinstance(t, str) else "", len(index)) for t in rows["text"]), np.int64, len(rows))
            texts = list(index)
            logit = np.zeros(len(texts))
            for start in range(0, len(texts), TEXTS_AT_ONCE):
                held = table_of.look_up([byte_words(t) for t in texts[start : start + TEXTS_AT_ONCE]])
                # only the words of these texts get places in the tables
                used = np.zeros(len(table_of.rows) if table_of.rows is not None else 0, bool)
                for x in held:
                    used[x] = True
                place = (np.cumsum(used) - 1).astype(np.int32)
                gates = table_of.rows[: len(used)][used] if used.any() else np.zeros((1, 6 * HIDDEN), np.float32)
                at, owner = _laid([place[x] for x in held])
                worst = np.full(len(held), -np.inf, np.float32)
                np.maximum.at(worst, owner, _logits(p, gates, at))
                logit[start : start + len(held)] = worst
            score = 1 / (1 + np.exp(-np.clip(model.slope * logit + model.shift, -500, 500)))
            yield rows.drop(columns="text").assign(score=score[own] if len(own) else np.zeros(0))

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score, the probability of label 1, for every row of ``docs``.

    A null or empty text is one window of nothing and scores by the bias alone. Null and repeated ids stay, equal texts
    score alike, other columns are ignored, an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInPandas(_scorer(model), "doc_id long, score double")


def op7_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from four of five folds of the labels."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
