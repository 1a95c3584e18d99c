"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Every word enters as two vectors: an embedding of the word (hashed) and the
mean embedding of its byte n-grams (characters, with marks at both ends). A
GRU reads a window of words forwards, another backwards; attention weights
pool the states, and a linear layer gives the window's logit. A window starts at
every word, all windows of a text are scored, and the text's score is the
logistic function of its largest window logit: where a passage starts makes no
difference.

Everything is numpy. Training draws a bounded, balanced sample of labelled
documents (TRAIN_ROWS at most, one row an id; never those with crc32(doc_id as
text) mod 5 = 0) and, as a label holds for a document and not for a window,
follows the soft maximum of the document's windows; each epoch takes every
TRAIN_STRIDE-th window from another start. Of a labelled text over LONGEST bytes
the sample holds that many bytes in pieces spread over it. Embedding rows that
few training documents use, or that occur under both labels alike, stay zero:
they would only learn documents by heart. For scoring, the input part of the
gates is computed once for each distinct word of a slice and laid out once a
word; all windows of a chunk step together over shifted views of it.

Defined cases: a text that is NULL or has no words is scored as one window of
padding; without usable labels, or with one class only, every score is the
(smoothed) share of label 1; repeated rows are scored alike; texts of any
length are read whole; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.llm.common import doc_bucket, table
from kasaflow.llm.quality import HOLD_OUT, labelled_sample
from kasaflow.llm.textarrays import WORD_BYTES, Flat, as_bytes, slices, word_ngrams

TRAIN_ROWS = 6_000
TRAIN_BYTES, LONGEST = 2_500, 30_000  # training uses the shorter documents, calibration also longer ones
PIECE = 3_000                # bytes, of the pieces that stand for a longer labelled text
CALIBRATE = 2_000            # documents of the sample on which the cut is placed
MIN_STEPS = 250
WINDOW, TRAIN_STRIDE = 12, 6  # words
HIDDEN, DIM = 6, 8
WORD_BITS, GRAM_BITS, GRAM_SIZES = 15, 14, (3, 4, 5)
EPOCHS, BATCH, RATE = 5, 32, 0.02
HEAD_START, SHRINK = 1.0, 2.0
MIN_DOCS, LEAST_Z = 4, 3.0   # embedding rows used by fewer training documents, or less one-sidedly, stay zero
CHUNK = 4096                 # windows that step together


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Encoded:
    """The distinct words of some texts (their embedding rows and n-grams), the texts as one line of word
    numbers (each filled up with 0 to WINDOW words at least), and windows of WINDOW numbers that start at every
    ``stride``-th word of a text, the first ``shift`` words nearer."""

    def __init__(self, texts: list[bytes], stride: int = 1, shift: int = 0):
        flat = Flat(texts)
        starts, ends = flat.runs(WORD_BYTES)
        owner = flat.owner(starts)
        h = flat.hashes(starts, ends)
        distinct, first, number = np.unique(h, return_index=True, return_inverse=True)
        self.word_rows = np.concatenate(([0], (distinct >> np.uint64(64 - WORD_BITS)).astype(np.int64)))
        self.gram_rows, self.gram_word = word_ngrams(flat, starts[first], ends[first], GRAM_SIZES, GRAM_BITS)
        self.gram_word = self.gram_word + 1
        self.grams = np.maximum(np.bincount(self.gram_word, minlength=len(self.word_rows)), 1)
        self.n = flat.n
        n_words = np.bincount(owner, minlength=flat.n)
        room = np.maximum(n_words, WINDOW)
        begin = np.cumsum(room) - room
        self.line = np.zeros(int(room.sum()), np.int32)
        self.line[begin[owner] + np.arange(len(owner)) - (np.cumsum(n_words) - n_words)[owner]] = number + 1
        last = room - WINDOW                                  # of a text's windows starts here
        n_win = -(-(last + shift) // stride) + 1
        self.window_text = np.repeat(np.arange(flat.n), n_win)
        order = np.arange(len(self.window_text)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        at = np.clip(order * stride - shift, 0, last[self.window_text])
        self.starts = begin[self.window_text] + at

    @property
    def windows(self) -> np.ndarray:
        return self.line[self.starts[:, None] + np.arange(WINDOW)]


def new_model(seed: int = 1) -> dict:
    rng = np.random.default_rng(seed)
    g = lambda *s, k=0.3: rng.normal(0, k, s).astype(np.float32)
    m = {"word": g(1 << WORD_BITS, DIM, k=0.02), "gram": g(1 << GRAM_BITS, DIM, k=0.1)}
    for d in ("f", "b"):
        m |= {f"W{d}": g(2 * DIM, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"U{d}": g(HIDDEN, 3 * HIDDEN)}
    return m | {"att": g(2 * HIDDEN), "out": g(2 * HIDDEN), "bias": np.zeros(1, np.float32)}


def inputs(m: dict, e: Encoded) -> np.ndarray:
    """Input vector of every distinct word (row 0: padding)."""
    mean = np.zeros((len(e.word_rows), DIM), np.float32)
    if len(e.gram_word):
        first = np.flatnonzero(np.r_[True, e.gram_word[1:] != e.gram_word[:-1]])
        mean[e.gram_word[first]] = np.add.reduceat(m["gram"][e.gram_rows], first, axis=0)
    x = np.concatenate((m["word"][e.word_rows], mean / e.grams[:, None].astype(np.float32)), 1)
    x[0] = 0
    return x


def _gates(m: dict, x: np.ndarray, d: str) -> np.ndarray:
    a = x @ m[f"W{d}"] + m[f"c{d}"]
    a[0, :HIDDEN] = 30.0  # padding: the update gate keeps the state as it is
    return a


def _steps(a: np.ndarray, U: np.ndarray, words: np.ndarray, keep: bool):
    """States after each step over ``words`` (windows, steps); with ``keep`` also what the way back needs."""
    h = np.zeros((len(words), HIDDEN), np.float32)
    out, kept, H = np.empty((words.shape[1], len(words), HIDDEN), np.float32), [], HIDDEN
    for t in range(words.shape[1]):
        x = a[words[:, t]]
        u = h @ U
        zr = _sigmoid(x[:, :2 * H] + u[:, :2 * H])
        z, r = zr[:, :H], zr[:, H:]
        n = np.tanh(x[:, 2 * H:] + r * u[:, 2 * H:])
        if keep:
            kept.append((h, z, r, n, u[:, 2 * H:]))
        h = n + z * (h - n)
        out[t] = h
    return out, kept


def _pool(m: dict, states: np.ndarray, words: np.ndarray):
    """Attention weights, pooled states and logits; ``states`` (steps, windows, 2 * HIDDEN)."""
    s = states @ m["att"]
    s = np.where(words.T > 0, s, -30.0)
    w = np.exp(s - s.max(0))
    w /= w.sum(0)
    pooled = np.einsum("tn,tnh->nh", w, states)
    return w, pooled, pooled @ m["out"] + m["bias"][0]


def window_logits(m: dict, e: Encoded) -> np.ndarray:
    """Logits of the windows from every word of the line; those that run into the next text are scored too and
    are not among ``e.starts``."""
    x = inputs(m, e)
    sides = []
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        a, U = _gates(m, x, d), m[f"U{d}"].T.copy()
        a[:, :2 * HIDDEN] *= 0.5                              # sigmoid(v) = tanh(v / 2) / 2 + 1 / 2
        U[:2 * HIDDEN] *= 0.5
        sides.append((a, U, np.stack((m["att"][part], m["out"][part]))))
    total = len(e.line) - WINDOW + 1
    out = np.empty(total, np.float32)
    for k in range(0, total, CHUNK):
        n = min(CHUNK, total - k)
        line = e.line[k:k + n + WINDOW - 1]
        seen = np.zeros((WINDOW, 2, n), np.float32)           # attention and output of each place's states
        for (a, U, heads), order in zip(sides, (range(WINDOW), range(WINDOW - 1, -1, -1))):
            gates = np.ascontiguousarray(a[line].T)
            h = np.zeros((HIDDEN, n), np.float32)
            for t in order:
                u = U @ h
                zr = gates[:2 * HIDDEN, t:t + n] + u[:2 * HIDDEN]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                c = u[2 * HIDDEN:]
                c *= zr[HIDDEN:]
                c += gates[2 * HIDDEN:, t:t + n]
                np.tanh(c, out=c)
                h -= c
                h *= zr[:HIDDEN]
                h += c
                seen[t] += heads @ h
        s, v = seen[:, 0], seen[:, 1]
        for t in np.flatnonzero([(line[t:t + n] == 0).any() for t in range(WINDOW)]):
            s[t, line[t:t + n] == 0] = -30.0
        w = np.exp(s - s.max(0))
        out[k:k + n] = (w * v).sum(0) / w.sum(0) + m["bias"][0]
    return out


def _text_logits(m: dict, raw: list[bytes]) -> np.ndarray:
    e = Encoded(raw)
    first = np.flatnonzero(np.r_[True, e.window_text[1:] != e.window_text[:-1]])
    return np.maximum.reduceat(window_logits(m, e)[e.starts], first).astype(float) if e.n else np.zeros(0)


def text_scores(m: dict, texts: list) -> np.ndarray:
    """Score of each text: the logistic function of its largest window logit."""
    raw = [as_bytes(t, "all") for t in texts]
    out = np.zeros(len(raw))
    for a, b in slices(raw):
        top = _text_logits(m, raw[a:b])
        out[a:b] = 1 / (1 + np.exp(-np.clip(top + m.get("shift", 0.0), -30, 30)))
    return out


def _sum_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``rows`` and, for each, the sum of its ``values``."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    return rows[first], np.add.reduceat(values[order], first, axis=0) if len(rows) else values[:0]


def _back_steps(a_grad, kept, U, words, dh_out):
    """Gradients of one direction: into the gates' inputs (rows of ``a_grad``) and U."""
    dU, dh = np.zeros_like(U), np.zeros_like(dh_out[0])
    steps = np.empty((words.shape[1], len(words), a_grad.shape[1]), np.float32)
    for t in range(words.shape[1] - 1, -1, -1):
        h, z, r, n, un = kept[t]
        dh = dh + dh_out[t]
        dz = dh * (h - n) * z * (1 - z)
        dn = dh * (1 - z) * (1 - n * n)
        dr = dn * un * r * (1 - r)
        da = np.concatenate((dz, dr, dn), 1)
        du = np.concatenate((dz, dr, dn * r), 1)
        steps[t] = da
        dU += h.T @ du
        dh = dh * z + du @ U.T
    rows, sums = _sum_rows(words.T.ravel(), steps.reshape(-1, a_grad.shape[1]))
    a_grad[rows] = sums
    return dU


def gradients(m: dict, e: Encoded, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted loss of a batch of texts and the gradient of every parameter."""
    x = inputs(m, e)
    w = e.windows
    af, ab = _gates(m, x, "f"), _gates(m, x, "b")
    f, kf = _steps(af, m["Uf"], w, True)
    b, kb = _steps(ab, m["Ub"], w[:, ::-1], True)
    states = np.concatenate((f, b[::-1]), 2)
    att, pooled, logit = _pool(m, states, w)
    # soft maximum over the windows of a text
    top = np.full(e.n, -np.inf, np.float32)
    np.maximum.at(top, e.window_text, logit)
    ex = np.exp(logit - top[e.window_text])
    share = ex / np.bincount(e.window_text, ex, e.n)[e.window_text]
    doc = np.bincount(e.window_text, share * logit, e.n)
    p = 1 / (1 + np.exp(-np.clip(doc, -30, 30)))
    loss = -np.mean(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
    dl = (share * (1 + logit - doc[e.window_text]) * ((p - y) * weight / e.n)[e.window_text]).astype(np.float32)
    g = {"bias": np.array([dl.sum()], np.float32), "out": pooled.T @ dl}
    dpool = dl[:, None] * m["out"]
    dstates = att[:, :, None] * dpool
    datt = np.einsum("nh,tnh->tn", dpool, states)
    ds = att * (datt - (att * datt).sum(0)) * (w.T > 0)
    dstates = dstates + ds[:, :, None] * m["att"]
    g["att"] = np.einsum("tn,tnh->h", ds, states)
    dx = np.zeros_like(x)
    for d, a, kept, words, ds_dir in (("f", af, kf, w, dstates[:, :, :HIDDEN]), ("b", ab, kb, w[:, ::-1], dstates[::-1, :, HIDDEN:])):
        da = np.zeros_like(a)
        g[f"U{d}"] = _back_steps(da, kept, m[f"U{d}"], words, ds_dir)
        da[0] = 0
        g[f"W{d}"], g[f"c{d}"] = x.T @ da, da.sum(0)
        dx += da @ m[f"W{d}"].T
    g["word"] = (e.word_rows[1:], dx[1:, :DIM])
    g["gram"] = (e.gram_rows, (dx[:, DIM:] / e.grams[:, None].astype(np.float32))[e.gram_word])
    return float(loss), g


def _apply(m: dict, state: dict, g: dict) -> None:
    """One step of Adagrad; embedding tables only where rows were used."""
    for k, v in g.items():
        if isinstance(v, tuple):
            on = state[k + " on"][v[0]]
            rows, grad = _sum_rows(v[0][on], v[1][on])
            s = state.setdefault(k, np.full(m[k].shape, 1e-6, np.float32))
            s[rows] += grad * grad
            m[k][rows] -= 5 * RATE * grad / np.sqrt(s[rows])
        else:
            s = state.setdefault(k, np.full(m[k].shape, 1e-6, np.float32))
            s += v * v
            m[k] -= RATE * v / np.sqrt(s)


def train(texts: list, y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> dict:
    """A model for texts with labels 0 and 1. Deterministic for the same rows in the same order."""
    y = np.asarray(y, float)
    m = new_model(seed)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        m["out"][:] = 0
        return m | {"shift": float(np.log(share / (1 - share)))}
    raw = [as_bytes(t, "all") for t in texts]
    size = np.array([len(r) for r in raw])
    short = size <= TRAIN_BYTES
    use = np.flatnonzero(short) if min(y[short].sum(), (1 - y[short]).sum()) >= 5 else np.arange(len(y))
    rng, state = np.random.default_rng(seed), {}
    # Rows that few documents use, or documents of both labels alike, would only learn
    # documents by heart: they stay zero.
    seen = {k: np.zeros((2, len(m[k]))) for k in ("word", "gram")}  # documents of either label that use a row
    for i in use:
        e = Encoded([raw[i]])
        seen["word"][int(y[i]), np.unique(e.word_rows[1:])] += 1
        seen["gram"][int(y[i]), np.unique(e.gram_rows)] += 1
    docs = np.bincount(y[use].astype(int), minlength=2)
    for k, (clean, toxic) in seen.items():
        n = clean + toxic
        # The first number of a row starts from its (shrunk) log odds: a head start where labels are few.
        odds = np.log((toxic + 0.5) / (docs[1] + 1)) - np.log((clean + 0.5) / (docs[0] + 1))
        m[k][:, 0] = HEAD_START * odds * n / (n + SHRINK)
        share = docs[1] / docs.sum()
        z = (toxic - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))
        state[k + " on"] = (n >= MIN_DOCS) & (np.abs(z) >= LEAST_Z)
        m[k][~state[k + " on"]] = 0
    epochs = max(epochs, min(40, MIN_STEPS * BATCH // len(use)))
    for _ in range(epochs):
        order = rng.permutation(use)
        for k in range(0, len(order), BATCH):
            part = order[k:k + BATCH]
            e = Encoded([raw[i] for i in part], TRAIN_STRIDE, int(rng.integers(TRAIN_STRIDE)))
            _, g = gradients(m, e, y[part], np.ones(len(part)))
            _apply(m, state, g)
    m["shift"] = _shift(m, raw[:CALIBRATE], y[:CALIBRATE])
    return m


def _shift(m: dict, raw: list[bytes], y: np.ndarray) -> float:
    """What to add to a text's logit so that 0 parts the labels best, long texts included:
    the middle of the widest gap among the cuts with the fewest weighted errors."""
    if y.min() == y.max():
        return 0.0
    top = np.concatenate([_text_logits(m, raw[a:b]) for a, b in slices(raw)])
    order = np.argsort(top, kind="stable")
    v, pos = top[order], y[order] == 1
    errors = np.r_[0, np.cumsum(pos)] / pos.sum() + (np.r_[0, np.cumsum(~pos)][-1] - np.r_[0, np.cumsum(~pos)]) / (~pos).sum()
    gaps = np.diff(np.r_[v[0] - 1, v, v[-1] + 1])
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    k = best[np.argmax(gaps[best])]
    edge = np.r_[v[0] - 1, v, v[-1] + 1]
    return -float((edge[k] + edge[k + 1]) / 2)


def pieces(text: str, most: int = LONGEST, size: int = PIECE) -> str:
    """A text of at most ``most`` bytes as it is; a longer one as that many bytes in evenly spread pieces."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= most:
        return text
    n = most // size
    step = (len(raw) - size) / (n - 1)
    return " ".join(raw[int(k * step):int(k * step) + size].decode("utf-8", "ignore") for k in range(n))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> dict:
    """The sample comes to the driver: ``rows`` texts of LONGEST bytes at most."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces(t) if t is not None else None)

    got = labelled_sample(docs, labels, label, rows, balanced=True)
    got = got.select("doc_id", cut("text").alias("text"), "y").toPandas().sort_values("doc_id", kind="stable")
    return train(got["text"].tolist(), got["y"].to_numpy(dtype=float))


def with_toxicity(docs: DataFrame, model: dict, text: str = "text", column: str = "toxic_score") -> DataFrame:
    """``docs`` and the score of every row. The model (about 1.5 MB, fixed size) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(text_scores(shared.value, s.tolist()), index=s.index)

    return docs.withColumn(column, score(F.col(text)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_toxicity(docs.select("doc_id", "text"), model, column="score")
    return scored.select("doc_id", (doc_bucket(F.col("doc_id"), HOLD_OUT) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
