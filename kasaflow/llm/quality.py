"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a few dozen counts and ratios. Cyclic boosting visits one
feature after the other, again and again, and fits a shallow tree on that
feature's bins to the current residuals; the trees of a feature add up to one
lookup table. Then the pairs of features whose joint bins still explain most
of the residual get small two-dimensional tables in the same way. A text's
score is the logistic function of the sum of its bins' table entries.

Training uses a bounded sample of the labelled rows (TRAIN_ROWS); scoring
covers every whole text. Labels are read only from rows whose
crc32(doc_id as text) mod 5 is not 0.

Defined cases: NULL and empty texts have all-zero features and a score like
any other; without usable labels, or with one class only, every score is the
(smoothed) share of label 1; repeated rows are scored alike; several labels
for an id count as their mean, rounded; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.llm.common import doc_bucket, table
from kasaflow.llm.textarrays import SALTS, SPACE, Flat, as_bytes, mix64, slices

TRAIN_ROWS = 20_000
HOLD_OUT = 5
THRESHOLD = 0.3
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 60, 25, 8, 0.15

FEATURES = ["bytes", "words", "word_length", "upper", "digits", "punctuation", "bars", "symbols", "marks",
            "distinct_words", "same_as_previous", "distinct_pairs", "distinct_lines", "words_a_line", "longest_word",
            "full_stops", "non_ascii", "odd_ends", "short_words", "distinct_fours"]


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


UPPER, LOWER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")
DIGIT, BAR, MARK, STOP = _class("0123456789"), _class("|"), _class("!?"), _class(".")
SYMBOL = _class("#$%&*@~^<>{}[]\\/=+_`")
PUNCT = _class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
HIGH = np.arange(256) >= 0x80
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[0x0A] = False


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each owner."""
    if not len(hashes):
        return np.zeros(n)
    key = np.unique(mix64(owner.astype(np.uint64) * SALTS[7]) ^ hashes, return_index=True)[1]
    return np.bincount(owner[key], minlength=n).astype(float)


def text_features(texts: list) -> np.ndarray:
    """(texts, features) as float32; None counts as an empty text."""
    raw = [as_bytes(t) for t in texts]
    out = np.zeros((len(raw), len(FEATURES)), np.float32)
    for a, b in slices(raw):
        f = Flat(raw[a:b])
        arr, n = f.array, f.n
        size = np.maximum(f.sizes, 1)
        count = lambda t: f.total(t[arr])
        starts, ends = f.runs(~SPACE)
        owner = f.owner(starts)
        words = np.bincount(owner, minlength=n).astype(float)
        per = np.maximum(words, 1)
        h = f.hashes(starts, ends)
        length = (ends - starts).astype(float)
        longest = np.zeros(n)
        np.maximum.at(longest, owner, length)
        pair = (owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, bool)
        again = np.bincount(owner[1:][pair & (h[1:] == h[:-1])], minlength=n) if len(owner) else np.zeros(n)
        two = mix64(h[:-1] * SALTS[0] + h[1:] * SALTS[1])[pair] if len(owner) else h
        four_ok = (owner[3:] == owner[:-3]) if len(owner) > 3 else np.zeros(0, bool)
        four = mix64(h[:-3] * SALTS[0] + h[1:-2] * SALTS[1] + h[2:-1] * SALTS[2] + h[3:] * SALTS[3])[four_ok] if len(owner) > 3 else h[:0]
        ls, le = f.runs(NOT_NEWLINE)
        line_owner = f.owner(ls)
        lines = np.maximum(np.bincount(line_owner, minlength=n), 1)
        upper, lower = count(UPPER), count(LOWER)
        last = arr[np.maximum(ends - 1, 0)] if len(ends) else arr[:0]
        cols = [np.log1p(f.sizes), np.log1p(words), np.bincount(owner, length, n) / per, upper / np.maximum(upper + lower, 1),
                count(DIGIT) / size, count(PUNCT) / size, count(BAR) / per, count(SYMBOL) / size, count(MARK) / per,
                _distinct(owner, h, n) / per, again / per,
                _distinct(owner[1:][pair], two, n) / np.maximum(words - 1, 1) if len(owner) else np.zeros(n),
                _distinct(line_owner, f.hashes(ls, le), n) / lines, np.log1p(words / lines), np.log1p(longest),
                count(STOP) / per, count(HIGH) / size,
                np.bincount(owner, (PUNCT & ~_class(".,;:"))[last], n) / per,
                np.bincount(owner, length <= 3, n) / per,
                _distinct(owner[3:][four_ok], four, n) / np.maximum(words - 3, 1) if len(owner) > 3 else np.zeros(n)]
        out[a:b] = np.stack(cols, 1)
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best place to cut a run of bins in two, by the gain in squared gradient over curvature."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl * gl / (hl + 1) + gr * gr / (hr + 1)
    if not len(gain):
        return 0.0, 0
    k = int(np.argmax(gain))
    return float(gain[k] - g.sum() ** 2 / (h.sum() + 1)), k + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth 2 on ordered bins, as one value for each bin."""
    value = np.zeros(len(g))
    gain, cut = _best_cut(g, h)
    parts = [(0, cut), (cut, len(g))] if gain > 1e-9 else [(0, len(g))]
    for lo, hi in parts:
        gain, c = _best_cut(g[lo:hi], h[lo:hi])
        for x, y in ((lo, lo + c), (lo + c, hi)) if gain > 1e-9 else ((lo, hi),):
            value[x:y] = -g[x:y].sum() / (h[x:y].sum() + 1)
    return value


def _pair_cuts(G: np.ndarray, H: np.ndarray):
    """For each way to cut a grid of bins in four: the sums of the quadrants."""
    def quads(M):
        c = M.cumsum(0).cumsum(1)
        all_, top, left = c[-1, -1], c[:-1, -1:], c[-1:, :-1]
        a = c[:-1, :-1]
        return np.stack([a, top - a, left - a, all_ - top - left + a])
    g, h = quads(G), quads(H)
    gain = (g * g / (h + 1)).sum(0) - G.sum() ** 2 / (H.sum() + 1)
    return g, h, gain


def train(X: np.ndarray, y: np.ndarray) -> dict:
    """Lookup tables of the additive model with pairs; X (rows, features), y of 0 and 1."""
    n = len(y)
    base = (y.sum() + 1) / (n + 2)
    model = {"bias": float(np.log(base / (1 - base))), "edges": [], "tables": [], "pairs": []}
    if n == 0 or y.min() == y.max():
        return model
    k = X.shape[1]
    model["edges"] = [np.unique(np.quantile(X[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    bins = [np.searchsorted(e, X[:, j], "right") for j, e in enumerate(model["edges"])]
    sizes = [len(e) + 1 for e in model["edges"]]
    tables = [np.zeros(s) for s in sizes]
    score = np.full(n, model["bias"])
    for _ in range(ROUNDS):
        for j in range(k):
            p = _sigmoid(score)
            g, h = np.bincount(bins[j], p - y, sizes[j]), np.bincount(bins[j], p * (1 - p), sizes[j])
            step = RATE * _shallow_tree(g, h)
            tables[j] += step
            score += step[bins[j]]
    model["tables"] = tables
    # pairs, by what a cut in four of their coarse bins would gain on the residuals
    coarse = [np.minimum(b * PAIR_BINS // s, PAIR_BINS - 1) for b, s in zip(bins, sizes)]
    p = _sigmoid(score)
    res, cur, found = p - y, p * (1 - p), []
    grid = lambda i, j, v: np.bincount(coarse[i] * PAIR_BINS + coarse[j], v, PAIR_BINS ** 2).reshape(PAIR_BINS, PAIR_BINS)
    for i in range(k):
        for j in range(i + 1, k):
            found.append((float(_pair_cuts(grid(i, j, res), grid(i, j, cur))[2].max()), i, j))
    chosen = [(i, j) for _, i, j in sorted(found, key=lambda x: (-x[0], x[1:]))[:PAIRS]]
    pair_tables = {ij: np.zeros((PAIR_BINS, PAIR_BINS)) for ij in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            p = _sigmoid(score)
            g, h, gain = _pair_cuts(grid(i, j, p - y), grid(i, j, p * (1 - p)))
            r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
            q = -RATE * g[:, r, c] / (h[:, r, c] + 1)
            step = np.empty((PAIR_BINS, PAIR_BINS))
            step[:r + 1, :c + 1], step[:r + 1, c + 1:], step[r + 1:, :c + 1], step[r + 1:, c + 1:] = q
            pair_tables[i, j] += step
            score += step[coarse[i], coarse[j]]
    model["pairs"] = [(i, j, t) for (i, j), t in pair_tables.items()]
    return model


def predict(model: dict, X: np.ndarray) -> np.ndarray:
    score = np.full(len(X), model["bias"])
    if not model["tables"]:
        return _sigmoid(score)
    bins = [np.searchsorted(e, X[:, j], "right") for j, e in enumerate(model["edges"])]
    for b, t in zip(bins, model["tables"]):
        score += t[b]
    for i, j, t in model["pairs"]:
        a = np.minimum(bins[i] * PAIR_BINS // len(model["tables"][i]), PAIR_BINS - 1)
        b = np.minimum(bins[j] * PAIR_BINS // len(model["tables"][j]), PAIR_BINS - 1)
        score += t[a, b]
    return _sigmoid(score)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int = HOLD_OUT,
                    balanced: bool = False) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents outside the held-out part, those of the smallest
    hash of the id; with ``balanced`` at most half of them of either label. An id that several rows have gives
    one of them (of the smallest hash of the text). The chosen ids are few (bounded by ``rows``), so they are
    broadcast."""
    lab = (labels.where(doc_bucket(F.col("doc_id"), modulus) > 0).where(F.col(label).isNotNull())
           .groupBy(F.col("doc_id").alias("_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y")))
    order = [F.xxhash64("_id", F.lit(5)), F.col("_id")]
    if balanced:
        picked = lab.where("y = 0").orderBy(*order).limit(rows // 2).unionAll(lab.where("y = 1").orderBy(*order).limit(rows // 2))
    else:
        picked = lab.orderBy(*order).limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    return (found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
            .select("doc_id", "t.text", "y"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> dict:
    """Features are computed where the rows are; only they (``rows`` at most) come to the driver."""
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "doc_id": pdf["doc_id"], "x": list(text_features(pdf["text"].tolist()))})

    got = (labelled_sample(docs, labels, label, rows)
           .mapInPandas(features, "y int, doc_id long, x array<float>").toPandas().sort_values("doc_id", kind="stable"))
    X = np.stack(got["x"].to_list()).astype(np.float64) if len(got) else np.zeros((0, len(FEATURES)))
    return train(X, got["y"].to_numpy(dtype=float))


def with_quality(docs: DataFrame, model: dict, text: str = "text", column: str = "quality_score") -> DataFrame:
    """``docs`` and the score of every row."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(predict(model, text_features(s.tolist()).astype(np.float64)), index=s.index)

    return docs.withColumn(column, score(F.col(text)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_quality(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")), column="score")
    return scored.select("doc_id", (doc_bucket(F.col("doc_id"), HOLD_OUT) == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
