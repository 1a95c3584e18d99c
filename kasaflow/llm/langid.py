"""Language identification by multilingual mixture inference.

For every language a model of hashed byte trigrams of its words is learned
(add-one smoothed logarithms, WORD marks included). A document is a mixture:
each of its words comes from one language with that language's proportion.
Expectation-maximisation estimates the proportions from the words' n-gram
likelihoods. Languages are then taken away one at a time, the weakest first,
the proportions being estimated anew; the set with the best likelihood less
PENALTY * ln(words) for each language is the document's, and its largest
proportion gives the prediction and the score.

Training reads a bounded sample of documents with a language (TRAIN_ROWS each
language at most, whole texts) whose crc32(doc_id as text) mod 4 is not 2; the
model has one row of 2**BITS numbers a language and is broadcast. Scoring
covers every whole text, a slice of documents at a time.

Defined cases: text NULL or without a letter: ``und`` with score 0; no
language learned: ``und`` with score 0; ties go to the first language in code
point order; repeated rows are scored alike; other columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.llm.common import doc_bucket, table
from kasaflow.llm.textarrays import WORD_BYTES, Flat, as_bytes, slices, word_ngrams

TRAIN_ROWS = 2_000           # a language
HOLD_OUT, HELD = 4, 2
BITS, SIZES = 15, (3,)
ITERATIONS, FLOOR = 12, 1e-6
PENALTY = 1.0
CLEAR = 0.02                 # languages below this proportion are not tried as part of the set
UNDETERMINED = "und"

LETTERS = WORD_BYTES.copy()
LETTERS[0x30:0x3A] = False


def _words(texts: list[bytes]):
    """Distinct words of some texts with their n-grams, and the (text, word) counts."""
    flat = Flat(texts)
    starts, ends = flat.runs(LETTERS)
    owner = flat.owner(starts)
    _, first, number = np.unique(flat.hashes(starts, ends), return_index=True, return_inverse=True)
    grams, gram_word = word_ngrams(flat, starts[first], ends[first], SIZES, BITS)
    key, count = np.unique(owner * max(len(first), 1) + number, return_counts=True)
    return grams, gram_word, len(first), key // max(len(first), 1), key % max(len(first), 1), count


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """How often each n-gram bucket occurs in the texts."""
    total = np.zeros(1 << BITS)
    for a, b in slices(texts):
        grams, gram_word, words, _, word, count = _words(texts[a:b])
        total += np.bincount(grams, np.bincount(word, count, words)[gram_word], 1 << BITS)
    return total


def em(loglik: np.ndarray, weight: np.ndarray, first: np.ndarray, doc: np.ndarray, active: np.ndarray):
    """Proportions and log-likelihoods of documents whose rows (document, word)
    are grouped by document: ``first`` row of each, ``doc`` of each row;
    ``active`` (documents, languages) says which languages take part."""
    share = active / active.sum(1, keepdims=True)
    best = np.where(active[doc], loglik, -np.inf).max(1)
    lik = np.exp(loglik - best[:, None])
    total = np.add.reduceat(weight, first)
    for _ in range(ITERATIONS):
        mix = lik * share[doc]
        whole = mix.sum(1)
        mix *= (weight / whole)[:, None]
        share = np.maximum(np.add.reduceat(mix, first, axis=0) / total[:, None], FLOOR) * active
        share /= share.sum(1, keepdims=True)
    ll = np.add.reduceat(weight * (np.log((lik * share[doc]).sum(1)) + best), first)
    return share, ll, total


def infer(loglik, weight, doc, n_docs: int):
    """Best language set and proportions of each document (rows grouped by document).
    Documents without rows get proportions of 0."""
    langs = loglik.shape[1]
    share = np.zeros((n_docs, langs))
    if not len(doc):
        return share
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    ids = doc[first]
    local = np.repeat(np.arange(len(ids)), np.diff(np.r_[first, len(doc)]))
    # one language each: no estimation needed
    single = np.add.reduceat(loglik * weight[:, None], first, axis=0)
    total = np.add.reduceat(weight, first)
    top = single.argmax(1)
    best_share = np.zeros((len(ids), langs))
    best_share[np.arange(len(ids)), top] = 1.0
    price = PENALTY * np.log(total + 1)
    best = single.max(1) - price
    # whole set, then without its weakest language, and so on; only where a second language is in sight
    rows, at = np.arange(len(doc)), np.arange(len(ids))
    active = np.ones((len(ids), langs), bool)
    while len(at) and langs > 1:
        f = np.flatnonzero(np.r_[True, local[rows][1:] != local[rows][:-1]])
        number = np.repeat(np.arange(len(at)), np.diff(np.r_[f, len(rows)]))
        s, ll, _ = em(loglik[rows], weight[rows], f, number, active[at])
        size = active[at].sum(1)
        value = ll - price[at] * size
        better = value > best[at]
        best[at[better]] = value[better]
        best_share[at[better]] = s[better]
        # drop every language out of sight at once, else the weakest
        weak = active[at] & (s < CLEAR)
        none = ~weak.any(1)
        weakest = np.where(active[at], s, np.inf).argmin(1)
        weak[np.flatnonzero(none), weakest[none]] = True
        active[at] &= ~weak
        on = active[at].sum(1) >= 2
        keep = np.zeros(len(ids), bool)
        keep[at[on]] = True
        rows, at = rows[keep[local[rows]]], at[on]
    share[ids] = best_share
    return share


def has_letter(text) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(model: dict, texts: list) -> tuple[list[str], np.ndarray]:
    names, table_ = model["langs"], model["logp"]
    out, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not names:
        return out, score
    raw = [as_bytes(t, "all") for t in texts]
    for a, b in slices(raw):
        grams, gram_word, words, doc, word, count = _words(raw[a:b])
        if not words:
            top, lead = np.zeros(b - a, int), np.zeros(b - a)
        else:
            first = np.flatnonzero(np.r_[True, gram_word[1:] != gram_word[:-1]])
            loglik = np.add.reduceat(table_[grams], first, axis=0)  # every word has a trigram: its marks count
            share = infer(loglik[word].astype(float), count.astype(float), doc, b - a)
            top, lead = share.argmax(1), share.max(1)
        for i in range(b - a):
            if lead[i] > 0:
                out[a + i], score[a + i] = names[top[i]], lead[i]
            elif has_letter(texts[a + i]):
                out[a + i], score[a + i] = names[0], 1.0 / len(names)
            if not has_letter(texts[a + i]):
                out[a + i], score[a + i] = UNDETERMINED, 0.0
    return out, np.minimum(score, 1.0)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Trigram tables. Each task adds up its part of the sample; per language
    and task one array of 2**BITS counts goes through a grouped sum."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                       & (doc_bucket(F.col("doc_id"), HOLD_OUT) != HELD) & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) / float(1 << 20)
    keep = F.lit(False)
    for lang, k in n.items():
        keep = keep | ((F.col("lang") == lang) & (draw < min(1.0, rows / k)))

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                got = gram_counts([as_bytes(t, "all") for t in texts])
                total[lang] = total[lang] + got if lang in total else got
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype("int32"), "n": c[at].astype("int64")})

    got = (known.where(keep).select("lang", "text").mapInPandas(counts, "lang string, bucket int, n long")
           .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())  # languages * 2**BITS rows at most
    langs = sorted(got["lang"].unique().tolist(), key=lambda s: s.encode("utf-8"))
    c = np.zeros((len(langs), 1 << BITS))
    if len(got):
        c[got["lang"].map({x: i for i, x in enumerate(langs)}), got["bucket"]] = got["n"]
    logp = np.log(c + 1.0) - np.log(c.sum(1, keepdims=True) + (1 << BITS)) if langs else c
    return {"langs": langs, "logp": np.ascontiguousarray(logp.T.astype(np.float32))}


def with_language(docs: DataFrame, model: dict, text: str = "text", column: str = "language") -> DataFrame:
    """``docs`` and a struct (lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            lang, score = predict(shared.value, s.tolist())
            yield pd.DataFrame({"lang_pred": lang, "score": score}, index=s.index)

    return docs.withColumn(column, identify(F.col(text)))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = with_language(docs.select("doc_id", "text"), fit(docs))
    return got.select("doc_id", (doc_bucket(F.col("doc_id"), HOLD_OUT) == HELD).alias("held_out"),
                      "language.lang_pred", "language.score")
