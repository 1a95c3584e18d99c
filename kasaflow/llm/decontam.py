"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact verification.

A document leaks an item if some stretch of its words is within edit distance
(1 - SIMILARITY) * n of the item's n words (words in lower case, without
punctuation). The CGK walk reads a word sequence step by step and moves on or
stays according to a random bit of (step, word): sequences a few edits apart
fall into step again, so their walks agree in most steps. Items and document
windows of the items' size (classes of similar lengths) are walked alike;
each of REPEATS walks keeps SAMPLES of its steps as a key, and equal keys make
a candidate. A candidate is verified by the exact edit distance of the item to
the best stretch around the window.

Windows that cannot match are left out before the walks by a bound that loses
nothing: d edits destroy at most 3 * d of an item's n - 2 word triples, so a
window with fewer than n - 2 - 3 * d of the benchmark's word triples holds no
match (for short items: pairs, n - 1 - 2 * d).

The benchmark is a reference set. Items of equal words are one in the index and
get their own rows at the end. Blocks of about ITEMS_AT_ONCE items and
ITEM_BYTES of text are broadcast, BLOCKS_AT_ONCE of them for one pass over the
documents (each text is split and hashed once a pass); with more blocks, every
pass is written before the next. Documents never shuffle.

Words are runs of letters and digits, as ever ending at punctuation, also beyond
ASCII; in scripts written without spaces each character is a word.

Defined cases: items that are NULL or have no words match nothing; items of
fewer than MIN_WORDS words match exactly, anywhere in a text, and items without
an id match like others, under a NULL id (``every_item=False`` asks for less:
short items then match only documents of exactly those words, items without an
id nothing); NULL, empty and short texts simply hold no long window; texts of any length
are read whole; repeated rows are treated alike; an empty benchmark leaves
every document clean; other columns are carried by ``with_leaks``.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.llm.common import table, written
from kasaflow.llm.textarrays import SALTS, WORD_BYTES, Flat, as_bytes, mix64, slices

SIMILARITY = 0.8
MIN_WORDS = 5
REPEATS, SAMPLES = 16, 2      # two steps that agree with probability 0.4 each: recall 0.94; measured: tests/llm
CLASS_RATIO = 1.25            # of the lengths that share walks
ITEMS_AT_ONCE, ITEM_BYTES = 20_000, 16 << 20
BLOCKS_AT_ONCE = 4
VERIFY_AT_ONCE = 2_000


# Thai, Lao, Myanmar, Khmer, Tai, Javanese and Balinese, kana, bopomofo, ideographs, Yi
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
            (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
            (0xA000, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F),
            (0x20000, 0x3FFFF))
ENDS_WORD, ALONE = 1, 2


def _kinds() -> np.ndarray:
    """For each code point: ENDS_WORD (punctuation, white space and control characters beyond ASCII), ALONE or 0."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for lo, hi in UNSPACED:
        kinds[lo:hi + 1] = ALONE
    ends = [c for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) in
            ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Zs", "Zl", "Zp", "Cc")]
    kinds[ends + [0x200B, 0xFEFF]] = ENDS_WORD
    return kinds


KINDS = _kinds()


def spaced(text) -> bytes:
    """Lower-case UTF-8 of a text in which every word is a run of WORD_BYTES."""
    if text is not None and not text.isascii():
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = KINDS[points]
        if kinds.any():
            alone = kinds == ALONE
            out = np.repeat(np.where(kinds == ENDS_WORD, np.uint32(32), points), 1 + 2 * alone)
            at = (np.arange(len(points)) + 2 * np.cumsum(alone))[alone]  # each ends up between two spaces
            out[at], out[at - 2] = 32, 32
            text = out.tobytes().decode("utf-32-le", "surrogatepass")
    return as_bytes(text, "all")


def edits(n) -> np.ndarray:
    """Edits allowed for items of n words."""
    return np.floor((1 - SIMILARITY) * np.asarray(n) + 1e-9).astype(np.int64)


def grams_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on."""
    g = words[:len(words) - size + 1] * SALTS[20]
    for j in range(1, size):
        g = g + words[j:len(words) - size + 1 + j] * SALTS[20 + j]
    return mix64(g)


class Grams:
    """A set of word n-grams of one size, with a bit map in front."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, size: int):
        self.size = size
        own = self.within(owner)
        self.all = np.unique(grams_of(words, size)[own]) if own.any() else np.zeros(0, np.uint64)
        self.map = np.zeros(1 << 20, bool)
        self.map[(self.all >> np.uint64(44)).astype(np.int64)] = True

    def within(self, owner: np.ndarray) -> np.ndarray:
        """Which n-grams lie in one text (owners below 0 are no text)."""
        if len(owner) < self.size:
            return np.zeros(0, bool)
        return (owner[self.size - 1:] == owner[:len(owner) - self.size + 1]) & (owner[self.size - 1:] >= 0)

    def before(self, words: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """For each word (and the end) how many n-grams of the set start before it."""
        out = np.zeros(len(words) + 1, np.int64)
        own = self.within(owner)
        if len(own) and len(self.all):
            g = grams_of(words, self.size)
            hit = self.map[(g >> np.uint64(44)).astype(np.int64)] & own
            some = np.flatnonzero(hit)
            hit[some] = self.all[np.minimum(np.searchsorted(self.all, g[some]), len(self.all) - 1)] == g[some]
            out[1:len(hit) + 1] = np.cumsum(hit)
            out[len(hit) + 1:] = out[len(hit)]
        return out


class Walks:
    """The random walks of one length class: bits, sampled steps, and the keys of sequences."""

    def __init__(self, shortest: int, seed: int):
        rng = np.random.default_rng(seed)
        self.length = 2 * shortest
        self.salt = mix64(rng.integers(1, 2**63, (REPEATS, self.length)).astype(np.uint64)) | np.uint64(1)
        self.sampled = np.stack([np.sort(rng.choice(self.length, min(SAMPLES, self.length), replace=False)) for _ in range(REPEATS)])

    def keys(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray, repeat: int) -> np.ndarray:
        """Key of the walk from each ``start`` (words from ``stop`` on count as one padding word)."""
        at, key = start.copy(), np.full(len(start), repeat + 1, np.uint64)
        end = np.minimum(at, len(words) - 1)
        w = words[end]
        for t in range(self.sampled[repeat][-1] + 1):
            if t:
                np.minimum(at, len(words) - 1, out=end)
                w = words[end]
                w[at >= stop] = 0
            if t in self.sampled[repeat]:
                key = mix64(key * SALTS[22] + w)
            at += ((w * self.salt[repeat, t]) >> np.uint64(63)).astype(np.int64)  # words are hashes: a random bit
        return key


class Benchmark:
    """A block of items, indexed: word pairs, and for each length class the walks and the items' keys."""

    def __init__(self, ids: list, texts: list, short_anywhere: bool = False):
        raw = [spaced(t) for t in texts]
        flat = Flat(raw)
        starts, ends = flat.runs(WORD_BYTES)
        self.words = flat.hashes(starts, ends)
        owner = flat.owner(starts)
        n = np.bincount(owner, minlength=len(raw))
        self.n, self.first = n, np.cumsum(n) - n
        self.names: dict[int, list] = {}                      # of each item that stands for those of its words
        of: dict[bytes, int] = {}
        for i in np.flatnonzero(n).tolist():
            k = of.setdefault(self.words[self.first[i]:self.first[i] + n[i]].tobytes(), i)
            self.names.setdefault(k, []).append(ids[i])
        n = np.where(np.isin(np.arange(len(raw)), list(self.names)), n, 0)
        self.whole, self.short = {}, []
        for size in range(1, MIN_WORDS) if short_anywhere else ():
            items = np.flatnonzero(n == size)
            if len(items):
                key = np.concatenate([grams_of(self.words[f:f + size], size) for f in self.first[items]])
                keys, group = np.unique(key, return_inverse=True)
                same: list[list[int]] = [[] for _ in keys]
                for k, g in zip(items.tolist(), group.tolist()):
                    same[g].append(k)
                self.short.append((size, keys, same))
        if not short_anywhere:
            for i in np.flatnonzero((n > 0) & (n < MIN_WORDS)):
                self.whole.setdefault(self.words[self.first[i]:self.first[i] + n[i]].tobytes(), []).append(int(i))
        long = n >= MIN_WORDS
        marked = np.where(long[owner], owner, -1) if len(owner) else owner
        self.grams = {g: Grams(self.words, marked, g) for g in (2, 3)}
        self.classes = []
        todo = np.unique(n[long])
        while len(todo):
            mine = todo[todo <= todo[0] * CLASS_RATIO]
            todo = todo[len(mine):]
            items = np.flatnonzero(long & (n >= mine[0]) & (n <= mine[-1]))
            walks = Walks(int(mine[0]), int(mine[0]))
            keys = [walks.keys(self.words, self.first[items], self.first[items] + n[items], r) for r in range(REPEATS)]
            order = [np.argsort(k, kind="stable") for k in keys]
            need = {g: int((mine - g + 1 - g * edits(mine)).min()) for g in (2, 3)}
            g = 3 if need[3] >= 2 else 2
            self.classes.append({"gram": g, "need": need[g], "span": int(mine[-1] + edits(mine[-1])), "walks": walks,
                                 "keys": [k[o] for k, o in zip(keys, order)], "items": [items[o] for o in order]})


def distances(bench: Benchmark, items: np.ndarray, words: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Least edit distance of each item to a stretch within words[lo:hi], and where the best one ends
    (the first of several); all rows of the table are filled for the whole batch at once."""
    n, wide = bench.n[items], int((hi - lo).max())
    cols = np.arange(wide)
    inside = cols < (hi - lo)[:, None]
    text = np.where(inside, words[np.minimum(lo[:, None] + cols, len(words) - 1)], np.uint64(0))
    row = np.zeros((len(items), wide + 1), np.int64)      # an empty prefix matches anywhere for nothing
    steps = np.arange(wide + 1)
    best, end = np.full(len(items), 1 << 30), np.zeros(len(items), np.int64)
    for i in range(int(n.max())):
        w = bench.words[np.minimum(bench.first[items] + i, len(bench.words) - 1)]
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + ((text != w[:, None]) | ~inside), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        done = n == i + 1
        if done.any():
            r = np.where(steps <= (hi - lo)[:, None], row, 1 << 30)[done]
            end[done], best[done] = r.argmin(1), r.min(1)
    return best, lo + end


class Words:
    """Some texts as hashes of their words."""

    def __init__(self, raw: list[bytes]):
        flat = Flat(raw)
        starts, ends = flat.runs(WORD_BYTES)
        self.words = flat.hashes(starts, ends)
        self.owner = flat.owner(starts)
        self.n = np.bincount(self.owner, minlength=flat.n)
        self.first = np.cumsum(self.n) - self.n
        self.stop = self.first + self.n


def leaks(bench: Benchmark | list[Benchmark], texts: list) -> list[list[tuple[int, int, int, int]]]:
    """For each text its (item_id, distance, item's words, word at which the match ends), one for each item."""
    out: list[list] = [[] for _ in texts]
    raw = [spaced(t) for t in texts]
    for a, b in slices(raw):
        held = Words(raw[a:b])
        for one in bench if isinstance(bench, list) else [bench]:
            _leaks_of(one, held, out, a)
    return out


def _leaks_of(bench: Benchmark, held: Words, out: list[list], a: int) -> None:
    words, owner, n_words, first, stop = held.words, held.owner, held.n, held.first, held.stop

    def add(d: int, k: int, dist: int, size: int, end: int) -> None:
        out[a + d] += [(name, dist, size, end) for name in bench.names[k]]

    for i in np.flatnonzero((n_words > 0) & (n_words < MIN_WORDS)) if bench.whole else ():
        for k in bench.whole.get(words[first[i]:stop[i]].tobytes(), ()):
            add(i, k, 0, int(bench.n[k]), int(n_words[i]))
    for size, keys, same in bench.short:
        if len(words) < size:
            continue
        g = grams_of(words, size)
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        hit = np.flatnonzero((keys[at] == g) & (owner[size - 1:] == owner[:len(g)]))
        _, one = np.unique(owner[hit] * len(keys) + at[hit], return_index=True)  # the first place in each text
        for p in hit[one].tolist():
            for k in same[at[p]]:
                add(int(owner[p]), k, 0, size, int(p + size - first[owner[p]]))
    if len(words) < MIN_WORDS or not bench.classes:
        return
    before = {g: bench.grams[g].before(words, owner) for g in {c["gram"] for c in bench.classes}}
    found = set()
    for c in bench.classes:
        # a stretch of ``span`` words holds span - gram + 1 n-grams; it may end with the text
        hits = before[c["gram"]]
        upto = np.maximum(np.minimum(np.arange(len(words)) + c["span"], stop[owner]) - c["gram"] + 1, 0)
        start = np.flatnonzero(hits[upto] - hits[:-1] >= c["need"])
        if not len(start):
            continue
        for r in range(REPEATS):
            key = c["walks"].keys(words, start, stop[owner[start]], r)
            lo, hi = np.searchsorted(c["keys"][r], key, "left"), np.searchsorted(c["keys"][r], key, "right")
            for s in np.flatnonzero(hi > lo):
                found.update((int(owner[start[s]]), int(k), int(start[s])) for k in c["items"][r][lo[s]:hi[s]])
    # neighbouring windows of one item are verified together
    todo, last = [], None
    for d, k, s in sorted(found):
        e = int(edits(bench.n[k]))
        if last is not None and last[0] == d and last[1] == k and s - last[2] <= max(e, 1) and s - todo[-1][2] <= 4 * max(e, 1):
            todo[-1][3] = s
        else:
            todo.append([d, k, s, s])
        last = (d, k, s)
    best: dict = {}
    for v in range(0, len(todo), VERIFY_AT_ONCE):
        part = np.array(todo[v:v + VERIFY_AT_ONCE], np.int64)
        d, k = part[:, 0], part[:, 1]
        e = edits(bench.n[k])
        lo = np.maximum(part[:, 2] - e, first[d])
        hi = np.minimum(part[:, 3] + bench.n[k] + e, stop[d])
        dist, end = distances(bench, k, words, lo, hi)
        for i in np.flatnonzero(dist <= e):
            new = (int(dist[i]), int(end[i] - first[d[i]]))
            key = (int(d[i]), int(k[i]))
            best[key] = min(best.get(key, new), new)
    for (d, k), (dist, end) in sorted(best.items()):
        add(d, k, dist, int(bench.n[k]), end)


LEAK = "array<struct<item_id:long,distance:int,item_words:int,word_end:int>>"


def _finder(shared: list):
    @F.pandas_udf(LEAK)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[dict(zip(("item_id", "distance", "item_words", "word_end"), x)) for x in found]
                             for found in leaks([b.value for b in shared], s.tolist())], index=s.index, dtype=object)
    return find


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", column: str = "leaks",
               every_item: bool = True) -> DataFrame:
    """``docs`` and an array of the benchmark items that each row's text holds: short ones and those without an
    id too, unless ``every_item`` is False."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    if not every_item:
        items = items.where(F.col("item_id").isNotNull())
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // ITEMS_AT_ONCE), -(-size // ITEM_BYTES))
    out = docs.withColumn(column, F.array().cast(LEAK))
    for first in range(0, blocks, BLOCKS_AT_ONCE):
        shared = []
        for k in range(first, min(first + BLOCKS_AT_ONCE, blocks)):
            block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text")
            # a NULL apart from the number: pandas would read ids as doubles
            block = block.select(F.coalesce("item_id", F.lit(0)).alias("item_id"), F.col("item_id").isNull().alias("nameless"), "text").toPandas()
            ids = [None if x else int(i) for i, x in zip(block["item_id"], block["nameless"])]
            shared.append(spark.sparkContext.broadcast(Benchmark(ids, block["text"].tolist(), every_item)))
        out = out.withColumn(column, F.concat(column, _finder(shared)(F.col(text))))
        if first + BLOCKS_AT_ONCE < blocks:
            out = written(out, "leaks-pass")
            for b in shared:
                b.unpersist()
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance, item_words, word_end): the best match of every leaked item in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
