"""Spelling variants of a corpus vocabulary, found in a trie of letter-group counts.

Words are arranged by how many letters of each group they have, one trie level
a group. One inserted, deleted or replaced code point adds at most one letter
to one group (surplus) and takes at most one from another (deficit), so a
depth-first search that follows equal counts, and once each a count one higher
and one lower, meets every near word; the words at the leaves it reaches are
verified letter by letter. A pair is looked for once, from the word that has
fewer letters of the first group in which the two differ: its search spends the
surplus first. A word's form is its near word of largest n (ties:
smallest in code-point order) if that n is at least ``RATIO`` times its own;
its root is the end of the chain of forms.

The trie is cut below its first levels into subtrees, which are dealt to
buckets. Every word lies in one bucket and is looked up in each bucket that
the budgets let it reach. The number of levels of the cut grows until no
subtree has more than ``SUBTREE`` words; subtrees still larger at the last
level are dealt out by a hash of the word, and looked up in each part. A task
holds one bucket's trie and streams the words that are looked up in it, so
neither a frequent shape nor its neighbours have to fit in memory. A word's
results of one bucket leave as one row. Chains of forms are followed by
doubling: n at least doubles along a chain, so few rounds are needed.

Defined cases: NULL, empty texts and texts without letters have no words; a
NULL id counts as an empty text in the hash of ``run_words``; every row counts,
also repeated rows; texts and words of any length are taken whole; ties as
above; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.llm.common import table, written

MIN_LETTERS, MIN_COUNT = 5, 3
RATIO = 2
TYPO = 97                     # a run whose hash this divides loses a letter
RUNS = re.compile("[A-Za-zÀ-ÿ]+")

# Levels of the trie: the letters of each group. Any split gives the same result; frequent letters part the
# subtrees well, and below them rare ones let a search end soon.
GROUPS = ("e", "t", "a", "o", "n", "i", "s", "r", "àáâäèéêë", "ñóôöùúüí", "vkjxqz", "by", "pw", "mf", "cg", "du", "l", "h")
REST = len(GROUPS)            # the last group: every other code point up to U+00FF
LEVELS = REST + 1

CUT_LEVELS = 8                # at most so many levels above the subtrees
BUCKETS_PER_TASK = 4          # evens out subtrees of different sizes
SUBTREE = 50_000              # words
LEAST_SUBTREE = 5_000
HOT_SUBTREES = 20_000         # at most so many subtrees exceed their size: bounds what is broadcast
PAIR_BYTES = 1 << 23          # of letters compared at once
KEEP_WIDTH = 32               # letters of a word that are kept ready for comparisons
FLUSH_BYTES = 1 << 25          # of texts whose words a task holds before it hands them on


def _group_table() -> np.ndarray:
    groups = np.full(256, REST, np.int64)
    for g, letters in enumerate(GROUPS):
        for c in letters:
            groups[ord(c)] = g
    return groups


GROUP_OF = _group_table()


# ---- words of the texts ------------------------------------------------------------------------

def run_words(doc_id: str, text: str) -> Counter:
    """The words of a text with their counts; a run whose crc32 (of id:run) TYPO divides loses one letter."""
    start = zlib.crc32(f"{doc_id}:".encode())
    words: Counter = Counter()
    for run, n in Counter(RUNS.findall(text.encode("utf-8").lower().decode("utf-8"))).items():
        h = zlib.crc32(run.encode("utf-8"), start)
        if h % TYPO == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= MIN_LETTERS:
            words[run] += n
    return words


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())],
                                          names=["word", "n"])

    held, read = Counter(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):  # one text at a time
            if text.is_valid:
                text = text.as_py()
                held.update(run_words(doc_id.as_py() or "", text))
                read += len(text)
                if read >= FLUSH_BYTES:
                    yield rows(held)
                    held, read = Counter(), 0
    if held:
        yield rows(held)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of every word of at least MIN_LETTERS letters and ``min_count`` occurrences."""
    pairs = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    return (pairs.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


# ---- the trie ------------------------------------------------------------------------------------

class Words:
    """Words as one array of letters, with their group counts."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.letters = np.frombuffer(b"".join(raw), np.uint8)
        self.n = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.tables: dict[int, np.ndarray] = {}
        owner = np.repeat(np.arange(len(raw)), self.n)
        self.counts = np.bincount(owner * LEVELS + GROUP_OF[self.letters], minlength=len(raw) * LEVELS).reshape(-1, LEVELS)

    def padded(self, which: np.ndarray, width: int) -> np.ndarray:
        """Letters of the chosen words, a row each, zeros behind."""
        if width <= KEEP_WIDTH:                             # one table of all words that fit
            if width not in self.tables:
                self.tables[width] = self._rows(np.arange(len(self.n)), width)
            return self.tables[width][which]
        return self._rows(which, width)

    def _rows(self, which: np.ndarray, width: int) -> np.ndarray:
        at = np.arange(width)
        inside = at < self.n[which][:, None]
        return np.where(inside, self.letters[np.where(inside, self.start[which][:, None] + at, 0)], 0)


class Trie:
    """Words by the counts of successive letter groups."""

    def __init__(self, words: Words):
        self.words = words
        self.order = np.lexsort(words.counts.T[::-1])       # words in order of their counts, first group first
        counts = words.counts[self.order]
        self.width = int(counts.max(initial=0)) + 2
        self.keys, parent = [], np.zeros(len(counts), np.int64)
        for level in range(LEVELS):                         # a node's children: parent * width + count, ascending
            keys, parent = np.unique(parent * self.width + counts[:, level], return_inverse=True)
            self.keys.append(keys)
        self.leaf = np.searchsorted(parent, np.arange(parent.max(initial=-1) + 2))

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of the nodes with the given counts, and which of them exist."""
        keys = self.keys[level]
        want = node * self.width + count
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return at, (keys[at] == want) & (count >= 0) & (count < self.width)

    def leaves(self, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(queries, leaves, unspent): leaves within a surplus and, at a later level, a deficit of one each, depth
        first; all queries that spend their budgets at the same levels walk together."""
        if not len(self.order) or not len(counts):
            return
        stack = [(0, np.zeros(len(counts), np.int64), np.arange(len(counts)), 1, 0)]
        while stack:
            level, node, query, surplus, deficit = stack.pop()
            while level < LEVELS and len(query):
                here = counts[query, level]
                if surplus or deficit:                      # the surplus opens the deficit
                    at, ok = self.child(level, node, here + surplus - deficit)
                    if ok.any():
                        stack.append((level + 1, at[ok], query[ok], 0, surplus))
                at, ok = self.child(level, node, here)
                node, query, level = at[ok], query[ok], level + 1
            if len(query):
                yield query, node, bool(surplus)

    def verified(self, query: np.ndarray, leaf: np.ndarray, other: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) pairs below the leaves that differ by exactly one code point, a million at a time."""
        size = self.leaf[leaf + 1] - self.leaf[leaf]
        upto = np.cumsum(size)
        lo = 0
        while lo < len(query):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + (PAIR_BYTES >> 3), "right")))
            part = size[lo:hi]
            q = np.repeat(query[lo:hi], part)
            place = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
            w = self.order[np.repeat(self.leaf[leaf[lo:hi]], part) + place]
            ok = one_apart(other, q, self.words, w)
            if ok.any():
                yield q[ok], w[ok]
            lo = hi


def one_apart(a: Words, left: np.ndarray, b: Words, right: np.ndarray) -> np.ndarray:
    """Whether the pairs of words differ by exactly one inserted, deleted or replaced code point."""
    out = np.zeros(len(left), bool)
    more = b.n[right] - a.n[left]
    bits = np.maximum(4, np.ceil(np.log2(np.maximum(a.n[left], b.n[right]) + 1)).astype(np.int64))
    for c in np.unique(bits):
        width = 1 << int(c)
        step = max(1, PAIR_BYTES // width)
        for longer in (0, 1, -1):
            members = np.flatnonzero((bits == c) & (more == longer))
            for lo in range(0, len(members), step):
                m = members[lo:lo + step]
                x, y = a.padded(left[m], width), b.padded(right[m], width)
                out[m] = (x != y).sum(1) == 1 if longer == 0 else _one_more(*((x, y) if longer == 1 else (y, x)))
    return out


def _one_more(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each row of y is that of x with one letter inserted: from the first difference on, y runs one ahead."""
    first = (x != y).argmax(1)
    apart = x[:, :-1] != y[:, 1:]
    last = np.where(apart.any(1), apart.shape[1] - 1 - apart[:, ::-1].argmax(1), -1)
    return last < first


# ---- subtrees over the cluster --------------------------------------------------------------------

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_LEVEL_SALT = np.arange(1, LEVELS + 1, dtype=np.uint64) * _MIX[1]


def _prefix_hash(counts: np.ndarray) -> np.ndarray:
    """Hash of each row's counts; equal for equal prefixes of equal length."""
    h = np.full(len(counts), _MIX[0], np.uint64)
    for level in range(counts.shape[1]):
        h = (h ^ (counts[:, level].astype(np.uint64) + _LEVEL_SALT[level])) * _MIX[0]
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _all_prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(levels, prefix, n): how many words of the batch lie below each prefix."""
    for pdf in batches:
        counts = Words(pdf["word"].tolist()).counts
        for p in range(1, CUT_LEVELS + 1):
            prefix, n = np.unique(_prefix_hash(counts[:, :p]), return_counts=True)
            yield pd.DataFrame({"levels": p, "prefix": prefix, "n": n})


def cut(words: DataFrame, n: int, tasks: int, subtree: int = SUBTREE) -> tuple[int, dict[int, int]]:
    """At which level to cut the trie of ``n`` words, and into how many parts the subtrees that stay too
    large are dealt. Small vocabularies are cut finer, so that all ``tasks`` have some of the work."""
    subtree = max(subtree, -(-n // HOT_SUBTREES))           # so fewer than HOT_SUBTREES can be larger
    goal = min(subtree, max(LEAST_SUBTREE, n // tasks))
    shape = "levels int, prefix long, n long"
    sizes = written(words.select("word").mapInPandas(_all_prefixes, shape).groupBy("levels", "prefix").agg(F.sum("n").alias("n")),
                    "spelling-prefixes")
    largest = {r["levels"]: r["n"] for r in sizes.groupBy("levels").agg(F.max("n").alias("n")).collect()}
    level = next((p for p in sorted(largest) if largest[p] <= goal), CUT_LEVELS)
    hot = sizes.where((F.col("levels") == level) & (F.col("n") > subtree)).select("prefix", F.ceil(F.col("n") / subtree).cast("int"))
    return level, {int(r[0]): int(r[1]) for r in hot.collect()}


def reachable(levels: int) -> np.ndarray:
    """What a surplus of at most one, and after it a deficit, can add to the first ``levels`` counts."""
    unit = np.eye(levels, dtype=np.int64)
    both = [unit[i] - unit[j] for i in range(levels) for j in range(i + 1, levels)]
    return np.vstack([np.zeros((1, levels), np.int64), unit, *[b[None] for b in both]])


def _dealt(levels: int, hot: dict[int, int], buckets: int):
    """Words to (bucket, is_query, word, n): the bucket a word lies in, and the buckets it is looked up in."""
    steps = reachable(levels)
    mod = np.uint64(buckets)

    def bucket(prefix: np.ndarray, part: np.ndarray) -> np.ndarray:
        x = (prefix.view(np.uint64) + part.astype(np.uint64)) * _MIX[1]
        return ((x ^ (x >> np.uint64(31))) % mod).astype(np.int64)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, n = pdf["word"].tolist(), pdf["n"].to_numpy(np.int64)
            counts = Words(words).counts[:, :levels]
            home = _prefix_hash(counts)
            part = np.array([zlib.crc32(w.encode("latin-1")) % hot.get(int(p), 1) for w, p in zip(words, home)], np.int64)
            out_bucket, out_word = [bucket(home, part)], [np.arange(len(words))]
            for step in steps:
                near = counts + step
                row = np.flatnonzero((near >= 0).all(1))
                prefix = _prefix_hash(near[row])
                parts = np.array([hot.get(int(p), 1) for p in prefix], np.int64) if hot else np.ones(len(row), np.int64)
                which = np.repeat(np.arange(len(row)), parts)
                number = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
                out_bucket.append(bucket(prefix[which], number))
                out_word.append(row[which])
            is_query = np.repeat([False, True], [len(words), sum(map(len, out_word)) - len(words)])
            b, w = np.concatenate(out_bucket), np.concatenate(out_word)
            _, once = np.unique((b * 2 + is_query) * len(words) + w, return_index=True)
            b, w, is_query = b[once], w[once], is_query[once]
            for lo in range(0, len(b), 100_000):
                s = slice(lo, lo + 100_000)
                yield pd.DataFrame({"bucket": b[s], "is_query": is_query[s], "word": [words[i] for i in w[s]], "n": n[w[s]]})
    return deal


class Best:
    """For each of a set of words: how many near words, and the best of them."""

    def __init__(self, words: np.ndarray):
        self.words, self.count = words, np.zeros(len(words), np.int64)
        self.n, self.best = np.zeros(len(words), np.int64), np.full(len(words), None, object)

    def add(self, mine: np.ndarray, other: np.ndarray, other_n: np.ndarray) -> None:
        """Pairs: places among the words, and near words with their n."""
        self.count += np.bincount(mine, minlength=len(self.words))
        top = self.n.copy()
        np.maximum.at(top, mine, other_n)
        for i in np.flatnonzero(other_n == top[mine]).tolist():     # few a word: those of its largest n
            m = mine[i]
            if self.best[m] is None or other_n[i] > self.n[m] or other[i] < self.best[m]:
                self.best[m], self.n[m] = other[i], other_n[i]

    def rows(self) -> pd.DataFrame:
        hit = np.flatnonzero(self.count)
        return pd.DataFrame({"word": self.words[hit], "n_near": self.count[hit], "best": self.best[hit], "best_n": self.n[hit]})


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (bucket, is_query): a bucket's own words make its trie, then words are looked up in it
    as they stream by. One row a (word, bucket) with near words, for either side of the pairs."""
    at, held, trie, own_n, own = None, [], None, None, None
    for pdf in batches:
        for bucket, rows in pdf.groupby("bucket", sort=True):
            if bucket != at:
                if trie is not None:
                    yield own.rows()
                at, held, trie = bucket, [], None
            mine, looked_up = rows[~rows["is_query"]], rows[rows["is_query"]]
            if len(mine):
                held.append(mine)
            if not len(looked_up) or not held:
                continue
            if trie is None:
                both = pd.concat(held, ignore_index=True)
                own, own_n = Best(both["word"].to_numpy(object)), both["n"].to_numpy(np.int64)
                trie = Trie(Words(own.words.tolist()))
            asked, asked_n = Best(looked_up["word"].to_numpy(object)), looked_up["n"].to_numpy(np.int64)
            words = Words(asked.words.tolist())
            for query, leaf, unspent in trie.leaves(words.counts):
                for q, w in trie.verified(query, leaf, words):
                    asked.add(q, own.words[w], own_n[w])
                    if not unspent:                         # words of equal counts look each other up
                        own.add(w, asked.words[q], asked_n[q])
            yield asked.rows()
    if trie is not None:
        yield own.rows()


def near_words(words: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """(word, n_near, best, best_n) of every word of (word, n) that has near words."""
    spark = words.sparkSession
    n, tasks = words.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels, hot = cut(words, n, tasks, subtree)
    buckets = max(tasks * BUCKETS_PER_TASK, -(-n // subtree))
    rows = words.mapInPandas(_dealt(levels, hot, buckets), "bucket long, is_query boolean, word string, n long")
    found = (rows.repartition(max(tasks, buckets // BUCKETS_PER_TASK), "bucket").sortWithinPartitions("bucket", "is_query")
             .mapInPandas(_search, "word string, n_near long, best string, best_n long"))
    top = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top"))
            .select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.m")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word of each chain of forms, by doubling."""
    at = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                  F.col("next").isNotNull().alias("moved"))
        step = written(step, "spelling-roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def spelling_groups(words: DataFrame, ratio: int = RATIO, subtree: int = SUBTREE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n)."""
    words = written(words.select("word", "n"), "spelling-words")
    near = written(near_words(words, subtree), "spelling-near")
    has_form = F.col("best_n") >= ratio * F.col("n")
    all_words = (words.join(near, "word", "left")
                 .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n")))
    ends = roots(all_words.where("form IS NOT NULL"))
    return (all_words.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(vocabulary(table(spark, sf_dir, "documents")))
