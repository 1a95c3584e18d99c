"""Token counts by rank-synchronous array merging.

A text's tokens under byte-fallback BPE are what is left of its characters
after merging, again and again, the adjacent pair of best rank (leftmost among
equals). No piece of the vocabulary holds a word mark after another character
or a line break, so a text falls into units ([spaces]word, or a line break)
that merge independently. The distinct units of a batch are held as ragged
numpy arrays of symbols; in each step every unit applies its lowest-rank pair
at once (all of its occurrences where that is the same as one after the other,
else the leftmost). What survives is counted: 1 for a piece, the number of
UTF-8 bytes for a character outside the vocabulary.

Two things keep long units linear. Of a long run of blanks, the front settles
into whole pieces that merge with nothing any more, before the rest has changed
(checked for the vocabulary); so many of them are counted at once. Units that
still merge after STEPS steps are finished one merge after the other from a
queue of their pairs.

The vocabulary file is read through its library (pieces and scores only); the
pair table (bounded by the vocabulary) is broadcast. Texts never shuffle.

Defined cases: NULL and empty texts have 0 bytes and 0 tokens; repeated rows
are counted alike; texts of any length are read whole; other columns are
carried by ``with_token_counts``.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.llm.common import table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
UNITS_AT_ONCE = 8_192
CACHE_UNITS = 1_000_000      # distinct units whose counts a task keeps; beyond it starts anew
CACHE_LETTERS = 64           # of a unit that is kept: bounds the bytes
STEPS = 64
NO_RANK = np.int32(2**31 - 1)


class Vocabulary:
    """Characters, pairs and ranks of a byte-fallback BPE vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        piece = {sp.id_to_piece(i): i for i in plain}
        inner = re.compile(f"[^{MARK}]{MARK}|\n")
        if any(inner.search(p) for p in piece) or sp.normalize("É a  ") != f"{MARK}É{MARK}a {MARK}":
            raise ValueError("units of this vocabulary cross words, or its texts are normalised")
        score = {p: sp.get_score(i) for p, i in piece.items()}
        level = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}  # equal scores: equal ranks
        self.chars = {p: i for p, i in piece.items() if len(p) == 1}
        # Every way to split a piece in two known symbols (a symbol is a piece or any single character).
        pairs = {}
        for p, i in piece.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                a = piece.get(a, -ord(a) if len(a) == 1 else None)
                b = piece.get(b, -ord(b) if len(b) == 1 else None)
                if a is not None and b is not None:
                    pairs[a, b] = (level[score[p]], i)
        # open addressing: a pair is in the first free slot from its hash on
        keys = np.array([self.key(a, b) for a, b in pairs], np.int64)
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.slots = np.full((1 << self.bits) + 64, -1, np.int64)
        self.ranks = np.full(len(self.slots), NO_RANK, np.int32)
        self.merged = np.full(len(self.slots), -1, np.int32)
        for k, at, (r, i) in zip(keys.tolist(), self.hash(keys).tolist(), pairs.values()):
            while self.slots[at] >= 0:
                at += 1
            self.slots[at], self.ranks[at], self.merged[at] = k, r, i

        self._pairs: dict | None = None
        self.blanks = self._blank_run(max((len(p) for p in piece if set(p) == {MARK}), default=1))

    def pairs(self) -> dict:
        """(rank, merged symbol) by pair, for merges one after the other; made when first needed."""
        if self._pairs is None:
            used = np.flatnonzero(self.slots >= 0)
            self._pairs = dict(zip(self.slots[used].tolist(), zip(self.ranks[used].tolist(), self.merged[used].tolist())))
        return self._pairs

    def _blank_run(self, longest: int) -> int:
        """Length of the piece that the front of a long run of blanks becomes while all behind it is still
        single blanks, if that piece merges with no piece of blanks any more; 0 if there is none."""
        one = self.chars.get(MARK)
        if one is None or longest < 2:
            return 0
        sizes, alive = {one: 1}, [one] * (8 * longest)
        blanks = set(sizes)
        pairs = self.pairs()
        grown = True
        while grown:  # all pieces of blanks
            grown = False
            for a in list(blanks):
                for b in list(blanks):
                    made = pairs.get(self.key(a, b))
                    if made and made[1] not in blanks:
                        blanks.add(made[1])
                        sizes[made[1]] = sizes[a] + sizes[b]
                        grown = True
        while True:  # one merge after the other, from the left
            ranks = [pairs.get(self.key(a, b), (NO_RANK,))[0] for a, b in zip(alive, alive[1:])]
            if not ranks or min(ranks) == NO_RANK:
                return 0
            at = ranks.index(min(ranks))
            alive[at:at + 2] = [pairs[self.key(alive[at], alive[at + 1])][1]]
            front = alive[0]
            if not any(self.key(front, b) in pairs for b in blanks):
                return sizes[front] if all(x == one for x in alive[1:]) else 0

    @staticmethod
    def key(a, b):
        """One number for a pair; symbols outside the vocabulary are minus their code point."""
        return (a + (1 << 21)) * (1 << 32) + (b + (1 << 21))

    def hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair (NO_RANK where there is none)."""
        keys = self.key(a.astype(np.int64), b.astype(np.int64))
        at = self.hash(keys)
        on = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] >= 0))
        while len(on):
            at[on] += 1
            s = self.slots[at[on]]
            on = on[(s != keys[on]) & (s >= 0)]
        hit = self.slots[at] == keys
        return np.where(hit, self.ranks[at], NO_RANK), np.where(hit, self.merged[at], -1)


def merge_counts(units: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Number of tokens of each unit (a non-empty string without a dummy mark to add)."""
    if len(units) > UNITS_AT_ONCE:  # small arrays stay in the processor's cache
        return np.concatenate([merge_counts(units[k:k + UNITS_AT_ONCE], vocabulary) for k in range(0, len(units), UNITS_AT_ONCE)])
    counts = np.zeros(len(units), np.int64)
    text = "".join(units)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letters, inverse = np.unique(codes, return_inverse=True)
    known = np.array([vocabulary.chars.get(chr(c), -c) for c in letters.tolist()], np.int64)
    width = np.array([1 if i >= 0 else len(chr(c).encode("utf-8", "surrogatepass"))
                      for c, i in zip(letters.tolist(), known.tolist())], np.int64)
    sym = known[inverse]
    unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
    weight = width[inverse]                       # tokens that a surviving symbol stands for
    rank = np.full(len(sym), NO_RANK, np.int32)   # of the pair that starts here
    into = np.full(len(sym), -1, np.int64)

    def refresh(at: np.ndarray) -> None:
        rank[at] = NO_RANK
        ok = at[at + 1 < len(sym)]
        ok = ok[unit[ok] == unit[ok + 1]]
        rank[ok], into[ok] = vocabulary.look_up(sym[ok], sym[ok + 1])

    refresh(np.arange(len(sym)))
    for _ in range(STEPS):
        if not len(sym):
            return counts
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        best = np.minimum.reduceat(rank, first)
        size = np.diff(np.r_[first, len(sym)])
        done = best == NO_RANK
        if done.any():  # units without a pair left: count and leave
            out = np.repeat(done, size)
            np.add.at(counts, unit[out], weight[out])
            keep = ~out
            sym, unit, weight, rank, into = sym[keep], unit[keep], weight[keep], rank[keep], into[keep]
            if not len(sym):
                return counts
            best, size = best[~done], size[~done]
        at = np.flatnonzero(rank == np.repeat(best, size))
        lead = np.r_[True, unit[at[1:]] != unit[at[:-1]]]
        if not lead.all():
            at = _together(at, lead, sym, unit, into, best, vocabulary)
        sym[at] = into[at]
        weight[at] = 1
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        where = (np.cumsum(keep) - 1)[at]
        sym, unit, weight, rank, into = sym[keep], unit[keep], weight[keep], rank[keep], into[keep]
        near = np.zeros(len(sym), bool)
        near[where] = True
        near[np.maximum(where - 1, 0)] = True
        refresh(np.flatnonzero(near))
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(sym) else np.zeros(0, np.int64)
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(sym)]):
        counts[unit[lo]] += _one_by_one(sym[lo:hi], weight[lo:hi], rank[lo:hi], vocabulary)
    return counts


def _one_by_one(sym: np.ndarray, weight: np.ndarray, rank: np.ndarray, vocabulary: Vocabulary) -> int:
    """Tokens of one unit, merged from a queue of (rank, place): n log n."""
    pairs, key = vocabulary.pairs(), vocabulary.key
    sym, weight = sym.tolist(), weight.tolist()
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    starts = np.flatnonzero(rank != NO_RANK)
    queue = [(r, i, sym[i], sym[i + 1]) for r, i in zip(rank[starts].tolist(), starts.tolist()) if i + 1 < n]
    heapq.heapify(queue)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i]
        if j >= n or sym[i] != a or sym[j] != b:            # one of the two has merged meanwhile
            continue
        made = pairs[key(a, b)][1]
        sym[i], weight[i] = made, 1
        sym[j], weight[j] = None, 0
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = pairs.get(key(made, sym[k]))
            if found:
                heapq.heappush(queue, (found[0], i, made, sym[k]))
        h = before[i]
        if h >= 0:
            found = pairs.get(key(sym[h], made))
            if found:
                heapq.heappush(queue, (found[0], h, sym[h], made))
    return sum(weight)


def _together(at, lead, sym, unit, into, best, vocabulary) -> np.ndarray:
    """Of the places where each unit's lowest-rank pair starts, those to merge in
    one step: all that do not overlap, read from the left, unless a merge would
    give a neighbouring pair of the same or a lower rank (which would have to go
    first); then only the unit's leftmost place."""
    take = np.ones(len(at), bool)
    touching = np.flatnonzero((at[1:] == at[:-1] + 1) & ~lead[1:]) + 1
    if len(touching):  # a run of touching places: every second one
        new_run = np.ones(len(at), bool)
        new_run[touching] = False
        start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - start) % 2 == 0
    place = at[take]
    group = np.cumsum(lead)[take] - 1
    low = best[group]
    made = into[place]
    n = len(sym)
    after = np.minimum(place + 2, n - 1)
    ok_after = (place + 2 < n) & (unit[after] == unit[place])
    prior = np.maximum(place - 1, 0)
    ok_prior = (place > 0) & (unit[prior] == unit[place])
    merged_here = np.full(n, -1, np.int64)
    merged_here[place] = made
    swallowed = np.zeros(n, bool)
    swallowed[place + 1] = True
    left = np.where(swallowed[prior], merged_here[np.maximum(prior - 1, 0)], sym[prior])
    right_new = np.where(merged_here[after] >= 0, merged_here[after], sym[after])
    risky = np.zeros(len(place), bool)
    for a, b, ok in ((made, sym[after], ok_after), (made, right_new, ok_after), (left, made, ok_prior), (sym[prior], made, ok_prior)):
        risky |= ok & (vocabulary.look_up(a, b)[0] <= low)
    bad = np.zeros(int(group[-1]) + 1, bool)
    bad[group[risky]] = True
    first = np.r_[True, group[1:] != group[:-1]]
    return place[first | ~bad[group]]


UNIT = re.compile(r" *[^ \n]+| +")
RUN = re.compile(r" {64,}")


def shortened(text: str, vocabulary: Vocabulary) -> tuple[str, int]:
    """The text with its long runs of blanks cut by whole pieces, and the number of pieces cut out."""
    size, cut = vocabulary.blanks, 0
    if not size or not RUN.search(text):
        return text, 0

    def less(m: re.Match) -> str:
        nonlocal cut
        pieces = max(0, (len(m.group()) - 4 * size) // size)
        cut += pieces
        return " " * (len(m.group()) - pieces * size)
    return RUN.sub(less, text), cut


def count_tokens(texts: list, vocabulary: Vocabulary, cache: dict) -> list[int]:
    """Tokens of each text; ``cache`` holds the counts of units met before."""
    split, new = [], set()
    for t in texts:
        if not t:
            split.append(None)
            continue
        t, cut = shortened(" " + t.replace(MARK, " "), vocabulary)
        units = UNIT.findall(t)
        split.append((units, t.count("\n") + cut))
        new.update(units)
    new.difference_update(cache)
    if new:
        if len(cache) > CACHE_UNITS:
            cache.clear()
            new = {u for s in split if s for u in s[0]}
        todo = sorted(new)
        cache.update(zip(todo, merge_counts([u.replace(" ", MARK) for u in todo], vocabulary).tolist()))
    out = [0 if s is None else sum(map(cache.__getitem__, s[0])) + s[1] for s in split]
    for u in new:
        if len(u) > CACHE_LETTERS:
            del cache[u]
    return out


def with_token_counts(docs: DataFrame, model_path: str, text: str = "text", column: str = "n_tokens") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_path))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        for s in batches:
            texts = s.tolist()
            out = []
            for k in range(0, len(texts), 500):
                out += count_tokens(texts[k:k + 500], shared.value, cache)
            yield pd.Series(out, index=s.index, dtype="int64")

    return docs.withColumn(column, count(F.col(text)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = with_token_counts(docs, public_tokenizers.path(MODEL))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
                          (F.col("n_tokens") > LIMIT).alias("over_limit"))
