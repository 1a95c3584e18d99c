"""Ranked lexical search by scanning the documents with an Aho-Corasick automaton.

All terms of the items, each between two guards, make one automaton. A text is
folded byte for byte (A-Z in lower case, every other ASCII byte that is no digit
or letter a guard), so the automaton finds exactly the whole terms, and their
counts (tf) come straight from the text: there is no index of the documents.
The automaton's outputs map to the items that hold the term.

Documents are scanned twice. The first scan adds up what the weights need:
documents with terms (N), their terms (L) and, per term of the items, the
documents that hold it (df); each task hands on one row a term. The second
scores every document for every item and keeps each item's best ``k`` of a
task; the best of the tasks are merged in two steps, so no task gets them all.

The items are a query set. They are cut into blocks by a hash, as many as keep
a block's mean near ITEMS_AT_ONCE items and TERM_BYTES of terms; one block at a time is
collected, broadcast and scanned for, and its automaton is built once a task.

Scores are whole numbers: w * ((1e9 * tf) div (1000 * tf + 8 * m)) summed over
an item's terms, with w and m as in ``weight`` and ``rank_documents``.

Defined cases: NULL or empty texts and texts without terms hold none and are
never ranked; items without terms have no rows; each row of the items is an
item of its own, also with a NULL or a repeated id, and each row of the
documents a document; equal scores go by ascending doc_id, NULL ids last; texts
of any length are read whole; an empty table on either side gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kasaflow.llm.common import table, written

TOP = 10
ITEMS_AT_ONCE = 2_000
TERM_BYTES = 4 << 20
GUARD = b" "
MERGE_PARTS = 64              # of an item's candidates in the first merge
CELLS = 4 << 20               # documents times items scored at once

FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))


def fold(text: str) -> bytes:
    """The text between guards, a guard in place of every byte that belongs to no term."""
    return GUARD + text.encode("utf-8").translate(FOLD) + GUARD


def n_terms(folded: bytes) -> int:
    inside = np.frombuffer(folded, np.uint8) != GUARD[0]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """Terms of a block of items: their order is the automaton's output, ``items_of`` maps it to items."""

    def __init__(self, pairs: list[tuple[int, str]]):
        self.items = sorted({i for i, _ in pairs})
        number = {i: k for k, i in enumerate(self.items)}
        self.terms = sorted({t for _, t in pairs})
        where = {t: k for k, t in enumerate(self.terms)}
        term = np.array([where[t] for _, t in pairs], np.int64)
        item = np.array([number[i] for i, _ in pairs], np.int64)
        self.item = item[np.argsort(term, kind="stable")]
        self.start = np.searchsorted(np.sort(term), np.arange(len(self.terms) + 1))
        self.weights: np.ndarray | None = None
        self.n_docs = self.n_all = 0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for k, t in enumerate(self.terms):
            found.add_word((GUARD + t.encode("utf-8") + GUARD).decode("latin-1"), k)
        found.make_automaton()
        return found

    def items_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``terms``, item) for every item that holds one of the terms."""
        size = self.start[terms + 1] - self.start[terms]
        at = np.repeat(np.arange(len(terms)), size)
        place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        return at, self.item[np.repeat(self.start[terms], size) + place]


def count_terms(automaton: ahocorasick.Automaton, folded: bytes) -> Counter:
    """tf of every term of the automaton that occurs in a folded text."""
    return Counter(map(itemgetter(1), automaton.iter(folded.decode("latin-1"))))


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(_item, item_id, term): the distinct terms of every row, written once (row numbers are fixed by that)."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), 1)
    rows = items.select(F.monotonically_increasing_id().alias("_item"), F.col(item_id).alias("item_id"),
                        F.array_distinct(terms).alias("terms"))
    return written(rows.select("_item", "item_id", F.explode("terms").alias("term")), "lexical-items")


def _statistics(shared, with_totals: bool):
    """One row a term that occurs (documents that hold it), and one (term -1) with N and L."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        automaton, df = block.automaton(), np.zeros(len(block.terms), np.int64)
        docs = total = 0
        for batch in batches:
            for text in batch.column(0):
                folded = fold(text.as_py()) if text.is_valid else b""
                n = n_terms(folded) if folded else 0
                if n:
                    docs, total = docs + 1, total + n
                    df[list(count_terms(automaton, folded))] += 1
        seen = np.flatnonzero(df)
        term, n = seen.tolist(), df[seen].tolist()
        if with_totals:
            term, n = [-1, -2, *term], [docs, total, *n]
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])
    return scan


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's ``k`` best candidates: highest score, then smallest id, NULL ids last."""
    order = np.lexsort((doc, null, -score, item))
    item = item[order]
    first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
    return order[rank < k]


def _ranker(shared, k: int):
    """Scores of (doc_id, text) rows; yields each item's best of the partition."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        block = shared.value
        automaton, n_items = block.automaton(), len(block.items)
        step = max(1, CELLS // max(n_items, 1))
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), step):
                rows = range(lo, min(lo + step, len(ids)))
                row, term, tf, m = [], [], [], np.ones(len(rows), np.int64)
                for r, at in enumerate(rows):
                    if not texts[at].is_valid:
                        continue
                    folded = fold(texts[at].as_py())
                    n = n_terms(folded)
                    if n:
                        m[r] = 10 + 90 * n * block.n_docs // block.n_all
                        counts = count_terms(automaton, folded)
                        row += [r] * len(counts)
                        term += counts.keys()
                        tf += counts.values()
                if not row:
                    continue
                row, term, tf = np.array(row), np.array(term), np.array(tf, np.int64)
                gain = block.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                at, item = block.items_of(term)
                cell, gain = row[at] * n_items + item, gain[at]
                order = np.argsort(cell, kind="stable")
                cell = cell[order]
                first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                score = np.add.reduceat(gain[order], first)
                found = cell[first]
                found, score = found[score > 0], score[score > 0]
                null = np.array([not ids[lo + r].is_valid for r in range(len(rows))])
                doc = np.array([ids[lo + r].as_py() or 0 for r in range(len(rows))], np.int64)
                new = [found % n_items, score, doc[found // n_items], null[found // n_items]]
                kept = [np.concatenate(both) for both in zip(kept, new)]
                keep = _best(*kept, k)
                kept = [x[keep] for x in kept]
        if len(kept[0]):
            ids = pa.array(kept[2], pa.int64(), mask=kept[3])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(block.items, np.int64)[kept[0]]), ids, pa.array(kept[1])],
                                             names=["_item", "doc_id", "score"])
    return scan


def merged(found: DataFrame, k: int) -> DataFrame:
    """(_item, rank, doc_id, score): the best of every task's best, first in parts."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS)))
    part = Window.partitionBy("_item", "_part").orderBy(*order)
    found = found.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= k)
    whole = Window.partitionBy("_item").orderBy(*order)
    return (found.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
            .select("_item", "rank", "doc_id", "score"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents with a score above 0.

    A term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))); a document's m is
    10 + (90 * n * N) div L for its n terms."""
    spark = docs.sparkSession
    terms = item_terms(items, item_id, item_text)
    texts = docs.select(F.col(text).alias("text"))
    pairs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_items, n_bytes = terms.agg(F.count_distinct("_item"), F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()
    blocks = max(1, -(-n_items // ITEMS_AT_ONCE), -(-n_bytes // TERM_BYTES))
    totals, out = None, None
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b).select("_item", "term").collect()
        if not rows:
            continue
        block = Block([(r[0], r[1]) for r in rows])
        shared = spark.sparkContext.broadcast(block)
        counted = texts.mapInArrow(_statistics(shared, totals is None), "term long, n long")
        df = {r[0]: r[1] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        shared.unpersist()
        if totals is None:  # the first scan counts the documents for all blocks
            totals = df.pop(-1, 0), df.pop(-2, 0)
        block.n_docs, block.n_all = totals
        block.weights = np.array([weight(totals[0], df.get(t, 0)) for t in range(len(block.terms))], np.int64)
        shared = spark.sparkContext.broadcast(block)
        found = written(merged(pairs.mapInArrow(_ranker(shared, k), "_item long, doc_id long, score long"), k), "lexical-best")
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    names = terms.select("_item", "item_id").distinct()
    return out.join(names, "_item").select("item_id", "rank", "doc_id", "score")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
