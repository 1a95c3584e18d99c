"""N-gram Jaccard join and its groups, by a blocked sparse matrix product.

Documents are rows, distinct word n-grams (shingles) are columns of a sparse
incidence matrix; the product of the matrix with its transpose holds the
overlap of every pair. Only the part of the product that can hold links is
computed, block by block:

1. Equal texts form a class, told by hashes; no text travels for it yet.
2. Postings are made where the texts are read, from one text of each class in
   a task, and travel once, packed as arrays by bucket of the n-gram's hash, so
   that each n-gram learns in how many texts it occurs (a class that several
   tasks read counts more than once, which changes the order of rarity alone).
   N-grams of one text only cannot overlap. A pair with Jaccard >= t overlaps in at least t * n
   n-grams of either side, so of each text only the first n - ceil(t * n) + 1
   n-grams in order of rarity must be looked at (the size-derived bound), and
   of these only the shared ones.
3. Texts that share such an n-gram and whose sizes fit are put in one
   candidate component through a leader for each (n-gram, size band): as many
   edges as postings, never pairs.
4. Texts travel once, by class and id, to meet the components; one text of
   each class in a component goes on. Each component's matrix is multiplied in tasks: small components many to a
   task, large ones cut into blocks of BLOCK texts by size band, and each
   fitting pair of blocks is a unit. In a unit the product is summed up over
   chunks of columns and pairs that fall below their bound are discarded on
   the way. A unit returns a spanning forest of its links, not its pairs.
5. Connected components of the links are the groups.

Nothing is capped, sampled or sent to the driver but counts. Classes are told
apart by 128 bits of hash, n-grams by 64. The postings of step 2 use the hash's upper 32 bits (64 where
there are more than 2**29 n-grams): clashes there only add candidates.

Defined cases: NULL texts and texts without words have no n-grams and link
with nothing; a text with fewer words than the width is one n-gram, its whole
sequence; equal texts link; repeated ids and rows are separate rows that get
their text's group; NULL ids belong to groups but never name one (a group of
NULL ids has a NULL component); an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kasaflow.llm.common import WORD_PATTERN, connected_components, table, written
from kasaflow.llm.textarrays import as_bytes, mix64, shingle_sets, slices

WIDTH, NUM, DEN = 3, 90, 100   # of the op9 contract; the operator's own default is WIDTH 5, 80 / 100
BLOCK = 256                    # texts in a block
COLUMNS = 8_192                # columns of the matrix multiplied at once
POSTINGS_PER_BUCKET = 1_000_000
MIN_BUCKETS, MAX_BUCKETS = 16, 65_536
PER_ROW, LEAST_IN_BLOCK, MOST_IN_BLOCK = 2_000, 100_000, 4_000_000  # n-grams
TEXTS_PER_UNIT, MIN_UNITS = 1_500, 16   # of small components
BYTES_PER_WORD = 6
SLICE = 500_000                # bytes of text whose n-grams are made at once: some 80 bytes of arrays a byte
WIDE_FROM = 1 << 29
NO_ID = (1 << 63) - 1


def _needed(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap with any text that a text of n n-grams can link with."""
    return -(-n * num // den)


# ---- step 2: postings, packed -------------------------------------------------------------

PACKED = "bucket int, block long, a binary, b binary, c binary"


def _postings(width: int, buckets: int, wide: bool):
    """(cid, text) rows to packed rows: for each block of texts and bucket, the n-grams and the texts'
    numbers in the block; and one row (bucket below 0) with the block's class ids and sizes. Rows come sorted
    by class: copies follow one another and only the first goes on, and a task run again makes the same blocks.
    A block is named by its partition and its place there, as another task may read the same classes.
    Blocks grow with the number of buckets (PER_ROW n-grams a row), up to what fits in a task."""
    dtype, shift = (np.uint64, 0) if wide else (np.uint32, 32)

    limit = max(LEAST_IN_BLOCK, min(MOST_IN_BLOCK, buckets * PER_ROW))

    def block(name: int, cids: np.ndarray, sets: list[np.ndarray]) -> pd.DataFrame:
        n = np.array([len(s) for s in sets], np.int64)
        grams = np.concatenate(sets)
        text = np.repeat(np.arange(len(sets), dtype=np.int32), n)
        token = (grams >> np.uint64(shift)).astype(dtype)
        bucket = (mix64(token.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        token, text, bucket = token[order], text[order], bucket[order]
        used, first = np.unique(bucket, return_index=True)
        cut = np.append(first, len(bucket))
        meta = -1 - int(mix64(np.array([name], np.int64).astype(np.uint64))[0] % np.uint64(buckets))
        rows = [(meta, name, cids.tobytes(), n.tobytes(), b"")]
        rows += [(int(k), name, token[cut[i]:cut[i + 1]].tobytes(), text[cut[i]:cut[i + 1]].tobytes(), b"") for i, k in enumerate(used)]
        return pd.DataFrame(rows, columns=["bucket", "block", "a", "b", "c"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cids, sets, held, last = [], [], 0, None
        name = TaskContext.get().partitionId() << 32
        for pdf in batches:
            ids = pdf["cid"].to_numpy(np.int64)
            new = np.r_[last is None or ids[0] != last, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
            last = ids[-1] if len(ids) else last
            ids = ids[new]
            raw = [as_bytes(t, "ascii") for t in pdf["text"][new]]
            for lo, hi in slices(raw, SLICE):
                got = shingle_sets(raw[lo:hi], width)
                cids.append(ids[lo:hi])
                sets += got
                held += sum(map(len, got))
                if held >= limit:
                    yield block(name, np.concatenate(cids), sets)
                    cids, sets, held, name = [], [], 0, name + 1
        if sets:
            yield block(name, np.concatenate(cids), sets)
    return pack


def _shared(wide: bool):
    """One bucket: the n-grams that occur in two texts or more, back to the blocks they came from, with
    the number of texts. Rows that describe blocks pass through."""
    dtype = np.uint64 if wide else np.uint32

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:
            return pdf
        token = np.frombuffer(b"".join(pdf["a"]), dtype)
        text = np.frombuffer(b"".join(pdf["b"]), np.int32)
        row = np.repeat(np.arange(len(pdf)), [len(a) // dtype().itemsize for a in pdf["a"]])
        order = np.argsort(token, kind="stable")
        t = token[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        size = np.diff(np.r_[first, len(t)])
        df = np.repeat(size, size)
        keep = df >= 2
        order, df = order[keep], df[keep].astype(np.int32)
        back = np.argsort(row[order], kind="stable")
        order, df = order[back], df[back]
        cut = np.searchsorted(row[order], np.arange(len(pdf) + 1))
        out = [(int(pdf["bucket"].iloc[i]), int(pdf["block"].iloc[i]), token[order[cut[i]:cut[i + 1]]].tobytes(),
                text[order[cut[i]:cut[i + 1]]].tobytes(), df[cut[i]:cut[i + 1]].tobytes())
               for i in range(len(pdf)) if cut[i + 1] > cut[i]]
        return pd.DataFrame(out, columns=["bucket", "block", "a", "b", "c"])
    return count


def _prefixes(num: int, den: int, wide: bool):
    """One block: (cid, n) of every text (token NULL), and (cid, n, token) for the shared n-grams among
    the first n - needed + 1 in order of (number of texts, n-gram)."""
    dtype = np.uint64 if wide else np.uint32

    def prefix(pdf: pd.DataFrame) -> pd.DataFrame:
        meta = pdf[pdf["bucket"] < 0]
        cids, n = np.frombuffer(b"".join(meta["a"]), np.int64), np.frombuffer(b"".join(meta["b"]), np.int64)
        rows = pdf[pdf["bucket"] >= 0]
        token = np.frombuffer(b"".join(rows["a"]), dtype)
        text = np.frombuffer(b"".join(rows["b"]), np.int32)
        df = np.frombuffer(b"".join(rows["c"]), np.int32)
        order = np.lexsort((token, df, text))
        token, text = token[order], text[order]
        shared = np.bincount(text, minlength=len(n))
        room = n - _needed(n, num, den) + 1 - (n - shared)    # of the looked-at n-grams, those in other texts too
        place = np.arange(len(text)) - (np.cumsum(shared) - shared)[text]
        take = place < room[text]
        token, text = token[take].astype(np.uint64).view(np.int64), text[take]
        return pd.DataFrame({"cid": np.concatenate((cids, cids[text])), "n": np.concatenate((n, n[text])),
                             "token": pd.array(np.concatenate((np.zeros(len(n), np.int64), token)), dtype="Int64"),
                             "is_text": np.concatenate((np.ones(len(n), bool), np.zeros(len(text), bool)))})
    return prefix


# ---- step 4: the product ---------------------------------------------------------------------

def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> np.ndarray:
    """Boolean matrix: which pairs link (right None: the pairs within ``left``). The incidence matrices
    are multiplied chunk of columns by chunk; a pair is discarded as soon as what is left of the smaller
    side's n-grams cannot lift it to its bound."""
    both = left if right is None else left + right
    n = np.array([len(s) for s in both], np.int64)
    m = len(left)
    rows, cols = slice(0, m), slice(0, m) if right is None else slice(m, len(both))
    a, b = n[rows][:, None], n[cols][None, :]
    # den * o >= num * (a + b - o)  <=>  o >= num * (a + b) / (num + den)
    bound = -(-num * (a + b) // (num + den))
    alive = (np.minimum(a, b) >= bound) & (np.minimum(a, b) > 0)
    if right is None:
        np.fill_diagonal(alive, False)
    if not alive.any():
        return alive
    grams = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), n)
    distinct, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    useful = count >= 2
    number = np.cumsum(useful) - 1
    keep = useful[column]
    column, owner = number[column][keep], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    left_over = np.bincount(owner, minlength=len(both)).astype(np.int64)
    total = np.zeros(alive.shape, np.float32)
    for c in range(0, int(useful.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, c), np.searchsorted(column, c + COLUMNS)
        dense = np.zeros((len(both), COLUMNS), np.float32)
        dense[owner[lo:hi], column[lo:hi] - c] = 1.0
        total += dense[rows] @ dense[cols].T
        left_over -= np.bincount(owner[lo:hi], minlength=len(both))
        alive &= total + np.minimum(left_over[rows][:, None], left_over[cols][None, :]) >= bound
        if not alive.any():
            break
    return alive & (total >= bound)


def forest(links: np.ndarray, square: bool) -> list[tuple[int, int]]:
    """A spanning forest (pairs of node numbers) of a link matrix; for a rectangular one the columns'
    nodes are numbered after the rows'."""
    if not square:
        r, c = links.shape
        whole = np.zeros((r + c, r + c), bool)
        whole[:r, r:] = links
        whole[r:, :r] = links.T
        links = whole
    seen, out = np.zeros(len(links), bool), []
    for root in np.flatnonzero(links.any(1)):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            reached = links[front].any(0) & ~seen
            seen |= reached
            front = np.flatnonzero(reached)
            out += [(int(root), int(x)) for x in front]
    return out


def _unit(num: int, den: int):
    """One unit of the product: components (cc) of texts (cid, packed n-grams), each within itself
    (side 0 only) or side 0 against side 1."""
    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        for _, part in pdf.groupby("cc", sort=False):
            cids, least = part["cid"].to_numpy(), part["least"].to_numpy()
            sets = [np.frombuffer(g, np.uint64) for g in part["grams"]]
            side = part["side"].to_numpy()
            if (side == 0).all():
                idx = np.arange(len(sets))
                links = overlaps(sets, None, num, den)
            else:
                l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                if not len(l) or not len(r):
                    continue
                idx = np.concatenate((l, r))
                links = overlaps([sets[i] for i in l], [sets[i] for i in r], num, den)
            out += [(int(least[idx[x]]), int(cids[idx[x]]), int(least[idx[y]]), int(cids[idx[y]]))
                    for x, y in forest(links, bool((side == 0).all()))]
        return pd.DataFrame(out, columns=["x_least", "x", "y_least", "y"]).astype("int64")
    return multiply


def _sets(width: int):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [as_bytes(t, "ascii") for t in pdf["text"]]
            for lo, hi in slices(raw, SLICE):
                got = shingle_sets(raw[lo:hi], width)
                part = pdf.iloc[lo:hi][["cc", "cid", "least", "band", "members", "sizes"]].copy()
                part["grams"] = [g.tobytes() for g in got]
                yield part
    return sets


def _units(members: DataFrame, width: int, num: int, den: int, partitions: int) -> DataFrame:
    """Texts of candidate components -> units of the product -> links (classes x and y with their smallest ids)."""
    sets = members.mapInPandas(_sets(width), "cc long, cid long, least long, band int, members long, sizes map<int,long>, grams binary")
    small = (sets.where(F.col("members") <= BLOCK)
             .select(F.concat(F.lit("s"), F.pmod(F.xxhash64("cc"), F.lit(partitions)).cast("string")).alias("unit"),
                     "cc", "cid", "least", F.lit(0).alias("side"), "grams"))
    blocks = lambda b: F.coalesce(F.ceil(F.element_at("sizes", b) / F.lit(BLOCK)), F.lit(0)).cast("int")
    up_to = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    own = F.pmod(F.xxhash64("cid"), blocks(F.col("band"))).cast("int")
    name = lambda b, i, c, j: F.concat_ws("-", F.lit("l"), F.col("cc"), b, i, c, j)
    band = F.col("band")
    entry = lambda unit, side: F.struct(unit.alias("unit"), side.cast("int").alias("side"))
    large = (sets.where(F.col("members") > BLOCK).withColumn("own", own)
             .withColumn("units", F.concat(
                 # its block with every block of its band (with itself: side 0 only)
                 F.transform(up_to(blocks(band)), lambda j: entry(
                     name(band, F.least("own", j), band, F.greatest("own", j)), F.when(F.col("own") <= j, F.lit(0)).otherwise(1))),
                 F.transform(up_to(blocks(band + 1)), lambda j: entry(name(band, F.col("own"), band + 1, j), F.lit(0))),
                 F.transform(up_to(blocks(band - 1)), lambda j: entry(name(band - 1, j, band, F.col("own")), F.lit(1)))))
             .select(F.explode("units").alias("u"), "cc", "cid", "least", "grams").select("u.unit", "cc", "cid", "least", "u.side", "grams"))
    return small.unionByName(large).groupBy("unit").applyInPandas(
        _unit(num, den), "x_least long, x long, y_least long, y long")


def _class_id(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def _with_class(df: DataFrame, clashes: DataFrame, text: str | None = None) -> DataFrame:
    """``df`` with its class id ``cid``: 64 bits of hash, and where these clash, of both hashes together."""
    if text is not None:
        df = df.withColumn("cid", _class_id(F.col(text))).withColumn("twin", F.xxhash64(F.lit(1), F.col(text)))  # another seed
    df = df.join(clashes, F.col("cid") == F.col("clash"), "left")
    return df.withColumn("cid", F.when(F.col("clash").isNotNull(), F.xxhash64("cid", "twin")).otherwise(F.col("cid"))).drop("clash", "twin")


def similar_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, num: int = 80,
                   den: int = 100) -> DataFrame:
    """(doc_id, cid, n_shingles, component_id, group_key) for every row: ``cid`` is the row's class (equal
    texts), ``component_id`` the smallest id of its group, ``group_key`` the group's smallest cid."""
    return _grouped(docs, text, doc_id, width, num, den)[0]


def _grouped(docs: DataFrame, text: str, doc_id: str, width: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """The groups, and the class hashes that stand for more than one text."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = written(source.select("id", _class_id(F.col("text")).alias("cid"), F.xxhash64(F.lit(1), F.col("text")).alias("twin"),
                                   F.octet_length("text").alias("bytes")), "join-digest")
    clashes = written(digest.groupBy("cid").agg(F.min("twin").alias("a"), F.max("twin").alias("b")).where("a <> b")
                      .select(F.col("cid").alias("clash")), "join-clashes")  # a few in 10**10 texts
    digest, source = _with_class(digest, clashes), _with_class(source, clashes, "text")
    classes = digest.groupBy("cid").agg(F.min(F.coalesce("id", F.lit(NO_ID))).alias("least"), F.first("bytes").alias("bytes"))
    size, rows = classes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    grams = size // BYTES_PER_WORD
    wide = grams > WIDE_FROM
    buckets = int(max(MIN_BUCKETS, min(MAX_BUCKETS, grams // POSTINGS_PER_BUCKET)))

    packed = source.select("cid", "text").sortWithinPartitions("cid").mapInPandas(_postings(width, buckets, wide), PACKED)
    shared = packed.groupBy("bucket").applyInPandas(_shared(wide), PACKED)
    stage = written(shared.groupBy("block").applyInPandas(_prefixes(num, den, wide), "cid long, n long, token long, is_text boolean"),
                    "join-prefixes")
    sizes = stage.where("is_text").select("cid", "n").distinct()  # a row for each block that holds the class

    # candidate components through leaders: sizes fit only within a band or between neighbouring bands
    band = F.floor(F.log("n") / F.lit(math.log(den / num) if num < den else 1.0) + 1e-9).cast("int")
    if num >= den:
        band = F.col("n").cast("int")
    post = (stage.where("not is_text and n > 0").select("cid", "n", "token").withColumn("band", band)
            .withColumn("hub", F.explode(F.array(F.col("band"), F.col("band") + 1))))
    leaders = post.groupBy("token", "hub").agg(F.min("cid").alias("leader"), F.max("cid").alias("other")).where("leader <> other")
    edges = post.join(leaders, ["token", "hub"]).where("cid <> leader").select("cid", "leader").distinct()
    candidates = connected_components(edges, "cid", "leader").select(F.col("node").alias("cid"), F.col("component").alias("cc"))
    candidates = candidates.join(sizes, "cid").withColumn("band", band)
    counts = candidates.groupBy("cc", "band").agg(F.count("*").alias("k"))
    counts = counts.groupBy("cc").agg(F.sum("k").alias("members"),
                                      F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("sizes"))  # an entry a band
    members = candidates.select("cid", "cc", "band").join(counts, "cc").join(classes.select("cid", "least"), "cid")

    # One row of each class, also where rows repeat or ids are NULL; repeats collapse before the exchange, which
    # is the only one of texts: the join meets them as they are dealt.
    chosen = source.groupBy("cid", F.coalesce("id", F.lit(NO_ID)).alias("least")).agg(F.min("text").alias("text"))
    texts = chosen.join(members, ["cid", "least"]).select("cc", "cid", "least", "band", "members", "sizes", "text")
    links = written(_units(texts, width, num, den, max(MIN_UNITS, int(rows // TEXTS_PER_UNIT))), "join-links")
    # A node is (smallest id, class), so a group's smallest node names the group's smallest id at once:
    # no join on the group, which may hold a large part of all classes.
    links = links.select(F.struct(F.col("x_least").alias("least"), F.col("x").alias("cid")).alias("x"),
                         F.struct(F.col("y_least").alias("least"), F.col("y").alias("cid")).alias("y"))
    groups = connected_components(links, "x", "y").select(F.col("node.cid").alias("cid"), "component")
    of = (classes.select("cid", "least").join(sizes, "cid").join(groups, "cid", "left")
          .select("cid", "n", F.coalesce("component.least", "least").alias("low"), F.coalesce("component.cid", "cid").alias("component")))
    name = F.when(F.col("n") == 0, F.col("id")).otherwise(F.when(F.col("low") < NO_ID, F.col("low")))
    groups = digest.select("id", "cid").join(of, "cid").select(
        F.col("id").alias(doc_id), "cid", F.col("n").alias("n_shingles"), name.alias("component_id"),
        F.col("component").alias("group_key"))
    return groups, clashes


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one row of each group: the one of the smallest id (NULL ids last). Rows without
    n-grams belong to no group and all stay."""
    groups, clashes = _grouped(docs.select(doc_id, text), text, doc_id, **how)
    groups = groups.where("n_shingles > 0").select(F.coalesce(doc_id, F.lit(NO_ID)).alias("id"), "cid", "group_key")
    counted = written(groups.groupBy("group_key", "id", "cid").agg(F.count("*").alias("n")), "join-counted")
    stay = counted.groupBy("group_key").agg(F.min(F.struct("id", "cid")).alias("k")).select("k.id", "k.cid")
    repeats = written(counted.where("n > 1").select(F.col("id").alias("again_id"), F.col("cid").alias("again_cid")), "join-repeats")
    body = F.coalesce(F.col(text), F.lit(""))
    has_words = F.col("_text").rlike(WORD_PATTERN)  # exactly the texts with n-grams
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
                        body.alias("_text"))
    bare = keyed.where(~has_words)
    keyed = _with_class(keyed.where(has_words), clashes, "_text")
    # Rows with the same id and text: one stays, picked in every task before the exchange.
    same = (F.col("id") == F.col("again_id")) & (F.col("cid") == F.col("again_cid"))
    once = keyed.join(repeats, same, "left_anti").join(stay, ["id", "cid"]).select("_row")
    picked = (keyed.join(repeats, same, "left_semi").groupBy("id", "cid").agg(F.first("_row").alias("_row"))
              .join(stay, ["id", "cid"]).select("_row"))
    return bare.select("_row").unionByName(once).unionByName(picked).select("_row.*")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_groups(docs, width=WIDTH, num=NUM, den=DEN).select("doc_id", "n_shingles", "component_id")
