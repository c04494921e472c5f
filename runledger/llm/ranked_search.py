"""Ranked lexical search: each item's best documents by integer term weights, scored window by window.

The documents are read twice, whole. The first reading splits every text into terms and keeps, beside each document's
length, the terms that some item asks for and how often they occur; it gives the counts over all documents. The second
walks these postings, each task over the documents it reads, in windows of WINDOW documents by ascending doc_id: postings
of a window are regrouped by term, and for each item every term's list is scattered into one array of scores that fits in a
core's cache. A bitset over stretches of the array says which were touched; only those are harvested, into a heap of the
item's best, and cleared. Scores of different documents do not depend on one another, so no document is shuffled; what
tasks hand on is k rows at most for an item.

Items are taken in blocks of BLOCK_BYTES of distinct terms, each sent to all tasks and matched against all documents;
an item longer than that is a block of its own. There is one block where all the items' terms fit.

Terms are the maximal runs of letters, digits and characters beyond ASCII; only A to Z are folded. All counts and scores are
64-bit integers, but a length times the number of documents, which is taken in 38 digits.

Defined cases: null text has no term and is no document of the counts; each row is a document, so rows that share a
doc_id are ranked each; a null doc_id comes last among equal scores; rows that share an item_id are one item with
the terms of all; an item without terms, and any item where no document holds a term, has no result; empty tables give an
empty result; other columns are never read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import drop, materialise, small_batches, text_bytes

#: Documents of a window: an array of as many 64-bit scores takes 256 KB.
WINDOW = 1 << 15
#: Scores that share a bit of the bitset.
STRETCH = 64
#: Bytes of distinct terms, by item, that are sent to all tasks at once.
BLOCK_BYTES = 16 << 20
#: Bytes of a text that are split into terms at a time.
PIECE = 1 << 20

_LETTERS = bytes(range(ord("a"), ord("z") + 1))
_KEPT = bytes(range(ord("0"), ord("9") + 1)) + _LETTERS.upper() + _LETTERS + bytes(range(128, 256))
_FOLD = bytes((c + 32 if c in _LETTERS.upper() else c) if c in _KEPT else 32 for c in range(256))


def terms(text: bytes):
    """Lists of terms of a UTF-8 text, piece by piece; pieces end between terms."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = at + PIECE
        if end < len(folded):
            end = folded.find(b" ", end)
            end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per item: item_id, terms (distinct, sorted), of items that have a term."""

    def split(batches):
        for batch in batches:
            found = [sorted({w for piece in terms(t.as_py()) for w in piece}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), text_bytes(text_col).alias("t")).mapInArrow(split, "item_id long, terms array<binary>")
    return rows.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def _postings(docs: DataFrame, words: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """One row per document that has a term: doc_id, n (its terms with repeats), held (places in words) and tf, in the order of held."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        place = {w: i for i, w in enumerate(sent.value)}
        for batch in batches:
            ids, ns, held, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, counts = 0, Counter()
                for piece in terms(text.as_py()):
                    n += len(piece)
                    counts.update(filter(place.__contains__, piece))
                if n:
                    own = sorted((place[w], tf) for w, tf in counts.items())
                    ids.append(doc_id), ns.append(n), held.append([i for i, _ in own]), tfs.append([tf for _, tf in own])
            arrays = [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "held", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("t"))
    return rows.mapInArrow(count, "doc_id long, n long, held array<int>, tf array<long>")


def weight(docs: Column, df: Column) -> Column:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return F.floor(F.lit(1000) * F.log((2 * docs + 2).cast("double") / (2 * df + 1).cast("double")))


def length_part(n: Column, docs: int, terms_in_all: int) -> Column:
    """100 - 90 + ((90 n N) div L)."""
    wide = F.lit(90).cast("decimal(38,0)") * n.cast("decimal(18,0)") * F.lit(docs).cast("decimal(18,0)")
    return F.call_function("div", wide, F.lit(terms_in_all).cast("decimal(18,0)")).cast("long") + 10


class WindowScorer:
    """The best k documents of each item, over the windows given to it."""

    def __init__(self, asked: list[list[int]], weights: np.ndarray, k: int):
        self.asked, self.weights, self.k = asked, weights, k
        self.best: list[list[tuple]] = [[] for _ in asked]
        self.scores = np.zeros(WINDOW, np.int64)
        self.touched = np.zeros(WINDOW // STRETCH, bool)

    def window(self, ids: list, m: np.ndarray, offsets: np.ndarray, held: np.ndarray, tf: np.ndarray) -> None:
        """ids: doc_ids of at most WINDOW documents; document i holds held[offsets[i]:offsets[i + 1]], tf times each."""
        slot = np.repeat(np.arange(len(ids)), np.diff(offsets))
        gain = self.weights[held] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[slot]))
        by_term = np.argsort(held, kind="stable")
        held, slot, gain = held[by_term], slot[by_term], gain[by_term]
        if not len(held):
            return
        present, first = np.unique(held, return_index=True)
        lists = dict(zip(present.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(held)], strict=True), strict=True))
        for item, asked in enumerate(self.asked):
            for term in asked:
                if at := lists.get(term):
                    into = slot[at[0] : at[1]]
                    self.scores[into] += gain[at[0] : at[1]]
                    self.touched[into // STRETCH] = True
            self._harvest(item, ids)

    def _harvest(self, item: int, ids: list) -> None:
        stretches = np.flatnonzero(self.touched)
        if not len(stretches):
            return
        scores, best = self.scores.reshape(-1, STRETCH), self.best[item]
        found = scores[stretches]
        # A document that ties with the kth may have the smaller doc_id.
        least = max(1, best[0][0] if len(best) == self.k else 1)
        if np.count_nonzero(found >= least) > self.k:
            least = max(least, int(np.partition(found, found.size - self.k, axis=None)[found.size - self.k]))
        rows, columns = np.nonzero(found >= least)
        for score, i in zip(found[rows, columns].tolist(), (stretches[rows] * STRETCH + columns).tolist(), strict=True):
            doc_id = ids[i]
            one = (score, doc_id is not None, -(doc_id or 0))
            if len(best) < self.k:
                heapq.heappush(best, one)
            elif one > best[0]:
                heapq.heapreplace(best, one)
        scores[stretches] = 0
        self.touched[stretches] = False


def _windows(batches):
    """Documents of a task in windows: ids, m, offsets, held, tf."""
    waiting, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, WINDOW - n)
            waiting.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == WINDOW:
                yield _window(waiting)
                waiting, n = [], 0
    if n:
        yield _window(waiting)


def _window(parts):
    table = pa.Table.from_batches(parts).combine_chunks()
    lists = [pa.concat_arrays(table.column(c).chunks) if table.column(c).num_chunks != 1 else table.column(c).chunk(0) for c in ("held", "tf")]
    offsets = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))])
    return table.column("doc_id").to_pylist(), table.column("m").to_numpy(), offsets, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy()


def _blocks(asked: DataFrame):
    """Lists of items of BLOCK_BYTES of terms at most, or of one item; one empty list where there are no items. The driver holds a block and a part of the table."""
    block, size = [], 0
    for row in asked.orderBy("item_id").toLocalIterator():
        own = sum(len(w) + 8 for w in row["terms"])
        if block and size + own > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(row)
        size += own
    yield block


def _ranked_block(docs: DataFrame, items: list, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    words = sorted({w for row in items for w in row["terms"]})
    place = {w: i for i, w in enumerate(words)}
    asked = [[place[w] for w in row["terms"]] for row in items]
    postings = materialise(_postings(docs, words, id_col, text_col), "postings")
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(words), np.int64)
    # As many rows at most as the block has terms.
    for row in postings.select(F.explode("held").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", weight(F.lit(n_docs), F.col("df")).alias("w")).collect():
        weights[row["term"]] = row["w"]
    sent = spark.sparkContext.broadcast(([row["item_id"] for row in items], asked, weights))

    def score(batches):
        names, asked_, weights_ = sent.value
        scorer = WindowScorer(asked_, weights_, k)
        for window in _windows(batches):
            scorer.window(*window)
        out = [(i, score, -minus if known else None) for i, best in zip(names, scorer.best, strict=True) for score, known, minus in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["item_id", "score", "doc_id"])

    rows = postings.select("doc_id", length_part(F.col("n"), n_docs, max(1, n_terms)).alias("m"), "held", "tf").sortWithinPartitions("doc_id")
    found = rows.mapInArrow(score, "item_id long, score long, doc_id long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = materialise(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked")
    drop(postings)
    return best.select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of highest score above 0 for each item, equal scores by ascending doc_id."""
    small_batches(docs.sparkSession)
    asked = materialise(_item_terms(items, item_id, item_text), "items")
    parts = [_ranked_block(docs, block, k, doc_id, doc_text) for block in _blocks(asked)]
    return reduce(DataFrame.unionByName, parts)
