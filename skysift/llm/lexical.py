"""Ranked lexical search of all documents for every item of a query set, exact.

A pass over the texts keeps, for each document, its length and the query terms that it holds with their counts; the
statistics (documents, terms in all, document frequencies) are counted from that written table over all documents. Then
every task searches the blocks of documents that it reads, each an inverted index of its own:

* Term at a time: the item's short lists in the block are summed into one list of accumulators, whose size is bounded
  by a quarter of the block.
* Document at a time: that list counts as one iterator, bounded by its largest sum, beside the long lists with their
  largest impacts. Iterators whose bounds together can't reach the item's k-th best score so far are only looked up:
  the others name the candidates of a window of documents, and the lists that are left are entered at these alone, from
  the largest bound to the least, as long as a candidate can still reach that score.

The k-th best scores carry over from block to block in a task, and start from what a 32nd of the documents, by hash,
reach: any k documents give a lower bound, so nothing is lost, and all tasks together return few more rows than the
answer has. A window over those ranks them.

The query set is taken in blocks of bounded size, whose terms go to every task; each block is another pass over the texts.

Defined results: a term is a maximal run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Documents
without terms (null, empty) count in no statistic and are never found. A row without an id counts and is found, after the
others of its score; rows that repeat an id are documents apart. An item without an id is none, rows that repeat an
item_id are one item, with the terms of all; an item without terms finds nothing. Only scores above 0 are returned. Texts
of any length are read whole. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skysift.llm.common import ascii_lower, let_workers_import, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A block of the query set holds items up to so many bytes of terms, or one item.
ITEM_BYTES = 16 << 20
#: Short lists are those that together hold at most this part of a block's documents; a window is so many documents.
SHORT, WINDOW = 4, 2048
#: First scores come from one document in so many.
FIRST = 32
POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
#: A-Z to a-z, and every other ASCII character that is neither letter nor digit to a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, with repeats."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item_id, term)."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), F.lit(0))
    return items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.explode(found).alias("term")).distinct()


def _postings(numbers: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, held = [], []
                for text in part.column(1).to_pylist():
                    words = terms(text)
                    n.append(len(words))
                    found = Counter(map(numbers.get, words))
                    found.pop(None, None)
                    held.append(found)
                lists = lambda side: pa.array([list(side(x)) for x in held], pa.list_(pa.int32()))
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), lists(Counter.keys), lists(Counter.values)], names=["doc_id", "n", "terms", "counts"])

    return run


class Best:
    """The k best documents of an item so far: scores, and ids as pairs of (there is none, id)."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(1, least)
        self.scores, self.none, self.ids = np.zeros(0, "int64"), np.zeros(0, bool), np.zeros(0, "int64")

    def add(self, scores: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        scores, none, ids = np.append(self.scores, scores), np.append(self.none, none), np.append(self.ids, ids)
        best = np.lexsort((ids, none, -scores))[: self.k]
        self.scores, self.none, self.ids = scores[best], none[best], ids[best]
        if len(best) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


class Block:
    """Inverted index of a block of documents: for each term the documents in order, their impacts and the largest of these."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray, m: np.ndarray, weight: np.ndarray):
        impact = weight[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m[doc]))
        order = np.argsort(term, kind="stable")
        order = order[impact[order] > 0]
        self.size, self.doc, self.impact, term = len(m), doc[order], impact[order], term[order]
        self.starts = np.searchsorted(term, np.arange(len(weight) + 1))
        there = np.flatnonzero(np.diff(self.starts))
        self.most = np.zeros(len(weight), "int64")
        if len(there):
            self.most[there] = np.maximum.reduceat(self.impact, self.starts[there])

    def accumulated(self, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents in the short lists, in order, and the sums of their impacts."""
        places = np.concatenate([np.arange(self.starts[t], self.starts[t + 1]) for t in short])
        docs, at = np.unique(self.doc[places], return_inverse=True)
        sums = np.zeros(len(docs), "int64")
        np.add.at(sums, at, self.impact[places])
        return docs, sums

    def search(self, item: np.ndarray, best: Best, none: np.ndarray, ids: np.ndarray) -> int:
        """Bring the k best of an item, given by its terms, up to date; returns how many postings of long lists were entered."""
        sizes = self.starts[item + 1] - self.starts[item]
        item = item[sizes > 0][np.argsort(sizes[sizes > 0], kind="stable")]
        n_short = int(np.searchsorted(np.cumsum(self.starts[item + 1] - self.starts[item]), self.size // SHORT, "right"))
        lists = [(self.doc[s:e], self.impact[s:e], int(self.most[t])) for t in item[n_short:] for s, e in [self.starts[t : t + 2]]]
        if n_short:
            docs, sums = self.accumulated(item[:n_short])
            lists.append((docs, sums, int(sums.max())))
        lists.sort(key=lambda x: x[2])
        below = np.cumsum([0, *(x[2] for x in lists)])  # below[i]: what the lists before the i-th can add
        entered = 0
        for low in range(0, self.size, WINDOW):
            high = min(low + WINDOW, self.size)
            # lists that can't reach the k-th best score even together name no candidates
            first = int(np.searchsorted(below[1:], best.least, "left"))
            if first == len(lists):
                break
            got = np.zeros(high - low, "int64")
            for docs, impact, _ in lists[first:]:
                s, e = np.searchsorted(docs, (low, high))
                got[docs[s:e] - low] += impact[s:e]
                entered += e - s
            may = np.flatnonzero(got)
            for i in range(first - 1, -1, -1):
                may = may[got[may] + below[i + 1] >= best.least]
                if not len(may):
                    break
                docs, impact, _ = lists[i]
                at = np.minimum(np.searchsorted(docs, may + low), len(docs) - 1)
                hit = docs[at] == may + low
                got[may[hit]] += impact[at[hit]]
                entered += len(may)
            may = may[got[may] >= best.least]
            if len(may):
                best.add(got[may], none[may + low], ids[may + low])
        return entered


def _search(items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, least: list[int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, x) for x in least]
        for batch in batches:
            batch = batch.filter(pa.compute.greater(batch.column(1), 0))
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype("int64")
            term, count = (np.asarray(batch.column(i).flatten(), "int64") for i in (2, 3))
            n = batch.column(1).to_numpy(zero_copy_only=False)
            block = Block(np.repeat(np.arange(len(sizes)), sizes), term, count, 50 + (50 * n * n_docs) // n_terms, weight)
            none = np.asarray(batch.column(0).is_null())
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for item, found in zip(items, best):
                block.search(item, found, none, ids)
        for at, found in enumerate(best):
            if len(found.scores):
                ids = pa.array(found.ids, pa.int64(), mask=found.none)
                yield pa.record_batch([pa.array([at] * len(ids), pa.int32()), ids, pa.array(found.scores)], names=["at", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, by: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores for each item."""
    spark = docs.sparkSession
    let_workers_import(spark)
    asked = written(item_terms(items))
    size = asked.agg(F.sum(F.length("term") * 4 + 16)).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = [_search_block(docs, asked.filter(block == b), k, doc_id, text) for b in range(blocks)]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _search_block(docs: DataFrame, asked: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    rows = asked.collect()  # bounded by ITEM_BYTES, or one item
    names = list(dict.fromkeys(r.item_id for r in rows))
    words = list(dict.fromkeys(r.term for r in rows))
    place, number = {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(words)}
    of: list[list[int]] = [[] for _ in names]
    for r in rows:
        of[place[r.item_id]].append(number[r.term])
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    postings = written(plain.mapInArrow(_postings({x.encode("utf-8", "surrogatepass"): i for x, i in number.items()}), POSTINGS))
    n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(words), "int64")
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        weight[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
    asks = [np.array(x, "int64") for x in of]
    run = lambda part, least: part.mapInArrow(_search(asks, weight, n_docs, n_terms, least, k), "at int, doc_id long, score long")
    some = postings.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0)
    first = _ranked(run(some, [1] * len(names)), "at", k).filter(F.col("rank") == k).select("at", "score").collect()
    scores = {r.at: r.score for r in first}
    best = _ranked(run(postings, [scores.get(i, 1) for i in range(len(names))]), "at", k)
    key = spark.createDataFrame(list(enumerate(names)), f"at int, item_id {asked.schema['item_id'].dataType.simpleString()}")
    return best.join(F.broadcast(key), "at").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
