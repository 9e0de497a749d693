"""Best-fit packing of documents into sequences of a fixed length, improved by swap-based local search.

Documents over the length are cut into full pieces, which are sequences by themselves. All other pieces are
dealt by a hash into groups of about GROUP_PIECES, each packed in one task: best-fit decreasing first, then
local search over the bins that are not full. It moves a piece, exchanges one piece for another, or two for
one (either way), whenever the fuller of two bins gains by it, which increases the sum of squared fills, so
that fill gathers in some bins while others run empty and are dropped; it ends when no such step is left
between any two bins. Bins that stay underfull in their group are opened again, and their pieces are packed
together with those of other groups in a second round, so that small leftovers meet; the number of pieces
per task stays bounded however large the table is.

Defined results: a null text is an empty document and holds only the end id. Repeated rows are packed apart.
Ties between pieces of equal length go to the smaller doc_id, and an empty table gives no sequences. Other
columns of the table, whatever their names, are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import let_workers_import, written
from skysift.llm.tokens import encoder

GROUP_PIECES = 20_000
#: Bins at least so full are left alone by the second round.
FULL_ENOUGH = 0.98

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long, full long"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that has room for it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    open_rooms = 0  # bit r is set if some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if r - n:
            room[r - n].append(b)
            open_rooms |= 1 << (r - n)
    return bins


class _Bins:
    """Underfull bins with an index of what each of them could give: its items by size, and its pairs by sum.

    The sizes and sums that occur are bits of an integer, so that the largest one in a range is found at once.
    """

    def __init__(self, bins: list[list[int]], size: list[int], capacity: int):
        self.bins, self.size, self.capacity = bins, size, capacity
        self.fill = [sum(size[i] for i in b) for b in bins]
        self.holders: tuple[dict[int, set[int]], dict[int, set[int]]] = ({}, {})
        self.bits = [0, 0]

    def _gifts(self, b: int) -> tuple[set[int], set[int]]:
        count = Counter(self.size[i] for i in self.bins[b])
        sizes = sorted(count)
        pairs = {x + y for k, x in enumerate(sizes) for y in sizes[k + 1 :] if x + y <= self.capacity}
        return set(sizes), pairs | {2 * x for x, n in count.items() if n > 1 and 2 * x <= self.capacity}

    def offer(self, b: int) -> None:
        for kind, some in enumerate(self._gifts(b)):
            for s in some:
                self.holders[kind].setdefault(s, set()).add(b)
                self.bits[kind] |= 1 << s

    def withdraw(self, b: int) -> None:
        for kind, some in enumerate(self._gifts(b)):
            for s in some:
                self.holders[kind][s].discard(b)
                if not self.holders[kind][s]:
                    self.bits[kind] &= ~(1 << s)

    def _largest(self, kind: int, low: int, high: int) -> int:
        """The largest size or sum on offer in (low, high], or 0."""
        found = self.bits[kind] & ((1 << (high + 1)) - 1)
        top = found.bit_length() - 1
        return top if top > low else 0

    def step(self, a: int) -> int | None:
        """Move or exchange one item for one, two for one or one for two, so that bin a gains as much as it can from a bin that is on offer. Returns that bin."""
        room = self.capacity - self.fill[a]
        if room <= 0:
            return None
        given, pairs = self._gifts(a)
        best, plan = 0, None
        for kind in (0, 1):
            for out_kind, outs in ((0, {0} | given), (1, pairs if kind == 0 else ())):
                for out in outs:
                    got = self._largest(kind, out + best, min(out + room, self.capacity))
                    if got:
                        best, plan = got - out, (kind, got, out_kind, out)
        if plan is None:
            return None
        kind, got, out_kind, out = plan
        b = min(self.holders[kind][got])
        self.withdraw(b)
        taken, left = self._pick(b, kind, got), self._pick(a, out_kind, out) if out else []
        self.bins[b] = [i for i in self.bins[b] if i not in taken] + left
        self.bins[a] = [i for i in self.bins[a] if i not in left] + taken
        self.fill[a] += best
        self.fill[b] -= best
        return b

    def _pick(self, b: int, kind: int, total: int) -> list[int]:
        """Items of a bin with that size or sum."""
        if kind == 0:
            return [next(i for i in self.bins[b] if self.size[i] == total)]
        seen: dict[int, int] = {}
        for i in self.bins[b]:
            if total - self.size[i] in seen:
                return [seen[total - self.size[i]], i]
            seen.setdefault(self.size[i], i)
        raise AssertionError("no such pair")


def local_search(bins: list[list[int]], size: list[int], capacity: int) -> list[list[int]]:
    """Move and exchange items between underfull bins until no step helps.

    In each pass the fullest bin that is left takes its turn and gains from the less full ones as long as it
    can, which always increases the sum of squared fills. Passes go on until one of them finds no step; as the
    sum is a bounded integer that every step increases, the search ends.
    """
    full = [b for b in bins if sum(size[i] for i in b) == capacity]
    left = [list(b) for b in bins if b and sum(size[i] for i in b) < capacity]
    changed = True
    while changed:
        changed = False
        under = _Bins(left, size, capacity)
        for b in range(len(left)):
            under.offer(b)
        turns = [(-f, b) for b, f in enumerate(under.fill)]
        heapify(turns)
        while turns:
            fill, a = heappop(turns)
            if -fill != under.fill[a] or not under.bins[a]:  # it has given something since: it stands further back
                continue
            under.withdraw(a)
            while (b := under.step(a)) is not None:
                changed = True
                if under.bins[b]:
                    under.offer(b)
                    heappush(turns, (-under.fill[b], b))
        left = [b for b in under.bins if b]
    return full + left


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers."""
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Pieces of every document: (doc_id, copy, piece, start, length, ids_crc32, full).

    copy tells repeated rows apart (a column of row numbers, if one is named); full numbers the pieces of full length, below zero, and is NULL for others.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        full = -1 - (TaskContext.get().partitionId() << 40)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows: list[tuple] = []
                for doc, copy, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), enc.encode(part.column(1))):
                    whole = ids + end
                    for p, a in enumerate(range(0, len(whole), 4 * capacity)):
                        piece = whole[a : a + 4 * capacity]
                        number = full if len(piece) == 4 * capacity else None
                        full -= number is not None
                        rows.append((doc, copy, p, a // 4, len(piece) // 4, zlib.crc32(piece), number))
                names = ["doc_id", "copy", "piece", "start", "length", "ids_crc32", "full"]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    let_workers_import(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.monotonically_increasing_id() if row is None else F.col(row).cast("long")).alias("copy")).mapInArrow(run, PIECES)


def _pack_groups(pieces: DataFrame, n_groups: int, capacity: int, seed: int) -> DataFrame:
    """Pack each of n_groups hash groups: adds bin (group and number in it), offset and fill."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "copy"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].tolist()
        bins, offsets, fills = np.zeros(len(pdf), "int64"), np.zeros(len(pdf), "int64"), np.zeros(len(pdf), "int64")
        for b, items in enumerate(pack(lengths, capacity)):
            at = 0
            for i in items:
                bins[i], offsets[i] = b, at
                at += lengths[i]
            fills[items] = at
        return pdf.assign(bin=bins, offset=offsets, fill=fills)

    let_workers_import(pieces.sparkSession)
    group = F.pmod(F.xxhash64("doc_id", "piece", "copy", F.lit(seed)), F.lit(n_groups))
    schema = f"group_id long, {PIECES}, bin long, offset long, fill long"
    return pieces.select(group.alias("group_id"), *[c.split()[0] for c in PIECES.split(", ")]).groupBy("group_id").applyInPandas(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Place pieces (as of cut()): adds sequence_id and offset. Runs over a written table."""
    columns = [c.split()[0] for c in PIECES.split(", ")]
    rest = pieces.filter(F.col("length") < capacity)
    full = pieces.filter(F.col("length") >= capacity).select(*columns, F.col("full").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    n_groups = max(1, -(-rest.count() // group_pieces))
    first = _pack_groups(rest, n_groups, capacity, 1)
    # any numbers will do for sequences: round, group and bin as one integer
    place = lambda r: (F.lit(r << 61) + F.col("group_id") * F.lit(1 << 21) + F.col("bin")).alias("sequence_id")
    if n_groups == 1:
        packed = first.select(*columns, place(0), "offset")
    else:
        first = written(first)
        loose = first.filter(F.col("fill") < FULL_ENOUGH * capacity)
        again = max(1, -(-loose.count() // group_pieces))
        second = _pack_groups(loose, again, capacity, 2)
        packed = first.filter(F.col("fill") >= FULL_ENOUGH * capacity).select(*columns, place(0), "offset").union(second.select(*columns, place(1), "offset"))
    return full.union(packed).drop("full")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Tokenize, cut and pack whole documents; one row for each piece."""
    return pack_pieces(written(cut(docs, vocabulary, end_id, capacity, doc_id, text, row)), capacity)


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, end_id: int, row: str = "copy", text: str = "text") -> DataFrame:
    """The packed sequences with their ids: (sequence_id, ids), pieces in offset order.

    ``row`` numbers the rows of ``docs`` and is the copy column of ``placed``: see pack_documents().
    """
    from skysift.llm.token_store import tokenize

    ids = tokenize(docs, vocabulary, end_id, row, text).select(F.col("doc_id").alias("copy"), "ids").join(placed.select("copy", "start", "length", "sequence_id", "offset"), "copy")
    piece = ids.select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    return piece.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x.ids)).alias("ids"))
