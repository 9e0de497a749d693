"""MinHash near-duplicate groups from bottom-k sketches.

One hash function is applied to a document's word shingles; its sketch is the k smallest values. Documents
with equal shingle sets form one class first, so exact copies cost one row each. Inverted lists of retained
values generate overlaps: two sets with a Jaccard similarity of 0.8 share, but for a chance of about one in a
million, at least OVERLAP of SKETCH retained values, so that by the prefix principle they meet in the list of
one of their rarest values; the most frequent values of each sketch need no list. Pairs from a list stay if the
estimate from the sketch of their union can be right. Exact Jaccard on the full sets then confirms.

Long lists are not paired out: each member is first compared with the list's hub (the member whose
values are the most frequent), then only members outside the hub's component are compared with the
others, as far as they aren't connected already. No list or partner is capped and no link between two
components is lost. Links become groups by components().

The most frequent values (HEAVY_VALUES of them at most, by the choice of their threshold) meet their members by
broadcast joins, so that a value that very many documents hold isn't one task.

Defined results: a document with fewer words than a shingle is its whole sequence; one without words (null,
empty) has an empty set and is linked with nothing. Repeated rows are copies; texts of any length are read
whole. Components are named by their least doc_id (nulls count last); where no row of a component has an id,
component_id is null and its first row is the one that is kept. Other columns, whatever their names, are left
out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import let_workers_import, written
from skysift.llm.components import components

SKETCH, OVERLAP = 32, 14
#: Longer lists are handled by hubs.
LONG_LIST = 48
#: At most so many values have more than an equal share of all retained values' rows; their tables are broadcast.
HEAVY_VALUES = 50_000
CACHE_WORDS = 200_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text, A-Z lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, "uint64")
    h = np.fromiter(map(_WORDS.__getitem__, found), "uint64", len(found))
    width = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, "uint64")
        for i in range(width):
            out = _mixed(out * _GOLDEN + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def _sketch_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(t, words) for t in part.column(3).to_pylist()]
                yield pa.record_batch(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([s[:SKETCH].view("int64") for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["rid", "doc_id", "mark", "n", "print", "sketch"],
                )

    return run


def _set_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(t, words) for t in part.column(2).to_pylist()]
                same = [xxhash.xxh3_128_digest(s.tobytes()) == p for s, p in zip(sets, part.column(1).to_pylist())]
                yield pa.record_batch([part.column(0).filter(pa.array(same)), pa.array([s.view("int64") for s, ok in zip(sets, same) if ok], pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _high(values: Column) -> Column:
    """The upper halves of retained values, in the same order: enough to compare sketches."""
    return F.transform(values, lambda v: (F.shiftrightunsigned(v, 32) - F.lit(1 << 31)).cast("int"))


def _needed(n: Column) -> Column:
    """Retained values that a set of n shingles shares at least with any set at 0.8 or more."""
    return F.when(n * 5 <= SKETCH * 4, F.ceil(n * 4 / 5)).when(n <= SKETCH, F.lit(SKETCH * 5 // 8)).otherwise(F.lit(OVERLAP)).cast("int")


def _likely(a: str, b: str) -> Column:
    """Whether the two sets (structs with node, n and sk) may be alike: by their sizes and shared retained values."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = (n * 5 >= m * 4) & (m * 5 >= n * 4)
    shared = F.size(F.array_intersect(f"{a}.sk", f"{b}.sk"))
    return sizes & F.when(sizes, shared >= F.least(_needed(n), _needed(m))).otherwise(False)


def _estimated(a: str, b: str) -> Column:
    """Whether the estimate from the sketch of the union leaves room for a similarity of 0.8."""
    union = F.slice(F.array_sort(F.array_union(f"{a}.sk", f"{b}.sk")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(f"{a}.sk", f"{b}.sk"), union))
    return shared * 100 >= F.size(union) * (100 * OVERLAP // SKETCH)


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b), a < b, with the frequency weights of both."""
    x, y = F.struct(f"{a}.node", f"{a}.hub"), F.struct(f"{b}.node", f"{b}.hub")
    return rows.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct().select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.hub").alias("ha"), F.col("y.hub").alias("hb"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(a, "a").join(b, "b")
    return joined.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum")).filter(F.col("both") * 100 >= (F.col("sum") - F.col("both")) * percent).select("a", "b")


def _with_root(df: DataFrame, roots: DataFrame, node: Column, name: str) -> DataFrame:
    r = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return df.join(r, node == F.col("_node"), "left").withColumn(name, F.coalesce("_root", node)).drop("_node", "_root")


def row_groups(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, first), one row for each row of ``docs``.

    rid is the column ``row``, if one is named; first is true for one row of each component, that of the
    least doc_id (nulls last) and rid.
    """
    if percent < 80:
        raise ValueError("the sketches are laid out for similarities of 0.8 or more")
    let_workers_import(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    number = F.monotonically_increasing_id() if row is None else F.col(row).cast("long")
    rows = docs.select(number.alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    rows = written(rows.mapInArrow(_sketch_batches(words), "rid long, doc_id long, mark long, n long, print binary, sketch array<long>"))

    # classes of equal sets; a class is called by its first row
    least = F.min(F.struct("rid", "doc_id", "mark", "n", "sketch"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    classes = rows.filter(F.col("print").isNotNull()).groupBy("print").agg(least.alias("c"), F.min(place).alias("place"))
    classes = written(classes.select("print", "place", F.col("c.rid").alias("node"), F.col("c.doc_id").alias("doc_id"), F.col("c.mark").alias("mark"), F.col("c.n").alias("n"), F.col("c.sketch").alias("sketch")))

    roots = written(_links(plain, classes, words, percent))  # (node, root)
    named = _with_root(classes.select("print", "place", "node"), roots, F.col("node"), "root")
    firsts = named.groupBy("root").agg(F.min("place").alias("place"))
    of_print = named.select("print", "root").join(firsts, "root").select("print", F.col("place.doc_id").alias("component_id"), F.col("place.rid").alias("first_rid"))
    out = rows.select("rid", "doc_id", F.col("n").alias("n_shingles"), "print").join(of_print, "print", "left")
    alone = F.col("first_rid").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("rid", "doc_id", "n_shingles", component.alias("component_id"), (alone | (F.col("rid") == F.col("first_rid"))).alias("first"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    groups = row_groups(docs, words, percent, doc_id, text)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & F.col("first"))
    return groups.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _with_counts(values: DataFrame, counts: DataFrame, heavy: int) -> DataFrame:
    """(node, v) with df of each value; values held by more than ``heavy`` sets stay where they are."""
    top = counts.filter(F.col("df") > heavy)
    marked = values.join(F.broadcast(top), "v", "left")
    return marked.filter("df IS NOT NULL").select("node", "v", "df").union(marked.filter("df IS NULL").select("node", "v").join(counts.filter(F.col("df") <= heavy), "v").select("node", "v", "df"))


def _with_list(rows: DataFrame, lists: DataFrame, heavy: int) -> DataFrame:
    """Rows with v and df joined with a table of one row for each long list (v, df and others)."""
    top, rest = lists.filter(F.col("df") > heavy).drop("df"), lists.filter(F.col("df") <= heavy).drop("df")
    return rows.filter(F.col("df") > heavy).join(F.broadcast(top), "v").unionByName(rows.filter(F.col("df") <= heavy).join(rest, "v"))


def _links(plain: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) of all classes that are linked with others."""
    # retained values in order of their frequency among sketches; a value of one sketch leads to nobody
    values = classes.select("node", F.explode("sketch").alias("v"))
    heavy = max(LONG_LIST, (classes.agg(F.sum(F.size("sketch"))).first()[0] or 0) // HEAVY_VALUES)
    counts = written(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    shared = _with_counts(values, counts, heavy).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    lists = classes.select("node", "doc_id", "mark", "print", "n", "sketch").join(shared, "node")
    length = F.size("sketch") - _needed(F.col("n")) + 1 - (F.size("sketch") - F.size("vs"))
    hub = F.aggregate("vs", F.lit(0.0), lambda s, x: s + F.log2(x.df.cast("double")))
    lists = written(lists.filter(length > 0).select("doc_id", "mark", "print", F.struct("node", hub.alias("hub"), "n", _high(F.col("sketch")).alias("sk")).alias("m"), F.slice("vs", 1, length).alias("vs")))

    entries = lists.select("m", F.explode("vs").alias("e")).select("m", "e.df", "e.v")
    # short lists: all their pairs
    short = entries.filter(F.col("df") <= LONG_LIST).groupBy("v").agg(F.collect_list("m").alias("ms")).filter(F.size("ms") > 1)
    short = short.select("ms", F.explode("ms").alias("x"))
    short = short.select("x", F.explode(F.filter("ms", lambda y: y.node > F.col("x.node"))).alias("y")).filter(_likely("x", "y") & _estimated("x", "y"))
    # long lists: each member with the hub
    long = entries.filter(F.col("df") > LONG_LIST)
    hubs = written(long.groupBy("v").agg(F.max_by("m", F.struct(F.col("m.hub"), -F.col("m.node"))).alias("h"), F.max("df").alias("df")))
    starred = _with_list(long, hubs, heavy).filter(F.col("m.node") != F.col("h.node")).filter(_likely("m", "h") & _estimated("m", "h"))
    pairs = written(_pairs(short, "x", "y").withColumn("star", F.lit(False)).union(_pairs(starred, "m", "h").withColumn("star", F.lit(True))))

    # first one pair of each document, with its most frequent partner, and the hubs' stars
    ends = pairs.select(F.col("a").alias("u"), "b", "a", "hb").union(pairs.select(F.col("b").alias("u"), "b", "a", F.col("ha")))
    first = ends.groupBy("u").agg(F.max_by(F.struct("a", "b"), F.struct("hb", "a", "b")).alias("p")).select("p.a", "p.b")
    first = written(first.union(pairs.filter("star").select("a", "b")).distinct())
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = written(_sets(lists, nodes, plain, words), {"compression": "none"})
    roots = components(_verified(first, sets, percent))

    # then every other pair whose ends aren't connected yet
    open_ = _with_root(_with_root(pairs.select("a", "b").distinct().join(first, ["a", "b"], "left_anti"), roots, F.col("a"), "ra"), roots, F.col("b"), "rb")
    open_ = open_.filter("ra <> rb").select("a", "b")
    first_links = _verified(written(open_.distinct()), sets, percent)
    # and members of long lists outside of their hub's component, against the whole list
    prefixes = lists.select("m", F.transform("vs", lambda e: e.v).alias("pre"), "vs")
    members = _with_root(prefixes.select("m", "pre", F.explode(F.filter("vs", lambda e: e.df > LONG_LIST)).alias("e")).select("m", "pre", "e.v", "e.df"), roots, F.col("m.node"), "root")
    tops = _with_root(hubs, roots, F.col("h.node"), "top").select("v", "df", "top")
    members = _with_list(members, tops, heavy).select("v", "df", "m.node", "m.n", "m.sk", "pre", "root", (F.col("root") != F.col("top")).alias("outer"))
    sizes = written(members.groupBy("v", "df").agg(F.count_if("outer").alias("n_outer"), F.count(F.lit(1)).alias("n_all")).filter("n_outer > 0"))
    members = written(_with_list(members, sizes, heavy).drop("df"))
    if members.isEmpty():
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(first_links))
    schema = "a long, b long"
    met = written(_in_blocks(members, _meet(percent, False), schema).distinct())
    nodes = written(met.select(F.col("a").alias("node")).union(met.select("b")).distinct())
    sets = _more_sets(sets, nodes, lists, plain, words)
    full = members.join(nodes, "node", "left_semi").join(sets, "node")
    links = _in_blocks(full, _meet(percent, True), schema).distinct()
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(first_links).union(links))


OUTER_BLOCK, INNER_BLOCK = 512, 1024


def _in_blocks(members: DataFrame, meet, schema: str) -> DataFrame:
    """Meet the outer members of each list with all of its members, in blocks of bounded size."""
    outer_blocks = F.ceil(F.col("n_outer") / OUTER_BLOCK).cast("int")
    inner_blocks = F.ceil(F.col("n_all") / INNER_BLOCK).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    rest = [x for x in members.columns if x not in ("outer", "n_outer", "n_all")]
    outer = members.filter("outer").select(*rest, mine(outer_blocks, 1).alias("ob"), every(inner_blocks).alias("ib"))
    inner = members.select(*rest, every(outer_blocks).alias("ob"), mine(inner_blocks, 2).alias("ib"))
    inner = inner.select(*[F.col(x).alias(x) for x in inner.columns])
    return outer.groupBy("v", "ob", "ib").cogroup(inner.groupBy("v", "ob", "ib")).applyInPandas(meet, schema)


class _Rows:
    """Ragged integer lists as codes of a shared vocabulary."""

    def __init__(self, lists: list[np.ndarray]):
        self.starts = np.cumsum([0, *(len(x) for x in lists)])
        self.values, self.codes = np.unique(np.concatenate([*lists, np.zeros(0, "int64")]).astype("int64"), return_inverse=True)
        self.flags = np.zeros(len(self.values), bool)

    def mark(self, some: np.ndarray) -> np.ndarray:
        """For every entry of the lists, whether it is one of the given values."""
        at = np.searchsorted(self.values, some)
        at = at[(at < len(self.values)) & (self.values[np.minimum(at, len(self.values) - 1)] == some)]
        self.flags[:] = False
        self.flags[at] = True
        return self.flags[self.codes]

    def shared(self, some: np.ndarray) -> np.ndarray:
        """How many values each list shares with the given ones."""
        sums = np.cumsum(np.concatenate([[0], self.mark(some)]))
        return sums[self.starts[1:]] - sums[self.starts[:-1]]


def _meet(percent: int, full: bool):
    """For two blocks of a list: with full sets the links found, one for each node and foreign component; else pairs that name all nodes that may have links."""

    def needed(n: np.ndarray) -> np.ndarray:
        return np.where(n * 5 <= SKETCH * 4, -(-n * 4 // 5), np.where(n <= SKETCH, SKETCH * 5 // 8, OVERLAP))

    def run(key: tuple, outer: pd.DataFrame, inner: pd.DataFrame) -> pd.DataFrame:
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if len(outer) and len(inner):
            nodes, roots, n = (inner[x].to_numpy() for x in ("node", "root", "n"))
            prefixes, sketches = _Rows(list(inner["pre"])), _Rows(list(inner["sk"]))
            sets = _Rows(list(inner["shingles"])) if full else None
            need, place = needed(n), np.arange(len(prefixes.codes))
            for x in outer.itertuples():
                # a pair belongs to the list of the first value that both prefixes hold
                hit = np.where(prefixes.mark(x.pre), place, len(place))
                first = np.minimum.reduceat(np.append(hit, len(place)), prefixes.starts[:-1])
                may = (first < prefixes.starts[1:]) & (roots != x.root) & (n * 5 >= x.n * 4) & (n * 4 <= x.n * 5)
                may[may] = prefixes.values[prefixes.codes[first[may]]] == key[0]
                if may.any():
                    may &= sketches.shared(x.sk) >= np.minimum(need, needed(np.int64(x.n)))
                if full and may.any():
                    both = sets.shared(x.shingles)
                    may &= both * 100 >= (n + x.n - both) * percent
                for i in np.flatnonzero(may):
                    if full:
                        found.setdefault((x.node, roots[i]), (x.node, nodes[i]))
                    else:
                        found.setdefault((nodes[i], 0), (x.node, nodes[i]))
                        found.setdefault((x.node, 0), (x.node, nodes[i]))
        return pd.DataFrame(sorted(set(found.values())), columns=["a", "b"], dtype="int64")

    return run


def _sets(lists: DataFrame, nodes: DataFrame, plain: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the full sets of some classes, from the texts of their first rows.

    Texts are found by id and hash, so that rows which repeat an id, or have none, don't meet one another.
    """
    chosen = lists.select(F.col("m.node").alias("node"), F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "print").join(nodes, "node", "left_semi")
    texts = plain.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    return texts.select("node", "print", "text").mapInArrow(_set_batches(words), "node long, shingles array<long>").dropDuplicates(["node"])


def _more_sets(sets: DataFrame, nodes: DataFrame, lists: DataFrame, plain: DataFrame, words: int) -> DataFrame:
    """The sets of all of ``nodes``, adding those not computed yet."""
    missing = written(nodes.join(sets.select("node"), "node", "left_anti"))
    if missing.isEmpty():
        return sets
    return sets.union(written(_sets(lists, missing, plain, words), {"compression": "none"}))
