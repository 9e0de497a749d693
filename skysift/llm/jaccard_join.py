"""Exact n-gram Jaccard join by a token-group matrix, as classes of linked documents.

Documents with equal shingle sets form one class first, so that exact copies cost one row each. Then:

1. Similar classes form groups. Classes that share the least three shingles under one of a few hash permutations meet
   that key's hub, the one whose shingles are the most frequent, and exact Jaccard on the full sets confirms. Classes
   linked in this way have one root; a group is up to about GROUP classes of one root, and a class that is linked with
   none is a group of its own. A root's groups needn't be compared with each other.
2. Shingles have a global order, the rarest first, by a sketch that counts all shingles of all documents. Any order
   gives right results; this one keeps common passages out of the prefixes. The matrix has a cell for each shingle of a
   prefix and each group that holds it, kept as rows; only shingles of more than one root matter.
3. A class is a query for the groups of other roots which hold so many of its prefix's shingles, and a member of such a size,
   that the threshold can be reached. The group's union of shingles bounds what the query can share with any member. Groups whose bound reaches
   the threshold are opened, and their members are compared exactly.

Links become classes by components(). No pair at or above the threshold is lost: two such sets share a shingle of both
prefixes, so that the one's class meets the other's group unless both have one root already.

Defined results: a document with fewer words than a shingle is its whole sequence; one without words (null, empty) has an
empty set and is linked with nothing. Repeated rows are copies; texts of any length are read whole. Components are named by
their least doc_id; where no row of a component has an id, component_id is null. Other columns, whatever their names,
are left out.
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
from skysift.llm.shingles import shingle_sets

#: The sketch has so many counters, 4 MB of classes of frequency once it is sent to the tasks; they are merged in chunks.
COUNTERS, CHUNK = 1 << 22, 1 << 16
#: Hash permutations that give keys, and how many least values make one.
PERMUTATIONS, LEAST = 4, 3
GROUP = 32
#: Sizes are met in bands of so much on a logarithmic scale.
BAND = 0.04
#: A group meets at most so many queries at a time, and a task about so many texts.
PARTNERS, TEXTS = 512, 2000
SLICE = 500
ROWS = "rid long, doc_id long, mark long, n long, print binary, weight float, keys array<long>, prefix array<long>"
_SEEDS = np.random.default_rng(13).integers(1, 2**63, PERMUTATIONS, dtype="uint64") | np.uint64(1)


def _slots(shingles: np.ndarray) -> np.ndarray:
    """Counters of shingles, in the order of these."""
    return (shingles >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype("int64")


def _counted(words: int):
    """Counters over all texts of a task, in chunks; a task counts to 65535."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, "int64")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                every = np.concatenate(shingle_sets(batch.column(0).slice(at, SLICE), words))
                every.sort()
                np.add.at(table, _slots(every), 1)
        table = np.minimum(table, 65535).astype("uint16")
        for at in range(0, COUNTERS, CHUNK):
            if table[at : at + CHUNK].any():
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([table[at : at + CHUNK].tobytes()], pa.binary())], names=["at", "counts"])

    return run


def _summed(chunks: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, "int64")
    for x in chunks["counts"]:
        total += np.frombuffer(x, "uint16")
    return pd.DataFrame({"at": [int(chunks["at"].iloc[0])], "counts": [np.minimum(total, 2**31 - 1).astype("int32").tobytes()]})


def frequency_classes(docs: DataFrame, words: int, text: str = "text") -> np.ndarray:
    """For each counter of the sketch 0, or by how many powers of two its count exceeds the mean by more than four deviations that chance gives."""
    parts = docs.select(F.col(text)).mapInArrow(_counted(words), "at int, counts binary").groupBy("at").applyInPandas(_summed, "at int, counts binary")
    table = np.zeros(COUNTERS, "int64")
    for r in parts.collect():  # COUNTERS numbers, whatever the corpus
        table[r["at"] : r["at"] + CHUNK] = np.frombuffer(r["counts"], "int32")
    mean = table.mean()
    return np.maximum(np.log2(np.maximum(table - mean, 1) / (4 * np.sqrt(mean) + 4)) + 1, 0).astype("uint8")


def prefix_length(n: int, percent: int) -> int:
    """How many shingles of a set of n, the first in any order, hold one of every set that is similar enough."""
    return n - -(-n * percent // 100) + 1 if n else 0


def _described(words: int, percent: int, classes):
    """Per text: the size and digest of its set, keys of its group, how frequent its shingles are, and its prefix."""

    def keys(s: np.ndarray) -> list[int]:
        with np.errstate(over="ignore"):
            mixed = [(x := s * seed) ^ (x >> np.uint64(29)) for seed in _SEEDS]
        least = [np.sort(np.partition(x, LEAST - 1)[:LEAST] if len(x) > LEAST else x) for x in mixed]
        return [xxhash.xxh3_64_intdigest(x.tobytes(), seed=i) - 2**63 for i, x in enumerate(least)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = classes.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = shingle_sets(part.column(3), words)
                weights, prefixes = [], []
                for s in sets:
                    f = frequency[_slots(s)]
                    weights.append(f.mean() if len(s) else 0.0)
                    prefixes.append(s[np.argsort(f, kind="stable")[: prefix_length(len(s), percent)]].view("int64"))
                yield pa.record_batch(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array(weights, pa.float32()),
                        pa.array([keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                        pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    names=["rid", "doc_id", "mark", "n", "print", "weight", "keys", "prefix"],
                )

    return run


def _sizes_fit(n: Column, least: Column, most: Column, percent: int) -> Column:
    """Whether a set of n may be similar to one whose size lies in a range."""
    return (n * 100 >= least * percent) & (most * 100 >= n * percent)


def _texts(chosen: DataFrame, classes: DataFrame, plain: DataFrame) -> DataFrame:
    """Rows (node, ...), each with the text of a row of its class.

    Texts are found by id and hash. Where several rows share both, one of them is taken.
    """
    places = classes.select("node", F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "twins")
    asked = chosen.join(places, "node")
    found = lambda some: plain.join(some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select(*chosen.columns, "text")
    if classes.filter("twins").isEmpty():
        return found(asked)
    return found(asked.filter("NOT twins")).union(found(asked.filter("twins")).dropDuplicates(chosen.columns))


def _matched(words: int, percent: int):
    """For a bucket of groups, each query with the first member found that is similar enough."""

    def run(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        links = []
        held = {k: list(m.itertuples()) for k, m in members.groupby(["root", "part", "copy"])}
        for group, some in queries.groupby(["root", "part", "copy"]):
            mine = held.get(group, [])
            sets = shingle_sets(pa.array([m.text for m in mine], pa.string()), words)
            if not sets:
                continue
            sizes, nodes = np.array([len(s) for s in sets]), [m.node for m in mine]
            union = sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))
            for at in range(0, len(some), SLICE):
                part = some.iloc[at : at + SLICE]
                for node, s in zip(part["node"], shingle_sets(pa.array(part["text"], pa.string()), words)):
                    # a bound over all members first; groups that can't reach the threshold stay closed
                    if _shared(s, union) * 100 < len(s) * percent:
                        continue
                    for i in np.flatnonzero((sizes * 100 >= len(s) * percent) & (len(s) * 100 >= sizes * percent)):
                        both = _shared(s, sets[i])
                        if both * 100 >= (len(s) + sizes[i] - both) * percent:
                            links.append((node, nodes[i]))
                            break
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _links(asked: DataFrame, members: DataFrame, classes: DataFrame, plain: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): for queries (node, root, part) of groups, members (root, part, node) that are similar enough, at least one of each group that has any.

    The members of a group are of one root, so that one link says as much as all. A group with many queries is copied.
    """
    copies = written(asked.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("copies")))
    total = copies.agg(F.sum("n")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("root", "part", "copy"), F.lit(max(1, 2 * total // TEXTS))).cast("int").alias("bucket")
    left = asked.join(copies, ["root", "part"]).withColumn("copy", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int"))
    right = members.join(copies, ["root", "part"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    sides = [_texts(written(x.select("node", "root", "part", "copy", bucket)), classes, plain) for x in (left, right)]
    sides = [x.select(*(F.col(y).alias(y) for y in x.columns)).groupBy("bucket") for x in sides]  # columns of their own
    return written(sides[0].cogroup(sides[1]).applyInPandas(_matched(words, percent), "a long, b long"))


def _stars(classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class with the hub of the most frequent shingles among the hubs of its keys."""
    keyed = classes.select(F.explode("keys").alias("key"), "node", "n", "weight")
    hubs = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("weight", (-F.col("node")).alias("at"), "n")).alias("hub")).filter("size > 1")
    met = keyed.join(hubs.select("key", "hub"), "key").filter((F.col("node") != -F.col("hub.at")) & _sizes_fit(F.col("n"), F.col("hub.n"), F.col("hub.n"), percent))
    return met.groupBy("node").agg(F.max("hub").alias("hub")).select(F.col("node").alias("a"), (-F.col("hub.at")).alias("b"))


def _grouped(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, n, root, part): the groups are the parts of each root."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= GROUP)
    linked = roots.join(sizes, "root", "left").select(F.col("node").alias("_node"), "root", F.pmod(F.xxhash64("node"), F.coalesce(F.ceil(F.col("size") / GROUP), F.lit(1))).cast("int").alias("part"))
    out = classes.select("node", "n").join(linked, F.col("node") == F.col("_node"), "left")
    return out.select("node", "n", F.coalesce("root", "node").alias("root"), F.coalesce("part", F.lit(0)).alias("part"))


def _queries(placed: DataFrame, percent: int) -> DataFrame:
    """(node, root, part): classes, and the groups of smaller roots which hold enough shingles of their prefix and a member of the right size."""
    tokens = placed.select("node", "n", "root", "part", F.posexplode("prefix").alias("before", "token"))
    shared = written(tokens.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token"))
    # Where a shingle is the first that two sets share, the shingles before it are lacking in the other set: this limits the
    # other's size. Sizes are met by bands, so that long lists of sets too much alike in size for that never meet.
    n, before = F.col("n"), F.col("before")
    reach = (n * 100 - before * (100 + percent)) / percent
    band = lambda x: F.floor(F.log(x) / BAND)
    cells = written(tokens.join(shared, "token").withColumn("reach", F.least(reach, n * 100 / percent) * (1 + 1e-9)).withColumn("from", n * percent / 100 * (1 - 1e-9)).filter(F.col("reach") >= F.col("from")))
    matrix = cells.groupBy(F.col("token").alias("_token"), F.col("root").alias("_root"), F.col("part").alias("_part"), band(n).alias("_band")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("_reach"))
    asking = cells.select("token", "node", "n", "root", "reach", F.explode(F.sequence(band(F.col("from")), band(F.col("reach")))).alias("band"))
    fits = (n <= F.col("_reach")) & (F.col("least") <= F.col("reach")) & _sizes_fit(n, F.col("least"), F.col("most"), percent)
    met = asking.join(matrix, (F.col("token") == F.col("_token")) & (F.col("band") == F.col("_band")) & (F.col("root") > F.col("_root")) & fits)
    met = written(met.select("node", F.col("_root").alias("root"), F.col("_part").alias("part")).distinct())

    # Of two sets, the one whose prefix ends first has all shingles of its prefix that the other holds in the other's prefix.
    # So either the query or a member lacks what it doesn't share of its prefix, and what is left must reach the threshold.
    held = placed.join(met.select("root", "part").distinct(), ["root", "part"], "left_semi")
    held = held.groupBy("root", "part").agg(F.array_distinct(F.flatten(F.collect_list("prefix"))).alias("held"), F.min("n").alias("least"), F.max("n").alias("most"))
    both = met.join(placed.select("node", "n", "prefix"), "node").join(held, ["root", "part"])
    both = both.select("node", "root", "part", "n", "least", "most", F.size(F.array_intersect("prefix", "held")).alias("shared"))
    length = lambda x: x - F.ceil(x * percent / 100) + 1
    least, most, shared = (F.col(x) for x in ("least", "most", "shared"))
    lacks = length(n) - shared
    mine = (n - lacks) * 100 >= (least + lacks) * percent
    theirs = (most - length(most) + shared) * 100 >= (n + F.greatest(length(least) - shared, F.lit(0))) * percent
    return both.filter(mine | theirs).select("node", "root", "part")


def row_groups(docs: DataFrame, words: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    spark = docs.sparkSession
    let_workers_import(spark)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    frequency = spark.sparkContext.broadcast(frequency_classes(docs, words, text))
    numbered = plain.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "mark", "text")
    rows = written(numbered.mapInArrow(_described(words, percent, frequency), ROWS))

    least = F.min(F.struct("rid", "doc_id", "mark", "n", "weight", "keys"))
    classes = rows.filter(F.col("print").isNotNull()).groupBy("print").agg(least.alias("c"), F.min("doc_id").alias("least_id"))
    classes = classes.select("print", "least_id", F.col("c.rid").alias("node"), *(f"c.{x}" for x in ("doc_id", "mark", "n", "weight", "keys")))
    twins = rows.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.lit(True).alias("twins"))
    classes = classes.join(twins, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").drop("_id", "_mark")
    classes = written(classes.withColumn("twins", F.coalesce("twins", F.lit(False))))

    # similar classes, by the hubs of their keys
    stars = written(_stars(classes, percent))
    asked = stars.select(F.col("a").alias("node"), F.col("b").alias("root"), F.lit(0).alias("part"))
    roots = components(_links(asked, asked.select("root", "part").distinct().withColumn("node", F.col("root")), classes, plain, words, percent))

    # groups of them, and the matrix
    groups = written(_grouped(classes, roots))
    placed = written(groups.join(rows.select(F.col("rid").alias("node"), "prefix"), "node"))
    asked = written(_queries(placed, percent))
    members = groups.join(asked.select("root", "part").distinct(), ["root", "part"], "left_semi").select("root", "part", "node")
    found = _links(asked, members, classes, plain, words, percent)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))

    named = classes.join(roots, "node", "left").select("print", "least_id", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = named.select("print", "root").join(ids, "root").select("print", "component_id")
    out = rows.select("rid", "doc_id", F.col("n").alias("n_shingles"), "print").join(of_print, "print", "left")
    return out.select("rid", "doc_id", "n_shingles", F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def similar_documents(docs: DataFrame, words: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    return row_groups(docs, words, percent, doc_id, text).drop("rid")
