"""Interaction of document filters over all their orders.

Every document gets a mask, one bit for each filter that it fails. Documents are counted by part and mask, so that
what follows works on at most 2 ** filters cells a part, whatever the number of documents. Each cell folds across the
array of all orders (a literal of the plan, sent with every task): ``aggregate`` carries along one order whether the cell's
documents are still there and ``transform`` does so for all orders, which gives orders x steps structs weighted by
the cell's counts. The structs of a part's cells are then summed element by element.

A filter is a condition on a text and its words, or EARLIER_COPY: a document fails that if any row of the
table with a smaller doc_id has the same text. Copies meet by a SHA-256 of the text, never by the text itself,
in partial minimums, and each row finds the minimum by hash and id together, so that no group of copies is one key.

Defined results: a null text is empty; a null part is the empty string. A row without an id has no earlier copy, is
none of another's and has no labels. Rows that repeat an id are judged apart, and none of them is an earlier copy of
another. A document counts as good or toxic if any of its label rows says so. Texts of any length are read whole. An
empty table has no parts. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import written

Test = Callable[[Column, Column], Column]
#: The filter that rows fail whose text some row of a smaller id has.
EARLIER_COPY = None
WORD = r"[^\x20\x09-\x0D]+"
#: All orders of more filters would be too many.
MOST_FILTERS = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def fewer_words(least: int) -> Test:
    return lambda text, words: F.size(words) < least


def fewer_distinct(percent: int) -> Test:
    return lambda text, words: F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * percent


def more_capitals(percent: int) -> Test:
    return lambda text, words: F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * percent


def holds(pattern: str) -> Test:
    return lambda text, words: text.rlike(pattern)


def mask_cells(docs: DataFrame, labels: DataFrame, tests: list[Test | None], part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents counted by part and by the filters that they fail."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    bit = lambda fails, i: F.when(fails, 1 << i).otherwise(0)
    mask = sum((bit(test(whole, words), i) for i, test in enumerate(tests) if test), F.lit(0))
    rows = docs.select(F.unhex(F.sha2(whole, 256)).alias("print"), F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"))
    rows = written(rows.groupBy("print", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")))
    if EARLIER_COPY in tests:
        firsts = rows.filter(F.col("id").isNotNull()).groupBy("print").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
        copy = F.col("id").isNotNull() & F.col("first").isNull()
        copies = sum(1 << i for i, test in enumerate(tests) if test is EARLIER_COPY)
        rows = rows.join(firsts, ["print", "id"], "left").withColumn("mask", F.col("mask") + F.when(copy, copies).otherwise(0))
    by_id = rows.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    said = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    counted = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return by_id.join(said, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), counted(F.col("good")).alias("good"), counted(F.col("bad")).alias("toxic"))


def _folded(orders: list[tuple[int, ...]]) -> Column:
    """For a cell, the counts of every step of every order, order by order."""
    times = lambda c, n: F.when(c, F.col(n)).otherwise(F.lit(0)).cast("bigint")

    def step(state: Column, f: Column) -> Column:
        fails = F.call_function("shiftright", F.col("mask"), f).bitwiseAND(1) == 1
        gone = state.there & fails
        cell = F.struct(
            f.alias("filter"),
            times(state.there & ~fails, "n").alias("kept"),
            times(gone, "n").alias("removed"),
            times(~state.there & fails, "n").alias("redundant"),
            times(F.col("mask") == F.call_function("shiftleft", F.lit(1), f), "n").alias("unique_fails"),
            times(gone, "good").alias("good_lost"),
            times(gone, "toxic").alias("toxic_lost"),
        )
        return F.struct((state.there & ~fails).alias("there"), F.concat(state.steps, F.array(cell)).alias("steps"))

    none = "array<struct<filter:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    fold = lambda order: F.aggregate(order, F.struct(F.lit(True).alias("there"), F.array().cast(none).alias("steps")), step, lambda s: s.steps)
    return F.flatten(F.transform(F.lit([list(o) for o in orders]), fold))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Test | None], part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), one row for each part, order and step.

    ``filters`` names the filters by one character each. kept and removed count documents after and in the step,
    redundant those that fail its filter but went earlier, unique_fails those that fail no other filter; shapley is what
    its filter removes, summed over all orders.
    """
    names = list(filters)
    if not 1 <= len(names) <= MOST_FILTERS or any(len(x) != 1 for x in names):
        raise ValueError(f"give one to {MOST_FILTERS} filters with names of one character")
    orders = list(permutations(range(len(names))))
    cells = mask_cells(docs, labels, list(filters.values()), part, doc_id, text)
    # a part has at most 2 ** filters cells
    folded = cells.select("part", _folded(orders).alias("steps")).groupBy("part").agg(F.collect_list("steps").alias("cells"))
    plus = lambda a, b: F.struct(a["filter"].alias("filter"), *((a[c] + b[c]).alias(c) for c in COUNTS))
    merged = F.aggregate(F.slice("cells", 2, 1 << len(names)), F.element_at("cells", 1), lambda s, x: F.zip_with(s, x, plus))
    totals = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda f: F.aggregate("steps", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["filter"] == f, x["removed"]).otherwise(0)))
    rows = folded.select("part", merged.alias("steps")).select("part", totals.alias("totals"), F.posexplode("steps").alias("at", "s"))
    order = F.element_at(F.lit(["".join(names[i] for i in o) for o in orders]), F.floor(F.col("at") / len(names)).cast("int") + 1)
    step = (F.col("at") % len(names) + 1).cast("int")
    shapley = F.element_at("totals", F.col("s.filter") + 1)
    return rows.select("part", order.alias("filter_order"), step.alias("step"), *(F.col(f"s.{c}").alias(c) for c in COUNTS), shapley.alias("shapley"))

