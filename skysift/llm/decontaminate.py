"""Benchmark decontamination: a prefix-filtered set join between benchmark windows and document words.

A benchmark item gives its windows of ``window`` consecutive words (a shorter item is one window). A
document is hit where a whole window occurs in it. Words are ordered by how often they occur in all
documents. As a window must be contained whole, its necessary prefix is one token, its rarest word, so only
document positions that hold the rarest word of some window are probed. The length bound drops windows that
do not fit into the document, the positional bound those that would begin before it or end after it; the
surviving candidates are verified word by word over the window's own size.

DataFrame functions only. Two passes read the documents: one counts the words that windows hold, one probes.
In both a Bloom filter of the wanted words lets few words of a document through, and an exact join follows. The
windows are broadcast while their words take up to BROADCAST_BYTES, which is measured; with more, the few
probes are shuffled by their word instead.

Defined results: null or wordless texts have no words, hits or items; a wordless item has no windows.
Repeated document rows, and rows without an id, are judged apart and keep their number; repeated items are one
item, and an item without an id is none. Ties between words of equal count go to the smaller word. Texts of any
length are read whole. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.bloom import may_contain
from skysift.llm.common import ascii_lower, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (win, items): each window's words and the ids of the items that hold it."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).filter((F.size("w") > 0) & F.col("item_id").isNotNull())
    n = F.least(F.size("w"), F.lit(window))
    wins = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda s: F.slice("w", s, n))).alias("win"))
    return wins.groupBy("win").agg(F.collect_set("item_id").alias("items"))


def keyed_windows(docs: DataFrame, wins: DataFrame, text: str = "text") -> DataFrame:
    """(win, items, key, off, n): each window with its rarest word in the documents and the first place where it stands."""
    placed = wins.select("win", "items", F.posexplode("win").alias("off", "word"))
    vocabulary = written(placed.select("word").distinct())
    wanted = may_contain(vocabulary, "word")
    counts = docs.select(F.explode(words(F.col(text))).alias("word")).filter(wanted(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.join(vocabulary, "word", "left_semi"))
    key = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"), F.col("off"))).alias("key")
    keyed = placed.join(counts, "word", "left").groupBy("win", "items").agg(key)
    return keyed.select("win", "items", F.col("key.word").alias("key"), F.col("key.off").alias("off"), F.size("win").alias("n"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Per document row: rid (its row: the column ``row``, if one is named), doc_id, n_words, hits (start and length of each window), items (sorted ids)."""
    wins = written(item_windows(benchmark, window))
    keyed = written(keyed_windows(docs, wins, text))
    size = keyed.agg(F.sum(F.length(F.array_join("win", " ")) * 4 + F.size("items") * 8 + F.length("key") * 4 + 64)).first()[0] or 0
    is_key = may_contain(written(keyed.select("key").distinct()), "key")

    # the words that may be keys, with their neighbourhoods; a document's first word stands for it in any case
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(number.alias("rid"), F.col(doc_id).alias("doc"), words(F.col(text)).alias("w"))
    places = rows.select("rid", "doc", F.size("w").alias("n_words"), "w", F.posexplode_outer("w").alias("pos", "word"))
    places = places.filter(F.col("pos").isNull() | (F.col("pos") == 0) | is_key(F.col("word")))
    reach = window - 1
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    probes = places.select("rid", "doc", "n_words", "pos", "word", first.alias("from"), F.slice("w", first + 1, F.lit(2 * reach + 1)).alias("near"))
    s = F.col("pos") - F.col("off")
    fits = (s >= 0) & (s + F.col("n") <= F.col("n_words"))
    same = F.slice("near", F.when(fits, s - F.col("from")).otherwise(0) + 1, F.col("n")) == F.col("win")
    found = probes.join(F.broadcast(keyed) if size <= BROADCAST_BYTES else keyed, (F.col("word") == F.col("key")) & fits & same, "left")
    hits = found.select("rid", "doc", "n_words", F.when(F.col("win").isNotNull(), F.struct(s.alias("s"), "n")).alias("hit"), "items")
    out = hits.groupBy("rid", "doc", "n_words").agg(F.collect_set("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return out.select("rid", F.col("doc").alias(doc_id), F.greatest("n_words", F.lit(0)).alias("n_words"), "hits", "items")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Digest per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contaminated(docs, benchmark, window)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h.s, h.s + h.n - 1))))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(covered).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
