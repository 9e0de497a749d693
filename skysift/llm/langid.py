"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of a sample of labelled text knows all its substrings. A text is parsed
into phrases, each the longest match that the automaton yields from there; the language that needs the fewest
phrases for each character wins. Texts are lower-cased, other characters than letters become one blank.

Training reads at most ``sample_chars`` characters of each language (a documented bound: the distinct texts,
each cut to the bound, that come first by their hash, until the bound is reached; a language with any text
is never empty). Every worker builds the automata from
this small broadcast sample. Automata are kept as dense tables and all languages share one array, so that numpy
walks through many whole texts and languages at once, one character of each at a time; when only a few long
texts are left, each is walked by itself.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing was learned.
Ties go to the alphabetically first language. The score is 1 - phrases(best) / phrases(second), or 1 if only
one language was learned. Rows with null text or lang teach nothing. Repeated rows are predicted alike. Columns
with the names of the results are replaced; pass other names to keep them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.llm.common import let_workers_import, written

SAMPLE_CHARS, MAX_BROADCAST = 40_000, 10_000
#: Characters of texts walked together, and texts times languages below which each is walked by itself.
WALK_CHARS, FEW = 16_000_000, 128
SLICE = 3000
UNKNOWN = "und"


def sample(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS, lang: str = "lang", text: str = "text") -> list[tuple[str, str]]:
    """(lang, text) with at most sample_chars characters each, for all languages that occur."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    # classes of hashes, each twice as wide as the one before; a language reads the first that together fill its
    # bound, counted over distinct texts (copies share a hash), and all of them if its texts are fewer
    rows = rows.withColumn("text", F.substring("text", 1, sample_chars))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 40))).withColumn("class", F.length(F.bin("h")))
    distinct = rows.groupBy("lang", "class", "h").agg(F.min(F.length("text")).alias("chars"))
    classes = distinct.groupBy("lang", "class").agg(F.sum("chars").alias("chars"))
    lower = Window.partitionBy("lang").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    read = classes.withColumn("before", F.coalesce(F.sum("chars").over(lower), F.lit(0))).filter(F.col("before") < sample_chars)
    read = written(read.groupBy("lang").agg(F.max("class").alias("last")))
    few = F.broadcast(read) if read.count() <= MAX_BROADCAST else read  # one small row for each language
    first = rows.join(few, "lang").filter(F.col("class") <= F.col("last"))
    some = Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("lang", "h", "text").dropDuplicates(["lang", "text"])
    first = first.withColumn("before", F.coalesce(F.sum(F.length("text")).over(some), F.lit(0))).filter(F.col("before") < sample_chars)
    texts: dict[str, str] = {}
    for r in first.orderBy("lang", "before", "text").collect():
        texts[r.lang] = (texts.get(r.lang, "") + " " + r.text)[: sample_chars + 1]
    return sorted(texts.items())


class Parser:
    """Counts phrases of texts against the automata of all learned languages."""

    def __init__(self, texts: list[tuple[str, str]]):
        self.langs = [lang for lang, _ in texts]
        plain = [self._plain(t) for _, t in texts]
        letters = sorted(set("".join(plain)))
        #: Symbol 0 is any character that no sample holds.
        self.symbol = np.zeros(0x110000, "uint8" if len(letters) < 255 else "uint16")
        for i, c in enumerate(letters):
            self.symbol[ord(c)] = i + 1
        self.width = len(letters) + 1
        tables, self.roots, at = [], [], 0
        for t in plain:
            table = self._table(self.symbol[np.frombuffer(t.encode("utf-32-le"), "<u4")].tolist())
            # a failing step starts a new phrase from the root: the target with its sign turned
            root = np.where(table[0] < 0, 0, table[0]) + at
            tables.append(np.where(table >= 0, table + at, ~root[None, :]))
            self.roots.append(at)
            at += len(table)
        self.table = np.concatenate(tables).astype("int32") if tables else np.zeros((1, 1), "int32")
        self.table *= self.width  # states are kept as row offsets
        self.table += np.where(self.table < 0, self.width - 1, 0).astype("int32")  # ~x * w + (w - 1) == ~(x * w)
        self.table = self.table.ravel()
        self.cells = memoryview(self.table)

    @staticmethod
    def _plain(text: str) -> str:
        return "".join(c if c.isalpha() else " " for c in text.lower())

    def _table(self, symbols: list[int]) -> np.ndarray:
        """The suffix automaton as states x symbols, -1 for no transition."""
        nexts, link, length, last = [{}], [-1], [0], 0
        for s in symbols:
            cur = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and s not in nexts[p]:
                nexts[p][s] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][s]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p != -1 and nexts[p].get(s) == q:
                        nexts[p][s] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        table = np.full((len(nexts), self.width), -1, "int64")
        for state, row in enumerate(nexts):
            for s, to in row.items():
                table[state, s] = to
        return table

    def phrases(self, lanes: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text of symbols for each language."""
        order = sorted(range(len(lanes)), key=lambda i: -len(lanes[i]))
        sizes = np.array([len(lanes[i]) for i in order], "int64")
        n, n_langs = len(lanes), len(self.langs)
        starts = np.cumsum([0, *sizes])[:-1]
        flat = np.concatenate([np.zeros(0, self.symbol.dtype), *(lanes[i] for i in order)])
        roots = np.array(self.roots, "int32")[:, None] * self.width
        state = np.repeat(roots, n, axis=1).astype("int32")
        # one phrase is open after a text's first symbol; each failing step opens another
        count = np.ones((n_langs, n), "int64")
        count[:, sizes == 0] = 0
        t, m = 0, int((sizes > 0).sum())
        state = state[:, :m].copy()
        while m * n_langs >= FEW:
            for t in range(t, int(sizes[m - 1])):
                step = self.table[state + flat[starts[:m] + t]]
                failed = step < 0
                if t:
                    count[:, :m] += failed
                state = np.where(failed, ~step, step)
            t += 1
            m = int(np.searchsorted(-sizes, -t, side="left"))  # texts longer than t
            state = state[:, :m].copy()
        for i in range(m):
            rest = flat[starts[i] + t : starts[i] + sizes[i]].tolist()
            for k in range(n_langs):
                count[k, i] += self._walk(rest, int(state[k, i])) - (t == 0 and self.table[state[k, i] + rest[0]] < 0)
        out = np.zeros((n, n_langs), "int64")
        out[order] = count.T
        return out

    def _walk(self, symbols: list[int], state: int) -> int:
        """How many steps from a state fail."""
        table, failed = self.cells, 0
        for s in symbols:
            state = table[state + s]
            if state < 0:
                failed += 1
                state = ~state
        return failed

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        owner, lanes = [], []
        total = np.zeros((len(texts), max(1, len(self.langs))), "int64")

        def flush() -> None:
            if lanes:
                total[owner] = self.phrases(lanes)
                owner.clear()
                lanes.clear()

        held = 0
        read = []
        for i, t in enumerate(texts):
            low = (t or "").lower()
            codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
            symbols = self.symbol[codes]
            odd = np.flatnonzero(symbols == 0)
            if len(odd):  # other characters than letters count as blanks, unknown letters stay unknown
                kind = np.array([low[j].isalpha() for j in odd])
                symbols[odd[~kind]] = self.symbol[32]
                letters = kind.any() or (symbols > 0).any() and not low.isspace() and any(map(str.isalpha, low))
            else:
                letters = len(symbols) > 0 and any(map(str.isalpha, low))
            if not letters or not self.langs:
                continue
            read.append(i)
            owner.append(i)
            lanes.append(symbols)
            held += len(symbols)
            if held >= WALK_CHARS:
                flush()
                held = 0
        flush()
        for i in read:
            best = int(total[i].argmin())
            langs[i] = self.langs[best]
            rest = np.delete(total[i], best)
            scores[i] = float(1 - total[i, best] / rest.min()) if len(rest) else 1.0
        return langs, scores


_PARSERS: dict[tuple, Parser] = {}


def _parser(texts: list[tuple[str, str]]) -> Parser:
    """One parser for each worker process and sample."""
    key = tuple(hash(x) for x in texts)
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(texts)
    return _PARSERS[key]


def predict(docs: DataFrame, texts: list[tuple[str, str]], text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the predicted language and its score (columns of these names are replaced)."""
    docs = docs.drop(lang_pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                langs, scores = parser.predict(part.column(at).to_pylist())
                yield pa.record_batch([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, lang_pred, score])

    let_workers_import(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32(doc_id as text) mod 4 is 2 teach nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
