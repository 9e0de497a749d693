"""Quality classifier with hierarchical empirical Bayes.

A logistic regression over figures of the text and hashed counts of its words (fitted with numpy on at most
MAX_TRAIN labelled documents, a documented bound) gives each document's evidence as a log-likelihood ratio.
Grouped aggregation counts the labels of every host and of every path in a host. The spread between hosts
beyond binomial noise gives, by the method of moments, the weight of the global rate in a host's posterior;
the spread between paths beyond their hosts gives the weight of the host's posterior in a path's. Sites with
few labels so shrink to the global rate. A document's posterior adds its evidence to the log-odds of its
path, host or the global rate.

Defined results: a null or empty text has the figures of an empty text; texts of any length are read whole.
Null hosts and paths are groups of their own. Without labels of both kinds the evidence is 0, and without any
labels the rate is one half. Labels without an id or a value don't count; several labels of one document count
once, as their least. Repeated rows are judged alike. A posterior of just one half is kept. Columns of ``docs``
with the names of the results are replaced; all others, whatever their names, stay.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skysift.llm.common import fresh, let_workers_import, written

MAX_TRAIN = 20_000
#: Tables of rates up to so many rows are broadcast (some ten MB).
BROADCAST_SITES = 200_000
FIGURES = ("length", "letters", "capitals", "digits", "symbols", "marks", "distinct", "commonest", "repeats", "lines", "word_length", "sentences", "runs", "bars")
#: Words are counted in so many hash buckets; a word's bucket is remembered for up to CACHE_WORDS words.
BUCKETS, CACHE_WORDS = 256, 100_000
WORD_RIDGE = 30.0
_KIND = np.zeros(256, "uint8")
for _i in range(256):
    c = chr(_i)
    _KIND[_i] = 1 if c.islower() and _i < 128 else 2 if c.isupper() and _i < 128 else 3 if c.isdigit() and _i < 128 else 4 if _i >= 128 else 5 if c in ".,;:'\"-()?" else 6 if c in " \t\n\r\v\f" else 7
_MARKS = re.compile(rb"[!#$%&*@~^=<>|\\/{}\[\]_+]{2,}")


def figures(text: str | None) -> list[float]:
    """Bounded figures of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    kinds = np.bincount(_KIND[np.frombuffer(raw, "uint8")], minlength=8)
    letters = kinds[1] + kinds[2] + kinds[4]
    counts = Counter(words)
    lines = raw.count(b"\n") + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        min(1.0, np.log1p(len(words)) / 10),
        letters / size,
        kinds[2] / max(1, letters),
        kinds[3] / size,
        kinds[7] / size,
        len(_MARKS.findall(raw)) / n,
        min(1.0, len(counts) / n * np.log2(n + 1) / 10),
        max(counts.values(), default=0) / n,
        repeats / n,
        min(1.0, lines / n),
        min(1.0, size / n / 20),
        min(1.0, kinds[5] / n),
        (n - len(counts)) / n,
        raw.count(b"|") / n,
    ]


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        b = self[word] = zlib.crc32(word.lower()) % BUCKETS
        return b


_BUCKETS = _Buckets()


def features(texts: list[str | None]) -> np.ndarray:
    """One row for each whole text: its figures, and the roots of the shares of its words in each bucket."""
    out = np.zeros((len(texts), len(FIGURES) + BUCKETS), "float32")
    for i, t in enumerate(texts):
        out[i, : len(FIGURES)] = figures(t)
        words = (t or "").encode("utf-8", "surrogatepass").split()
        if words:
            found = np.bincount(np.fromiter(map(_BUCKETS.__getitem__, words), "int64", len(words)), minlength=BUCKETS)
            out[i, len(FIGURES) :] = np.sqrt(found / len(words))
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale, weights and intercept (of the log-likelihood ratio) by Newton steps on the ridge-penalised likelihood; features beyond the figures are held WORD_RIDGE times as tightly."""
    d = x.shape[1] if x.ndim == 2 else len(FIGURES) + BUCKETS
    if not len(y) or y.min() == y.max():
        return np.zeros(d), np.ones(d), np.zeros(d), 0.0
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(d + 1)
    w[-1] = prior = np.log(y.mean() / (1 - y.mean()))
    penalty = np.diag([ridge if i < len(FIGURES) else ridge * WORD_RIDGE for i in range(d)] + [1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w[:-1], float(w[-1] - prior)


def _judged(docs: DataFrame, text: str, model: tuple | None, name: str) -> DataFrame:
    """Add the features (as bytes of 32-bit floats), or with a model the evidence, as a column."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                x = features(part.column(at).to_pylist())
                if model is None:
                    column = pa.array([r.tobytes() for r in x], pa.binary())
                else:
                    mean, scale, w, b = model
                    column = pa.array(np.clip((x - mean) / scale, -20, 20) @ w + b, pa.float64())
                yield pa.record_batch([*part.columns, column], names=[*part.schema.names, name])

    let_workers_import(docs.sparkSession)
    kind = T.BinaryType() if model is None else T.DoubleType()
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def evidence_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple:
    """The document classifier. labels: (doc_id, label), one row for each document."""
    n = labels.count()
    chosen = labels
    if n > MAX_TRAIN:
        share = int(0.9 * MAX_TRAIN / n * (1 << 30))
        chosen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).orderBy("doc_id").limit(MAX_TRAIN)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most MAX_TRAIN rows
    known = _judged(rows, "text", None, "x").select("doc_id", "label", "x").groupBy("doc_id").agg(F.min("label").alias("y"), F.min("x").alias("x")).orderBy("doc_id").collect()
    return fit(np.array([np.frombuffer(r.x, "float32") for r in known], float), np.array([r.y for r in known], float))


def _weight(groups: DataFrame, centre: Column, parents: Column) -> float:
    """How many labels the parent's rate is worth in a group: from the spread of rates beyond binomial noise."""
    p = F.least(F.greatest(centre, F.lit(1e-3)), F.lit(1 - 1e-3))
    spread = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2) / (p * (1 - p)))
    s, n, n2, h, free = groups.agg(spread, F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count(F.lit(1)), parents).first()
    if not n or h <= free:
        return 100.0
    room = n - n2 / n - (h - free)
    rho = ((s or 0.0) - (h - free)) / room if room > 0 else 0.0
    return 1 / min(max(rho, 1e-3), 0.5) - 1


def posteriors(docs: DataFrame, labels: DataFrame, host: str, path: str, doc_id: str = "doc_id") -> tuple[float, DataFrame, DataFrame]:
    """The global rate, (host, host_rate) and (host, path, path_rate). labels: (doc_id, label)."""
    # narrow columns only; partial aggregation keeps a hot host from meeting in one task
    site = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(path).alias("path"))
    paths = written(site.join(labels, "doc_id").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")))
    n, k = paths.agg(F.sum("n"), F.sum("k")).first()
    rate = (k + 1) / (n + 2) if n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    w = _weight(hosts, F.lit(rate), F.lit(1))
    hosts = hosts.select("host", ((F.col("k") + w * rate) / (F.col("n") + w)).alias("host_rate"))
    of = hosts.select(F.col("host").alias("of"), "host_rate")
    both = paths.join(of, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    w = _weight(both, F.col("host_rate"), F.countDistinct(F.struct("host")))
    paths = both.select("host", "path", ((F.col("k") + w * F.col("host_rate")) / (F.col("n") + w)).alias("path_rate"))
    return rate, hosts, paths


def classify(docs: DataFrame, labels: DataFrame, host: str, path: str, doc_id: str = "doc_id", text: str = "text", label: str = "quality", results: tuple[str, str, str, str] = ("evidence", "prior", "posterior", "kept")) -> DataFrame:
    """All rows and columns of ``docs`` with evidence, prior (of its site), posterior and kept, by the names in ``results``."""
    evidence, prior, posterior, kept = results
    docs = docs.drop(*results)
    labels = written(labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("long").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label")))
    model = evidence_model(docs, labels, doc_id, text)
    rate, hosts, paths = posteriors(docs, labels, host, path, doc_id)
    h, p, q, of_host, of_path = (fresh(docs, x) for x in ("of_host", "on_host", "of_path", "host_rate", "path_rate"))
    hosts = hosts.select(F.col("host").alias(h), F.col("host_rate").alias(of_host))
    paths = paths.select(F.col("host").alias(p), F.col("path").alias(q), F.col("path_rate").alias(of_path))
    # few sites are broadcast, so that no text is shuffled; with more, AQE splits the skewed hosts
    hosts, paths = (F.broadcast(t) if t.count() <= BROADCAST_SITES else t for t in (written(hosts), written(paths)))
    out = _judged(docs, text, model, evidence)
    out = out.join(hosts, F.col(host).eqNullSafe(F.col(h)), "left").join(paths, F.col(host).eqNullSafe(F.col(p)) & F.col(path).eqNullSafe(F.col(q)), "left")
    out = out.withColumn(prior, F.least(F.greatest(F.coalesce(of_path, of_host, F.lit(rate)), F.lit(1e-6)), F.lit(1 - 1e-6))).drop(h, p, q, of_host, of_path)
    odds = F.col(evidence) + F.log(F.col(prior) / (1 - F.col(prior)))
    out = out.withColumn(posterior, 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0)))))
    return out.withColumn(kept, F.col(posterior) >= 0.5)
