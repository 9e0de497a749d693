"""Masked pseudo-likelihood scores from a bidirectional window network over bytes.

Every byte of a text is predicted from the SIDE bytes before and the SIDE after it: their position-wise
embeddings are summed into a hidden tanh layer; a softmax over the 16 upper halves of a byte, and one over the
16 lower halves given the upper one, give the conditional distribution over all 256 bytes. A document's score
is the sum of the conditional log-probabilities of all its bytes. Bytes leave no character of any script out.

Training uses the whole corpus: its distinct windows and their counts come from grouped aggregation, a table
that grows with the corpus. It is written once, in a mixed order; in each round as many tasks as it fills stream
through their shares with numpy from the same parameters, weighted by the counts. Their parameter vectors are summed
by tasks, FAN_IN at a time, until at most FAN_IN sums are left for the driver. Scoring evaluates each distinct window
of a batch of texts once.

Defined results: null and empty texts have no tokens, a sum of 0 and a null mean. Repeated rows count in the
corpus as often as they occur and are scored alike. Texts of any length are read whole. Over an empty corpus the
network stays as it began. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import let_workers_import, written

SIDE, HIDDEN = 3, 32
#: Symbols are bytes, and PAD beyond the text's ends. A window is one integer, BITS for each symbol.
PAD, SYMBOLS, BITS = 256, 257, 9
TASK_WINDOWS, ROUNDS, BATCH, FAN_IN = 200_000, 3, 512, 64
#: Bytes of text taken together, and distinct windows that a counting task holds before it passes them on.
BATCH_BYTES, HELD_WINDOWS = 2_000_000, 2_000_000
Params = list[np.ndarray]


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), "uint8")


def _text_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of bounded length with the bytes of their texts."""
    for batch in batches:
        at, some, size = 0, [], 0
        for i, text in enumerate(batch.column(column)):
            some.append(bytes_of(text.as_py()))
            size += len(some[-1])
            if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                yield batch.slice(at, i + 1 - at), some
                at, some, size = i + 1, [], 0


def windows_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all bytes of some texts as integers, and where each text's begin."""
    lengths = np.array([len(t) for t in texts], "int64")
    starts = np.cumsum(np.concatenate([[SIDE], lengths + SIDE]))[:-1]
    row = np.full(int(lengths.sum()) + SIDE * (len(texts) + 1), PAD, "int64")
    for t, at in zip(texts, starts):
        row[at : at + len(t)] = t
    n = len(row) - 2 * SIDE
    codes = np.zeros(n, "int64")
    for i in range(2 * SIDE + 1):
        codes = codes << BITS | row[i : i + n]
    return codes[row[SIDE : SIDE + n] != PAD], np.concatenate([[0], np.cumsum(lengths)])


def split(codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The symbols around and the centre."""
    parts = [codes >> BITS * (2 * SIDE - i) & ((1 << BITS) - 1) for i in range(2 * SIDE + 1)]
    return parts[:SIDE] + parts[SIDE + 1 :], parts[SIDE]


def count_windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n): the distinct windows of the whole corpus."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], np.add.reduceat(counts, first)

    def emitted(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(codes), 200_000):
            yield pa.record_batch([pa.array(codes[at : at + 200_000]), pa.array(counts[at : at + 200_000], pa.int64())], names=["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for _, texts in _text_batches(batches, 0):
            found = np.unique(windows_of(texts)[0], return_counts=True)
            if len(found[0]):
                parts.append(found)
            if sum(len(p[0]) for p in parts) >= HELD_WINDOWS:
                yield from emitted(*merged(parts))
                parts = []
        if parts:
            yield from emitted(*merged(parts))

    let_workers_import(docs.sparkSession)
    return docs.select(F.col(text)).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def initial(seed: int = 1) -> Params:
    rng = np.random.default_rng(seed)
    shapes = ((2 * SIDE, SYMBOLS, HIDDEN), (HIDDEN,), (HIDDEN, 16), (16,), (16, HIDDEN, 16), (16, 16))
    return [(rng.normal(0, 0.3, s) if len(s) == 3 or s == (HIDDEN, 16) else np.zeros(s)).astype("float32") for s in shapes]


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _hidden(params: Params, around: list[np.ndarray]) -> np.ndarray:
    return np.tanh(sum(params[0][i][s] for i, s in enumerate(around)) + params[1])


def log_probabilities(params: Params, codes: np.ndarray) -> np.ndarray:
    """The log-probability of each window's centre, given what stands around it."""
    _, _, vh, ch, vl, cl = params
    out = np.empty(len(codes), params[0].dtype)
    for at in range(0, len(codes), 65_536):
        some = codes[at : at + 65_536]
        order = np.argsort((some >> BITS * SIDE + 4 & 15).astype("int8"), kind="stable")
        around, centre = split(some[order])
        h, high, low = _hidden(params, around), centre >> 4, centre & 15
        lp = _log_softmax(h @ vh + ch)[np.arange(len(high)), high]
        ends = np.searchsorted(high, np.arange(17)).tolist()
        for g, (i, j) in enumerate(zip(ends, ends[1:])):
            if i < j:
                lp[i:j] += _log_softmax(h[i:j] @ vl[g] + cl[g])[np.arange(j - i), low[i:j]]
        out[at + order] = lp
    return out


def _summed(kinds: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each of n kinds; kinds may list several kinds for a row, one after another round of rows."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    order = np.argsort(kinds, kind="stable")
    kinds = kinds[order]
    first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    out[kinds[first]] = np.add.reduceat(rows[order % len(rows)], first, axis=0)
    return out


def gradients(params: Params, codes: np.ndarray, weight: np.ndarray) -> Params:
    """Of the weighted sum of negative log-probabilities. Windows are put in order of their centres' upper halves."""
    e, _, vh, ch, vl, cl = params
    codes = codes[order := np.argsort(codes >> BITS * SIDE + 4 & 15, kind="stable")]
    around, centre = split(codes)
    h, high, low = _hidden(params, around), centre >> 4, centre & 15
    weight = weight[order].astype(h.dtype)[:, None]
    at = np.arange(len(high))
    dz = np.exp(_log_softmax(h @ vh + ch))
    dz[at, high] -= 1
    dz *= weight
    dh = dz @ vh.T
    ends = np.searchsorted(high, np.arange(17)).tolist()
    met = [(g, slice(i, j)) for g, (i, j) in enumerate(zip(ends, ends[1:])) if i < j]
    dl = cl[high]
    for g, rows in met:
        dl[rows] += h[rows] @ vl[g]
    dl = np.exp(_log_softmax(dl))
    dl[at, low] -= 1
    dl *= weight
    dvl, dcl = np.zeros_like(vl), np.zeros_like(cl)
    dcl[[g for g, _ in met]] = np.add.reduceat(dl, [rows.start for _, rows in met], axis=0)
    for g, rows in met:
        dvl[g] = h[rows].T @ dl[rows]
        dh[rows] += dl[rows] @ vl[g].T
    dh *= 1 - h * h
    kinds = np.concatenate([i * SYMBOLS + s for i, s in enumerate(around)])
    return [_summed(kinds, dh, len(around) * SYMBOLS).reshape(e.shape), dh.sum(axis=0), h.T @ dz, dz.sum(axis=0), dvl, dcl]


def _flat(params: Params) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params])


def _shaped(flat: np.ndarray, like: Params) -> Params:
    """Views of one vector in the shapes of some parameters."""
    return [x.reshape(p.shape) for x, p in zip(np.split(flat, np.cumsum([p.size for p in like])[:-1]), like)]


def train(params: Params, windows: Iterable[tuple[np.ndarray, np.ndarray]], rate: float) -> tuple[Params, int]:
    """Adam over batches of (windows, counts), each window weighted by its count; returns the sum of counts too."""
    flat = _flat(params)
    params = _shaped(flat, params)
    m, s, g, x = (np.zeros_like(flat) for _ in range(4))
    step = total = 0
    for codes, counts in windows:
        total += int(counts.sum())
        for at in range(0, len(codes), BATCH):
            some, n = codes[at : at + BATCH], counts[at : at + BATCH]
            step += 1
            np.concatenate([d.ravel() for d in gradients(params, some, n / n.sum())], out=g)
            m *= 0.9
            m += np.multiply(g, 0.1, out=x)
            g *= g
            s *= 0.99
            s += np.multiply(g, 0.01, out=x)
            np.sqrt(np.divide(s, 1 - 0.99**step, out=x), out=x)
            x += 1e-8
            np.divide(m, x, out=x)
            x *= rate / (1 - 0.9**step)
            flat -= x
    return params, total


def _added(vectors: DataFrame) -> DataFrame:
    """One row (n, sums) for each task: the vectors in its partition, each times its n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            for k, some in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = np.frombuffer(some.as_buffer(), "float64")
                n, sums = n + k, row.copy() if sums is None else sums + row
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["n", "sums"])

    return vectors.mapInArrow(run, "n long, sums binary")


def fit(windows: DataFrame, rounds: int = ROUNDS, task_windows: int = TASK_WINDOWS) -> Params:
    """Parameters from a written window table, whose rows should stand in an order that mixes them (``mixed``)."""
    params = initial()
    spark = windows.sparkSession
    let_workers_import(spark)
    tasks = max(1, -(-windows.count() // task_windows))
    dealt = windows.coalesce(tasks)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=0.02 / (1 + r)) -> Iterator[pa.RecordBatch]:
            new, n = train(shared.value, ((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches), rate)
            if n:
                yield pa.record_batch([pa.array([n], pa.int64()), pa.array([(_flat(new).astype("float64") * n).tobytes()], pa.binary())], names=["n", "sums"])

        trained, left = dealt.mapInArrow(run, "n long, sums binary"), tasks
        while left > FAN_IN:
            left = -(-left // FAN_IN)
            trained = _added(trained.repartition(left))
        rows = trained.collect()  # at most FAN_IN rows
        if not rows:
            break
        flat = sum(np.frombuffer(t.sums, "float64") for t in rows) / sum(t.n for t in rows)
        params = _shaped(flat.astype("float32"), params)
    return params


def mixed(windows: DataFrame) -> DataFrame:
    """Each partition's windows in the order of a hash."""
    return windows.sortWithinPartitions(F.xxhash64("code"))


def score(docs: DataFrame, params: Params, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_probability, mean) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _text_batches(batches, 1):
            codes, starts = windows_of(texts)
            kinds, place = np.unique(codes, return_inverse=True)
            sums = np.concatenate([[0.0], np.cumsum(log_probabilities(shared.value, kinds)[place], dtype="float64")])
            total, n = sums[starts[1:]] - sums[starts[:-1]], np.diff(starts)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = total / n
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(total), pa.array(mean, mask=n == 0)], names=["doc_id", "n_tokens", "log_probability", "mean"])

    let_workers_import(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, n_tokens long, log_probability double, mean double")


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the whole of ``docs`` and score each of its rows."""
    return score(docs, fit(written(mixed(count_windows(docs, text)))), doc_id, text)
