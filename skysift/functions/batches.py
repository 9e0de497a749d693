"""Tasks over the Arrow batches of a partition that is sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows again as tables that hold each key's rows together, with the places where a key's rows begin, and the table's end.

    Of the rows read, only those of the last key wait for the next batch.
    """
    waiting: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(key)
        last = ids[-1]
        start = batch.num_rows - int(np.argmax(_starts(ids)[::-1])) - 1
        if start == 0 and waiting and waiting[-1].column(key)[-1] == last:
            waiting.append(pa.Table.from_batches([batch]))
            continue
        done = pa.concat_tables([*waiting, pa.Table.from_batches([batch.slice(0, start)])])
        if done.num_rows:
            yield done, _edges(done, key)
        waiting = [pa.Table.from_batches([batch.slice(start)])]
    if waiting:
        done = pa.concat_tables(waiting)
        yield done, _edges(done, key)


def _starts(ids: pa.Array) -> np.ndarray:
    """Whether a row's key differs from the one before it; the first row's does."""
    codes = ids.dictionary_encode("encode").indices.to_numpy()
    return np.concatenate([[True], codes[1:] != codes[:-1]])


def _edges(table: pa.Table, key: str) -> np.ndarray:
    return np.append(np.flatnonzero(_starts(table.column(key).combine_chunks())), table.num_rows)
