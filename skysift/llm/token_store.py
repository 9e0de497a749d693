"""Token-id output as ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of (doc_id, row) and sorted in each range, so files follow one another in id
order, each stripe covers a narrow span of ids (min/max statistics prune it), and stripes are read in
parallel. ORC writes the id lists as run-length-encoded integers. The number of ranges follows the bytes of
the texts, so that a task's share stays the same at any size of the table; as row tells repeated ids apart, a
doc_id with very many rows is dealt over several ranges too.

Defined results: a null text is an empty document and holds only the end id. Rows that repeat a doc_id
stay apart, in the order of row, by which they are written and counted. An empty table gives an empty store.
A null doc_id sorts first. Long texts are encoded whole; other columns of the table, whatever their names,
are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysift.llm.common import let_workers_import, written
from skysift.llm.tokens import encoder

SCHEMA = "doc_id long, row long, ids array<int>"
#: Bytes of text in a task.
RANGE_BYTES = 128 << 20
#: Rows that are encoded together.
ROWS = 2000


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, row, ids): the ids of each whole text, with the end id appended; row is 0 unless a column is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                at, ids = enc.encode_column(part.column(2))
                values = pa.array(np.insert(ids, at[1:], end_id).view("<i4"))
                lists = pa.ListArray.from_arrays(pa.array(at + np.arange(len(at)), pa.int32()), values)
                coded = pa.record_batch([part.column(0), part.column(1), lists], names=["doc_id", "row", "ids"])
                yield from (coded.slice(i, 1000) for i in range(0, part.num_rows, 1000))

    let_workers_import(docs.sparkSession)
    number = F.lit(0) if row is None else F.col(row)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), number.cast("long").alias("row"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, doc_id: str = "doc_id", text: str = "text", stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Encode ``docs`` and write the store."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    dealt = rows.repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    options = {"orc.stripe.size": str(stripe_bytes), "orc.create.index": "true", "orc.row.index.stride": str(index_rows), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
    tokenize(dealt, vocabulary, end_id, row="row").write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, row, ids) of a store. Filters on doc_id skip stripes by their statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        offsets = ids.offsets.to_numpy()
        values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
        crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64()), batch.column(3)], names=["doc_id", "row", "n_tokens", "ids_crc32", "file"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a store, start counting the ids of all documents before.

    Starts come from a running sum within each file, in the order of its rows, plus the totals of the files
    before it: one small row for each file is all that passes through a single task.
    """
    rows = read_tokens(spark, path).withColumn("file", F.col("_metadata.file_path"))
    let_workers_import(spark)
    stats = rows.mapInArrow(_crc_batches, "doc_id long, row long, n_tokens long, ids_crc32 long, file string")
    stats = written(stats)  # checksums are taken once: the rest works on these narrow rows
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row")
    files = stats.groupBy("file").agg(F.min(place).alias("low"), F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("low", "file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy(F.asc_nulls_first("doc_id"), "row").rowsBetween(Window.unboundedPreceding, -1))
    return stats.withColumn("within", F.coalesce(within, F.lit(0))).join(files, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
