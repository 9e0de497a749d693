"""Streaming twins of the chunked loops: thin wrappers over the batch operators.

State and sinks live under the given folders, so a query that is started again goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def candidates(lines: DataFrame, search: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Append the rows that a row-wise search keeps; run until the input is used up."""
    return search(lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_counts(rows: DataFrame, column: str, out: str, checkpoint: str) -> StreamingQuery:
    """Counts by a column over all that has come so far; each trigger replaces the table."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace).trigger(availableNow=True).start()


def first_seen(rows: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Pass on each key once, whatever comes later."""
    return rows.select(key).dropDuplicates([key]).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def touched_summaries(epochs: DataFrame, history: Callable[[], DataFrame], summarize: Callable[[DataFrame], DataFrame], key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Recompute the summaries of sources with new epochs from their full history, and replace those rows.

    Versions are kept apart by batch; latest() reads the newest row of each source. Late epochs need no order.
    """

    def renew(batch: DataFrame, number: int) -> None:
        touched = batch.select(key).distinct()
        summarize(history().join(touched, key, "left_semi")).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return epochs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(renew).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, key: str) -> DataFrame:
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    rest = [x for x in rows.columns if x not in (key, "version", "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(key, "_r.*")


def line_run(spectra: DataFrame, search: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """The line search over spectra as they come: the classified lines of each batch of whole spectra, and how many were searched.

    Each batch is written under its number, so that one which is run again replaces itself. What depends on all spectra, the
    recurrence cut and the totals, is taken from read_lines() over all batches so far, and so equals that of one run over all.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/searched/batch={number}")
        search(batch).write.mode("overwrite").parquet(f"{out}/lines/batch={number}")

    return spectra.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()


def read_lines(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The classified lines of all batches, and the row (n_searched)."""
    lines = spark.read.option("basePath", f"{out}/lines").parquet(f"{out}/lines/batch=*").drop("batch")
    searched = spark.read.option("basePath", f"{out}/searched").parquet(f"{out}/searched/batch=*").agg(F.sum("n").alias("n_searched"))
    return lines, searched
