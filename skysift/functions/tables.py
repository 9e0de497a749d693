"""Tables written to the folder that the cluster shares, to cut lineage between rounds."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset and Spark runs in one process (tests) under a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="skysift-"))
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/skysift-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the rank from 1 in a total order. Rows are dealt to ranges and numbered in each, from the number of rows in those before."""
    rows = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn(name, place).join(F.broadcast(parts), "_part").withColumn(name, (c(name) + c("_before")).cast("int")).drop("_part", "_before")


def let_workers_import(spark: SparkSession) -> None:
    """Put the library on the Python path of the workers if the driver found it by other means."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
