"""Shared helpers: tables written to the cluster's shared folder, and text utilities."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. lower() is much faster than translate(), and equal unless other capitals occur."""
    other_capitals = c.rlike(r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]")
    return F.when(other_capitals, F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def let_workers_import(spark: SparkSession) -> None:
    """Put the repository on the Python path of the workers if the driver found it by other means."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process (tests) under a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="skysift-"))
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/skysift-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column has."""
    used = {x.lower() for x in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def with_row(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written with a number for each row, and the number's column, by a name that no other column has.

    The numbers are written once, so that all later passes see the same ones.
    """
    name = fresh(df, "row")
    return written(df.withColumn(name, F.monotonically_increasing_id())), name


def written(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}.parquet"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
