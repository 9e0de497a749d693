"""Sinks: Parquet with provenance, per-field overwrites, nested JSON of the best objects, slim CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_with_provenance(df: DataFrame, path: str) -> None:
    """Write a table, and beside it one row with its row count and columns, counted in the same pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").parquet(path)
    row = [(path.rsplit("/", 1)[-1], seen.get["n_rows"], ",".join(df.columns))]
    df.sparkSession.createDataFrame(row, "name string, n_rows long, columns string").coalesce(1).write.mode("overwrite").json(f"{path}.provenance")


def write_field(df: DataFrame, path: str, field: str) -> None:
    """Replace the rows of one field only, also by none: each field is a folder of its own."""
    df.write.mode("overwrite").parquet(f"{path}/field={field}")


def write_best_curves(ranked: DataFrame, epochs: DataFrame, path: str, n: int, score: str = "score", key: str = "source_id") -> None:
    """The n best sources with their epochs in order, as nested JSON."""
    best = ranked.orderBy(F.desc(score), key).limit(n)
    points = epochs.join(F.broadcast(best.select(key)), key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("mjd", "mag"))).alias("epochs"))  # n rows
    best.join(points, key, "left").coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """Scalar columns as CSV with a header."""
    bulky = [n for n, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    df.drop(*bulky, *drop).write.mode("overwrite").option("header", True).csv(path)
