"""Scans, sinks and the contract of the main table."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from skysift.operators import catalog
from skysift.plans.bindings import bound
from skysift.sources import scans, sinks

DATA = "/root/testdata/sf0.001"


def test_ingest_checks_and_fills(spark):
    cols = ", ".join(f"{n} double" for n in scans.REQUIRED)
    df = scans.ingest(spark.createDataFrame([tuple([1.0, math.nan, math.inf] + [2.0] * (len(scans.REQUIRED) - 3))], cols))
    row = df.first()
    assert row.ra is None and row.dec is None and row.cc_flags == "0000" and row.gaia_nn_arcsec == math.inf
    with pytest.raises(ValueError, match="teff"):
        scans.ingest(df.drop("teff"))


def test_filters_reach_the_scan(spark):
    stars = spark.read.parquet(f"{DATA}/lineitem.parquet").filter("l_quantity > 40").select("l_orderkey")
    plan = stars._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40" in plan and "l_extendedprice" not in plan


def test_parquet_with_provenance(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_with_provenance(spark.range(5).withColumn("x", F.lit(1)), path)
    assert spark.read.parquet(path).count() == 5
    row = spark.read.json(f"{path}.provenance").first()
    assert (row.n_rows, row.columns) == (5, "id,x")


def test_empty_field_clears_only_itself(spark, tmp_path):
    path = str(tmp_path / "fields")
    for field, n in (("a", 3), ("b", 4), ("a", 0)):
        sinks.write_field(spark.range(n), path, field)
    back = spark.read.option("basePath", path).parquet(f"{path}/field=*")
    assert {r.field: r["count"] for r in back.groupBy("field").count().collect()} == {"b": 4}


def test_best_curves_and_csv(spark, tmp_path):
    epochs = spark.createDataFrame([(i % 3, float(9 - i), 12.0 + i) for i in range(9)], "source_id long, mjd double, mag double")
    ranked = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.1)], "source_id long, score double")
    sinks.write_best_curves(ranked, epochs, str(tmp_path / "best"), 2)
    rows = [json.loads(x) for p in (tmp_path / "best").glob("part-*") for x in p.read_text().splitlines()]
    assert [r["source_id"] for r in rows] == [1, 0] and [e["mjd"] for e in rows[0]["epochs"]] == sorted(e["mjd"] for e in rows[0]["epochs"])
    sinks.write_csv(ranked.withColumn("bulky", F.array(F.lit(1))), str(tmp_path / "field1/c"))
    back = scans.union_of_fields(spark, str(tmp_path / "field1/c/*.csv"), "source_id long, score double", "dip")
    assert back.count() == 3 and back.first().cand_type == "dip" and back.first().field_dir == "c"


def test_funnel_is_monotone_and_partition_invariant(spark):
    df = bound(spark, DATA, "catalogue")
    got = [[tuple(r) for r in catalog.funnel_counts(catalog.analyze(df.repartition(n))).orderBy("step").collect()] for n in (1, 7)]
    assert got[0] == got[1] and [r[2] for r in got[0]] == sorted((r[2] for r in got[0]), reverse=True)
