"""Whole runs, and runs that are stopped and started again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skysift.functions.tables import shared_folder
from skysift.operators import runs, spectra
from skysift.streaming import twins

c = F.col


def test_a_stopped_run_goes_on(spark):
    path, made = shared_folder(spark), []

    def first():
        made.append("first")
        return spark.range(10)

    def second(of, fail):
        made.append("second")
        # a task that fails leaves a part of the table behind
        return of.withColumn("x", F.when(c("id") < 9, c("id") * 2).otherwise(F.raise_error(F.lit("killed")) if fail else F.lit(-1)))

    def run(fail):
        stages = runs.Stages(spark, path)
        one = stages.table("first", first)
        return stages.table("second", lambda: second(one, fail))

    with pytest.raises(Exception, match="killed"):
        run(True)
    assert runs.Stages(spark, path).manifest("first").first().n_rows == 10 and runs.Stages(spark, path).manifest("second") is None
    assert sorted(r.x for r in run(False).collect()) == [-1, *range(0, 18, 2)]
    assert made == ["first", "second", "second"]
    assert run(True).count() == 10 and made == ["first", "second", "second"]
    manifest = runs.Stages(spark, path).manifest("second").first()
    assert (manifest.n_rows, manifest.columns) == (10, "id,x")


def pixels(spark, n=24):
    rows = []
    for s in range(n):
        for i in range(90):
            line = 40.0 * 2.718 ** (-0.5 * ((i - 20 - 2 * (s % 20)) / 1.0) ** 2) if s % 2 else 0.0
            rows.append((s, i, 5000.0 + i, 100.0 + (i * 7 + s * 3) % 5 * 0.2 + line, 1.0))
    return spark.createDataFrame(rows, "spec_id long, pix int, wave double, flux double, ivar double")


def test_a_stream_of_spectra_ends_as_one_run(spark):
    p = pixels(spark)
    widths = p.select("spec_id").distinct().withColumn("sigma", F.lit(1.0))
    whole = spectra.classified(p, widths)
    want = [(r.spec_id, r.pix, r.score, r.hunt_rank) for r in spectra.run_candidates(whole).collect()]
    totals = {(r.reason, r.n) for r in spectra.run_totals(whole).collect()}
    assert len(want) >= 3

    folder, path = shared_folder(spark), shared_folder(spark)
    arrays = p.groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct("pix", "wave", "flux", "ivar"))).alias("p"))
    arrays.repartition(4).write.parquet(folder)

    def search(batch):
        own = batch.select("spec_id", F.explode("p").alias("q")).select("spec_id", "q.*")
        return spectra.classified(own, batch.select("spec_id").withColumn("sigma", F.lit(1.0)))

    twins.line_run(twins.stream(spark, folder, arrays.schema, 1), search, f"{path}/out", f"{path}/state").awaitTermination()
    lines, searched = twins.read_lines(spark, f"{path}/out")
    assert searched.first().n_searched == 24
    assert [(r.spec_id, r.pix, r.score, r.hunt_rank) for r in spectra.run_candidates(lines).collect()] == want
    assert {(r.reason, r.n) for r in spectra.run_totals(lines).collect()} == totals
    summary = spectra.run_summary(lines, searched).first()
    assert (summary.n_searched, summary.n_candidates) == (24, len(want))


def test_no_catalogue_means_no_novelty(spark):
    accelerations = spark.createDataFrame([(1, 5.0, 1.0, 0.01, 0.01, 10.0, 10.0, 1.0)], "source_id long, accel_ra double, accel_dec double, accel_ra_error double, accel_dec_error double, parallax double, phot_g_mean_mag double, bp_rp double")
    orbit = spark.createDataFrame([(2, 9.0, 0.0, 0.0, 9.0, 400.0, 2.0, 12.0, 9.0)], "source_id long, a_ti double, b_ti double, f_ti double, g_ti double, period double, parallax double, phot_g_mean_mag double, ruwe double")
    places = spark.createDataFrame([(2, 10.0, 10.0)], "source_id long, ra double, dec double")
    catalogue = lambda *rows: spark.createDataFrame(rows, "label string, id long, ra double, dec double")
    run = lambda t: runs.companion_run(accelerations, orbit, places, t)
    found = {name: [(r.in_literature, r.novel) for r in run(t)["dark"].collect()] for name, t in (("none", catalogue()), ("other", catalogue(("a", 7, 200.0, 0.0))), ("same", catalogue(("a", 2, 200.0, 0.0))))}
    if found["none"]:
        assert found == {"none": [(False, False)], "other": [(False, True)], "same": [(True, False)]}
    assert run(catalogue())["summary"].first().n_searched == 1
