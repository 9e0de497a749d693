"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from skysift import plans
from skysift.plans.bindings import TABLES

DATA = "/root/testdata/sf0.001"
#: A query of each kind; the others run the same operators.
NAMES = (
    "sed_excess", "funnel_reasons", "funnel_counts", "dust_fit", "analyze_summary", "indicator_axes", "dip_events", "dip_summary", "dip_periods", "flash_summary", "fade_detrended", "shared_epochs", "fractional_rms",
    "band_coincidence", "sky_nearest", "known_objects", "literature_match", "blend_verdicts", "planet_hosts", "acceleration_rank", "orbit_masses", "close_encounters", "regime_sweep", "destinations",
    "line_triage", "excluded_bandwidth", "redshift_families", "completeness_map", "field_limits", "locus_excess", "combined_p_values",
    "object_classes", "trend_verdicts", "vet_verdicts", "vet_run", "frame_fades", "frame_scatter", "assembled_funnel", "blend_counts", "variability_periods", "shortlist_variability", "encounter_followup", "matched_null",
    "cluster_tests", "line_search", "absorption_search", "spectra_run", "spectra_totals", "shape_run", "encounter_summary", "companion_candidates", "science_candidates",
    "field_targets", "cone_stars", "anchor_shell", "orbit_solutions", "acceleration_solutions", "spectrum_sources", "spectrum_ids", "near_infrared", "quality_columns", "nearby_planets", "field_candidates", "nearest_sources",
    "enriched_shortlist", "confirm_shortlist", "follow_up_input", "clean_scores",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = duck.execute(plans.ORACLE_SQL[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    want = Counter(tuple(plain(r[found.index(x)]) for x in columns) for r in result.fetchall())
    assert Counter(tuple(plain(r[x]) for x in columns) for r in df.collect()) == want


def test_every_query_has_sql():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) <= {"field_search"}
