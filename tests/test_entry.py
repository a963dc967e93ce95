"""The driver contract: schemas of Spark and SQL agree on a small table, rows too."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tremorlake import all_queries as reference

SF = "/root/testdata/sf0.001"
SAMPLE = ["catalog_view", "mw_conversion", "matched_observations", "canonical_events", "mc_gft", "b_value_by_mc", "spatial_poisson", "backtest_scores", "roc_pr", "block_bootstrap", "etas_intensity", "omori_ratio", "features_all", "features_labelled", "ledger_records", "ledger_summary", "ledger_integrity", "etas_transformed_times", "mc_recommended", "temporal_poisson", "poisson_intervals", "calibration_errors", "origin_context", "residual_gaps", "provenance_steps", "range_validation"]


def plain(rows):
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    return sorted(tuple(map(text, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    frame = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert plain(frame.select(*columns).collect()) == plain(found.fetchall())


def test_names():
    assert set(reference.SQL) <= set(reference.QUERIES) <= set(entry.queries())
