"""The registered queries: names, oracles and a sample compared with DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="needs the driver's test tables")
SAMPLE = [
    "p1_plausibility", "u1_deduplicate", "d1_mad_log_scores", "a18_cleaning_report", "w1_carry_forward", "u6_three_frequencies",
    "a14_leadtime_by_day", "d4_series_anomalies", "m8_compare_levels", "w12_request_intervals", "x33_url_verdicts", "i7_route_weights",
    "r1_idempotent_raw_ingest", "r3_incremental_daily_index", "r3_incremental_elementary", "r3_incremental_routes", "r2_late_observations",
    "x11_depth_overflow", "n5_seasonal_damped_trend", "n10_recommendation", "o4_sector_sort_modes",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 200


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 30 and all(0 < r.coverage_ratio <= 1 for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
