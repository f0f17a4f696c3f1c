"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
CHEAP = [
    "time_bursts", "similarity_bursts", "verdicts_time", "verdicts_similarity", "top_keepers", "frame_id", "slug", "csv_cells",
    "size_and_clock_text", "capture_time", "foreground_faces", "eye_open_fraction", "locked_region", "laplacian_variance", "laplacian_tiles",
    "exposure_fractions", "dhash", "tone_histogram", "manifest_parse", "cache_fill", "cache_latest", "route_events",
    "source_stats", "unique_names", "live_time_bursts", "incremental_measure",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.canonical(got) == check.canonical(want)


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["rel", "filename", "burst_id"] and df.count() == 1000
