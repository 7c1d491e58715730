"""Registered queries against their SQL twins on the smallest tables.

A sample of every family runs by default; TRACKFRAME_ALL=1 runs all of them.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect

SAMPLE = (
    "match_points", "match_boxes", "nearest_within", "join_scores", "track_metrics", "frame_summary", "association_diagnostics", "fit_velocity_seconds",
    "forecast_error", "hash_split", "leakage_filter", "near_duplicates", "assess", "check_detections", "check_sequences", "sequence_outcome",
    "frame_stats", "component_features", "temporal_residual", "translation_consensus", "track_snapshots", "read_box_csv", "hash_manifest", "frame_counts_stream",
)
NAMES = sorted(contract.oracle_sql()) if os.environ.get("TRACKFRAME_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    _, problem = compare(contract.queries()[name](spark, sf), contract.oracle_sql()[name], con)
    assert problem is None, problem


def test_every_sql_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 15 and df.columns[0] == "sequence_id"
