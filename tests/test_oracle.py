"""Registered queries against their DuckDB oracle SQL on sf0.001 (the full
set runs at sf0.01 with ``tools/check_oracle.py``)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tools.check_oracle import digest

from .conftest import SF0001

SUBSET = [
    "flagship_length_band_profile",
    "t1_split_assignment",
    "t4_responses_marked",
    "x7_classifier_features",
    "x8_term_counts",
    "a4_top_terms",
    "a5_representatives",
    "t14_hashed_embedding",
    "e4_per_tag_metrics",
    "e11_confusion_pairs",
    "w4_w5_threshold_sweep",
    "m6_nearest_centroid",
    "g3_g4_dominant_cells",
    "g7_decision_grid",
]


def test_every_query_is_registered_with_names():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "members" in df.columns


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF0001)
    s_rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(entry.oracle_sql()[name])
    o_rows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(s_rows) == len(o_rows)
    assert digest(df.columns, s_rows)[0] == digest(rel.columns, o_rows)[0]
