"""Registered queries against their SQL at the smallest scale; all of them with SINEW_ALL_QUERIES=1."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, differences  # noqa: E402

SF = Path("/root/testdata/sf0.001")
SAMPLE = [
    "assemble_features", "device_features", "drop_transitions", "label_windows", "device_state_timeline", "read_feature_dump",
    "session_zscore", "group_kfold", "score_ensemble", "smooth_vote_debounce", "write_filter", "classification_report", "stream_smooth",
]

pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("SINEW_ALL_QUERIES") else SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert differences(entry.queries()[name](spark, str(SF)).toPandas(), con.sql(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 71
