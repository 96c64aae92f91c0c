"""Decoding queries on values whose scores are no probabilities: the same rows as their SQL."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
#: Scores over 1 alone and beside others, below 0, none, and not a number; the rest are usual.
VALUES = [800.0, 903.15, 20.0, -900.0, None, float("nan"), float("inf"), 300.0, 684.1, 10.0]
KS = [1, 120, 200, 99, 76, 3, 150, None, 130, -40]


@pytest.fixture(scope="module")
def unbounded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("unbounded")
    rows = []
    for k in range(600):
        value = VALUES[k // 3 % len(VALUES)] if k % 4 else 49.5
        key = KS[k // 5 % len(KS)]
        rows.append((k, datetime(2024, 1, 1) + timedelta(seconds=k), k % 3, "view", value, "{}" if key is None else f'{{"k": {key}}}'))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / "events.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["crop_window", "decode_intervals"])
def test_scores_beyond_probabilities(spark, unbounded, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{unbounded}/events.parquet/*.parquet'")
    wanted = con.execute(f"select entity, action, start_frame, stop_frame from ({entry.oracle_sql()[name]})").fetchall()
    found = [tuple(r) for r in entry.queries()[name](spark, unbounded).select("entity", "action", "start_frame", "stop_frame").collect()]
    assert wanted and Counter(found) == Counter(wanted)
