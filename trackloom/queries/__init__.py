"""Queries that apply the operators to the driver's tables, each with SQL for the same rows.

The tables hold no poses, so events stand for them: a user is a mouse, its events in order of time are the frames, and
keypoints are made of an event's value and k. All rows take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.queries import decoding, features, tables, windows

MODULES = (decoding, windows, features, tables)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
