"""Decoding, validation and scores: exact cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trackloom.functions.frames import Track
from trackloom.operators import decode, evaluate

t = Track(("video",))


def frames(spark, rows, names):
    return spark.createDataFrame([(1, *r) for r in rows], f"video int, frame bigint, {', '.join(f'{n} double' for n in names)}")


def got(df):
    return sorted((r.action, r.start_frame, r.stop_frame) for r in df.collect())


def test_constant_run_keeps_its_last_frame(spark):
    df = frames(spark, [(100, 0.9), (101, 0.9), (102, 0.9)], ["rear"])
    assert got(decode.intervals(df, t, {"rear": 0.5})) == [("rear", 100, 103)]


def test_gaps_and_threshold(spark):
    df = frames(spark, [(1, 0.9), (2, 0.9), (5, 0.9), (6, 0.1), (7, 0.9)], ["rear"])
    assert got(decode.intervals(df, t, {"rear": 0.5})) == [("rear", 1, 3), ("rear", 5, 6), ("rear", 7, 8)]


def test_winner_has_its_own_threshold(spark):
    df = frames(spark, [(5, 0.8, 0.7), (6, 0.1, 0.9)], ["rear", "freeze"])
    assert got(decode.intervals(df, t, {"rear": 0.85, "freeze": 0.5})) == [("freeze", 6, 7)]


def test_first_of_equal_probabilities_wins(spark):
    df = frames(spark, [(1, 0.6, 0.6)], ["b", "a"])
    assert got(decode.intervals(df, t, {"b": 0.5, "a": 0.5})) == [("b", 1, 2)]


@pytest.mark.parametrize("bad", [float("nan"), 1.1, -0.1, None])
def test_invalid_probabilities_raise(spark, bad):
    with pytest.raises(Exception, match="no probability"):
        decode.intervals(frames(spark, [(1, bad)], ["rear"]), t, {"rear": 0.5}).collect()


def test_legacy_loses_the_last_run_and_ignores_gaps(spark):
    df = frames(spark, [(1, 0.9), (2, 0.9), (9, 0.9), (10, 0.1), (11, 0.9)], ["rear"])
    assert got(decode.legacy(df, t, {"rear": 0.5})) == [("rear", 1, 10)]


def _found(spark, rows):
    return spark.createDataFrame([(1, "mouse1", "self", *r) for r in rows], "video_id int, agent string, target string, action string, start_frame bigint, stop_frame bigint")


def _problems(spark, rows):
    allowed = spark.createDataFrame([(1, "mouse1", "self", "rear")], "video_id int, agent string, target string, action string")
    spans = spark.createDataFrame([(1, 0, 99)], "video_id int, low bigint, high bigint")
    return {r.problem: r.n for r in decode.validation(_found(spark, rows), allowed, spans).collect()}


def test_validation(spark):
    assert _problems(spark, [("rear", 0, 3), ("rear", 4, 10)]) == {}
    assert _problems(spark, [("rear", 0, 3), ("rear", 2, 10)]) == {"overlap": 1}
    assert _problems(spark, [("invented", 0, 3)]) == {"not_labelled": 1}
    assert _problems(spark, [("rear", 5, 5), ("rear", 90, 101)]) == {"reversed": 1, "out_of_range": 1}
    assert _problems(spark, [("rear", 0, None)])["null"] == 1
    with pytest.raises(ValueError, match="overlap 1"):
        allowed = _found(spark, [("rear", 0, 1)]).select("video_id", "agent", "target", "action")
        decode.validate(_found(spark, [("rear", 0, 3), ("rear", 2, 10)]), allowed, spark.createDataFrame([(1, 0, 99)], "video_id int, low bigint, high bigint"))


def test_greedy_overlaps(spark):
    df = _found(spark, [("rear", 0, 5), ("rear", 3, 8), ("rear", 5, 6), ("rear", 5, 9), ("rear", 6, 7)])
    assert got(decode.drop_overlaps(df, ["video_id", "agent", "target"])) == [("rear", 0, 5), ("rear", 5, 6), ("rear", 6, 7)]


def test_no_rows(spark):
    df = frames(spark, [], ["rear"])
    assert got(decode.intervals(df, t, {"rear": 0.5})) == []
    assert evaluate.f1_at(spark.createDataFrame([], "label int, prediction double"), 0.5).first().f1 == 0


def test_threshold_grid_agrees_with_counting(spark):
    rows = [(k % 3 == 0, ((k * 37) % 101) / 100) for k in range(300)]
    df = spark.createDataFrame([(int(a), b) for a, b in rows], "label int, prediction double")
    for r in evaluate.threshold_grid(df, 100).collect():
        cut = round(r.threshold * 100) / 100
        assert r.tp == sum(1 for a, b in rows if a and b >= cut) and r.fp == sum(1 for a, b in rows if not a and b >= cut), cut


def test_best_threshold_is_the_smallest_of_equal_ones(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.1)], "label int, prediction double")
    best = evaluate.best_threshold(df).first()
    assert (best.threshold, best.f1) == (0.11, 1.0)


def test_gaussian_mirrors_the_ends(spark):
    import numpy as np

    tracks = {n: [float((7 * k * k + n) % 11) for k in range(n)] for n in (1, 2, 5, 7, 8, 9, 10, 16, 17, 18, 40)}
    df = spark.createDataFrame([(n, k, v) for n, x in tracks.items() for k, v in enumerate(x)], "video int, frame bigint, v double")
    found = decode.gaussian(df, t, {"s": "v"}).orderBy("video", "frame").collect()
    w = np.exp(-0.5 * (np.arange(-8, 9) / 2) ** 2)
    for n, x in tracks.items():
        padded = np.pad(x, 8, mode="symmetric")
        assert np.allclose([r.s for r in found if r.video == n], [(padded[k : k + 17] * w).sum() / w.sum() for k in range(n)])


def test_gaussian_knows_nothing_near_a_missing_value(spark):
    df = spark.createDataFrame([(1, k, None if k == 20 else 1.0) for k in range(60)], "video int, frame bigint, v double")
    found = decode.gaussian(df, t, {"s": "v"}).orderBy("frame").collect()
    assert [r.frame for r in found if r.s is None] == list(range(12, 29))
    assert all(abs(r.s - 1) < 1e-12 for r in found if r.s is not None)
