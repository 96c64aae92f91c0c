"""Windows and missing data: exact cases, and pandas where it defines them."""

from __future__ import annotations

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackloom.functions.frames import Track, bins, flag, milliseconds, scale, scale_signed, wrap, wrap_mod
from trackloom.operators import missing

t = Track(("k",))
c = F.col


def series(spark, values):
    return spark.createDataFrame([(1, k, v) for k, v in enumerate(values)], "k int, frame bigint, v double")


def run(spark, values, make):
    return [r.o for r in series(spark, values).withColumn("o", make).orderBy("frame").collect()]


def same(a, b, digits=4):
    assert [None if x is None else round(x, digits) for x in a] == [None if x is None or x != x else round(float(x), digits) for x in b]


def test_scale():
    assert [scale(n, f) for n, f in ((5, 15), (15, 15), (1, 1), (10, None), (10, float("nan")))] == [2, 8, 1, 10, 10]
    assert scale_signed(-5, 15) == -2 and scale_signed(0, 60) == 0 and milliseconds(500, 25) == 12


@pytest.mark.parametrize(("w", "want"), [(4, [1, 3, 6, 10, 14, 18, 22, 26, 30, 24]), (5, [3, 6, 10, 15, 20, 25, 30, 35, 30, 24])])
def test_centred_sum(spark, w, want):
    assert run(spark, [float(k) for k in range(10)], t.sum(c("v"), w, True)) == want


V = [3.0, 1.0, 2.0, 2.0, None, 5.0, 2.0]


def test_percent_rank(spark):
    same(run(spark, V, t.percent_rank(c("v"), 3, 1)), [1, 0.5, 0.6667, 0.8333, None, 1, 0.5])


def ewm(spark, values, span):
    return [r.e for r in t.ewm(series(spark, values), {"e": ("v", span)}).orderBy("frame").collect()]


def test_ewm(spark):
    same(ewm(spark, V, 3), [3, 1.6667, 1.8571, 1.9333, 1.9333, 4.0213, 2.8559])
    same(ewm(spark, [None, *V], 1), pd.Series([None, *V], dtype=float).ffill())


@pytest.mark.parametrize("span", [3, 30])
def test_ewm_over_long_gaps_is_that_of_pandas(spark, span):
    """Gaps of less than a block, of several blocks, and values at the very ends of blocks."""
    gone = [*range(20, 900), *range(1000, 3000), *range(3100, 3460), *range(6890, 6910), *range(7000, 11_500)]
    v = [None if k in set(gone) else float((k * 37) % 101) for k in range(12_000)]
    same(ewm(spark, v, span), pd.Series(v, dtype=float).ewm(span=span, min_periods=1).mean(), 7)


def test_quantile(spark):
    assert run(spark, [1.0, 2.0, 4.0, 8.0], t.quantile(c("v"), 0.25, 4)) == [1, 1.25, 1.5, 1.75]


def test_rolling_like_pandas(spark):
    v = [None if k % 7 == 3 else float((k * 37) % 23) for k in range(60)]
    s = pd.Series(v, dtype=float)
    for w in (4, 5, 9):
        for centred in (False, True):
            mp = max(1, w // 4)
            roll = s.rolling(w, min_periods=mp, center=centred)
            same(run(spark, v, t.mean(c("v"), w, centred, 4)), roll.mean())
            same(run(spark, v, t.std(c("v"), w, centred, 4)), roll.std())
            same(run(spark, v, t.quantile(c("v"), 0.75, w, centred, 4)), roll.quantile(0.75))
    other = pd.Series([float((k * 17) % 11) for k in range(60)])
    df = spark.createDataFrame([(1, k, v[k], float(other[k])) for k in range(60)], "k int, frame bigint, v double, o double")
    same([r.r for r in df.withColumn("r", t.corr(c("v"), c("o"), 12, part=6)).orderBy("frame").collect()], s.rolling(12, min_periods=2).corr(other))


def test_long_mean_is_mean(spark):
    v = [None if k % 5 == 0 else float((k * 31) % 17) for k in range(40)]
    total, count = t.totals(c("v"))
    df = series(spark, v).withColumns({"a": total, "b": count})
    for w, centred in ((6, True), (7, True), (9, False), (100, True)):
        both = df.withColumns({"x": t.long_mean(c("a"), c("b"), w, centred, 2), "y": t.mean(c("v"), w, centred, mp=2)}).orderBy("frame").collect()
        same([r.x for r in both], [r.y for r in both], 9)


def test_bins_flags_and_angles(spark):
    assert run(spark, [0.5, 0.51, 2.0, 5.0, 5.1, None], bins(c("v"))) == [0, 1, 1, 2, 3, None]
    assert run(spark, [1.0, None], flag(c("v") > 0)) == [1.0, 0.0]
    same(run(spark, [4.0, -4.0, 1.0], wrap(c("v"))), [4 - 6.283185307, 6.283185307 - 4, 1])
    same(run(spark, [4.0, -4.0, 1.0], wrap_mod(c("v"))), [4 - 6.283185307, 6.283185307 - 4, 1])


def test_gap_fill(spark):
    v = [0.0, *[None] * 9, 10.0, *[None] * 4]
    df = missing.fill_gaps(series(spark, v), Track(("k",), "frame", 8.0), ["v"])
    assert [r.v for r in df.orderBy("frame").collect()] == [0, 1, 2, 2, 2, None, None, None, 10, 10, 10, 10, 10, None, None]


def test_long_tracks_cost_their_length(spark):
    """Twice the rows take about twice the time, not four times."""
    took = []
    for n in (20_000, 20_000, 80_000):
        df = spark.range(n).select(F.lit(1).alias("k"), c("id").alias("frame"), F.when(c("id") % 5 > 1, c("id").cast("double")).alias("v"))
        began = time.perf_counter()
        missing.interpolate(missing.fill_gaps(df, t, ["v"]), t, ["v"]).write.format("noop").mode("overwrite").save()
        total, count = t.totals(c("v"))
        df.withColumns({"a": total, "b": count}).select(t.long_mean(c("a"), c("b"), 240, True, 1)).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    assert took[2] < 8 * took[1]


def test_streak(spark):
    v = [None if m else 1.0 for m in (1, 1, 0, 1, 1, 1, 0, 0, 1)]
    df = missing.streak(series(spark, v), t, c("v").isNull(), "s")
    assert [r.s for r in df.orderBy("frame").collect()] == [1, 2, 0, 2, 3, 4, 0, 0, 2]


def test_state_changes(spark):
    v = [None, None, 1.0, 1.0, 2.0]
    assert run(spark, v, F.when(F.coalesce(c("v") != t.shift(c("v"), 1), F.lit(True)), 1.0).otherwise(0.0)) == [1, 1, 1, 0, 1]


def test_preprocess_keeps_rows_and_fills(spark):
    rows = [(1, k, 10.0 + k, 5.0, None if k in (4, 5) else 11.0 + k, 5.0) for k in range(20)]
    df = spark.createDataFrame(rows, "k int, frame bigint, body_center_x double, body_center_y double, nose_x double, nose_y double")
    made = missing.preprocess(df, t, ("body_center", "nose"), F.lit(1.0)).orderBy("frame").collect()
    assert len(made) == 20 and all(r.nose_x is not None for r in made) and round(made[10].nose_x, 6) == 21
