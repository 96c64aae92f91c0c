"""Missing keypoints: filling short gaps, figures of what is missing, and removal of outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.frames import EPS, Track, norm
from trackloom.operators import anchors
from trackloom.operators.anchors import point

c = F.col


def gap_limit(fps: float) -> int:
    return max(1, round(0.25 * fps)) if fps and fps > 0 else gap_limit(30.0)


def _interpolated(df: DataFrame, t: Track, columns: list[str], limit: int | None) -> DataFrame:
    """Linear between both neighbours of a gap, in its first limit rows; by position, not by frame number."""
    # what comes after is looked for from the end of the track: a frame up to its end would be read anew for every row
    before = t.over.rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*t.keys).orderBy(F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_row", F.row_number().over(t.over))
    near, far = {}, {}
    for k in columns:
        at = F.when(c(k).isNotNull(), c("_row"))
        near |= {f"_v0{k}": F.last(c(k), True).over(before), f"_r0{k}": F.last(at, True).over(before)}
        far |= {f"_v1{k}": F.last(c(k), True).over(after), f"_r1{k}": F.last(at, True).over(after)}
    ends = near | far
    df = df.withColumns(near).withColumns(far)
    out = {}
    for k in columns:
        step = (c(f"_v1{k}") - c(f"_v0{k}")) / (c(f"_r1{k}") - c(f"_r0{k}"))
        near = F.lit(True) if limit is None else c("_row") - c(f"_r0{k}") <= limit
        inner = c(f"_v0{k}").isNotNull() & c(f"_v1{k}").isNotNull() & near
        out[k] = F.when(c(k).isNotNull(), c(k)).when(inner, c(f"_v0{k}") + step * (c("_row") - c(f"_r0{k}")))
    return df.withColumns(out).drop("_row", *ends)


def fill_gaps(df: DataFrame, t: Track, columns: list[str]) -> DataFrame:
    """Short gaps filled, with L = a quarter of a second: the first L rows of a gap between two values are interpolated,
    then up to L rows take the value before, and then up to L the value after. So the ends of a long gap are filled too,
    and a gap of 3 L rows is filled whole."""
    limit = gap_limit(t.rate)
    df = _interpolated(df, t, columns, limit)
    df = df.withColumns({k: F.last(c(k), True).over(t.over.rowsBetween(-limit, 0)) for k in columns})
    return df.withColumns({k: F.first(c(k), True).over(t.over.rowsBetween(0, limit)) for k in columns})


def streak(df: DataFrame, t: Track, missing: Column, name: str) -> DataFrame:
    """Length of the run of missing rows so far; 0 where not missing. The valid row before a run counts in it, so a run
    starts at 2; one at the very beginning starts at 1."""
    made = df.withColumn("_ok", F.sum(F.when(missing, 0).otherwise(1)).over(t.over.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*t.keys, "_ok").orderBy(t.frame)
    return made.withColumn(name, F.when(missing, F.row_number().over(own)).otherwise(0).cast("double")).drop("_ok")


def _ok_count(parts: tuple[str, ...], prefix: str = "") -> Column:
    return reduce(lambda a, b: a + b, (F.when(anchors.ok(p, prefix), 1.0).otherwise(0.0) for p in parts), F.lit(0.0))


def features(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    one = lambda ok: F.when(ok, 1.0).otherwise(0.0)
    df = df.withColumns({"kp_ok_cnt": _ok_count(parts), "kp_missing_ratio": 1 - _ok_count(parts) / (max(len(parts), 1) + EPS), "nose_proxy_ok": one(anchors.nose_ok(parts)), "center_proxy_ok": one(anchors.centre_ok(parts))})
    df = streak(df, t, c("nose_proxy_ok") < 0.5, "nose_missing_streak")
    df = streak(df, t, c("center_proxy_ok") < 0.5, "center_missing_streak")
    out = {}
    for w in (20, 40, 60, 80) if section == 9 else (15, 30, 60, 120):
        out |= {f"kp_missing_m{w}": t.mean(c("kp_missing_ratio"), w, True, 5), f"nose_ok_m{w}": t.mean(c("nose_proxy_ok"), w, True, 5), f"center_ok_m{w}": t.mean(c("center_proxy_ok"), w, True, 5)}
    return df.withColumns(out)


def pair_features(df: DataFrame, t: Track, parts_a: tuple[str, ...], parts_b: tuple[str, ...]) -> DataFrame:
    one = lambda ok: F.when(ok, 1.0).otherwise(0.0)
    out = {}
    for who, parts in (("A", parts_a), ("B", parts_b)):
        p = f"{who}_"
        out |= {f"{who}_kp_missing_ratio": 1 - _ok_count(parts, p) / (max(len(parts), 1) + EPS), f"{who}_nose_proxy_ok": one(anchors.nose_ok(parts, p)), f"{who}_center_proxy_ok": one(anchors.centre_ok(parts, p))}
    df = df.withColumns(out)
    a, b = c("A_kp_missing_ratio"), c("B_kp_missing_ratio")
    df = df.withColumns({"AB_kp_missing_ratio_mean": (a + b) * 0.5, "AB_kp_missing_ratio_diff": a - b, "AB_both_center_ok": c("A_center_proxy_ok") * c("B_center_proxy_ok")})
    for who in "AB":
        df = streak(df, t, c(f"{who}_nose_proxy_ok") < 0.5, f"{who}_nose_missing_streak")
    return df.withColumns({f"AB_miss_m{w}": t.mean(c("AB_kp_missing_ratio_mean"), w, True, 5) for w in (15, 30, 60, 120)})


def drop_far_parts(df: DataFrame, parts: tuple[str, ...], ppc: Column, prefix: str = "", limit: float = 15.0) -> DataFrame:
    """A part over limit cm from body_center is none; without a distance it stays."""
    bx, by = point("body_center", prefix)
    out = {}
    for p in parts:
        if p != "body_center":
            x, y = point(p, prefix)
            far = norm(x - bx, y - by) / ppc > limit
            out |= {f"{prefix}{p}_x": F.when(far, None).otherwise(x), f"{prefix}{p}_y": F.when(far, None).otherwise(y)}
    return df.withColumns(out) if out else df


def drop_jumps(df: DataFrame, t: Track, parts: tuple[str, ...], ppc: Column, prefix: str = "", limit: float = 100.0) -> DataFrame:
    """A part that moved faster than limit cm/s since the row before is none; steps are taken before any is removed."""
    out = {}
    for p in parts:
        x, y = point(p, prefix)
        fast = norm(t.diff(x), t.diff(y)) / ppc * t.rate > limit
        out |= {f"{prefix}{p}_x": F.when(fast, None).otherwise(x), f"{prefix}{p}_y": F.when(fast, None).otherwise(y)}
    return df.withColumns(out)


def interpolate(df: DataFrame, t: Track, columns: list[str]) -> DataFrame:
    """Gaps between values interpolated whatever their length; the rest takes the column's mean."""
    df = _interpolated(df, t, columns, None)
    return df.withColumns({k: F.coalesce(c(k), F.avg(c(k)).over(t.whole)) for k in columns})


def smooth(df: DataFrame, t: Track, columns: list[str], rows: int = 7) -> DataFrame:
    """Centred mean of full windows; where there is none, the column's mean."""
    return df.withColumns({k: F.coalesce(t.full(F.avg, c(k), rows), F.avg(c(k)).over(t.whole)) for k in columns})


def preprocess(df: DataFrame, t: Track, parts: tuple[str, ...], ppc: Column, prefix: str = "") -> DataFrame:
    """Far parts, jumps, gaps and noise out, in this order."""
    columns = [f"{prefix}{p}_{k}" for p in parts for k in "xy"]
    df = drop_jumps(drop_far_parts(df, parts, ppc, prefix), t, parts, ppc, prefix)
    return smooth(interpolate(df, t, columns), t, columns)
