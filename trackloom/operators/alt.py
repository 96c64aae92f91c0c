"""The second family of features: distances in cm, speeds over times in milliseconds, longer contexts, lags.

Rolling figures need a value in every row of a centred window. Coordinates are pixels, ppc is pixels per cm. Lags of
the last stages are in rows whatever the frame rate. Wide tables have `<part>_x` of one mouse, or `A_<part>_x` and
`B_<part>_x` of agent and target; columns that come out name them `agent` and `target`. A comparison with NULL is NULL
here, and composites of one mouse take a missing figure as 0.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.frames import EPS, Track, milliseconds, norm, wrap_mod
from trackloom.operators.anchors import point
from trackloom.operators.reshape import densify

c = F.col
#: The parts of this family; pairs of parts that stretch; corners of the outline, in order; target parts that count as head and rear.
PARTS = ("ear_left", "ear_right", "nose", "neck", "body_center", "lateral_left", "lateral_right", "hip_left", "hip_right", "tail_base", "tail_tip")
SPEED_PARTS = ("ear_left", "ear_right", "tail_base", "body_center", "nose")
STRETCH = (("nose", "tail_base"), ("nose", "body_center"), ("nose", "hip_left"), ("nose", "hip_right"), ("lateral_left", "lateral_right"))
OUTLINE = ("nose", "ear_left", "hip_left", "tail_base", "hip_right", "ear_right")
HEAD, REAR = ("nose", "ear_left", "ear_right", "neck", "body_center"), ("hip_left", "hip_right", "tail_base")
SPEED_TIMES = (200, 500, 1000)
SIDES = (("A", "agent"), ("B", "target"))


class Units:
    """Distances in cm and figures per second on one track."""

    def __init__(self, t: Track, ppc: Column) -> None:
        self.t, self.ppc = t, ppc

    def rows(self, ms: float) -> int:
        return milliseconds(ms, self.t.fps)

    def away(self, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
        return norm(a[0] - b[0], a[1] - b[1]) / self.ppc

    def step(self, p: tuple[Column, Column]) -> Column:
        return norm(self.t.diff(p[0]), self.t.diff(p[1])) / self.ppc

    def mean(self, x: Column, ms: float) -> Column:
        return self.t.full(F.avg, x, self.rows(ms))

    def std(self, x: Column, ms: float) -> Column:
        return self.t.full(F.stddev_samp, x, self.rows(ms))


def with_parts(df: DataFrame, prefixes: tuple[str, ...] = ("",), parts: tuple[str, ...] = PARTS) -> DataFrame:
    """df with a NULL column for every coordinate that it lacks."""
    lacking = {f"{p}{part}_{k}": F.lit(None).cast("double") for p in prefixes for part in parts for k in "xy" if f"{p}{part}_{k}" not in df.columns}
    return df.withColumns(lacking) if lacking else df


def _tidy(df: DataFrame) -> DataFrame:
    return df.drop(*(k for k in df.columns if k.startswith("_")))


def self_features(df: DataFrame, t: Track, ppc: Column, arena: tuple[Column, Column] = (F.lit, F.lit), parts: tuple[str, ...] = PARTS) -> DataFrame:
    """First stage for one mouse. df also has group_x and group_y, the mean place of all mice."""
    u, width, height = Units(t, ppc), *arena
    nose, tail, body, ears = point("nose"), point("tail_base"), point("body_center"), (point("ear_left"), point("ear_right"))
    base = {f"_st_{p}": u.step(point(p)) for p in SPEED_PARTS}
    for p in ("nose", "ear_left", "tail_base"):
        base |= {f"_v{k}_{p}": t.diff(x) for k, x in zip("xy", point(p), strict=True)}
    base |= {"agent__heading": F.atan2(nose[1] - tail[1], nose[0] - tail[0]), "agent__body_length": u.away(nose, tail), "_jx": nose[0] - body[0], "_jy": nose[1] - body[1]}
    base |= {f"_st_{a}_{b}": u.away(point(a), point(b)) for a, b in STRETCH}
    made = df.withColumns(base)
    layer = {f"_acc_{p}": norm(t.diff(c(f"_vx_{p}")), t.diff(c(f"_vy_{p}"))) / ppc * t.rate**2 for p in ("nose", "ear_left", "tail_base")}
    layer |= {"_turn": F.abs(wrap_mod(t.diff(c("agent__heading")))) * t.rate, "_jit": norm(t.diff(c("_jx")), t.diff(c("_jy"))) / ppc * t.rate}
    layer |= {f"_sv_{a}_{b}": t.diff(c(f"_st_{a}_{b}")) * t.rate / ppc for a, b in STRETCH}  # already in cm, and divided again: as the models were made with
    made = made.withColumns(layer)
    out = {f"aa__{a}__{b}__distance": u.away(point(a), point(b)) for a, b in combinations(parts, 2)}
    out |= {f"agent__{p}__speed_{ms}ms": u.mean(c(f"_st_{p}") * t.rate, ms) for p in SPEED_PARTS for ms in SPEED_TIMES}
    w = u.rows(500)
    twice = reduce(lambda s, ab: s + ab[0][0] * ab[1][1] - ab[0][1] * ab[1][0], ((point(a), point(b)) for a, b in zip(OUTLINE, OUTLINE[1:] + OUTLINE[:1], strict=True)), F.lit(0.0))
    out |= {
        "agent__elongation": c("agent__body_length") / (u.away(*ears) + EPS),
        "agent__dist_to_wall": F.least(body[0], width * ppc - body[0], body[1], height * ppc - body[1]) / ppc,
        "agent__spine_angle": ((nose[0] - body[0]) * (tail[0] - body[0]) + (nose[1] - body[1]) * (tail[1] - body[1])) / (norm(nose[0] - body[0], nose[1] - body[1]) * norm(tail[0] - body[0], tail[1] - body[1]) + EPS),
        "agent__dist_to_group_center": u.away(body, (c("group_x"), c("group_y"))),
        "agent__tortuosity_500ms": t.full(F.sum, c("_st_body_center") * ppc, w) / (norm(t.diff(body[0], w), t.diff(body[1], w)) + EPS),
        "agent__nose_jitter_200ms": u.mean(c("_jit"), 200),
        "agent__ang_vel_200ms": u.mean(c("_turn"), 200),
        "agent__body_area": F.abs(twice) * 0.5 / (ppc * ppc),
    }
    for a, b in STRETCH:
        out |= {f"agent__{a}__{b}__stretch_vel_200ms": u.mean(c(f"_sv_{a}_{b}"), 200), f"agent__{a}__{b}__pose_jitter_500ms": u.std(c(f"_st_{a}_{b}"), 500)}
    out |= {f"agent__{short}__energy_200ms": u.mean(c(f"_acc_{p}"), 200) for p, short in (("nose", "nose"), ("ear_left", "ear_l"), ("tail_base", "tail"))}
    return _tidy(made.withColumns(out))


def self_second(df: DataFrame, t: Track) -> DataFrame:
    """Accelerations, steadiness of speed, and composites, on the columns of self_features()."""
    u = Units(t, F.lit(1.0))
    zero = lambda k: F.coalesce(c(k), F.lit(0.0))
    slow, fast = "agent__body_center__speed_500ms", "agent__body_center__speed_200ms"
    made = df.withColumns({"_a5": F.abs(t.diff(c(slow))) * t.rate, "_a2": F.abs(t.diff(c("agent__nose__speed_200ms"))) * t.rate})
    return _tidy(made.withColumns({
        "agent__body_center__accel_500ms": u.mean(c("_a5"), 500), "agent__nose__accel_200ms": u.mean(c("_a2"), 200), "agent__speed_std_500ms": u.std(c(fast), 500),
        "agent__interaction__grooming_ratio": zero("agent__nose_jitter_200ms") / (zero(fast) + 1),
        "agent__interaction__agility_index": zero(fast) * zero("agent__ang_vel_200ms"),
        "agent__interaction__rear_score": zero("agent__body_length") / (zero(slow) + 1),
    }))


def self_context(df: DataFrame, t: Track) -> DataFrame:
    """Mean and spread over a second of all columns of speed, energy or area; speed and acceleration some rows before and after."""
    u, out = Units(t, F.lit(1.0)), {}
    for k in [k for k in df.columns if any(s in k for s in ("speed", "energy", "area"))]:
        out |= {f"{k}_avg_1s": u.mean(c(k), 1000), f"{k}_std_1s": u.std(c(k), 1000)}
    for k, short in (("agent__body_center__speed_500ms", "speed"), ("agent__body_center__accel_500ms", "accel")):
        for n in (5, 10, 15):
            out |= {f"agent__{short}_lag_{n}": t.shift(c(k), n), f"agent__{short}_lead_{n}": t.shift(c(k), -n)}
    return df.withColumns(out)


def pair_features(df: DataFrame, t: Track, ppc: Column, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """First stage for agent and target."""
    u = Units(t, ppc)
    at = {w: {p: point(p, f"{w}_") for p in {*PARTS, *parts}} for w in "AB"}
    base = {f"_st_{w}_{p}": u.step(at[w][p]) * t.rate for w in "AB" for p in SPEED_PARTS}
    (ax, ay), (bx, by) = at["A"]["body_center"], at["B"]["body_center"]
    base |= {"_close": u.away((ax, ay), (bx, by)), "_rvx": t.diff(ax) - t.diff(bx), "_rvy": t.diff(ay) - t.diff(by)}
    base |= {f"{name}_heading": F.atan2(at[w]["nose"][1] - at[w]["tail_base"][1], at[w]["nose"][0] - at[w]["tail_base"][0]) for w, name in SIDES}
    made = df.withColumns(base).withColumn("_nearing", t.diff(c("_close")) * t.rate)
    away = lambda p, q: u.away(at["A"][p], at["B"][q])
    out = {f"at__{p}__{q}__dist": away(p, q) for p, q in product(parts, repeat=2)}
    out |= {"agent_nose__min_dist_to_target_head": F.least(*(away("nose", q) for q in HEAD)), "agent_nose__min_dist_to_target_rear": F.least(*(away("nose", q) for q in REAR))}
    out |= {f"{name}__{p}__speed_{ms}ms": u.mean(c(f"_st_{w}_{p}"), ms) for w, name in SIDES for p in SPEED_PARTS for ms in SPEED_TIMES}
    out |= {
        "relative_speed": norm(c("_rvx"), c("_rvy")) / ppc * t.rate,
        "agent_relative_heading": wrap_mod(c("agent_heading") - F.atan2(by - ay, bx - ax)),
        "mutual_facing_angle": F.abs(F.abs(c("agent_heading") - c("target_heading")) - math.pi),
        "approach_speed_200ms": u.mean(c("_nearing"), 200), "approach_speed_500ms": u.mean(c("_nearing"), 500),
    }
    for (me, name), (you, other) in (SIDES, SIDES[::-1]):
        nose, tail, body, there = at[me]["nose"], at[me]["tail_base"], at[me]["body_center"], at[you]["body_center"]
        hx, hy, tx, ty = nose[0] - tail[0], nose[1] - tail[1], there[0] - body[0], there[1] - body[1]
        along, across, size = hx * tx + hy * ty, hx * ty - hy * tx, norm(hx, hy)
        out |= {f"{name}_to_{other}__long_dist": along / (size + EPS) / ppc, f"{name}_to_{other}__lat_dist_signed": across / (size + EPS) / ppc, f"{name}_to_{other}__lat_dist": F.abs(across / (size + EPS) / ppc), f"{name}_facing_score": along / (size * norm(tx, ty) + EPS)}
        fx, fy, gx, gy = nose[0] - body[0], nose[1] - body[1], tail[0] - body[0], tail[1] - body[1]
        out |= {f"{name}_elongation": u.away(nose, tail) / (u.away(at[me]["ear_left"], at[me]["ear_right"]) + EPS), f"{name}_body_angle": (fx * gx + fy * gy) / (norm(fx, fy) * norm(gx, gy) + EPS)}
    return _tidy(made.withColumns(out))


def _one(condition: Column) -> Column:
    """1.0 or 0.0, NULL where unknown."""
    return condition.cast("int").cast("double")


def pair_second(df: DataFrame, t: Track) -> DataFrame:
    """Second to sixth stage: differences of speed, contact, composites, a second of context, lags, trend."""
    u = Units(t, F.lit(1.0))
    fast = [c(f"{who}__body_center__speed_200ms") for who in ("agent", "target")]
    slow = [c(f"{who}__body_center__speed_500ms") for who in ("agent", "target")]
    dist, near = "at__body_center__body_center__dist", "approach_speed_500ms"
    df = df.withColumns({
        "speed_diff_200ms": fast[0] - fast[1], "speed_diff_500ms": slow[0] - slow[1], "speed_ratio_200ms": fast[0] / (fast[1] + 0.1),
        "in_contact": _one(c(dist) < 5), "face_to_face": _one((c("mutual_facing_angle") < 0.5) & (c("at__nose__nose__dist") < 5)),
    })
    third = lambda *conditions: reduce(lambda a, b: a + b, (_one(x) * 0.33 for x in conditions))
    df = df.withColumns({
        "chase_score": third(c("speed_diff_200ms") > 0, c("agent_facing_score") > 0.5, c(near) < 0),
        "flee_score": third(c("speed_diff_200ms") < 0, c("target_facing_score") < 0, c(near) > 0),
        "sniff_score": (_one(c("agent_nose__min_dist_to_target_head") < 3) + _one(c("agent_nose__min_dist_to_target_rear") < 3)) * (1 / (fast[0] + 1)),
    })
    out = {}
    for k in (dist, near, "speed_diff_200ms", "chase_score"):
        out |= {f"{k}_avg_1s": u.mean(c(k), 1000), f"{k}_std_1s": u.std(c(k), 1000)}
    out |= {"dist_min_1s": t.full(F.min, c(dist), u.rows(1000)), "dist_max_1s": t.full(F.max, c(dist), u.rows(1000))}
    for n in (5, 10, 15, 30):
        for k, short in ((c(dist), "dist"), (c(near), "approach"), (slow[0], "agent_speed")):
            out |= {f"{short}_lag_{n}": t.shift(k, n), f"{short}_lead_{n}": t.shift(k, -n)}
    df = df.withColumns(out)
    return df.withColumns({"dist_change_1s": c("dist_lag_30") - c(dist), "approaching_trend": _one(c(f"{near}_avg_1s") < -0.5)})


def on_skeleton(features: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """Features on every frame from the first to the last of a key."""
    return densify(features, keys, frame)
