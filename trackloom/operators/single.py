"""Features of one mouse in a video. Each takes a wide table (`<part>_x`, `<part>_y`), its Track and the parts it has,
and adds columns; what needs a window over a window is a layer of its own.

Speeds are in cm/s. A figure is NULL where an input is; a flag is 0.0 there. Without the parts that a family needs, the
table comes back as it is. section 9 has shorter windows, as its videos are slower.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.frames import EPS, Track, bins, cosine, flag, norm, scale_signed, wrap
from trackloom.operators import anchors
from trackloom.operators.anchors import point

c = F.col


def windows(section: int, usual: tuple[int, ...], nine: tuple[int, ...]) -> tuple[int, ...]:
    return nine if section == 9 else usual


def _with_centre(df: DataFrame, parts: tuple[str, ...]) -> DataFrame | None:
    at = anchors.centre(parts)
    return None if at is None else df.withColumns({"_cx": at[0], "_cy": at[1]})


def squared(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return dx * dx + dy * dy


def squared_distances(df: DataFrame, declared: tuple[str, ...], parts: tuple[str, ...]) -> DataFrame:
    """`a+b`: squared distance of every two declared parts; NULL where the table lacks one."""
    have = set(parts)
    return df.withColumns({f"{a}+{b}": squared(*point(a), *point(b)) if {a, b} <= have else F.lit(None).cast("double") for a, b in combinations(declared, 2)})


def elongation(df: DataFrame) -> DataFrame:
    """Of squared distances, as squared_distances() has them."""
    need = ("nose+tail_base", "ear_left+ear_right")
    return df.withColumn("elong", c(f"`{need[0]}`") / (c(f"`{need[1]}`") + EPS)) if set(need) <= set(df.columns) else df


def core(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    """Displacements of ears and tail, ear distance at offsets, its steadiness, body angle, nose-tail lengths."""
    have, out = set(parts), {}
    if {"ear_left", "ear_right"} <= have:
        lag = t.ws(10)
        (lx, ly), (rx, ry) = point("ear_left"), point("ear_right")
        if "tail_base" in have:
            tx, ty = point("tail_base")
            for name, (x, y), (px, py) in (("sp_lf", (lx, ly), (lx, ly)), ("sp_rt", (rx, ry), (rx, ry)), ("sp_lf2", (lx, ly), (tx, ty)), ("sp_rt2", (rx, ry), (tx, ty))):
                out[name] = squared(x, y, t.shift(px, lag), t.shift(py, lag))
        df = df.withColumn("_ear", norm(lx - rx, ly - ry))
        for off in (-30, -20, -10, 10, 20, 30):
            out[f"ear_o{off}"] = t.shift(c("_ear"), -scale_signed(off, t.fps))
        out["ear_con"] = t.std(c("_ear"), 30, True, mp=1) / (t.mean(c("_ear"), 30, True, mp=1) + EPS)
    front, at = anchors.nose(parts), anchors.centre(parts)
    if "tail_base" in have and front is not None:
        (nx, ny), (tx, ty) = front, point("tail_base")
        if at is not None:
            bx, by = at
            out["body_ang"] = cosine(nx - bx, ny - by, tx - bx, ty - by)
        df = df.withColumn("_nt", norm(nx - tx, ny - ty))
        for n in (10, 20, 40):
            out[f"nt_lg{n}"] = t.shift(c("_nt"), t.ws(n))
            out[f"nt_df{n}"] = c("_nt") - t.shift(c("_nt"), t.ws(n))
    return df.withColumns(out).drop("_ear", "_nt") if out else df


def position(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    """Mean and spread of the centre, its range (clipped to the 1 % and 99 % quantiles of the whole track), displacement and activity."""
    made = _with_centre(df, parts)
    if made is None:
        return df
    clip = {}
    for k in "xy":
        low, high = (F.percentile(c(f"_c{k}"), [0.01, 0.99]).over(t.whole)[j] for j in (0, 1))
        clip[f"_k{k}"] = F.when(c(f"_c{k}").isNotNull(), F.greatest(F.least(c(f"_c{k}"), high), low))
    made = made.withColumns(clip | {"_dx": t.diff(c("_cx")), "_dy": t.diff(c("_cy"))})
    out = {}
    for w in windows(section, (15, 30, 60, 120), (5, 15, 30, 60)):
        for k in "xy":
            out[f"c{k}_m{w}"] = t.mean(c(f"_c{k}"), w, True)
            out[f"c{k}_s{w}"] = t.std(c(f"_c{k}"), w, True)
            out[f"{k}_rng{w}"] = t.most(c(f"_k{k}"), w, True) - t.least(c(f"_k{k}"), w, True)
        sx, sy = t.sum(c("_dx"), w), t.sum(c("_dy"), w)
        out[f"disp{w}"] = F.sqrt(sx * sx + sy * sy)
        out[f"act{w}"] = F.sqrt(t.var(c("_dx"), w) + t.var(c("_dy"), w))
    return made.withColumns(out).drop("_cx", "_cy", "_kx", "_ky", "_dx", "_dy")


def curvature(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    made = _with_centre(df, parts)
    if made is None:
        return df
    made = made.withColumns({"_vx": t.diff(c("_cx")), "_vy": t.diff(c("_cy"))})
    made = made.withColumns({"_ax": t.diff(c("_vx")), "_ay": t.diff(c("_vy")), "_turn": F.abs(t.diff(F.atan2("_vy", "_vx")))})
    v = norm(c("_vx"), c("_vy"))
    made = made.withColumn("_curv", F.abs(c("_vx") * c("_ay") - c("_vy") * c("_ax")) / (v * v * v + EPS))
    out = {f"curv_mean_{w}": t.mean(c("_curv"), w, part=5) for w in windows(section, (15, 30, 60, 120), (25, 50, 75))}
    out |= {f"turn_rate_{w}": t.sum(c("_turn"), w, part=5) for w in windows(section, (15, 30, 60, 120), (30,))}
    return made.withColumns(out).drop("_cx", "_cy", "_vx", "_vy", "_ax", "_ay", "_turn", "_curv")


def speed(df: DataFrame, t: Track, parts: tuple[str, ...], name: str = "_speed") -> DataFrame | None:
    made = _with_centre(df, parts)
    return None if made is None else made.withColumn(name, norm(t.diff(c("_cx")), t.diff(c("_cy"))) * t.rate).drop("_cx", "_cy")


def multiscale(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    """Mean, spread and quartiles of speed, where the track is as long as the window; ratio of the shortest to the longest mean."""
    made = speed(df, t, parts)
    if made is None:
        return df
    sizes, out = windows(section, (15, 30, 60, 120), (20, 40, 60, 80)), {}
    made = made.withColumn("_n", F.count(F.lit(1)).over(t.whole))
    for w in sizes:
        fits = c("_n") >= t.ws(w)
        q25, q75 = (t.quantile(c("_speed"), q, w, part=4) for q in (0.25, 0.75))
        out |= {f"sp_m{w}": F.when(fits, t.mean(c("_speed"), w, part=4)), f"sp_s{w}": F.when(fits, t.std(c("_speed"), w, part=4)), f"sp_q25_{w}": F.when(fits, q25), f"sp_q75_{w}": F.when(fits, q75), f"sp_iqr{w}": F.when(fits, q75 - q25)}
    made = made.withColumns(out)
    return made.withColumn("sp_ratio", c(f"sp_m{sizes[0]}") / (c(f"sp_m{sizes[-1]}") + EPS)).drop("_speed", "_n")


def states(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    """Share of time in each speed state, and number of changes; a change to or from an unknown state counts, as does the first row."""
    made = speed(df, t, parts)
    if made is None:
        return df
    made = made.withColumn("_state", bins(t.mean(c("_speed"), 15, part=3)))
    made = made.withColumn("_change", F.when(F.coalesce(c("_state") != t.shift(c("_state"), 1), F.lit(True)), 1.0).otherwise(0.0))
    made, out = made.withColumn("_n", F.count(F.lit(1)).over(t.whole)), {}
    for w in windows(section, (15, 30, 60, 120), (20, 40, 60, 80)):
        fits = c("_n") >= t.ws(w)
        out |= {f"s{k}_{w}": F.when(fits, t.mean(flag(c("_state") == k), w, part=5)) for k in range(4)} | {f"trans_{w}": F.when(fits, t.sum(c("_change"), w, part=5))}
    return made.withColumns(out).drop("_speed", "_state", "_change", "_n")


def long_range(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    made = _with_centre(df, parts)
    if made is None:
        return df
    made = made.withColumn("_speed", norm(t.diff(c("_cx")), t.diff(c("_cy"))) * t.rate)
    out = {}
    for w in (30, 60, 120):
        mp = max(5, t.ws(w) // 6)
        out |= {f"{k}_ml{w}": t.mean(c(f"_c{k}"), w, mp=mp) for k in "xy"}
        out[f"sp_pct{w}"] = t.percent_rank(c("_speed"), w, mp)
    made = t.ewm(made.withColumns(out), {f"{k}_e{w}": (f"_c{k}", t.ws(w)) for w in (30, 60, 120) for k in "xy"})
    return made.drop("_cx", "_cy", "_speed")


def steadiness(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    have, out, mp = set(parts), {}, t.ws(5)
    if {"ear_left", "ear_right"} <= have:
        x, y = anchors.middle(point("ear_left"), point("ear_right"))
        sx, sy = t.std(x, 30, mp=mp), t.std(y, 30, mp=mp)
        out["ear_mid_std"] = F.sqrt(sx * sx + sy * sy)
    if {"nose", "tail_base"} <= have:
        (nx, ny), (tx, ty) = point("nose"), point("tail_base")
        out["nose_tail_length_std"] = t.std(norm(nx - tx, ny - ty), 30, mp=mp)
    return df.withColumns(out) if out else df


def head_elevation(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    front, at = anchors.nose(parts), anchors.centre(parts)
    if section <= 3 or section == 8 or front is None or at is None:
        return df
    out = {}
    for w in (10, 20, 30):
        out |= {f"head_elev_mean_{w}": t.mean(front[1] - at[1], w, mp=t.ws(w)), f"head_elev_std_{w}": t.std(front[1] - at[1], w, mp=t.ws(w))}
        if "tail_base" in parts:
            out[f"body_vert_{w}"] = t.mean(front[1] - point("tail_base")[1], w, mp=t.ws(w))
    return df.withColumns(out)


def body_width(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    if section == 3 or not {"lateral_left", "lateral_right"} <= set(parts):
        return df
    (lx, ly), (rx, ry) = point("lateral_left"), point("lateral_right")
    made = df.withColumn("_width", norm(lx - rx, ly - ry))
    made = made.withColumn("_step", t.diff(c("_width")))
    out = {}
    for w in (15, 30, 60, 120):
        out |= {f"body_width_mean_{w}": t.mean(c("_width"), w, mp=t.ws(w)), f"body_width_std_{w}": t.std(c("_width"), w, mp=t.ws(w)), f"body_width_change_{w}": t.mean(c("_step"), w, mp=t.ws(w))}
    return made.withColumns(out).drop("_width", "_step")


def pose_shape(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    """Triangle of nose, centre and tail."""
    front, at = anchors.nose(parts), anchors.centre(parts)
    if front is None or at is None or "tail_base" not in parts:
        return df
    (nx, ny), (cx, cy), (tx, ty) = front, at, point("tail_base")
    a, b, d = norm(nx - cx, ny - cy), norm(cx - tx, cy - ty), norm(nx - tx, ny - ty)
    area = F.abs((nx - cx) * (ty - cy) - (ny - cy) * (tx - cx)) * 0.5
    around = a + b + d
    made = df.withColumns({"tri_area": area, "tri_front_back_ratio": a / (b + EPS), "tri_compactness": area / (around * around + EPS)})
    out = {}
    for w in windows(section, (15, 30, 60), (15, 30)):
        out |= {f"tri_area_m{w}": t.mean(c("tri_area"), w, True, 4), f"tri_area_s{w}": t.std(c("tri_area"), w, True, 4)}
    return made.withColumns(out)


def head_apart(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    """Motion of the head against the body."""
    front, at = anchors.nose(parts), anchors.centre(parts)
    if front is None or at is None:
        return df
    sizes = windows(section, (15, 30, 60), (30, 60))
    made = df.withColumns({"_rx": front[0] - at[0], "_ry": front[1] - at[1], "_cx": at[0], "_cy": at[1]})
    made = made.withColumns({
        "head_rel_speed": norm(t.diff(c("_rx")), t.diff(c("_ry"))) * t.rate,
        "_body": norm(t.diff(c("_cx")), t.diff(c("_cy"))) * t.rate,
        "head_turn_speed": F.abs(wrap(t.diff(F.atan2("_ry", "_rx")))) * t.rate,
    })
    out = {"head_body_speed_ratio": c("head_rel_speed") / (c("_body") + EPS)}
    for w in sizes:
        out |= {f"head_rel_sp_m{w}": t.mean(c("head_rel_speed"), w, True, 4), f"head_rel_sp_s{w}": t.std(c("head_rel_speed"), w, True, 4)}
        out |= {f"head_turn_m{w}": t.mean(c("head_turn_speed"), w, True, 4), f"head_turn_s{w}": t.std(c("head_turn_speed"), w, True, 4), f"head_turn_sum{w}": t.sum(c("head_turn_speed"), w, True, 4)}
    if {"ear_left", "ear_right"} <= set(parts):
        ex, ey = anchors.middle(point("ear_left"), point("ear_right"))
        made = made.withColumns({"ear_center_dist": norm(ex - c("_cx"), ey - c("_cy")), "ear_nose_dist": norm(ex - front[0], ey - front[1]), "ear_nose_center_angle": cosine(ex - front[0], ey - front[1], c("_cx") - front[0], c("_cy") - front[1])})
        for w in sizes:
            out |= {f"ear_center_m{w}": t.mean(c("ear_center_dist"), w, True, 4), f"ear_center_s{w}": t.std(c("ear_center_dist"), w, True, 4)}
    return made.withColumns(out).drop("_rx", "_ry", "_cx", "_cy", "_body")


def body_axis(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    """Speed along and across the axis from tail to nose, and the slip between heading and axis."""
    front, at = anchors.nose(parts), anchors.centre(parts)
    if front is None or at is None or "tail_base" not in parts:
        return df
    sizes = windows(section, (15, 30, 60, 120), (15, 30, 60))
    tx, ty = point("tail_base")
    ux, uy = front[0] - tx, front[1] - ty
    size = norm(ux, uy) + EPS
    made = df.withColumns({"_ux": ux / size, "_uy": uy / size, "_cx": at[0], "_cy": at[1]})
    made = made.withColumns({"_vx": t.diff(c("_cx")) * t.rate, "_vy": t.diff(c("_cy")) * t.rate})
    made = made.withColumns({"v_forward": c("_vx") * c("_ux") + c("_vy") * c("_uy"), "v_lateral": c("_vx") * -c("_uy") + c("_vy") * c("_ux"), "_slip": F.atan2("_vy", "_vx") - F.atan2("_uy", "_ux")})
    made = made.withColumns({"v_forward_abs": F.abs("v_forward"), "v_lateral_abs": F.abs("v_lateral"), "slip_angle": F.atan2(F.sin("_slip"), F.cos("_slip"))})
    made = made.withColumns({"lat_over_fwd": c("v_lateral_abs") / (c("v_forward_abs") + EPS), "slip_angle_abs": F.abs("slip_angle")})
    out = {}
    for w in sizes:
        m = lambda name, w=w: t.mean(c(name), w, True, 4)
        s = lambda name, w=w: t.std(c(name), w, True, 4)
        out |= {f"v_fwd_m{w}": m("v_forward"), f"v_fwd_s{w}": s("v_forward"), f"v_fwd_abs_m{w}": m("v_forward_abs"), f"v_lat_m{w}": m("v_lateral"), f"v_lat_s{w}": s("v_lateral"), f"v_lat_abs_m{w}": m("v_lateral_abs"), f"lat_fwd_ratio_m{w}": m("lat_over_fwd")}
        out |= {f"slip_m{w}": m("slip_angle"), f"slip_s{w}": s("slip_angle"), f"slip_abs_m{w}": m("slip_angle_abs")}
    for w in windows(section, (15, 30, 60, 120), (30, 60)):
        share = lambda cond, w=w: t.mean(flag(cond), w, True, 5)
        out |= {f"forward_ratio_{w}": share(c("v_forward") > 1), f"backward_ratio_{w}": share(c("v_forward") < -1), f"lateral_dom_ratio_{w}": share(c("v_lateral_abs") > c("v_forward_abs")), f"slip_align_ratio_{w}": share(c("slip_angle_abs") < math.pi / 6)}
    return made.withColumns(out).drop("_ux", "_uy", "_cx", "_cy", "_vx", "_vy", "_slip")


def micromotion(df: DataFrame, t: Track, parts: tuple[str, ...], section: int = 1) -> DataFrame:
    """Fast motion of head and tail, and how they go together."""
    front, at = anchors.nose(parts), anchors.centre(parts)
    tail = point("tail_base") if "tail_base" in parts else None
    made, out = df, {}
    for name, spot in (("head", front), ("tail", tail)):
        if spot is None:
            continue
        made = made.withColumns({f"_{name}_vx": t.diff(spot[0]) * t.rate, f"_{name}_vy": t.diff(spot[1]) * t.rate})
        vx, vy = c(f"_{name}_vx"), c(f"_{name}_vy")
        made = made.withColumns({f"_{name}_sp": norm(vx, vy), f"{name}_accel": norm(t.diff(vx), t.diff(vy)) * t.rate, f"{name}_jitter": F.abs(wrap(t.diff(F.atan2(vy, vx + 1e-8))))})
        for w in (3, 5, 7):
            out |= {f"{name}_hf_m{w}": t.mean(c(f"_{name}_sp"), w, True, 2), f"{name}_hf_s{w}": t.std(c(f"_{name}_sp"), w, True, 2)}
            if name == "head":
                out[f"head_hf_max{w}"] = t.most(c("_head_sp"), w, True, 2)
        for w in (5, 10):
            out[f"{name}_accel_m{w}"] = t.mean(c(f"{name}_accel"), w, True, 2)
            if name == "head":
                out[f"head_accel_s{w}"] = t.std(c("head_accel"), w, True, 2)
        for w in (5, 10, 15) if name == "head" else (5, 10):
            out[f"{name}_jitter_m{w}"] = t.mean(c(f"{name}_jitter"), w, True, 2)
            if name == "head":
                out[f"head_jitter_sum{w}"] = t.sum(c("head_jitter"), w, True, 2)
    if tail is not None and at is not None:
        made = made.withColumns({"_bvx": t.diff(at[0]) * t.rate, "_bvy": t.diff(at[1]) * t.rate})
        made = made.withColumn("tail_rel_speed", norm(c("_tail_vx") - c("_bvx"), c("_tail_vy") - c("_bvy")))
        out |= {f"tail_rel_m{w}": t.mean(c("tail_rel_speed"), w, True, 3) for w in (10, 20)}
    if tail is not None and front is not None:
        both = c("_head_sp") + c("_tail_sp")
        made = made.withColumns({"head_tail_speed_ratio": c("_head_sp") / (c("_tail_sp") + EPS), "head_tail_dir_consistency": (c("_head_vx") * c("_tail_vx") + c("_head_vy") * c("_tail_vy")) / ((c("_head_sp") + EPS) * (c("_tail_sp") + EPS))})
        made = made.withColumn("head_tail_independence", (1 - F.abs("head_tail_dir_consistency")) * both)
        for short, name, sizes in (("head_tail_ratio", "head_tail_speed_ratio", (10, 20)), ("head_tail_dir", "head_tail_dir_consistency", (10, 20, 30)), ("head_tail_indep", "head_tail_independence", (15, 30))):
            out |= {f"{short}_m{w}": t.mean(c(name), w, True, 3) for w in sizes}
    return made.withColumns(out).drop(*(x for x in made.columns if x.startswith(("_head_", "_tail_", "_bv")))) if out else df


def is_round(shape: Column) -> Column:
    return F.coalesce(F.lower(shape).rlike("circle|circular|round"), F.lit(False))


def arena(df: DataFrame, t: Track, parts: tuple[str, ...], width: Column, height: Column, shape: Column, section: int = 1) -> DataFrame:
    """Place in the arena. Its size is known; where it lies is taken from the range of the mouse's own centre. NULL where
    the size isn't known; what only a rectangle has is NULL in a round arena. Of equally near walls, the first of left,
    right, bottom and top counts."""
    made, front = _with_centre(df, parts), anchors.nose(parts)
    if made is None:
        return df
    made = made.withColumns({f"_{f}{k}": agg(c(f"_c{k}")).over(t.whole) for k in "xy" for f, agg in (("lo", F.min), ("hi", F.max))})
    known, circle, side = (width > 0) & (height > 0), is_round(shape), F.least(width, height)
    mx, my = (c("_lox") + c("_hix")) / 2, (c("_loy") + c("_hiy")) / 2
    away = norm(c("_cx") - mx, c("_cy") - my)
    left, right, bottom, top = c("_cx") - c("_lox"), c("_hix") - c("_cx"), c("_cy") - c("_loy"), c("_hiy") - c("_cy")
    nearest = F.least(left, right, bottom, top)
    corner = F.least(norm(left, bottom), norm(right, bottom), norm(left, top), norm(right, top))
    radius = side / 2
    rim = F.when(away.isNotNull(), F.greatest(radius - away, F.lit(0.0)))
    pick = lambda a, b: F.when(known, F.when(circle, a).otherwise(b))
    square = lambda a: F.when(known & ~circle, a)
    out = {
        "dist_to_left_wall": square(left), "dist_to_right_wall": square(right), "dist_to_bottom_wall": square(bottom), "dist_to_top_wall": square(top),
        "dist_to_nearest_wall": pick(rim, nearest),
        "dist_to_wall_norm": pick(rim / (radius + EPS), nearest / (side / 2 + EPS)),
        "dist_to_arena_center": F.when(known, away),
        "dist_to_center_norm": pick(away / (radius + EPS), away / (norm(width / 2, height / 2) + EPS)),
        "dist_to_nearest_corner": square(corner),
        "is_near_wall": pick(flag(rim < radius * 0.15), flag(nearest < side * 0.15)),
        "is_in_center": pick(flag(away < radius * 0.3), flag(away < side * 0.3)),
        "is_in_corner": pick(F.lit(0.0), flag(corner < side * 0.2)),
    }
    if front is not None:
        hx, hy = front[0] - c("_cx"), front[1] - c("_cy")
        size = norm(hx, hy) + EPS
        radial = (hx * (c("_cx") - mx) + hy * (c("_cy") - my)) / (size * (away + EPS))
        toward = F.when(left == nearest, -hx / size).when(right == nearest, hx / size).when(bottom == nearest, -hy / size).when(top == nearest, hy / size)
        out["facing_nearest_wall"] = pick(radial, toward)
    made = made.withColumns(out)
    if front is not None:
        made = made.withColumns({f"facing_wall_m{w}": t.mean(c("facing_nearest_wall"), w, True, 4) for w in windows(section, (15, 30, 60, 120), (15, 30))})
    return made.drop("_cx", "_cy", "_lox", "_hix", "_loy", "_hiy")


#: The numbers of a video that become features as they are, and the categories that become flags.
META_NUMBERS = ("frames_per_second", "pix_per_cm_approx", "video_width", "video_height", "arena_width_cm", "arena_height_cm", "n_mice")
META_CATEGORIES = ("lab_id", "arena_shape", "arena_type", "tracking_method")
UNKNOWN, MISSING = "__UNK__", "__NA__"


def meta_features(df: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Figures and flags of a video's metadata, as FLOAT and BYTE. vocabulary: the known values of each category.

    A missing category is first named __NA__, which no vocabulary of real values holds, and so falls to __UNK__; the
    flag of __NA__ is there and always 0.
    """
    raw = {n: F.expr(f"try_cast(`{n}` AS double)") for n in META_NUMBERS}
    up = {n: F.when(raw[n].isNotNull(), F.greatest(raw[n], F.lit(0.0))) for n in META_NUMBERS}
    fps, ppc, aw, ah, mice = (up[n] for n in ("frames_per_second", "pix_per_cm_approx", "arena_width_cm", "arena_height_cm", "n_mice"))
    vw, vh = raw["video_width"], raw["video_height"]
    area = aw * ah
    out = {
        "fps_log1p": F.log1p(fps), "sec_per_frame": 1 / (fps + EPS), "cm_per_pix_approx": 1 / (ppc + EPS), "log_pix_per_cm": F.log1p(ppc),
        "video_aspect": vw / (vh + EPS), "video_area_px": vw * vh, "video_area_log1p": F.log1p(F.greatest(vw * vh, F.lit(0.0))), "video_diag_px": norm(vw, vh),
        "arena_aspect": aw / (ah + EPS), "arena_area_cm2": area, "arena_area_log1p": F.log1p(area), "arena_perimeter_cm": (aw + ah) * 2, "arena_diag_cm": norm(aw, ah),
        "n_mice_log1p": F.log1p(mice), "n_mice_sq": mice * mice, "mice_density": mice / (area + EPS), "arena_area_per_mouse": area / (mice + EPS),
    }
    made = {n: raw[n].cast("float") for n in META_NUMBERS} | {k: v.cast("float") for k, v in out.items()}
    for name in META_CATEGORIES:
        known = sorted(set(vocabulary.get(name, [])))
        value = F.coalesce(c(name), F.lit(MISSING))
        value = F.when(value.isin(known), value).otherwise(UNKNOWN) if known else F.lit(UNKNOWN)
        made |= {f"{name}={v}": (value == v).cast("byte") for v in [*known, UNKNOWN, MISSING]}
    return df.withColumns(made)
