"""Directed features of two mice A and B in a video, on a wide table of both (`A_<part>_x`, `B_<part>_y` ...).

rel is A - B, so it points from B to A: a positive A_vel_along means that A moves away, and B_chasing asks for a growing
distance. Both are as the behaviour models were made with, and are kept. Velocities are per frame unless a name says
rate or accel. A figure is NULL where an input is; a flag is 0.0 there.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.frames import EPS, Track, cosine, flag, norm, scale_signed, wrap
from trackloom.operators import anchors
from trackloom.operators.anchors import point
from trackloom.operators.single import squared

c = F.col


def cross_distances(df: DataFrame, declared: tuple[str, ...], parts_a: tuple[str, ...], parts_b: tuple[str, ...]) -> DataFrame:
    """`p+q`: squared distance of A's p to B's q; NULL where either is lacking."""
    return df.withColumns({f"{a}+{b}": squared(*point(a, "A_"), *point(b, "B_")) if a in parts_a and b in parts_b else F.lit(None).cast("double") for a, b in product(declared, repeat=2)})


def orientation(df: DataFrame, t: Track, parts_a: tuple[str, ...], parts_b: tuple[str, ...]) -> DataFrame:
    """Who faces whom, each one's place in the other's frame, and how bodies lie over each other."""
    need = {"body_center", "nose", "tail_base"}
    if not (need <= set(parts_a) and need <= set(parts_b)):
        return df
    (nax, nay), (tax, tay), (bax, bay) = (point(p, "A_") for p in ("nose", "tail_base", "body_center"))
    (nbx, nby), (tbx, tby), (bbx, bby) = (point(p, "B_") for p in ("nose", "tail_base", "body_center"))
    oax, oay, obx, oby = nax - tax, nay - tay, nbx - tbx, nby - tby
    dx, dy = bax - bbx, bay - bby
    na, nb, d = norm(oax, oay) + EPS, norm(obx, oby) + EPS, norm(dx, dy)
    made = df.withColumns({
        "A_face_B": cosine(oax, oay, -dx, -dy), "B_face_A": cosine(obx, oby, dx, dy),
        "A_front_of_B": (dx * obx + dy * oby) / nb, "A_side_of_B": (dx * -oby + dy * obx) / nb,
        "B_front_of_A": (-dx * oax - dy * oay) / na, "B_side_of_A": (dx * oay - dy * oax) / na,
        "body_ori_alignment": cosine(oax, oay, obx, oby), "_d": d,
    })
    align = F.abs("body_ori_alignment")
    made = made.withColumns({"body_overlap_score": align / (c("_d") + 1), "body_overlap_binary": flag((c("_d") < 8) & (align > 0.7)), "vertical_overlap": flag((F.abs("A_front_of_B") < 3) & (F.abs("A_side_of_B") < 3) & (c("_d") < 8))})
    out = {}
    for w in (15, 30, 60):
        out |= {f"overlap_score_m{w}": t.mean(c("body_overlap_score"), w, True, 5), f"overlap_binary_p{w}": t.mean(c("body_overlap_binary"), w, True, 5)}
    out |= {f"vertical_overlap_p{w}": t.mean(c("vertical_overlap"), w, True, 5) for w in (15, 30)}
    return made.withColumns(out).drop("_d")


def nose_features(df: DataFrame, t: Track, parts_a: tuple[str, ...], parts_b: tuple[str, ...]) -> DataFrame:
    if "nose" not in parts_a or "nose" not in parts_b:
        return df
    made = df.withColumn("_sq", squared(*point("nose", "A_"), *point("nose", "B_")))
    made = made.withColumn("_nn", F.sqrt("_sq"))
    out = {}
    for n in (10, 20, 40):
        lag = t.shift(c("_nn"), t.ws(n))
        out |= {f"appr_{n}": c("_sq") - t.shift(c("_sq"), t.ws(n)), f"nn_lg{n}": lag, f"nn_ch{n}": c("_nn") - lag, f"cl_ps{n}": t.mean(flag(c("_nn") < 10), n)}
    return made.withColumns(out).drop("_sq", "_nn")


def tail_features(df: DataFrame, t: Track, parts_a: tuple[str, ...], parts_b: tuple[str, ...]) -> DataFrame:
    if "tail_base" not in parts_a or "tail_base" not in parts_b:
        return df
    (ax, ay), (bx, by) = point("tail_base", "A_"), point("tail_base", "B_")
    made = df.withColumns({"_tx": bx - ax, "_ty": by - ay, "tail_rel_dist": norm(bx - ax, by - ay)})
    made = made.withColumns({"tail_rel_speed": norm(t.diff(c("_tx")), t.diff(c("_ty"))) * t.rate, "tail_approach_rate": -t.diff(c("tail_rel_dist")) * t.rate})
    out = {f"{k}_m{w}": t.mean(c(k), w, True, 5) for w in (15, 30, 60) for k in ("tail_rel_dist", "tail_rel_speed", "tail_approach_rate")}
    if "nose" in parts_a and "nose" in parts_b:
        (nax, nay), (nbx, nby) = point("nose", "A_"), point("nose", "B_")
        out |= {"tailA_noseB_dist": norm(ax - nbx, ay - nby), "tailB_noseA_dist": norm(bx - nax, by - nay)}
    return made.withColumns(out).drop("_tx", "_ty")


def ear_features(df: DataFrame, t: Track, parts_a: tuple[str, ...], parts_b: tuple[str, ...]) -> DataFrame:
    lag, out = t.ws(10), {}
    for side in ("left", "right"):
        if f"ear_{side}" in parts_a and f"ear_{side}" in parts_b:
            a, b = point(f"ear_{side}", "A_"), point(f"ear_{side}", "B_")
            a_then, b_then = (tuple(t.shift(k, lag) for k in p) for p in (a, b))
            out |= {f"sp_A_{side}": squared(*a, *a_then), f"sp_AB_{side}": squared(*a, *b_then), f"sp_B_{side}": squared(*b, *b_then)}
    return df.withColumns(out) if out else df


def pursuit(df: DataFrame, t: Track, parts_a: tuple[str, ...], parts_b: tuple[str, ...]) -> DataFrame:
    """Velocities along and across the line between the centres; chasing, escaping and sidestepping."""
    a, b = anchors.centre(parts_a, "A_"), anchors.centre(parts_b, "B_")
    if a is None or b is None:
        return df
    made = df.withColumns({"_rx": a[0] - b[0], "_ry": a[1] - b[1], "_ax": a[0], "_ay": a[1], "_bx": b[0], "_by": b[1]})
    made = made.withColumns({"_d": norm(c("_rx"), c("_ry"))} | {f"_v{k}": t.diff(c(f"_{k}")) for k in ("ax", "ay", "bx", "by")})
    rx, ry, d = c("_rx"), c("_ry"), c("_d") + EPS
    vax, vay, vbx, vby = (c(f"_v{k}") for k in ("ax", "ay", "bx", "by"))
    made = made.withColumns({"A_vel_along": (vax * rx + vay * ry) / d, "A_vel_perp": (vay * rx - vax * ry) / d, "B_vel_along": (-vbx * rx - vby * ry) / d, "B_vel_perp": (vbx * ry - vby * rx) / d, "_dd": t.diff(c("_d"))})
    al, bl, dd = c("A_vel_along"), c("B_vel_along"), c("_dd")
    made = made.withColumns({
        "A_chasing": flag((al > 0) & (dd < 0)), "B_chasing": flag((bl > 0) & (dd > 0)),
        "A_chase_intensity": -al * dd / (norm(vax, vay) + EPS), "B_chase_intensity": bl * dd / (norm(vbx, vby) + EPS),
        "A_escaping": flag((al < 0) & (bl < 0)), "B_escaping": flag((bl < 0) & (al > 0)),
        "A_sidestepping": flag(F.abs("A_vel_perp") > F.abs("A_vel_along")), "B_sidestepping": flag(F.abs("B_vel_perp") > F.abs("B_vel_along")),
    })
    out = {}
    for who in "AB":
        for w in (15, 30, 60):
            out |= {f"{who}_{short}_p{w}": t.mean(c(f"{who}_{name}"), w, True, 5) for name, short in (("chasing", "chasing"), ("escaping", "escaping"), ("sidestepping", "sidestep"))}
            out[f"{who}_chase_int_m{w}"] = t.mean(c(f"{who}_chase_intensity"), w, True, 5)
        out |= {f"{who}_chase_consist_{w}": t.mean(flag(c(f"{who}_vel_along") > 0), w, True, 5) for w in (30, 60)}
    return made.withColumns(out).drop("_rx", "_ry", "_ax", "_ay", "_bx", "_by", "_d", "_vax", "_vay", "_vbx", "_vby", "_dd")


def dynamics(df: DataFrame, t: Track, parts_a: tuple[str, ...], parts_b: tuple[str, ...]) -> DataFrame:
    """What both true centres do to each other: distance and its spread, agreement of motion, leading, approach, relative
    path, similarity and asymmetry. facing_asymmetry needs the columns of orientation()."""
    if "body_center" not in parts_a or "body_center" not in parts_b:
        return df
    f = t.rate
    (ax, ay), (bx, by) = point("body_center", "A_"), point("body_center", "B_")
    made = df.withColumns({"_rx": ax - bx, "_ry": ay - by})
    made = made.withColumns({"_d": norm(c("_rx"), c("_ry")), "_sq": c("_rx") * c("_rx") + c("_ry") * c("_ry"), "_rvx": t.diff(c("_rx")) * f, "_rvy": t.diff(c("_ry")) * f, "_vax": t.diff(ax), "_vay": t.diff(ay), "_vbx": t.diff(bx), "_vby": t.diff(by)})
    rx, ry, d, vax, vay, vbx, vby = (c(k) for k in ("_rx", "_ry", "_d", "_vax", "_vay", "_vbx", "_vby"))
    made = made.withColumns({"_sa": norm(vax, vay), "_sb": norm(vbx, vby), "_dot": vax * vbx + vay * vby, "_turn": F.abs(wrap(t.diff(F.atan2("_rvy", "_rvx")))), "rel_accel": norm(t.diff(c("_rvx")), t.diff(c("_rvy"))) * f, "_rs": norm(c("_rvx"), c("_rvy")), "_approach": -t.diff(d), "_aa": norm(t.diff(vax), t.diff(vay)) * f, "_ab": norm(t.diff(vbx), t.diff(vby)) * f})
    sa, sb = c("_sa"), c("_sb")
    a_along, b_along = vax * rx + vay * ry, -vbx * rx - vby * ry
    layer = {
        "rel_turn_rate": c("_turn") * f,
        "v_cls": flag(d < 5), "cls": flag((d >= 5) & (d < 15)), "med": flag((d >= 15) & (d < 30)), "far": flag(d >= 30),
        "_val": c("_dot") / (sa * sb + EPS), "_lead_a": a_along / (sa * d + EPS), "_lead_b": b_along / (sb * d + EPS),
        "leadership_asymmetry": (a_along - b_along) / (d + EPS), "interaction_potential": 1 / (d + EPS), "approach_rate": c("_approach") * f,
        "direction_similarity": F.cos(wrap(F.atan2(vay, vax) - F.atan2(vby, vbx))), "speed_similarity": 1 - F.abs(sa - sb) / (sa + sb + EPS),
        "speed_diff": sa - sb, "speed_ratio": sa / (sb + EPS), "_gap": F.abs(sa - sb), "accel_diff": c("_aa") - c("_ab"),
    }
    if {"A_face_B", "B_face_A"} <= set(df.columns):
        layer["facing_asymmetry"] = c("A_face_B") - c("B_face_A")
    made = made.withColumns(layer)
    made = made.withColumns({"rel_curvature": c("rel_turn_rate") / (c("_rs") + EPS), "sudden_escape": flag(c("approach_rate") < -20), "_chase": c("_approach") * c("_lead_b"), "_n": F.count(F.lit(1)).over(t.whole)})
    out: dict[str, Column] = {}
    for w in (5, 15, 30, 60):
        sq, dot = c("_sq"), c("_dot")
        out |= {f"d_m{w}": t.mean(sq, w, True), f"d_s{w}": t.std(sq, w, True), f"d_mn{w}": t.least(sq, w, True), f"d_mx{w}": t.most(sq, w, True), f"int{w}": 1 / (1 + t.var(sq, w, True)), f"co_m{w}": t.mean(dot, w, True), f"co_s{w}": t.std(dot, w, True)}
    out["int_con"] = t.std(c("_sq"), 30, True) / (t.mean(c("_sq"), 30, True) + EPS)
    out |= {f"va_{off}": t.shift(c("_val"), -scale_signed(off, t.fps)) for off in (-30, -20, -10, 0, 10, 20, 30)}
    for w in (30, 60):
        out |= {f"A_ld{w}": t.mean(c("_lead_a"), w, part=6), f"B_ld{w}": t.mean(c("_lead_b"), w, part=6)}
        pa, pb = t.sum(sa, w, True, 5), t.sum(sb, w, True, 5)
        out |= {f"path_diff_{w}": pa - pb, f"path_ratio_{w}": pa / (pb + EPS)}
    out["chase_30"] = t.mean(c("_chase"), 30, part=6)
    out |= {f"sp_cor{w}": t.corr(sa, sb, w, part=6) for w in (60, 120)}
    out["speed_dtw_distance"] = t.lagged_mean(c("_gap"), t.ws(30))
    for w in (15, 30, 60):
        out |= {f"{k}_m{w}": t.mean(c(k), w, True, 5) for k in ("rel_turn_rate", "rel_curvature", "rel_accel", "speed_diff", "speed_ratio")}
        out |= {f"rel_speed_m{w}": t.mean(c("_rs"), w, True, 5), f"rel_speed_s{w}": t.std(c("_rs"), w, True, 5), f"speed_diff_s{w}": t.std(c("speed_diff"), w, True, 5)}
    for w in (60, 120):
        out |= {f"direction_sim_m{w}": t.mean(c("direction_similarity"), w, True, 6), f"speed_sim_m{w}": t.mean(c("speed_similarity"), w, True, 6)}
    for w in (15, 30):
        out[f"accel_diff_m{w}"] = t.mean(c("accel_diff"), w, True, 5)
        if "facing_asymmetry" in layer:
            out[f"facing_asym_m{w}"] = t.mean(c("facing_asymmetry"), w, True, 5)
    made = made.withColumns(out)
    return made.drop(*(k for k in made.columns if k.startswith("_") and k not in df.columns))


def contacts(df: DataFrame, t: Track, parts_a: tuple[str, ...], parts_b: tuple[str, ...]) -> DataFrame:
    """Distances from the front of one mouse to the parts of the other, and contact at 3, 5 and 8 cm."""
    made, out = df, {}
    for me, you, mine, yours in (("A", "B", parts_a, parts_b), ("B", "A", parts_b, parts_a)):
        name = anchors.front_name(mine)
        if name is None or not yours:
            continue
        front = anchors.middle(point("ear_left", f"{me}_"), point("ear_right", f"{me}_")) if name == "ears" else point(name, f"{me}_")
        away = {p: norm(front[0] - point(p, f"{you}_")[0], front[1] - point(p, f"{you}_")[1]) for p in yours}
        near = reduce(F.least, away.values()) if len(away) > 1 else next(iter(away.values()))
        base = {f"{me}_front_to_{you}_min": near}
        base |= {f"{me}_front_to_{you}_{short}": away[p] for p, short in (("nose", "nose"), ("head", "head"), ("body_center", "center"), ("tail_base", "tail")) if p in away}
        made = made.withColumns(base)
        flags = {f"{me}_front_contact_{k}": flag(c(f"{me}_front_to_{you}_min") < k) for k in (3, 5, 8)}
        made = made.withColumns(flags)
        out |= {f"{k}_p{w}": t.mean(c(k), w, True, 5) for k in flags for w in (15, 30, 60)}
        out |= {f"{me}_contact_duration_{w}": t.sum(c(f"{me}_front_contact_5"), w, True) for w in (30, 60)}
    return made.withColumns(out) if out else df
