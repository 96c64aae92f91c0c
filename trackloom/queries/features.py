"""Features of single mice and of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import alt, pair, single
from trackloom.queries import sql as q
from trackloom.queries import views as v
from trackloom.queries.views import PAIR_OVER as PO
from trackloom.queries.views import PAIR_TRACK as pt
from trackloom.queries.views import PARTS
from trackloom.queries.views import TRACK as t

c = F.col
K, PK = ["entity", "frame"], ["agent", "target", "frame"]
N, B, T = ("nose_x", "nose_y"), ("body_center_x", "body_center_y"), ("tail_base_x", "tail_base_y")
EL, ER = ("ear_left_x", "ear_left_y"), ("ear_right_x", "ear_right_y")


def _minus(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    return f"({a[0]} - {b[0]})", f"({a[1]} - {b[1]})"


def _away(a: tuple[str, str], b: tuple[str, str]) -> str:
    return q.norm(*_minus(a, b))


def _sq(a: tuple[str, str], b: tuple[str, str]) -> str:
    x, y = _minus(a, b)
    return f"({x} * {x} + {y} * {y})"


class Family:
    """One feature family: its query, and the layers of its SQL."""

    def __init__(self, make, layers: list[dict[str, str]], out: list[str], digits: int = 4, pairs: bool = False) -> None:
        self.make, self.layers, self.out, self.digits, self.pairs = make, layers, out, digits, pairs

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        base = v.pose_pairs(spark, sf_dir) if self.pairs else v.poses(spark, sf_dir)
        return v.rounded(self.make(base), PK if self.pairs else K, self.out, self.digits)

    @property
    def sql(self) -> str:
        return q.layered(v.PAIR_SQL if self.pairs else v.POSE_SQL, self.layers, PK if self.pairs else K, self.out, self.digits)


FAMILIES: dict[str, Family] = {}


def _family(name: str, make, layers: list[dict[str, str]], digits: int = 4, pairs: bool = False, hidden: tuple[str, ...] = ()) -> None:
    out = [k for layer in layers for k in layer if not k.startswith("_") and k not in hidden]
    FAMILIES[name] = Family(make, layers, out, digits, pairs)


CENTRE = {"_cx": B[0], "_cy": B[1]}
STEP = {"_dx": q.diff("_cx"), "_dy": q.diff("_cy")}
SPEED = {"_speed": f"{q.norm(q.diff('_cx'), q.diff('_cy'))} * 30"}

_family("single_distances", lambda df: single.elongation(single.squared_distances(df, ("nose", "tail_base", "ear_left", "ear_right", "absent"), PARTS)), [
    {f"{a}+{b}": _sq((f"{a}_x", f"{a}_y"), (f"{b}_x", f"{b}_y")) for a, b in (("nose", "tail_base"), ("nose", "ear_left"), ("nose", "ear_right"), ("tail_base", "ear_left"), ("tail_base", "ear_right"), ("ear_left", "ear_right"))} | {f"{a}+absent": "null" for a in ("nose", "tail_base", "ear_left", "ear_right")},
    {"elong": '"nose+tail_base" / ("ear_left+ear_right" + 1e-6)'},
])

_lag = lambda p, n: (q.shift(p[0], n), q.shift(p[1], n))
_family("single_core", lambda df: single.core(df, t, PARTS), [
    {"_ear": _away(EL, ER), "_nt": _away(N, T), "sp_lf": _sq(EL, _lag(EL, 10)), "sp_rt": _sq(ER, _lag(ER, 10)), "sp_lf2": _sq(EL, _lag(T, 10)), "sp_rt2": _sq(ER, _lag(T, 10)), "body_ang": q.cosine(*_minus(N, B), *_minus(T, B))},
    {f"ear_o{o}": q.shift("_ear", -o) for o in (-30, -20, -10, 10, 20, 30)} | {"ear_con": f"({q.std('_ear', 30, True)}) / ({q.mean('_ear', 30, True)} + 1e-6)"}
    | {f"nt_lg{n}": q.shift("_nt", n) for n in (10, 20, 40)} | {f"nt_df{n}": q.diff("_nt", n) for n in (10, 20, 40)},
])

_quant = {f"_{e}{k}": f"quantile_cont(_c{k}, {p}) over (partition by entity)" for k in "xy" for e, p in (("l", 0.01), ("h", 0.99))}
_family("single_position", lambda df: single.position(df, t, PARTS), [
    CENTRE, _quant | STEP, {f"_k{k}": f"greatest(least(_c{k}, _h{k}), _l{k})" for k in "xy"},
    {f"c{k}_m{w}": q.mean(f"_c{k}", w, True) for w in (15, 30, 60, 120) for k in "xy"} | {f"c{k}_s{w}": q.std(f"_c{k}", w, True) for w in (15, 30, 60, 120) for k in "xy"}
    | {f"{k}_rng{w}": f"({q.most(f'_k{k}', w, True)}) - ({q.least(f'_k{k}', w, True)})" for w in (15, 30, 60, 120) for k in "xy"}
    | {f"disp{w}": q.norm(q.total("_dx", w), q.total("_dy", w)) for w in (15, 30, 60, 120)} | {f"act{w}": f"sqrt(({q.var('_dx', w)}) + ({q.var('_dy', w)}))" for w in (15, 30, 60, 120)},
])

_family("single_curvature", lambda df: single.curvature(df, t, PARTS), [
    CENTRE, {"_vx": q.diff("_cx"), "_vy": q.diff("_cy")}, {"_ax": q.diff("_vx"), "_ay": q.diff("_vy"), "_turn": f"abs({q.diff('atan2(_vy, _vx)')})", "_v": q.norm("_vx", "_vy")},
    {"_curv": "abs(_vx * _ay - _vy * _ax) / (_v * _v * _v + 1e-6)"},
    {f"curv_mean_{w}": q.mean("_curv", w, part=5) for w in (15, 30, 60, 120)} | {f"turn_rate_{w}": q.total("_turn", w, part=5) for w in (15, 30, 60, 120)},
])

_fits = lambda e, w: f"case when _n >= {w} then {e} end"
_family("single_multiscale", lambda df: single.multiscale(df, t, PARTS), [
    CENTRE, SPEED | {"_n": "count(*) over (partition by entity)"},
    {f"sp_m{w}": _fits(q.mean("_speed", w, part=4), w) for w in (15, 30, 60, 120)} | {f"sp_s{w}": _fits(q.std("_speed", w, part=4), w) for w in (15, 30, 60, 120)}
    | {f"sp_q{p}_{w}": _fits(q.roll(f"quantile_cont({{}}, 0.{p})", "_speed", w, part=4), w) for w in (15, 30, 60, 120) for p in (25, 75)},
    {f"sp_iqr{w}": f"sp_q75_{w} - sp_q25_{w}" for w in (15, 30, 60, 120)} | {"sp_ratio": "sp_m15 / (sp_m120 + 1e-6)"},
])

_family("state_occupancy", lambda df: single.states(df, t, PARTS), [
    CENTRE, SPEED | {"_n": "count(*) over (partition by entity)"}, {"_m": q.mean("_speed", 15, part=3)}, {"_state": "case when _m <= 0.5 then 0 when _m <= 2 then 1 when _m <= 5 then 2 when _m > 5 then 3 end"},
    {"_change": f"case when _state = {q.shift('_state', 1)} then 0.0 else 1.0 end"} | {f"_s{k}": q.flag(f"_state = {k}") for k in range(4)},
    {f"s{k}_{w}": _fits(q.mean(f"_s{k}", w, part=5), w) for w in (15, 30, 60, 120) for k in range(4)} | {f"trans_{w}": _fits(q.total("_change", w, part=5), w) for w in (15, 30, 60, 120)},
])


def _long_range_sql() -> str:
    """EWM and percent rank by joining rows to those before them."""
    ewm = ", ".join(f"sum(o._c{k} * power({1 - 2 / (w + 1)}, t.frame - o.frame)) / sum(power({1 - 2 / (w + 1)}, t.frame - o.frame)) as {k}_e{w}" for w in (30, 60, 120) for k in "xy")
    pct = ", ".join(f"case when count(o._speed) filter (where t.frame - o.frame < {w}) >= {max(5, w // 6)} and any_value(t._speed) is not null then (count(*) filter (where o._speed < t._speed and t.frame - o.frame < {w}) + (count(*) filter (where o._speed = t._speed and t.frame - o.frame < {w}) + 1) / 2.0) / count(o._speed) filter (where t.frame - o.frame < {w}) end as sp_pct{w}" for w in (30, 60, 120))
    means = {f"{k}_ml{w}": q.mean(f"_c{k}", w, mp=max(5, w // 6)) for w in (30, 60, 120) for k in "xy"}
    cells = ", ".join(f"round({n}::double, 4) + 0.0 as {n}" for w in (30, 60, 120) for n in (f"x_e{w}", f"y_e{w}", f"sp_pct{w}", f"x_ml{w}", f"y_ml{w}"))
    return f"""with p0 as (select *, {', '.join(f'{e} as {n}' for n, e in CENTRE.items())} from ({v.POSE_SQL})), p as (select *, {SPEED['_speed']} as _speed from p0),
        e as (select t.entity, t.frame, {ewm}, {pct} from p t join p o on o.entity = t.entity and o.frame <= t.frame group by 1, 2),
        m as (select entity, frame, {', '.join(f'{x} as {n}' for n, x in means.items())} from p) select entity, frame, {cells} from e join m using (entity, frame)"""


LONG_OUT = [n for w in (30, 60, 120) for n in (f"x_e{w}", f"y_e{w}", f"sp_pct{w}", f"x_ml{w}", f"y_ml{w}")]


def single_long_range(spark, sf_dir):
    return v.rounded(single.long_range(v.poses(spark, sf_dir), t, PARTS), K, LONG_OUT)


_family("single_steadiness", lambda df: single.steadiness(df, t, PARTS), [
    {"_ex": "(ear_left_x + ear_right_x) / 2", "_ey": "(ear_left_y + ear_right_y) / 2", "_nt": _away(N, T)},
    {"ear_mid_std": q.norm(q.std("_ex", 30, mp=5), q.std("_ey", 30, mp=5)), "nose_tail_length_std": q.std("_nt", 30, mp=5)},
])
_family("single_elevation", lambda df: single.head_elevation(df, t, PARTS, 5), [
    {"_e": f"{N[1]} - {B[1]}", "_v": f"{N[1]} - {T[1]}"},
    {n: e for w in (10, 20, 30) for n, e in ((f"head_elev_mean_{w}", q.mean("_e", w, mp=w)), (f"head_elev_std_{w}", q.std("_e", w, mp=w)), (f"body_vert_{w}", q.mean("_v", w, mp=w)))},
])
_family("single_width", lambda df: single.body_width(df, t, PARTS), [
    {"_w": _away(("lateral_left_x", "lateral_left_y"), ("lateral_right_x", "lateral_right_y"))}, {"_d": q.diff("_w")},
    {n: e for w in (15, 30, 60, 120) for n, e in ((f"body_width_mean_{w}", q.mean("_w", w, mp=w)), (f"body_width_std_{w}", q.std("_w", w, mp=w)), (f"body_width_change_{w}", q.mean("_d", w, mp=w)))},
])
_family("single_shape", lambda df: single.pose_shape(df, t, PARTS), [
    {"_a": _away(N, B), "_b": _away(B, T), "_c": _away(N, T), "tri_area": f"abs(({N[0]} - {B[0]}) * ({T[1]} - {B[1]}) - ({N[1]} - {B[1]}) * ({T[0]} - {B[0]})) / 2"},
    {"tri_front_back_ratio": "_a / (_b + 1e-6)", "tri_compactness": "tri_area / ((_a + _b + _c) * (_a + _b + _c) + 1e-6)"} | {n: e for w in (15, 30, 60) for n, e in ((f"tri_area_m{w}", q.mean("tri_area", w, True, 4)), (f"tri_area_s{w}", q.std("tri_area", w, True, 4)))},
])
_em = ("_ex", "_ey")
_family("single_head", lambda df: single.head_apart(df, t, PARTS), [
    CENTRE | {"_rx": f"{N[0]} - {B[0]}", "_ry": f"{N[1]} - {B[1]}", "_ex": "(ear_left_x + ear_right_x) / 2", "_ey": "(ear_left_y + ear_right_y) / 2"},
    {"head_rel_speed": f"{q.norm(q.diff('_rx'), q.diff('_ry'))} * 30", "_body": SPEED["_speed"], "_turn": q.diff("atan2(_ry, _rx)"), "ear_center_dist": _away(_em, B), "ear_nose_dist": _away(_em, N), "ear_nose_center_angle": q.cosine(*_minus(_em, N), *_minus(B, N))},
    {"head_turn_speed": f"abs({q.wrap('_turn')}) * 30", "head_body_speed_ratio": "head_rel_speed / (_body + 1e-6)"},
    {n: e for w in (15, 30, 60) for n, e in ((f"head_rel_sp_m{w}", q.mean("head_rel_speed", w, True, 4)), (f"head_rel_sp_s{w}", q.std("head_rel_speed", w, True, 4)), (f"head_turn_m{w}", q.mean("head_turn_speed", w, True, 4)), (f"head_turn_s{w}", q.std("head_turn_speed", w, True, 4)), (f"head_turn_sum{w}", q.total("head_turn_speed", w, True, 4)), (f"ear_center_m{w}", q.mean("ear_center_dist", w, True, 4)), (f"ear_center_s{w}", q.std("ear_center_dist", w, True, 4)))},
])
_axis = {"v_fwd_m": "v_forward", "v_fwd_abs_m": "v_forward_abs", "v_lat_m": "v_lateral", "v_lat_abs_m": "v_lateral_abs", "lat_fwd_ratio_m": "lat_over_fwd", "slip_m": "slip_angle", "slip_abs_m": "slip_angle_abs"}
_family("body_axis", lambda df: single.body_axis(df, t, PARTS), [
    CENTRE | {"_u": f"{_away(N, T)} + 1e-6"}, {"_ux": f"({N[0]} - {T[0]}) / _u", "_uy": f"({N[1]} - {T[1]}) / _u", "_vx": f"{q.diff('_cx')} * 30", "_vy": f"{q.diff('_cy')} * 30"},
    {"v_forward": "_vx * _ux + _vy * _uy", "v_lateral": "_vy * _ux - _vx * _uy", "_slip": "atan2(_vy, _vx) - atan2(_uy, _ux)"},
    {"v_forward_abs": "abs(v_forward)", "v_lateral_abs": "abs(v_lateral)", "slip_angle": "atan2(sin(_slip), cos(_slip))"},
    {"lat_over_fwd": "v_lateral_abs / (v_forward_abs + 1e-6)", "slip_angle_abs": "abs(slip_angle)", "_f": q.flag("v_forward > 1"), "_b": q.flag("v_forward < -1"), "_l": q.flag("v_lateral_abs > v_forward_abs"), "_s": q.flag("abs(slip_angle) < pi() / 6")},
    {f"{n}{w}": q.mean(e, w, True, 4) for w in (15, 30, 60, 120) for n, e in _axis.items()} | {f"{n}{w}": q.std(e, w, True, 4) for w in (15, 30, 60, 120) for n, e in (("v_fwd_s", "v_forward"), ("v_lat_s", "v_lateral"), ("slip_s", "slip_angle"))}
    | {f"{n}{w}": q.mean(e, w, True, 5) for w in (15, 30, 60, 120) for n, e in (("forward_ratio_", "_f"), ("backward_ratio_", "_b"), ("lateral_dom_ratio_", "_l"), ("slip_align_ratio_", "_s"))},
], digits=3)


def _micro() -> list[dict[str, str]]:
    first = CENTRE | {f"_{n}v{k}": f"{q.diff(p[i])} * 30" for n, p in (("h", N), ("t", T), ("b", B)) for i, k in enumerate("xy")}
    second = {f"_{n}s": q.norm(f"_{n}vx", f"_{n}vy") for n in "ht"} | {f"{name}_accel": f"{q.norm(q.diff(f'_{n}vx'), q.diff(f'_{n}vy'))} * 30" for n, name in (("h", "head"), ("t", "tail"))} | {f"_{n}j": q.diff(f"atan2(_{n}vy, _{n}vx + 1e-8)") for n in "ht"} | {"tail_rel_speed": q.norm("_tvx - _bvx", "_tvy - _bvy")}
    third = {"head_jitter": f"abs({q.wrap('_hj')})", "tail_jitter": f"abs({q.wrap('_tj')})", "head_tail_speed_ratio": "_hs / (_ts + 1e-6)", "head_tail_dir_consistency": "(_hvx * _tvx + _hvy * _tvy) / ((_hs + 1e-6) * (_ts + 1e-6))"}
    fourth = {"head_tail_independence": "(1 - abs(head_tail_dir_consistency)) * (_hs + _ts)"}
    m = lambda e, w, part=2: q.mean(e, w, True, part)
    last = {f"{name}_hf_m{w}": m(e, w) for name, e in (("head", "_hs"), ("tail", "_ts")) for w in (3, 5, 7)} | {f"{name}_hf_s{w}": q.std(e, w, True, 2) for name, e in (("head", "_hs"), ("tail", "_ts")) for w in (3, 5, 7)} | {f"head_hf_max{w}": q.most("_hs", w, True, 2) for w in (3, 5, 7)}
    last |= {f"{n}_accel_m{w}": m(f"{n}_accel", w) for n in ("head", "tail") for w in (5, 10)} | {f"head_accel_s{w}": q.std("head_accel", w, True, 2) for w in (5, 10)}
    last |= {f"head_jitter_m{w}": m("head_jitter", w) for w in (5, 10, 15)} | {f"head_jitter_sum{w}": q.total("head_jitter", w, True, 2) for w in (5, 10, 15)} | {f"tail_jitter_m{w}": m("tail_jitter", w) for w in (5, 10)}
    last |= {f"tail_rel_m{w}": m("tail_rel_speed", w, 3) for w in (10, 20)} | {f"{n}_m{w}": m(e, w, 3) for n, e, sizes in (("head_tail_ratio", "head_tail_speed_ratio", (10, 20)), ("head_tail_dir", "head_tail_dir_consistency", (10, 20, 30)), ("head_tail_indep", "head_tail_independence", (15, 30))) for w in sizes}
    return [first, second, third, fourth, last]


_family("single_micromotion", lambda df: single.micromotion(df, t, PARTS), _micro(), digits=2)

_arena = [
    CENTRE, {f"_{e}{k}": f"{f}(_c{k}) over (partition by entity)" for k in "xy" for e, f in (("l", "min"), ("h", "max"))} | {"_w": "case when entity % 7 = 0 then null else 40 + entity % 5 end::double", "_g": "(30 + entity % 3)::double", "_round": "entity % 2 = 0"},
    {"_mx": "(_lx + _hx) / 2", "_my": "(_ly + _hy) / 2", "_side": "least(_w, _g)", "dist_to_left_wall": "case when _w is not null and not _round then _cx - _lx end", "dist_to_right_wall": "case when _w is not null and not _round then _hx - _cx end", "dist_to_bottom_wall": "case when _w is not null and not _round then _cy - _ly end", "dist_to_top_wall": "case when _w is not null and not _round then _hy - _cy end", "_hdx": f"{N[0]} - _cx", "_hdy": f"{N[1]} - _cy"},
    {"dist_to_arena_center": f"case when _w is not null then {q.norm('_cx - _mx', '_cy - _my')} end", "_near": "least(dist_to_left_wall, dist_to_right_wall, dist_to_bottom_wall, dist_to_top_wall)", "_hs": f"{q.norm('_hdx', '_hdy')} + 1e-6",
     "dist_to_nearest_corner": f"least({q.norm('dist_to_left_wall', 'dist_to_bottom_wall')}, {q.norm('dist_to_right_wall', 'dist_to_bottom_wall')}, {q.norm('dist_to_left_wall', 'dist_to_top_wall')}, {q.norm('dist_to_right_wall', 'dist_to_top_wall')})"},
    {"dist_to_nearest_wall": "case when _w is null then null when _round then greatest(_side / 2 - dist_to_arena_center, 0) else _near end"},
    {"dist_to_wall_norm": "dist_to_nearest_wall / (_side / 2 + 1e-6)", "dist_to_center_norm": f"dist_to_arena_center / (case when _round then _side / 2 else {q.norm('_w / 2', '_g / 2')} end + 1e-6)",
     "is_near_wall": "case when _w is null then null when dist_to_nearest_wall < 0.15 * (case when _round then _side / 2 else _side end) then 1.0 else 0.0 end", "is_in_center": "case when _w is null then null when dist_to_arena_center < 0.3 * (case when _round then _side / 2 else _side end) then 1.0 else 0.0 end",
     "is_in_corner": "case when _w is null then null when not _round and dist_to_nearest_corner < 0.2 * _side then 1.0 else 0.0 end",
     "facing_nearest_wall": "case when _w is null then null when _round then -(_hdx / _hs * (_mx - _cx) + _hdy / _hs * (_my - _cy)) / (dist_to_arena_center + 1e-6) when dist_to_left_wall = _near then -_hdx / _hs when dist_to_right_wall = _near then _hdx / _hs when dist_to_bottom_wall = _near then -_hdy / _hs else _hdy / _hs end"},
    {f"facing_wall_m{w}": q.mean("facing_nearest_wall", w, True, 4) for w in (15, 30, 60, 120)},
]
_family("arena_spatial", lambda df: single.arena(df, t, PARTS, F.when(c("entity") % 7 != 0, (40 + c("entity") % 5).cast("double")), (30 + c("entity") % 3).cast("double"), F.when(c("entity") % 2 == 0, "Circular").otherwise("square")), _arena)


# pairs
def _ab(p: tuple[str, str], who: str) -> tuple[str, str]:
    return f'"{who}_{p[0]}"', f'"{who}_{p[1]}"'


NA, NB, TA, TB, BA, BB = _ab(N, "A"), _ab(N, "B"), _ab(T, "A"), _ab(T, "B"), _ab(B, "A"), _ab(B, "B")
D = lambda e, n=1: q.diff(e, n, PO)
PM = lambda e, w, cen=True, part=5: q.mean(e, w, cen, part, over=PO)
PS = lambda e, w, cen=True, part=5: q.std(e, w, cen, part, over=PO)

_some = ("nose", "tail_base", "ear_left", "ear_right")
_family("pair_distances", lambda df: single.elongation(pair.cross_distances(df, _some, PARTS, PARTS)), [
    {f"{a}+{b}": _sq((f'"A_{a}_x"', f'"A_{a}_y"'), (f'"B_{b}_x"', f'"B_{b}_y"')) for a in _some for b in _some}, {"elong": '"nose+tail_base" / ("ear_left+ear_right" + 1e-6)'},
], digits=3, pairs=True)

_orient = [
    {"_oax": f"{NA[0]} - {TA[0]}", "_oay": f"{NA[1]} - {TA[1]}", "_obx": f"{NB[0]} - {TB[0]}", "_oby": f"{NB[1]} - {TB[1]}", "_dx": f"{BA[0]} - {BB[0]}", "_dy": f"{BA[1]} - {BB[1]}"},
    {"_d": q.norm("_dx", "_dy"), "A_face_B": q.cosine("_oax", "_oay", "-_dx", "-_dy"), "B_face_A": q.cosine("_obx", "_oby", "_dx", "_dy"), "A_front_of_B": f"(_dx * _obx + _dy * _oby) / ({q.norm('_obx', '_oby')} + 1e-6)", "A_side_of_B": f"(_dy * _obx - _dx * _oby) / ({q.norm('_obx', '_oby')} + 1e-6)",
     "B_front_of_A": f"-(_dx * _oax + _dy * _oay) / ({q.norm('_oax', '_oay')} + 1e-6)", "B_side_of_A": f"(_dx * _oay - _dy * _oax) / ({q.norm('_oax', '_oay')} + 1e-6)", "body_ori_alignment": q.cosine("_oax", "_oay", "_obx", "_oby")},
    {"body_overlap_score": "abs(body_ori_alignment) / (_d + 1)", "body_overlap_binary": q.flag("_d < 8 and abs(body_ori_alignment) > 0.7"), "vertical_overlap": q.flag('abs("A_front_of_B") < 3 and abs("A_side_of_B") < 3 and _d < 8')},
    {f"overlap_score_m{w}": PM("body_overlap_score", w) for w in (15, 30, 60)} | {f"overlap_binary_p{w}": PM("body_overlap_binary", w) for w in (15, 30, 60)} | {f"vertical_overlap_p{w}": PM("vertical_overlap", w) for w in (15, 30)},
]
_family("pair_orientation", lambda df: pair.orientation(df, pt, PARTS, PARTS), _orient, pairs=True)

_family("pair_nose", lambda df: pair.nose_features(df, pt, PARTS, PARTS), [
    {"_sq": _sq(NA, NB)}, {"_nn": "sqrt(_sq)"}, {"_near": q.flag("_nn < 10")},
    {f"appr_{n}": D("_sq", n) for n in (10, 20, 40)} | {f"nn_lg{n}": q.shift("_nn", n, PO) for n in (10, 20, 40)} | {f"nn_ch{n}": D("_nn", n) for n in (10, 20, 40)} | {f"cl_ps{n}": q.mean("_near", n, over=PO) for n in (10, 20, 40)},
], digits=3, pairs=True)
_family("pair_tail", lambda df: pair.tail_features(df, pt, PARTS, PARTS), [
    {"_x": f"{TB[0]} - {TA[0]}", "_y": f"{TB[1]} - {TA[1]}", "tailA_noseB_dist": _away(TA, NB), "tailB_noseA_dist": _away(TB, NA)}, {"tail_rel_dist": q.norm("_x", "_y"), "tail_rel_speed": f"{q.norm(D('_x'), D('_y'))} * 30"}, {"tail_approach_rate": f"-{D('tail_rel_dist')} * 30"},
    {f"{n}_m{w}": PM(n, w) for w in (15, 30, 60) for n in ("tail_rel_dist", "tail_rel_speed", "tail_approach_rate")},
], digits=3, pairs=True)
_shift2 = lambda p: (q.shift(p[0], 10, PO), q.shift(p[1], 10, PO))
_family("pair_ears", lambda df: pair.ear_features(df, pt, PARTS, PARTS), [
    {n: e for side, p in (("left", EL), ("right", ER)) for n, e in ((f"sp_A_{side}", _sq(_ab(p, "A"), _shift2(_ab(p, "A")))), (f"sp_AB_{side}", _sq(_ab(p, "A"), _shift2(_ab(p, "B")))), (f"sp_B_{side}", _sq(_ab(p, "B"), _shift2(_ab(p, "B")))))},
], digits=3, pairs=True)
_chase = [
    {"_rx": f"{BA[0]} - {BB[0]}", "_ry": f"{BA[1]} - {BB[1]}", "_ax": D(BA[0]), "_ay": D(BA[1]), "_bx": D(BB[0]), "_by": D(BB[1])}, {"_d": q.norm("_rx", "_ry")},
    {"_dd": D("_d"), "A_vel_along": "(_ax * _rx + _ay * _ry) / (_d + 1e-6)", "A_vel_perp": "(_ay * _rx - _ax * _ry) / (_d + 1e-6)", "B_vel_along": "-(_bx * _rx + _by * _ry) / (_d + 1e-6)", "B_vel_perp": "(_bx * _ry - _by * _rx) / (_d + 1e-6)"},
    {"A_chasing": q.flag('"A_vel_along" > 0 and _dd < 0'), "B_chasing": q.flag('"B_vel_along" > 0 and _dd > 0'), "A_chase_intensity": f'"A_vel_along" * -_dd / ({q.norm("_ax", "_ay")} + 1e-6)', "B_chase_intensity": f'"B_vel_along" * _dd / ({q.norm("_bx", "_by")} + 1e-6)',
     "A_escaping": q.flag('"A_vel_along" < 0 and "B_vel_along" < 0'), "B_escaping": q.flag('"B_vel_along" < 0 and "A_vel_along" > 0'), "A_sidestepping": q.flag('abs("A_vel_perp") > abs("A_vel_along")'), "B_sidestepping": q.flag('abs("B_vel_perp") > abs("B_vel_along")'), "_ca": q.flag('"A_vel_along" > 0'), "_cb": q.flag('"B_vel_along" > 0')},
    {f"{w}_{s}_p{n}": PM(f'"{w}_{e}"', n) for w in "AB" for n in (15, 30, 60) for s, e in (("chasing", "chasing"), ("escaping", "escaping"), ("sidestep", "sidestepping"))} | {f"{w}_chase_int_m{n}": PM(f'"{w}_chase_intensity"', n) for w in "AB" for n in (15, 30, 60)} | {f"{w}_chase_consist_{n}": PM(f"_c{w.lower()}", n) for w in "AB" for n in (30, 60)},
]
_family("pair_chase", lambda df: pair.pursuit(df, pt, PARTS, PARTS), _chase, digits=3, pairs=True)


def _dynamics() -> list[dict[str, str]]:
    base = {"_rx": f"{BA[0]} - {BB[0]}", "_ry": f"{BA[1]} - {BB[1]}", "_ax": D(BA[0]), "_ay": D(BA[1]), "_bx": D(BB[0]), "_by": D(BB[1])}
    two = {"_d": q.norm("_rx", "_ry"), "_sq": "_rx * _rx + _ry * _ry", "_vx": f"{D('_rx')} * 30", "_vy": f"{D('_ry')} * 30", "_sa": q.norm("_ax", "_ay"), "_sb": q.norm("_bx", "_by"), "_dot": "_ax * _bx + _ay * _by", "_aa": f"{q.norm(D('_ax'), D('_ay'))} * 30", "_ab": f"{q.norm(D('_bx'), D('_by'))} * 30", "_ang": "atan2(_ay, _ax) - atan2(_by, _bx)"}
    three = {"rel_accel": f"{q.norm(D('_vx'), D('_vy'))} * 30", "_turn": D("atan2(_vy, _vx)"), "_rs": q.norm("_vx", "_vy"), "_dd": D("_d"), "v_cls": q.flag("_d < 5"), "cls": q.flag("_d >= 5 and _d < 15"), "med": q.flag("_d >= 15 and _d < 30"), "far": q.flag("_d >= 30"),
             "_val": "_dot / (_sa * _sb + 1e-6)", "_la": "(_ax * _rx + _ay * _ry) / (_sa * _d + 1e-6)", "_lb": "-(_bx * _rx + _by * _ry) / (_sb * _d + 1e-6)", "leadership_asymmetry": "(_ax * _rx + _ay * _ry) / (_d + 1e-6) + (_bx * _rx + _by * _ry) / (_d + 1e-6)", "interaction_potential": "1 / (_d + 1e-6)",
             "direction_similarity": f"cos({q.wrap('_ang')})", "speed_similarity": "1 - abs(_sa - _sb) / (_sa + _sb + 1e-6)", "speed_diff": "_sa - _sb", "speed_ratio": "_sa / (_sb + 1e-6)", "_gap": "abs(_sa - _sb)", "accel_diff": "_aa - _ab"}
    four = {"rel_turn_rate": f"abs({q.wrap('_turn')}) * 30", "approach_rate": "-_dd * 30", "_chase": "-_dd * _lb"}
    five = {"rel_curvature": "rel_turn_rate / (_rs + 1e-6)", "sudden_escape": q.flag("approach_rate < -20")}
    last = {}
    for w in (5, 15, 30, 60):
        last |= {f"d_m{w}": q.mean("_sq", w, True, over=PO), f"d_s{w}": q.std("_sq", w, True, over=PO), f"d_mn{w}": q.least("_sq", w, True, over=PO), f"d_mx{w}": q.most("_sq", w, True, over=PO), f"int{w}": f"1 / (1 + ({q.var('_sq', w, True, over=PO)}))", f"co_m{w}": q.mean("_dot", w, True, over=PO), f"co_s{w}": q.std("_dot", w, True, over=PO)}
    last["int_con"] = f"({q.std('_sq', 30, True, over=PO)}) / ({q.mean('_sq', 30, True, over=PO)} + 1e-6)"
    last |= {f"va_{o}": q.shift("_val", -o, PO) for o in (-30, -20, -10, 0, 10, 20, 30)}
    for w in (30, 60):
        a, b = (q.total(k, w, True, 5, over=PO) for k in ("_sa", "_sb"))
        last |= {f"A_ld{w}": PM("_la", w, False, 6), f"B_ld{w}": PM("_lb", w, False, 6), f"path_diff_{w}": f"({a}) - ({b})", f"path_ratio_{w}": f"({a}) / (({b}) + 1e-6)"}
    last["chase_30"] = PM("_chase", 30, False, 6)
    both = lambda k: f"case when _sa is not null and _sb is not null then {k} end"
    last |= {f"sp_cor{w}": f"case when count({both('_sa')}) over ({PO} {q.rows(w, False)}) >= {w // 6} then covar_samp(_sa, _sb) over ({PO} {q.rows(w, False)}) / nullif(stddev_samp({both('_sa')}) over ({PO} {q.rows(w, False)}) * stddev_samp({both('_sb')}) over ({PO} {q.rows(w, False)}), 0) end" for w in (60, 120)}
    last["speed_dtw_distance"] = f"case when count(_gap) over ({PO} rows between 30 preceding and 1 preceding) = 30 then avg(_gap) over ({PO} rows between 30 preceding and 1 preceding) end"
    last |= {f"{n}_m{w}": PM(n, w) for w in (15, 30, 60) for n in ("rel_turn_rate", "rel_curvature", "rel_accel", "speed_diff", "speed_ratio")} | {f"rel_speed_m{w}": PM("_rs", w) for w in (15, 30, 60)} | {f"rel_speed_s{w}": PS("_rs", w) for w in (15, 30, 60)} | {f"speed_diff_s{w}": PS("speed_diff", w) for w in (15, 30, 60)}
    last |= {f"direction_sim_m{w}": PM("direction_similarity", w, True, 6) for w in (60, 120)} | {f"speed_sim_m{w}": PM("speed_similarity", w, True, 6) for w in (60, 120)} | {f"accel_diff_m{w}": PM("accel_diff", w) for w in (15, 30)}
    return [base, two, three, four, five, last]


_family("pair_dynamics", lambda df: pair.dynamics(df, pt, PARTS, PARTS), _dynamics(), digits=2, pairs=True)
_family("pair_facing", lambda df: pair.dynamics(pair.orientation(df, pt, PARTS, PARTS), pt, PARTS, PARTS), [
    *_orient[:2], {"facing_asymmetry": '"A_face_B" - "B_face_A"'}, {f"facing_asym_m{w}": PM("facing_asymmetry", w) for w in (15, 30)},
], pairs=True, hidden=tuple(k for layer in _orient[:2] for k in layer))


def _contacts() -> list[dict[str, str]]:
    first = {f"_{w}_{p}": _away(_ab(N, w), (f'"{o}_{p}_x"', f'"{o}_{p}_y"')) for w, o in ("AB", "BA") for p in PARTS}
    second = {f"{w}_front_to_{o}_min": f"least({', '.join(f'_{w}_{p}' for p in PARTS)})" for w, o in ("AB", "BA")} | {f"{w}_front_to_{o}_{s}": f"_{w}_{p}" for w, o in ("AB", "BA") for p, s in (("nose", "nose"), ("body_center", "center"), ("tail_base", "tail"))}
    third = {f"{w}_front_contact_{k}": q.flag(f'"{w}_front_to_{o}_min" < {k}') for w, o in ("AB", "BA") for k in (3, 5, 8)}
    last = {f"{n}_p{w}": PM(f'"{n}"', w) for n in third for w in (15, 30, 60)} | {f"{w}_contact_duration_{n}": q.total(f'"{w}_front_contact_5"', n, True, over=PO) for w in "AB" for n in (30, 60)}
    return [first, second, third, last]


_family("contact_occupancy", lambda df: pair.contacts(df, pt, PARTS, PARTS), _contacts(), pairs=True)

# the second family
APARTS = tuple(p for p in alt.PARTS if p in PARTS)
PPC = 1.7
_norm = lambda a, b: f"({_away(a, b)} / {PPC})"
_pt = lambda p, w="": (f'"{w}{p}_x"', f'"{w}{p}_y"')
ms = {200: 6, 500: 15, 1000: 30}
F_ = lambda e, n, over=q.OVER: q.mean(e, ms[n], True, mp=ms[n], over=over)
S_ = lambda e, n, over=q.OVER: q.std(e, ms[n], True, mp=ms[n], over=over)


def _alt_self(df: DataFrame) -> DataFrame:
    df = df.withColumns({"group_x": F.lit(20.0), "group_y": F.lit(9.0)})
    return alt.self_features(alt.with_parts(df), t, F.lit(PPC), (F.lit(50.0), F.lit(40.0)), APARTS)


def _alt_self_layers() -> list[dict[str, str]]:
    first = {f"_st_{p}": f"{q.norm(q.diff(f'{p}_x'), q.diff(f'{p}_y'))} / {PPC}" for p in alt.SPEED_PARTS} | {f"_v{k}_{p}": q.diff(f"{p}_{k}") for p in ("nose", "ear_left", "tail_base") for k in "xy"}
    first |= {"agent__heading": f"atan2({N[1]} - {T[1]}, {N[0]} - {T[0]})", "agent__body_length": _norm(N, T), "_jx": f"{N[0]} - {B[0]}", "_jy": f"{N[1]} - {B[1]}"} | {f"_st_{a}_{b}": _norm(_pt(a), _pt(b)) for a, b in alt.STRETCH}
    second = {f"_acc_{p}": f"{q.norm(q.diff(f'_vx_{p}'), q.diff(f'_vy_{p}'))} / {PPC} * 900" for p in ("nose", "ear_left", "tail_base")} | {"_turn0": q.diff("agent__heading"), "_jit": f"{q.norm(q.diff('_jx'), q.diff('_jy'))} / {PPC} * 30"} | {f"_sv_{a}_{b}": f"{q.diff(f'_st_{a}_{b}')} * 30 / {PPC}" for a, b in alt.STRETCH}
    third = {"_turn": f"abs({q.wrap_mod('_turn0')}) * 30"} | {f"_sp_{p}": f"_st_{p} * 30" for p in alt.SPEED_PARTS} | {"_path": f"_st_body_center * {PPC}"}
    ring = list(zip(alt.OUTLINE, alt.OUTLINE[1:] + alt.OUTLINE[:1], strict=True))
    last = {f"aa__{a}__{b}__distance": _norm(_pt(a), _pt(b)) for i, a in enumerate(APARTS) for b in APARTS[i + 1 :]} | {f"agent__{p}__speed_{n}ms": F_(f"_sp_{p}", n) for p in alt.SPEED_PARTS for n in ms}
    last |= {"agent__elongation": f"agent__body_length / ({_norm(EL, ER)} + 1e-6)", "agent__dist_to_wall": f"least({B[0]}, {50 * PPC} - {B[0]}, {B[1]}, {40 * PPC} - {B[1]}) / {PPC}", "agent__spine_angle": q.cosine(*_minus(N, B), *_minus(T, B)), "agent__dist_to_group_center": _norm(B, ("20.0", "9.0")),
             "agent__tortuosity_500ms": f"({q.total('_path', 15, True, mp=15)}) / ({q.norm(q.diff(B[0], 15), q.diff(B[1], 15))} + 1e-6)", "agent__nose_jitter_200ms": F_("_jit", 200), "agent__ang_vel_200ms": F_("_turn", 200),
             "agent__body_area": f"abs({' + '.join(f'{a}_x * {b}_y - {a}_y * {b}_x' for a, b in ring)}) / 2 / {PPC * PPC}"}
    last |= {n: e for a, b in alt.STRETCH for n, e in ((f"agent__{a}__{b}__stretch_vel_200ms", F_(f"_sv_{a}_{b}", 200)), (f"agent__{a}__{b}__pose_jitter_500ms", S_(f"_st_{a}_{b}", 500)))} | {f"agent__{s}__energy_200ms": F_(f"_acc_{p}", 200) for p, s in (("nose", "nose"), ("ear_left", "ear_l"), ("tail_base", "tail"))}
    return [first, second, third, last]


_family("alt_self", _alt_self, _alt_self_layers(), digits=2)


def _alt_context_layers() -> list[dict[str, str]]:
    z = lambda k: f"coalesce({k}, 0)"
    slow, fast = "agent__body_center__speed_500ms", "agent__body_center__speed_200ms"
    pre = {"_a5": f"abs({q.diff(slow)}) * 30", "_a2": f"abs({q.diff('agent__nose__speed_200ms')}) * 30"}
    two = {"agent__body_center__accel_500ms": F_("_a5", 500), "agent__nose__accel_200ms": F_("_a2", 200), "agent__speed_std_500ms": S_(fast, 500), "agent__interaction__grooming_ratio": f"{z('agent__nose_jitter_200ms')} / ({z(fast)} + 1)", "agent__interaction__agility_index": f"{z(fast)} * {z('agent__ang_vel_200ms')}", "agent__interaction__rear_score": f"{z('agent__body_length')} / ({z(slow)} + 1)"}
    layers = _alt_self_layers()
    names = [k for k in (*layers[0], *layers[-1], *two) if not k.startswith("_") and any(s in k for s in ("speed", "energy", "area"))]
    three = {n: e for k in names for n, e in ((f"{k}_avg_1s", F_(k, 1000)), (f"{k}_std_1s", S_(k, 1000)))}
    for k, s in ((slow, "speed"), ("agent__body_center__accel_500ms", "accel")):
        three |= {n: e for j in (5, 10, 15) for n, e in ((f"agent__{s}_lag_{j}", q.shift(k, j)), (f"agent__{s}_lead_{j}", q.shift(k, -j)))}
    return [*layers, pre, two, three]


_layers = _alt_context_layers()
_family("alt_self_context", lambda df: alt.self_context(alt.self_second(_alt_self(df), t), t), _layers, digits=2, hidden=tuple(k for layer in _alt_self_layers() for k in layer))


def _alt_pair(df: DataFrame) -> DataFrame:
    return alt.pair_features(alt.with_parts(df, ("A_", "B_"), (*alt.PARTS, *PARTS)), pt, F.lit(PPC), ("nose", "body_center", "tail_base"))


def _alt_pair_layers() -> list[dict[str, str]]:
    P = lambda p, w: _pt(p, f"{w}_")
    side = {"A": "agent", "B": "target"}
    first = {f"_st_{w}_{p}": f"{q.norm(D(P(p, w)[0]), D(P(p, w)[1]))} / {PPC} * 30" for w in "AB" for p in alt.SPEED_PARTS} | {"_close": _norm(BA, BB), "_rvx": f"{D(BA[0])} - {D(BB[0])}", "_rvy": f"{D(BA[1])} - {D(BB[1])}"}
    first |= {f"{side[w]}_heading": f"atan2({P('nose', w)[1]} - {P('tail_base', w)[1]}, {P('nose', w)[0]} - {P('tail_base', w)[0]})" for w in "AB"}
    second = {"_nearing": f"{D('_close')} * 30"}
    for w, o in ("AB", "BA"):
        n, m, b, th = P("nose", w), P("tail_base", w), P("body_center", w), P("body_center", o)
        second |= {f"_hx{w}": f"{n[0]} - {m[0]}", f"_hy{w}": f"{n[1]} - {m[1]}", f"_tx{w}": f"{th[0]} - {b[0]}", f"_ty{w}": f"{th[1]} - {b[1]}"}
    some = ("nose", "body_center", "tail_base")
    last = {f"at__{a}__{b}__dist": _norm(P(a, "A"), P(b, "B")) for a in some for b in some}
    last |= {"agent_nose__min_dist_to_target_head": f"least({', '.join(_norm(NA, P(p, 'B')) for p in alt.HEAD if p in PARTS)})", "agent_nose__min_dist_to_target_rear": f"least({', '.join(_norm(NA, P(p, 'B')) for p in alt.REAR)})"}
    last |= {f"{side[w]}__{p}__speed_{n}ms": F_(f'"_st_{w}_{p}"', n, PO) for w in "AB" for p in alt.SPEED_PARTS for n in ms}
    last |= {"relative_speed": f"{q.norm('_rvx', '_rvy')} / {PPC} * 30", "agent_relative_heading": q.wrap_mod(f"agent_heading - atan2({BB[1]} - {BA[1]}, {BB[0]} - {BA[0]})"), "mutual_facing_angle": "abs(abs(agent_heading - target_heading) - pi())", "approach_speed_200ms": F_("_nearing", 200, PO), "approach_speed_500ms": F_("_nearing", 500, PO)}
    for w, o in ("AB", "BA"):
        a, b, hx, hy, tx, ty = side[w], side[o], f'"_hx{w}"', f'"_hy{w}"', f'"_tx{w}"', f'"_ty{w}"'
        size = q.norm(hx, hy)
        last |= {f"{a}_to_{b}__long_dist": f"({hx} * {tx} + {hy} * {ty}) / ({size} + 1e-6) / {PPC}", f"{a}_to_{b}__lat_dist_signed": f"({hx} * {ty} - {hy} * {tx}) / ({size} + 1e-6) / {PPC}", f"{a}_to_{b}__lat_dist": f"abs(({hx} * {ty} - {hy} * {tx}) / ({size} + 1e-6) / {PPC})", f"{a}_facing_score": f"({hx} * {tx} + {hy} * {ty}) / ({size} * {q.norm(tx, ty)} + 1e-6)",
                 f"{a}_elongation": f"{_norm(P('nose', w), P('tail_base', w))} / ({_norm(P('ear_left', w), P('ear_right', w))} + 1e-6)", f"{a}_body_angle": q.cosine(*_minus(P("nose", w), P("body_center", w)), *_minus(P("tail_base", w), P("body_center", w)))}
    return [first, second, last]


_family("alt_pair", _alt_pair, _alt_pair_layers(), digits=2, pairs=True)


def _alt_pair_second_layers() -> list[dict[str, str]]:
    one = lambda e: f"({e})::int::double"
    f = [f"{w}__body_center__speed_200ms" for w in ("agent", "target")]
    s = [f"{w}__body_center__speed_500ms" for w in ("agent", "target")]
    dist, near = "at__body_center__body_center__dist", "approach_speed_500ms"
    two = {"speed_diff_200ms": f"{f[0]} - {f[1]}", "speed_diff_500ms": f"{s[0]} - {s[1]}", "speed_ratio_200ms": f"{f[0]} / ({f[1]} + 0.1)", "in_contact": one(f"{dist} < 5"), "face_to_face": one("mutual_facing_angle < 0.5 and at__nose__nose__dist < 5")}
    three = {"chase_score": " + ".join(f"{one(e)} * 0.33" for e in ("speed_diff_200ms > 0", "agent_facing_score > 0.5", f"{near} < 0")), "flee_score": " + ".join(f"{one(e)} * 0.33" for e in ("speed_diff_200ms < 0", "target_facing_score < 0", f"{near} > 0")),
             "sniff_score": f"({one('agent_nose__min_dist_to_target_head < 3')} + {one('agent_nose__min_dist_to_target_rear < 3')}) * (1 / ({f[0]} + 1))"}
    four = {n: e for k in (dist, near, "speed_diff_200ms", "chase_score") for n, e in ((f"{k}_avg_1s", F_(k, 1000, PO)), (f"{k}_std_1s", S_(k, 1000, PO)))} | {"dist_min_1s": q.least(dist, 30, True, mp=30, over=PO), "dist_max_1s": q.most(dist, 30, True, mp=30, over=PO)}
    four |= {n: e for j in (5, 10, 15, 30) for k, sh in ((dist, "dist"), (near, "approach"), (s[0], "agent_speed")) for n, e in ((f"{sh}_lag_{j}", q.shift(k, j, PO)), (f"{sh}_lead_{j}", q.shift(k, -j, PO)))}
    return [*_alt_pair_layers(), two, three, four, {"dist_change_1s": f"dist_lag_30 - {dist}", "approaching_trend": one(f"{near}_avg_1s < -0.5")}]


_family("alt_pair_second", lambda df: alt.pair_second(_alt_pair(df), pt), _alt_pair_second_layers(), digits=2, pairs=True, hidden=tuple(k for layer in _alt_pair_layers() for k in layer))

QUERIES = {n: f.query for n, f in FAMILIES.items()} | {"single_long_range": single_long_range}
ORACLE_SQL = {n: f.sql for n, f in FAMILIES.items()} | {"single_long_range": _long_range_sql()}
