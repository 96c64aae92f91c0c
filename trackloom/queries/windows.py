"""Windows and missing data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions.frames import norm
from trackloom.operators import decode, missing
from trackloom.queries import sql as q
from trackloom.queries import views as v
from trackloom.queries.views import TRACK as t

c = F.col
K = ["entity", "frame"]
X = f"select entity, frame, x, y, event_id, part, case when part = 'error' then null else x end as g, case when part = 'error' then null else y end as h from ({v.TRAJ_SQL})"


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trajectory, and g and h: x and y with the errors missing."""
    return v.traj(spark, sf_dir).withColumns({"g": F.when(c("part") != "error", c("x")), "h": F.when(c("part") != "error", c("y"))})


def diff_speed(spark, sf_dir):
    df = _x(spark, sf_dir).withColumns({"speed": norm(t.diff(c("x")), t.diff(c("y"))) * t.rate, "turn": t.diff(c("x"), 3)})
    return v.rounded(df, K, ["speed", "turn"])


def lag_lead(spark, sf_dir):
    return v.rounded(_x(spark, sf_dir).withColumns({"before": t.shift(c("x"), t.ws(10)), "after": t.shift(c("x"), -t.ws(10))}), K, ["before", "after"])


def roll_mean_centered(spark, sf_dir):
    df = _x(spark, sf_dir).withColumns({"m15": t.mean(c("g"), 15, True, 5), "m30": t.mean(c("g"), 30, True, 5), "s30": t.sum(c("g"), 30, True, 5)})
    return v.rounded(df, K, ["m15", "m30", "s30"])


def roll_std_trailing(spark, sf_dir):
    return v.rounded(_x(spark, sf_dir).withColumns({"std15": t.std(c("g"), 15, part=4), "var30": t.var(c("g"), 30, part=4)}), K, ["std15", "var30"], 3)


def roll_minmax(spark, sf_dir):
    return v.rounded(_x(spark, sf_dir).withColumns({"low": t.least(c("g"), 15, True), "high": t.most(c("g"), 15)}), K, ["low", "high"])


def roll_quantile_iqr(spark, sf_dir):
    df = _x(spark, sf_dir).withColumns({"q25": t.quantile(c("g"), 0.25, 20, part=4), "q75": t.quantile(c("g"), 0.75, 20, part=4)})
    return v.rounded(df.withColumn("iqr", c("q75") - c("q25")), K, ["q25", "q75", "iqr"])


def roll_pct_rank(spark, sf_dir):
    return v.rounded(_x(spark, sf_dir).withColumn("pct", t.percent_rank(c("h"), 30, 5)), K, ["pct"])


def roll_corr(spark, sf_dir):
    return v.rounded(_x(spark, sf_dir).withColumn("r", t.corr(c("g"), c("y"), 60, part=6)), K, ["r"])


def ewm_mean(spark, sf_dir):
    return v.rounded(t.ewm(_x(spark, sf_dir), {"e": ("g", 15)}), K, ["e"])


#: Four tracks of all events; x is missing in a run of 1,900 rows, and y where its own number says so.
LONG_SQL = f"select event_id % 4 as entity, row_number() over (partition by event_id % 4 order by event_id) as frame, x, y, event_id, part from ({v.TRAJ_SQL})"
LONG = f"select entity, frame, case when frame between 300 and 2199 or part = 'click' then null else x end as g, case when y < 60 then null else y end as h from ({LONG_SQL})"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = v.traj(spark, sf_dir).withColumn("entity", c("event_id") % 4)
    df = df.withColumn("frame", F.row_number().over(Window.partitionBy("entity").orderBy("event_id")).cast("bigint"))
    return df.select("entity", "frame", F.when(~c("frame").between(300, 2199) & (c("part") != "click"), c("x")).alias("g"), F.when(c("y") >= 60, c("y")).alias("h"))


def ewm_long_gap(spark, sf_dir):
    return v.rounded(t.ewm(_long(spark, sf_dir), {"e30": ("g", 30), "e3": ("h", 3), "e120": ("h", 120)}), K, ["e30", "e3", "e120"])


def gap_fill_long(spark, sf_dir):
    return v.rounded(missing.fill_gaps(_long(spark, sf_dir), t, ["g", "h"]), K, ["g", "h"])


def interpolate_long(spark, sf_dir):
    return v.rounded(missing.interpolate(_long(spark, sf_dir), t, ["g", "h"]), K, ["g", "h"])


def winsor_range(spark, sf_dir):
    low, high = (F.percentile(c("x"), p).over(t.whole) for p in (0.01, 0.99))
    df = _x(spark, sf_dir).withColumn("k", F.greatest(F.least(c("x"), high), low))
    return v.rounded(df.withColumn("rng", t.most(c("k"), 15, True) - t.least(c("k"), 15, True)), K, ["k", "rng"])


def lagged_window_gap(spark, sf_dir):
    df = _x(spark, sf_dir).withColumn("gap", F.abs(t.diff(c("g")) - t.diff(c("y"))))
    return v.rounded(df.withColumn("d", t.lagged_mean(c("gap"), 5)), K, ["d"])


def full_window_mean(spark, sf_dir):
    return v.rounded(_x(spark, sf_dir).withColumns({"m": t.full(F.avg, c("g"), 4), "s": t.full(F.stddev_samp, c("x"), 7)}), K, ["m", "s"])


def long_window_mean(spark, sf_dir):
    total, count = t.totals(c("g"))
    df = _x(spark, sf_dir).withColumns({"total": total, "count": count})
    return v.rounded(df.withColumns({"m240": t.long_mean(c("total"), c("count"), 240, True, 48), "t40": t.long_mean(c("total"), c("count"), 40, False, 8)}), K, ["m240", "t40"])


def gaussian_smooth(spark, sf_dir):
    return v.rounded(decode.gaussian(_x(spark, sf_dir), t, {"s": "x"}), K, ["s"])


def gap_fill(spark, sf_dir):
    return v.rounded(missing.fill_gaps(_x(spark, sf_dir), t, ["g", "h"]), K, ["g", "h"])


def missing_streak(spark, sf_dir):
    return v.rounded(missing.streak(_x(spark, sf_dir), t, c("g").isNull(), "streak"), K, ["streak"])


MISSING_OUT = ["kp_ok_cnt", "kp_missing_ratio", "nose_proxy_ok", "center_proxy_ok", "nose_missing_streak", "center_missing_streak", *(f"{k}_m{w}" for w in (15, 30, 60, 120) for k in ("kp_missing", "nose_ok", "center_ok"))]


def missing_features(spark, sf_dir):
    return v.rounded(missing.features(v.poses(spark, sf_dir), t, v.PARTS), K, MISSING_OUT)


MISSING_PAIR_OUT = [*(f"{w}_{k}" for w in "AB" for k in ("kp_missing_ratio", "nose_proxy_ok", "center_proxy_ok", "nose_missing_streak")), "AB_kp_missing_ratio_mean", "AB_kp_missing_ratio_diff", "AB_both_center_ok", *(f"AB_miss_m{w}" for w in (15, 30, 60, 120))]


def missing_pair(spark, sf_dir):
    return v.rounded(missing.pair_features(v.pose_pairs(spark, sf_dir), v.PAIR_TRACK, v.PARTS, v.PARTS), ["agent", "target", "frame"], MISSING_PAIR_OUT)


OUTLIER = ("nose", "body_center", "tail_base")
OUTLIER_OUT = [f"{p}_{k}" for p in OUTLIER for k in "xy"]


def outlier_null(spark, sf_dir):
    one = F.lit(1.0)
    df = missing.drop_far_parts(v.poses(spark, sf_dir), OUTLIER, one)
    return v.rounded(missing.drop_jumps(df, t, OUTLIER, one, limit=600.0), K, OUTLIER_OUT)


def interpolate_smooth(spark, sf_dir):
    df = missing.interpolate(_x(spark, sf_dir), t, ["g", "h"])
    return v.rounded(missing.smooth(df, t, ["g", "h"]), K, ["g", "h"])


NAMES = ("diff_speed", "lag_lead", "roll_mean_centered", "roll_std_trailing", "roll_minmax", "roll_quantile_iqr", "roll_pct_rank", "roll_corr", "ewm_mean", "ewm_long_gap", "gap_fill_long", "interpolate_long", "winsor_range", "lagged_window_gap", "full_window_mean", "long_window_mean", "gaussian_smooth", "gap_fill", "missing_streak", "missing_features", "missing_pair", "outlier_null", "interpolate_smooth")
QUERIES = {k: globals()[k] for k in NAMES}


def _streak(missing_sql: str, name: str, keys: str) -> list[dict[str, str]]:
    """Two layers: number of valid rows so far, and the place in the run of missing ones."""
    return [
        {f"_ok_{name}": f"sum(case when {missing_sql} then 0 else 1 end) over (partition by {keys} order by frame rows unbounded preceding)"},
        {name: f"case when {missing_sql} then row_number() over (partition by {keys}, _ok_{name} order by frame) else 0 end"},
    ]


def _fill(name: str, limit: int) -> list[dict[str, str]]:
    o = q.OVER
    return [
        {f"{name}_a": f"last_value({name} ignore nulls) over ({o} rows between unbounded preceding and current row)", f"{name}_i": f"max(case when {name} is not null then rn end) over ({o} rows between unbounded preceding and current row)",
         f"{name}_b": f"first_value({name} ignore nulls) over ({o} rows between current row and unbounded following)", f"{name}_j": f"min(case when {name} is not null then rn end) over ({o} rows between current row and unbounded following)"},
        {f"{name}_1": f"case when {name} is not null then {name} when {name}_a is not null and {name}_b is not null{f' and rn - {name}_i <= {limit}' if limit else ''} then {name}_a + ({name}_b - {name}_a) / ({name}_j - {name}_i) * (rn - {name}_i) end"},
    ]


def _merge(*many: list[dict[str, str]]) -> list[dict[str, str]]:
    return [{k: e for one in layer for k, e in one.items()} for layer in zip(*many, strict=True)]


def _gap_fill_sql(base: str = X) -> str:
    o = q.OVER
    two = [{f"{n}_2": f"last_value({n}_1 ignore nulls) over ({o} rows between 8 preceding and current row)" for n in "gh"}, {f"{n}_3": f"first_value({n}_2 ignore nulls) over ({o} rows between current row and 8 following)" for n in "gh"}]
    inner = q.layered(base, [{"rn": f"row_number() over ({o})"}, *_merge(_fill("g", 8), _fill("h", 8)), *two], K, ["g_3", "h_3"])
    return f"select entity, frame, g_3 as g, h_3 as h from ({inner})"


def _smooth_sql() -> str:
    o = q.OVER
    mean = {f"{n}_2": f"coalesce({n}_1, avg({n}_1) over (partition by entity))" for n in "gh"}
    last = {f"{n}_3": f"coalesce({q.mean(f'{n}_2', 7, True, mp=7)}, avg({n}_2) over (partition by entity))" for n in "gh"}
    inner = q.layered(X, [{"rn": f"row_number() over ({o})"}, *_merge(_fill("g", 0), _fill("h", 0)), mean, last], K, ["g_3", "h_3"])
    return f"select entity, frame, g_3 as g, h_3 as h from ({inner})"


def _ok(part: str, p: str = "") -> str:
    return f'("{p}{part}_x" is not null and "{p}{part}_y" is not null)'


def _count(p: str = "") -> str:
    return " + ".join(f"(case when {_ok(part, p)} then 1.0 else 0.0 end)" for part in v.PARTS)


def _missing_sql() -> str:
    n = len(v.PARTS)
    first = {"kp_ok_cnt": _count(), "kp_missing_ratio": f"1 - ({_count()})::double / ({n} + 1e-6)", "nose_proxy_ok": q.flag(_ok("nose")), "center_proxy_ok": q.flag(_ok("body_center"))}
    runs = _merge(_streak("nose_proxy_ok < 0.5", "nose_missing_streak", "entity"), _streak("center_proxy_ok < 0.5", "center_missing_streak", "entity"))
    last = {f"{k}_m{w}": q.mean(e, w, True, 5) for w in (15, 30, 60, 120) for k, e in (("kp_missing", "kp_missing_ratio"), ("nose_ok", "nose_proxy_ok"), ("center_ok", "center_proxy_ok"))}
    return q.layered(v.POSE_SQL, [first, *runs, last], K, MISSING_OUT)


def _missing_pair_sql() -> str:
    n, first = len(v.PARTS), {}
    for w in "AB":
        first |= {f"{w}_kp_missing_ratio": f"1 - ({_count(w + '_')})::double / ({n} + 1e-6)", f"{w}_nose_proxy_ok": q.flag(_ok("nose", w + "_")), f"{w}_center_proxy_ok": q.flag(_ok("body_center", w + "_"))}
    second = {"AB_kp_missing_ratio_mean": '("A_kp_missing_ratio" + "B_kp_missing_ratio") / 2', "AB_kp_missing_ratio_diff": '"A_kp_missing_ratio" - "B_kp_missing_ratio"', "AB_both_center_ok": '"A_center_proxy_ok" * "B_center_proxy_ok"'}
    runs = _merge(*(_streak(f'"{w}_nose_proxy_ok" < 0.5', f"{w}_nose_missing_streak", "agent, target") for w in "AB"))
    last = {f"AB_miss_m{w}": q.mean('"AB_kp_missing_ratio_mean"', w, True, 5, over=v.PAIR_OVER) for w in (15, 30, 60, 120)}
    return q.layered(v.PAIR_SQL, [first, second, *runs, last], ["agent", "target", "frame"], MISSING_PAIR_OUT)


def _outlier_sql() -> str:
    far = {f"o_{p}_{k}": f"{p}_{k}" if p == "body_center" else f"case when {q.norm(f'{p}_x - body_center_x', f'{p}_y - body_center_y')} > 15 then null else {p}_{k} end" for p in OUTLIER for k in "xy"}
    fast = {f"z_{p}_{k}": f"case when {q.norm(q.diff(f'o_{p}_x'), q.diff(f'o_{p}_y'))} * 30 > 600 then null else o_{p}_{k} end" for p in OUTLIER for k in "xy"}
    inner = q.layered(v.POSE_SQL, [far, fast], K, [f"z_{k}" for k in OUTLIER_OUT])
    return f"select entity, frame, {', '.join(f'z_{k} as {k}' for k in OUTLIER_OUT)} from ({inner})"


def _gaussian_sql() -> str:
    """Rows joined to their mirrored neighbours."""
    weights = [math.exp(-0.5 * (k / 2.0) ** 2) for k in range(-8, 9)]
    taps = ", ".join(f"({k}, {w / sum(weights)!r})" for k, w in zip(range(-8, 9), weights, strict=True))
    return f"""with t as ({X}), n as (select entity, count(*) as n from t group by entity), w(k, weight) as (values {taps}),
        mirrored as (select entity, frame, weight, ((frame - 1 + k) % (2 * n) + 2 * n) % (2 * n) as m, n from t join n using (entity), w)
        select a.entity, a.frame, round(sum(b.x * a.weight), 4) + 0.0 as s from mirrored a join t b on a.entity = b.entity and b.frame - 1 = case when a.m >= a.n then 2 * a.n - 1 - a.m else a.m end group by 1, 2"""


def _ewm_long_sql() -> str:
    """Rows joined to those before them with a weight above 1e-15; where all of these are missing, the last mean before."""
    spans = {"e30": ("g", 30), "e3": ("h", 3), "e120": ("h", 120)}
    near = ", ".join(f"sum(o.{k} * power({1 - 2 / (w + 1)}, t.frame - o.frame)) / sum(case when o.{k} is not null then power({1 - 2 / (w + 1)}, t.frame - o.frame) end) as {n}" for n, (k, w) in spans.items())
    kept = ", ".join(f"last_value(case when {k} is not null then {n} end ignore nulls) over ({q.OVER} rows between unbounded preceding and current row) as {n}" for n, (k, _) in spans.items())
    return f"""with t as ({LONG}), j as (select t.entity, t.frame, any_value(t.g) as g, any_value(t.h) as h, {near} from t join t o on o.entity = t.entity and o.frame <= t.frame and o.frame > t.frame - 2100 group by 1, 2),
        k as (select entity, frame, {kept} from j) select entity, frame, {', '.join(f'round({n}, 4) + 0.0 as {n}' for n in spans)} from k"""


def _ewm_sql() -> str:
    a = 2 / 16
    return f"""with t as ({X}) select t.entity, t.frame, round(sum(o.g * power({1 - a}, t.frame - o.frame)) / sum(case when o.g is not null then power({1 - a}, t.frame - o.frame) end), 4) + 0.0 as e
        from t join t o on o.entity = t.entity and o.frame <= t.frame group by 1, 2"""


def _pct_sql() -> str:
    return f"""with t as ({X}) select t.entity, t.frame, round(case when any_value(t.h) is not null and count(o.h) >= 5
        then (count(*) filter (where o.h < t.h) + (count(*) filter (where o.h = t.h) + 1) / 2.0) / count(o.h) end, 4) + 0.0 as pct
        from t join t o on o.entity = t.entity and o.frame between t.frame - 29 and t.frame group by 1, 2"""


ORACLE_SQL = {
    "diff_speed": q.layered(X, [{"speed": f"{q.norm(q.diff('x'), q.diff('y'))} * 30", "turn": q.diff("x", 3)}], K, ["speed", "turn"]),
    "lag_lead": q.layered(X, [{"before": q.shift("x", 10), "after": q.shift("x", -10)}], K, ["before", "after"]),
    "roll_mean_centered": q.layered(X, [{"m15": q.mean("g", 15, True, 5), "m30": q.mean("g", 30, True, 5), "s30": q.total("g", 30, True, 5)}], K, ["m15", "m30", "s30"]),
    "roll_std_trailing": q.layered(X, [{"std15": q.std("g", 15, part=4), "var30": q.var("g", 30, part=4)}], K, ["std15", "var30"], 3),
    "roll_minmax": q.layered(X, [{"low": q.least("g", 15, True), "high": q.most("g", 15)}], K, ["low", "high"]),
    "roll_quantile_iqr": q.layered(X, [{"q25": q.roll("quantile_cont({}, 0.25)", "g", 20, part=4), "q75": q.roll("quantile_cont({}, 0.75)", "g", 20, part=4)}, {"iqr": "q75 - q25"}], K, ["q25", "q75", "iqr"]),
    "roll_pct_rank": _pct_sql(),
    "roll_corr": q.layered(X, [{"yy": "case when g is not null then y end"}, {"n": f"count(g) over ({q.OVER} {q.rows(60, False)})", "rr": f"corr(g, yy) over ({q.OVER} {q.rows(60, False)})"}, {"r": "case when n >= 10 and not isnan(rr) then rr end"}], K, ["r"]),
    "ewm_mean": _ewm_sql(),
    "ewm_long_gap": _ewm_long_sql(),
    "gap_fill_long": _gap_fill_sql(LONG),
    "interpolate_long": f"select entity, frame, round(coalesce(g_1, avg(g_1) over (partition by entity)), 4) + 0.0 as g, round(coalesce(h_1, avg(h_1) over (partition by entity)), 4) + 0.0 as h from ({q.layered(LONG, [{'rn': f'row_number() over ({q.OVER})'}, *_merge(_fill('g', 0), _fill('h', 0))], K, ['g_1', 'h_1'], 12)})",
    "winsor_range": q.layered(X, [{"lo": "quantile_cont(x, 0.01) over (partition by entity)", "hi": "quantile_cont(x, 0.99) over (partition by entity)"}, {"k": "greatest(least(x, hi), lo)"}, {"rng": f"{q.most('k', 15, True)} - {q.least('k', 15, True)}"}], K, ["k", "rng"]),
    "lagged_window_gap": q.layered(X, [{"gap": f"abs({q.diff('g')} - {q.diff('y')})"}, {"d": f"case when count(gap) over ({q.OVER} rows between 5 preceding and 1 preceding) = 5 then avg(gap) over ({q.OVER} rows between 5 preceding and 1 preceding) end"}], K, ["d"]),
    "full_window_mean": q.layered(X, [{"m": q.mean("g", 4, True, mp=4), "s": q.std("x", 7, True, mp=7)}], K, ["m", "s"]),
    "long_window_mean": q.layered(X, [{"m240": q.mean("g", 240, True, mp=48), "t40": q.mean("g", 40, mp=8)}], K, ["m240", "t40"]),
    "gaussian_smooth": _gaussian_sql(),
    "gap_fill": _gap_fill_sql(),
    "missing_streak": q.layered(X, _streak("g is null", "streak", "entity"), K, ["streak"]),
    "missing_features": _missing_sql(),
    "missing_pair": _missing_pair_sql(),
    "outlier_null": _outlier_sql(),
    "interpolate_smooth": _smooth_sql(),
}
