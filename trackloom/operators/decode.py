"""From frame probabilities to intervals of behaviour, and checks of intervals.

Intervals are half-open: [start_frame, stop_frame). Of equal probabilities the first action in the given order wins.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.frames import Track
from trackloom.operators.durations import LEAST_FRAMES, LEAST_OTHERWISE

c = F.col
NONE = "none"


def winner(probabilities: dict[str, Column]) -> tuple[Column, Column]:
    """Name and probability of the first greatest."""
    values = F.array(*(F.coalesce(p, F.lit(-1.0)) for p in probabilities.values()))
    best = F.array_max(values)
    return F.element_at(F.array(*map(F.lit, probabilities)), F.array_position(values, best).cast("int")), best


def thresholds(cutoffs: dict[str, float], name: Column, default: float | None = None) -> Column:
    table = F.create_map(*(x for k, v in cutoffs.items() for x in (F.lit(k), F.lit(float(v)))))
    found = F.try_element_at(table, name)
    return found if default is None else F.coalesce(found, F.lit(default))


def check_probabilities(df: DataFrame, names: list[str]) -> DataFrame:
    """df, which raises when a probability isn't a number from 0 to 1."""
    bad = lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1)
    return df.withColumns({n: F.when(bad(c(n)), F.raise_error(F.lit(f"{n} is no probability")).cast("double")).otherwise(c(n)) for n in names})


def runs(df: DataFrame, t: Track, label: str, gaps: bool = True) -> DataFrame:
    """Runs of equal labels, also broken by gaps in frame numbers: keys, label, start_frame, stop_frame. NULL labels
    break runs and make none. One shuffle: the window and the aggregation share the keys' partitioning."""
    before = t.shift(c(label), 1)
    change = F.coalesce(~c(label).eqNullSafe(before), F.lit(True))
    if gaps:
        change = change | F.coalesce(c(t.frame) - t.shift(c(t.frame), 1) != 1, F.lit(True))
    marked = df.withColumn("_run", F.sum(F.when(change, 1).otherwise(0)).over(t.over.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where(c(label).isNotNull()).groupBy(*t.keys, "_run", label).agg(F.min(t.frame).alias("start_frame"), (F.max(t.frame) + 1).alias("stop_frame")).drop("_run")


def intervals(df: DataFrame, t: Track, cutoffs: dict[str, float], checked: bool = True) -> DataFrame:
    """The canonical decoding: in each frame the winner counts if it reaches its own cut-off; runs of it are intervals.
    checked: what isn't a probability raises; else any score is taken as it is (NULL never wins, NaN is the greatest)."""
    name, best = winner({a: c(a) for a in cutoffs})
    chosen = (check_probabilities(df, list(cutoffs)) if checked else df).withColumns({"_name": name, "_best": best})
    chosen = chosen.select(*t.keys, t.frame, F.when(c("_best") >= thresholds(cutoffs, c("_name")), c("_name")).alias("action"))
    return runs(chosen, t, "action")


def legacy(df: DataFrame, t: Track, cutoffs: dict[str, float], default: float = 0.27) -> DataFrame:
    """The former decoding, for comparison: gaps don't break runs, a run ends where the next one starts, and the last
    run of a track is lost."""
    name, best = winner({a: c(a) for a in cutoffs})
    chosen = df.withColumns({"_name": name, "_best": best}).withColumn("_label", F.when(c("_best") >= thresholds(cutoffs, c("_name"), default), c("_name")).otherwise(NONE))
    starts = chosen.withColumn("_new", F.coalesce(c("_label") != t.shift(c("_label"), 1), F.lit(True))).where("_new")
    ended = starts.withColumn("stop_frame", F.lead(c(t.frame)).over(t.over)).where(c("stop_frame").isNotNull() & (c("_label") != NONE))
    return ended.select(*t.keys, c("_label").alias("action"), c(t.frame).alias("start_frame"), "stop_frame")


def by_change(df: DataFrame, t: Track, label: str) -> DataFrame:
    """Runs as rows where the label differs from the row before, up to the next such row. In three-valued logic the
    first row of a track has nothing to differ from, so its run is lost; the last run has no stop."""
    starts = df.withColumn("_new", c(label) != t.shift(c(label), 1)).where("_new")
    return starts.select(*t.keys, c(label).alias("action"), c(t.frame).alias("start_frame"), F.lead(c(t.frame)).over(t.over).alias("stop_frame"))


def out_of_fold(df: DataFrame, t: Track, actions: list[str]) -> DataFrame:
    """Decoding of `prediction_<action>` times `label_<action>`; a row of zeros is `none`, whose runs are left out, and
    so are runs without a stop."""
    scores = {a: c(f"prediction_{a}") * c(f"label_{a}") for a in actions}
    name, best = winner(scores)
    made = by_change(df.withColumn("_label", F.when(best == 0, NONE).otherwise(name)), t, "_label")
    return drop_invalid(made.where(c("action") != NONE))


def gaussian(df: DataFrame, t: Track, out: dict[str, str], sigma: float = 2.0, truncate: float = 4.0) -> DataFrame:
    """Adds Gaussian smoothings along the rows, {name: column}, mirrored at the ends with the edge rows repeated. A NULL
    within reach makes NULL.

    A mirrored row is never farther off than the reach, so all taps are among the rows that far before and after.
    """
    reach = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    shares = [w / total for w in weights]
    near = {f"_g_{name}": F.array(*(t.shift(c(column), -k) for k in range(-reach, reach + 1))) for name, column in out.items()}
    rest = F.count(F.lit(1)).over(t.over.rowsBetween(0, reach))  # this row and those after it, as far as taps reach
    made = df.withColumns(near | {"_g_at": F.row_number().over(t.over) - 1, "_g_rest": rest})
    place, n = c("_g_at"), c("_g_at") + c("_g_rest")  # n: the track's length, or more than any tap's place

    def mirrored(k: int) -> Column:
        at = F.pmod(place + k, 2 * n)
        return F.when(at >= n, 2 * n - 1 - at).otherwise(at) - place + reach

    def smooth(seen: Column) -> Column:
        inner = [F.get(seen, F.lit(j)) * w for j, w in enumerate(shares)]
        edge = [F.get(seen, mirrored(j - reach).cast("int")) * w for j, w in enumerate(shares)]
        return F.when((place >= reach) & (c("_g_rest") > reach), reduce(operator.add, inner)).otherwise(reduce(operator.add, edge))

    return made.withColumns({name: smooth(c(f"_g_{name}")) for name in out}).drop("_g_at", "_g_rest", *near)


def long_enough(found: DataFrame, lab: Column, least_frames: dict[str, int] | None = None, default: int = LEAST_OTHERWISE) -> DataFrame:
    """Intervals of at least the lab's and action's number of frames; those without a stop count as long enough."""
    table = F.create_map(*(x for k, v in (LEAST_FRAMES if least_frames is None else least_frames or {"": 0}).items() for x in (F.lit(k), F.lit(int(v)))))
    least = F.coalesce(F.try_element_at(table, F.concat(lab, F.lit("_"), c("action"))), F.lit(default))
    return found.where(c("stop_frame").isNull() | (c("stop_frame") - c("start_frame") >= least))


def pair_order(agent: str = "agent_id", target: str = "target_id") -> list[Column]:
    """How (agent, target) are listed: by agent, the agent itself first and then the other targets."""
    return [c(agent), c(target) != "self", c(target)]


def scored(df: DataFrame, t: Track, cutoffs: dict[str, float], least_frames: dict[str, int] | None, lab: str, default: int = LEAST_OTHERWISE) -> DataFrame:
    """Decoding of smoothed fold means: a score is p / cut-off where p reaches it, else 0; runs of the best score of at
    least the lab's and action's number of frames. A run without a stop counts as long enough here and is dropped then,
    as is the first run of a track."""
    smoothed = gaussian(df, t, {f"_s_{a}": a for a in cutoffs})
    smoothed = smoothed.withColumns({f"_q_{a}": F.when(c(f"_s_{a}") >= v, F.coalesce(F.try_divide(c(f"_s_{a}"), F.lit(float(v))), F.lit(0.0))).otherwise(0.0) for a, v in cutoffs.items()})
    name, best = winner({a: c(f"_q_{a}") for a in cutoffs})
    made = by_change(smoothed.withColumn("_label", F.when(best == 0, NONE).otherwise(name)), t, "_label").where(c("action") != NONE)
    return drop_invalid(long_enough(made, F.lit(lab), least_frames, default))


def drop_invalid(found: DataFrame) -> DataFrame:
    """Without intervals that are empty, reversed or open."""
    return found.where(c("start_frame") < c("stop_frame"))


def drop_overlaps(found: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy by start within keys: an interval stays if it starts at or after the last kept stop (0 at first). What
    stays depends on what stayed before, so each key's intervals are folded as an array; they are one video's."""
    rest = [k for k in found.columns if k not in (*keys, "start_frame", "stop_frame")]
    row = F.struct("start_frame", "stop_frame", *rest)
    whole = found.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    kind = whole.schema["_all"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("bigint").alias("stop"), F.array().cast(kind).alias("kept"))
    step = lambda s, x: F.when(x["start_frame"] >= s["stop"], F.struct(x["stop_frame"].cast("bigint").alias("stop"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s)
    kept = whole.select(*keys, F.explode(F.aggregate("_all", start, step, lambda s: s["kept"])).alias("_x"))
    return kept.select(*keys, *(c(f"_x.{k}").alias(k) for k in ("start_frame", "stop_frame", *rest))).select(*found.columns)


def fill_empty(found: DataFrame, spans: DataFrame, allowed: DataFrame, video: str = "video_id") -> DataFrame:
    """Intervals for videos that have none: for each (agent, target), the video's frames [low, high] are cut into equal
    batches, rounded up, one for each of its actions in order. spans: video, low, high. allowed: video, agent, target, action."""
    empty = spans.join(found.select(video).distinct(), video, "left_anti")
    pair = Window.partitionBy(video, "agent", "target")
    rows = allowed.distinct().withColumns({"_k": F.row_number().over(pair.orderBy("action")) - 1, "_n": F.count(F.lit(1)).over(pair)}).join(empty, video)
    size = F.ceil((c("high") + 1 - c("low")) / c("_n"))
    start = c("low") + c("_k") * size
    made = rows.select(video, "agent", "target", "action", start.cast("bigint").alias("start_frame"), F.least(start + size, c("high") + 1).cast("bigint").alias("stop_frame"))
    return drop_invalid(made)


def validation(found: DataFrame, allowed: DataFrame, spans: DataFrame, video: str = "video_id") -> DataFrame:
    """(problem, n) of every kind of fault: `null`, `reversed`, `unknown_video`, `out_of_range`, `not_labelled`,
    `duplicate`, `overlap`; none if all is well."""
    keys = [video, "agent", "target", "action", "start_frame", "stop_frame"]
    one = lambda name, rows: rows.agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(F.lit(name).alias("problem"), "n")
    missing = None
    for k in keys:
        missing = c(k).isNull() if missing is None else missing | c(k).isNull()
    known = found.join(spans.withColumnRenamed(video, "_v"), c(video) == c("_v"), "left")
    order = Window.partitionBy(video, "agent", "target").orderBy("start_frame", "stop_frame", "action")
    problems = [
        one("null", found.where(missing)),
        one("reversed", found.where(c("start_frame") >= c("stop_frame"))),
        one("unknown_video", known.where(c("_v").isNull())),
        one("out_of_range", known.where((c("start_frame") < c("low")) | (c("stop_frame") > c("high") + 1))),
        one("not_labelled", found.join(allowed.distinct(), [video, "agent", "target", "action"], "left_anti")),
        one("duplicate", found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")),
        one("overlap", found.withColumn("_p", F.max("stop_frame").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(c("_p") > c("start_frame"))),
    ]
    out = problems[0]
    for p in problems[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")


def validate(found: DataFrame, allowed: DataFrame, spans: DataFrame, video: str = "video_id") -> None:
    problems = validation(found, allowed, spans, video).collect()  # seven rows at most
    if problems or found.isEmpty():
        raise ValueError("invalid intervals: " + (", ".join(f"{r.problem} {r.n}" for r in problems) or "none"))


def segments(df: DataFrame, t: Track, flag: str) -> DataFrame:
    """Runs of frames where a flag is true."""
    return runs(df.select(*t.keys, t.frame, F.when(c(flag), True).alias("on")), t, "on").drop("on")


def crop(found: DataFrame, before: float, after: float, fps: float, keys: list[str] | None = None) -> DataFrame:
    """The intervals around the longest one (of equal ones the first) of each key, or of all: from so many seconds before
    its start to so many after."""
    keys = keys or []
    longest = F.max_by("start_frame", F.struct(c("stop_frame") - c("start_frame"), -c("start_frame"))).alias("_at")
    at = found.groupBy(*keys).agg(longest)
    both = found.join(at, keys) if keys else found.crossJoin(F.broadcast(at))  # one row
    return both.where((c("stop_frame") > c("_at") - before * fps) & (c("start_frame") < c("_at") + after * fps)).drop("_at").select(*found.columns)
