"""Which behaviours are labelled in a video, and labels of frames from annotated intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: Behaviours of a mouse by itself, and of one towards another.
SELF_BEHAVIOURS = ("biteobject", "climb", "dig", "exploreobject", "freeze", "genitalgroom", "huddle", "rear", "rest", "run", "selfgroom")
PAIR_BEHAVIOURS = (
    "allogroom", "approach", "attack", "attemptmount", "avoid", "chase", "chaseattack", "defend", "disengage", "dominance", "dominancegroom", "dominancemount", "ejaculate",
    "escape", "flinch", "follow", "intromit", "mount", "reciprocalsniff", "shepherd", "sniff", "sniffbody", "sniffface", "sniffgenital", "submit", "tussle",
)


def of_kind(behaviours: DataFrame, kind: str, column: str = "action") -> DataFrame:
    """Behaviours of the kind `self` or `pair`, by their names; unknown names are of neither."""
    return behaviours.where(c(column).isin(*{"self": SELF_BEHAVIOURS, "pair": PAIR_BEHAVIOURS}[kind]))


def of_videos(solution: DataFrame, submission: DataFrame, video: str = "video_id") -> DataFrame:
    """Rows of the solution whose video the submission has."""
    return solution.join(submission.select(video).distinct(), video, "left_semi")


def parse_behaviours(videos: DataFrame, column: str = "behaviors_labeled", distinct: bool = True) -> DataFrame:
    """One row per labelled (agent, target, action) of a JSON array of "agent,target,action"; quotes within are dropped.
    With distinct, repeated ones count once, in order; without, all come as they are."""
    cells = F.transform(F.from_json(c(column), "array<string>"), lambda s: F.regexp_replace(s, "'", ""))
    cells = F.array_sort(F.array_distinct(cells)) if distinct else cells
    rows = videos.select(*(k for k in videos.columns if k != column), F.explode(cells).alias("_cell")).withColumn("_cell", F.split("_cell", ","))
    return rows.select(*(k for k in videos.columns if k != column), *(F.trim(F.get("_cell", F.lit(k))).alias(n) for k, n in enumerate(("agent", "target", "action"))))


def mouse_number(name: Column) -> Column:
    """3 of `mouse3`; NULL of `self`."""
    return F.when(name.rlike(r"mouse\d+"), F.regexp_extract(name, r"mouse(\d+)", 1)).cast("int")


def mouse_name(number: Column) -> Column:
    return F.concat(F.lit("mouse"), number.cast("string"))


def target_name(agent: Column, target: Column) -> Column:
    return F.when(agent == target, F.lit("self")).otherwise(mouse_name(target))


def hit_frames(intervals: DataFrame, keys: list[str], stop_inclusive: bool) -> DataFrame:
    """A row for every frame that an interval of an action covers. Whether stop itself counts is the two conventions'
    difference: it does in P1's labels, not in P2's."""
    stop = c("stop_frame") if stop_inclusive else c("stop_frame") - 1
    return intervals.where(stop >= c("start_frame")).select(*keys, "action", F.explode(F.sequence("start_frame", stop)).alias("frame")).distinct()


def label_frames(frames: DataFrame, intervals: DataFrame, labelled: DataFrame, keys: list[str], stop_inclusive: bool = True) -> DataFrame:
    """(keys, frame, action, label) for every frame and action: 1 inside an interval of the action, 0 elsewhere if the
    action is labelled for the key. An action that is annotated but not labelled has its 1s only. Long intervals are
    expanded per frame, so the join is an equi-join on (keys, frame, action)."""
    wanted = frames.select(*keys, "frame").join(labelled.select(*keys, "action").distinct(), keys)
    hits = hit_frames(intervals, keys, stop_inclusive).join(frames.select(*keys, "frame"), [*keys, "frame"], "left_semi").withColumn("_hit", F.lit(1))
    both = wanted.withColumn("_asked", F.lit(1)).join(hits, [*keys, "frame", "action"], "full")
    return both.select(*keys, "frame", "action", F.when(c("_hit").isNotNull(), 1).otherwise(0).cast("tinyint").alias("label"))


def coverage(expected: DataFrame, observed: DataFrame, columns: list[str]) -> DataFrame:
    """Expected behaviours that weren't observed."""
    return expected.select(*columns).distinct().join(observed.select(*columns).distinct(), columns, "left_anti")


def without_prediction(videos: DataFrame, predicted: DataFrame, key: str = "video_id") -> DataFrame:
    return videos.join(predicted.select(key).distinct(), key, "left_anti")
