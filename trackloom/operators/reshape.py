"""From long keypoint tables to wide ones, and from mice to ordered pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that are left out of videos with more than LEAN parts, and labs whose videos are left out.
REDUNDANT = (
    "headpiece_bottombackleft", "headpiece_bottombackright", "headpiece_bottomfrontleft", "headpiece_bottomfrontright",
    "headpiece_topbackleft", "headpiece_topbackright", "headpiece_topfrontleft", "headpiece_topfrontright",
    "spine_1", "spine_2", "tail_middle_1", "tail_middle_2", "tail_midpoint",
)
LEAN = 5
SKIPPED_LABS = "MABe22"


def usable_videos(videos: DataFrame) -> DataFrame:
    """Videos of other than the skipped labs that have a list of labelled behaviours."""
    return videos.where(~F.col("lab_id").startswith(SKIPPED_LABS) & F.col("behaviors_labeled").isNotNull())


def drop_redundant(long: DataFrame, video: str = "video_id") -> DataFrame:
    """Rows of redundant parts go where a video has more than LEAN parts."""
    counts = long.groupBy(video).agg(F.count_distinct("bodypart").alias("_parts"))
    kept = long.join(counts, video)
    return kept.where((F.col("_parts") <= LEAN) | ~F.col("bodypart").isin(*REDUNDANT)).drop("_parts")


def lean_parts(declared: list[str]) -> list[str]:
    return [p for p in declared if p not in REDUNDANT] if len(declared) > LEAN else declared


def pivot_parts(long: DataFrame, keys: list[str], parts: list[str], part: str = "bodypart") -> DataFrame:
    """One row per key, with `<part>_x` and `<part>_y`. A key that has a part twice raises when the table is used: the
    check rides along with the aggregation."""
    once = lambda k: F.when(F.count(F.col(k)) > 1, F.raise_error(F.lit("a part occurs twice in a frame")).cast("double")).otherwise(F.first(F.col(k), True))
    return long.groupBy(*keys).pivot(part, parts).agg(once("x").alias("x"), once("y").alias("y"))


def to_cm(wide: DataFrame, columns: list[str], pix_per_cm: Column) -> DataFrame:
    return wide.withColumns({k: F.try_divide(F.col(k), pix_per_cm) for k in columns})


def densify(df: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """A row for every frame from the first to the last of each key; new rows are NULL but for keys and frame."""
    ends = df.groupBy(*keys).agg(F.min(frame).alias("_low"), F.max(frame).alias("_high"))
    every = ends.select(*keys, F.explode(F.sequence("_low", "_high")).alias(frame))
    return every.join(df, [*keys, frame], "left")


def aligned(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables side by side on their keys; a key that a table lacks has NULL in its columns. Each other column has to be
    in one table only."""
    names = [k for t in tables for k in t.columns if k not in keys]
    if not tables or len(set(names)) < len(names):
        raise ValueError(f"columns of more than one table: {sorted({k for k in names if names.count(k) > 1})}")
    return reduce(lambda a, b: a.join(b, keys, "full"), tables)


def pairs(wide: DataFrame, video: list[str], mouse: str, frame: str, columns: list[str]) -> DataFrame:
    """Ordered pairs of mice in a frame: video, agent, target, frame, and columns with A_ and B_."""
    side = lambda name, prefix: wide.select(*video, F.col(mouse).alias(name), F.col(frame), *(F.col(k).alias(prefix + k) for k in columns))
    return side("agent", "A_").join(side("target", "B_"), [*video, frame]).where(F.col("agent") != F.col("target"))


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(f"`{k}`").alias(prefix + k) for k in df.columns if k not in keys))


def with_columns_of(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Exactly these columns in this order; those that df lacks are NULL."""
    have = set(df.columns)
    return df.select(*(F.col(f"`{k}`") if k in have else F.lit(None).cast(kind).alias(k) for k in columns))


def n_mice(strains: list[str]) -> Column:
    return sum((F.when(F.col(s).isNotNull(), 1).otherwise(0) for s in strains), F.lit(0))


def group_centroid(long: DataFrame, video: list[str], frame: str = "frame") -> DataFrame:
    """Mean place of all mice and parts in a frame."""
    return long.groupBy(*video, frame).agg(F.avg("x").alias("group_x"), F.avg("y").alias("group_y"))


def sections(videos: DataFrame, column: str = "body_parts_tracked") -> DataFrame:
    """Distinct part lists in order, numbered from 0."""
    distinct = videos.select(column).where(F.col(column).isNotNull()).distinct()
    return distinct.select(column, (F.row_number().over(_by(column)) - 1).alias("section"))  # as many rows as tracking set-ups


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def assert_distinct_columns(df: DataFrame) -> DataFrame:
    twice = sorted({k for k in df.columns if df.columns.count(k) > 1})
    if twice:
        raise ValueError(f"columns occur twice: {', '.join(twice)}")
    return df


def assert_names(names: list[str]) -> None:
    bad = [n for n in names if not n.replace("_", "").replace("-", "").isalnum()]
    if bad:
        raise ValueError(f"names aren't plain: {bad}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
