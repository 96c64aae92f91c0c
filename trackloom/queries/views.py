"""The tables as trajectories: the same views as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.frames import Track

TRACK = Track(("entity",), "frame", 30.0)
PAIR_TRACK = Track(("agent", "target"), "frame", 30.0)
PAIR_OVER = "partition by agent, target order by frame"

# Value and k are scaled by numbers with many digits, so that no mean lies halfway between two rounded values.
TRAJ_SQL = """select user_id as entity, row_number() over (partition by user_id order by ts) as frame, value * 0.7310585 as x,
    cast(json_extract_string(props, '$.k') as double) * 0.9238795 as y, event_type as part, event_id from events"""

#: Keypoints of an event, as SQL that both engines read. The nose is missing in events of the kind error.
POSE = {
    "nose": ("case when part = 'error' then null else x / 10 end", "case when part = 'error' then null else y / 5 end"),
    "body_center": ("x / 11 + event_id % 7", "y / 6 + event_id % 5"),
    "tail_base": ("x / 12 + event_id % 11", "y / 7 - event_id % 3"),
    "ear_left": ("x / 10 + event_id % 4 + 1", "y / 5 + event_id % 6"),
    "ear_right": ("x / 10 - event_id % 3", "y / 5 - event_id % 8 - 1"),
    "lateral_left": ("x / 11 + event_id % 3 + 2", "y / 6 + event_id % 2"),
    "lateral_right": ("x / 11 - event_id % 5", "y / 6 - event_id % 4 - 1"),
    "hip_left": ("x / 12 + event_id % 2 + 1", "y / 7 + event_id % 4"),
    "hip_right": ("x / 12 - event_id % 6", "y / 7 - event_id % 5 - 1"),
}
PARTS = tuple(POSE)
COLUMNS = [f"{p}_{k}" for p in PARTS for k in "xy"]
POSE_SQL = "select entity, frame, " + ", ".join(f"{e} as {p}_{k}" for p, xy in POSE.items() for k, e in zip("xy", xy, strict=True)) + f" from ({TRAJ_SQL})"
#: So many users with numbers in a row are the mice of a video; every ordered pair of a video in a frame is a row.
MICE = 4
PAIR_SQL = f"""select a.entity as agent, b.entity as target, a.frame as frame, {', '.join(f'a.{c} as "A_{c}", b.{c} as "B_{c}"' for c in COLUMNS)}
    from ({POSE_SQL}) a join ({POSE_SQL}) b on a.entity // {MICE} = b.entity // {MICE} and a.frame = b.frame and a.entity <> b.entity"""
INTERVAL_SQL = f"select entity, event_id, part as action, frame as start_frame, frame + 1 + event_id % 7 as stop_frame from ({TRAJ_SQL})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("entity"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).cast("bigint").alias("frame"), (F.col("value") * F.lit(0.7310585)).alias("x"),
        (F.get_json_object("props", "$.k").cast("double") * F.lit(0.9238795)).alias("y"), F.col("event_type").alias("part"), "event_id",
    )


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traj(spark, sf_dir).select("entity", "frame", *(F.expr(e).alias(f"{p}_{k}") for p, xy in POSE.items() for k, e in zip("xy", xy, strict=True)))


def pose_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trackloom.operators.reshape import pairs

    return pairs(with_video(poses(spark, sf_dir)), ["video"], "entity", "frame", COLUMNS).drop("video")


def with_video(df: DataFrame) -> DataFrame:
    return df.withColumn("video", F.expr(f"entity div {MICE}"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traj(spark, sf_dir).select("entity", "event_id", F.col("part").alias("action"), F.col("frame").alias("start_frame"), (F.col("frame") + 1 + F.col("event_id") % 7).alias("stop_frame"))


def rounded(df: DataFrame, keys: list[str], out: list[str], digits: int = 4) -> DataFrame:
    return df.select(*keys, *((F.round(F.col(f"`{k}`").cast("double"), digits) + 0.0).alias(k) for k in out))
