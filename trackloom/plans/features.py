"""Features of all mice or pairs of a section, planned once per bucket of videos.

Window lengths depend on the frame rate and columns on the body parts that a video has, and both are literals of a
plan; so videos are dealt into buckets by (frame rate, parts), of which there are few, and their tables are united.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.frames import Track
from trackloom.operators import missing, pair, reshape, single

c = F.col
KEYS = ["video_id", "mouse_id"]
PAIR_KEYS = ["video_id", "agent", "target"]


@dataclass(frozen=True)
class Bucket:
    """Videos that one plan serves."""

    fps: float
    parts: tuple[str, ...]
    videos: tuple[int, ...]


def buckets(tracking: DataFrame, videos: DataFrame) -> list[Bucket]:
    """tracking: video_id, bodypart; videos: video_id, frames_per_second. A row per video comes to the driver."""
    parts = tracking.groupBy("video_id").agg(F.array_sort(F.collect_set("bodypart")).alias("parts"))
    rows = videos.select("video_id", F.coalesce(c("frames_per_second"), F.lit(30.0)).alias("fps")).join(parts, "video_id").collect()
    dealt: dict[tuple, list[int]] = {}
    for r in rows:
        dealt.setdefault((r.fps, tuple(r.parts)), []).append(r.video_id)
    return [Bucket(fps, own, tuple(sorted(v))) for (fps, own), v in sorted(dealt.items(), key=str)]


def wide(tracking: DataFrame, videos: DataFrame, bucket: Bucket) -> DataFrame:
    """One row per video, mouse and frame, in cm, with short gaps filled."""
    rows = tracking.join(F.broadcast(videos.select("video_id").where(c("video_id").isin(*bucket.videos))), "video_id")  # a bucket's videos
    made = reshape.pivot_parts(rows.withColumnRenamed("video_frame", "frame"), [*KEYS, "frame"], list(bucket.parts))
    columns = [f"{p}_{k}" for p in bucket.parts for k in "xy"]
    scaled = made.join(F.broadcast(videos.select("video_id", "pix_per_cm_approx")), "video_id")
    scaled = reshape.to_cm(scaled, columns, c("pix_per_cm_approx")).drop("pix_per_cm_approx")
    return missing.fill_gaps(scaled, Track(tuple(KEYS), "frame", bucket.fps), columns)


def single_features(poses: DataFrame, videos: DataFrame, bucket: Bucket, declared: tuple[str, ...], section: int) -> DataFrame:
    t, parts = Track(tuple(KEYS), "frame", bucket.fps), bucket.parts
    meta = videos.select("video_id", c("arena_width_cm").alias("_w"), c("arena_height_cm").alias("_h"), c("arena_shape").alias("_s")).dropDuplicates(["video_id"])
    df = poses.join(F.broadcast(meta), "video_id", "left")
    df = single.elongation(missing.features(single.squared_distances(df, declared, parts), t, parts, section))
    for family in (single.core, single.position, single.curvature, single.multiscale, single.states, single.long_range, single.steadiness, single.head_elevation, single.body_width, single.pose_shape, single.head_apart, single.body_axis, single.micromotion):
        df = family(df, t, parts, section)
    df = single.arena(df, t, parts, c("_w"), c("_h"), c("_s"), section)
    return df.drop("_w", "_h", "_s", *(f"{p}_{k}" for p in parts for k in "xy"))


def pair_features(poses: DataFrame, bucket: Bucket, declared: tuple[str, ...]) -> DataFrame:
    t, parts = Track(tuple(PAIR_KEYS), "frame", bucket.fps), bucket.parts
    columns = [f"{p}_{k}" for p in parts for k in "xy"]
    df = reshape.pairs(poses, ["video_id"], "mouse_id", "frame", columns)
    df = missing.pair_features(pair.cross_distances(df, declared, parts, parts), t, parts, parts)
    df = single.elongation(df)
    for family in (pair.orientation, pair.nose_features, pair.tail_features, pair.ear_features, pair.pursuit, pair.dynamics, pair.contacts):
        df = family(df, t, parts, parts)
    return df.drop(*(f"{w}_{k}" for w in "AB" for k in columns))


def section_features(tracking: DataFrame, videos: DataFrame, declared: list[str], section: int, kind: str, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """Features of all videos of a section: keys, frame, features in order, metadata features last."""
    declared = tuple(reshape.lean_parts(declared))
    tracking = reshape.drop_redundant(tracking)
    out = []
    for bucket in buckets(tracking, videos):
        poses = wide(tracking, videos, bucket)
        out.append(single_features(poses, videos, bucket, declared, section) if kind == "single" else pair_features(poses, bucket, declared))
    made = reshape.union_all(out)
    meta = single.meta_features(videos, vocabulary or {})
    keep = [k for k in meta.columns if k not in videos.columns or k in single.META_NUMBERS]
    return reshape.assert_distinct_columns(made.join(F.broadcast(meta.select("video_id", *(F.col(f"`{k}`") for k in keep))), "video_id"))
