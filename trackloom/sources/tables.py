"""Sources and sinks. A table of many small files per video is read in one scan; lab and video come from the paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VIDEOS = """
    video_id bigint, lab_id string, mouse1_strain string, mouse2_strain string, mouse3_strain string, mouse4_strain string,
    frames_per_second double, pix_per_cm_approx double, video_width int, video_height int, arena_width_cm double,
    arena_height_cm double, arena_shape string, arena_type string, tracking_method string, body_parts_tracked string,
    behaviors_labeled string
"""
TRACKING = "video_frame bigint, mouse_id int, bodypart string, x double, y double"
ANNOTATION = "agent_id int, target_id int, action string, start_frame bigint, stop_frame bigint"
INTERVALS = "row_id bigint, video_id bigint, agent_id string, target_id string, action string, start_frame bigint, stop_frame bigint"


def read_videos(spark: SparkSession, path: str, schema: str = VIDEOS) -> DataFrame:
    """A CSV file with a header; columns are taken by name, those that aren't there are NULL."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    kinds = spark.createDataFrame([], schema).schema
    return raw.select(*(F.col(f.name).cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds))


def _by_path(df: DataFrame) -> DataFrame:
    parts = F.split(F.col("_metadata.file_path"), "/")
    return df.select("*", F.url_decode(F.element_at(parts, -2)).alias("lab_id"), F.regexp_extract(F.element_at(parts, -1), r"^(.*)\.parquet$", 1).cast("bigint").alias("video_id"))


def read_tracking(spark: SparkSession, folder: str) -> DataFrame:
    """`<folder>/<lab_id>/<video_id>.parquet`, all in one scan; NaN coordinates become NULL."""
    df = _by_path(spark.read.schema(TRACKING).parquet(f"{folder}/*/*.parquet"))
    return df.withColumns({k: F.when(~F.isnan(k), F.col(k)) for k in "xy"})


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    return _by_path(spark.read.schema(ANNOTATION).parquet(f"{folder}/*/*.parquet"))


def annotated_only(tracking: DataFrame, annotations: DataFrame) -> DataFrame:
    """Tracking of videos that have an annotation file."""
    return tracking.join(annotations.select("video_id").distinct(), "video_id", "left_semi")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet with zstd. Doubles are written as they are; cast features to float first if they go to models."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def floats(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *(F.col(f"`{k}`").cast("float").alias(k) if t == "double" else F.col(f"`{k}`") for k, t in df.dtypes if k not in keys))


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Rows numbered from 0 in order, without gaps and without sorting all rows in one task: rows are dealt into sorted
    ranges, counted per range, and numbered within."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that both uses deal alike
    dealt = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(F.col("_part"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row per range
    within = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn("_k", F.row_number().over(within)).join(F.broadcast(starts), "_part").select((F.col("_base") + F.col("_k") - 1).cast("bigint").alias(name), *df.columns)


def write_trace(df: DataFrame, path: str, actions: list[str]) -> None:
    """Frame probabilities as `probability_<action>`, a folder for each video, agent and target."""
    keys = ["video_id", "agent_id", "target_id"]
    write_table(df.select(*keys, "video_frame", *(F.col(a).alias(f"probability_{a}") for a in actions)), path, keys)


def write_intervals(df: DataFrame, path: str) -> None:
    """One CSV file with a header, by video, agent, target and start, with row_id from 0."""
    order = ["video_id", "agent_id", "target_id", "start_frame", "stop_frame", "action"]
    columns = [f.split(" ")[0] for f in INTERVALS.replace("\n", "").split(", ")]
    numbered(df, order).select(*columns).coalesce(1).sortWithinPartitions("row_id").write.mode("overwrite").csv(path, header=True)


def check_written(spark: SparkSession, path: str) -> int:
    """Number of rows of written intervals, whose row_id must be 0 to n - 1, each once."""
    names = spark.read.csv(path, header=True).columns
    if names != spark.createDataFrame([], INTERVALS).columns:
        raise ValueError(f"header is {names}")
    got = spark.read.schema(INTERVALS).csv(path, header=True)
    n, least, most, distinct = got.agg(F.count(F.lit(1)), F.min("row_id"), F.max("row_id"), F.count_distinct("row_id")).first()
    if n and (least, most, distinct) != (0, n - 1, n):
        raise ValueError("row_id isn't 0 to n - 1")
    return n


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, sha256) of files, read by executors."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def dataset_signature(spark: SparkSession, pattern: str) -> str:
    """One digest of all files' names, sizes and digests, in the order of names."""
    names = F.element_at(F.split("path", "/"), -1)
    row = file_digests(spark, pattern).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", names, "length", "sha256"))), "\n"), 256)).first()  # a line per file
    return row[0]


def content_digest(df: DataFrame) -> Column:
    """An aggregate that doesn't depend on the order of rows."""
    each = F.xxhash64(*(F.col(f"`{k}`") for k in df.columns))
    return F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(each), F.sum(each.cast("decimal(38,0)")))
