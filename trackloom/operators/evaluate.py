"""Scores of predictions: confusion counts and F1 at thresholds, threshold grids, frame-set F1, and the audit of
out-of-fold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def _counts(hit: Column, label: Column) -> list[Column]:
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    return [one(hit & (label == 1)).alias("tp"), one(hit & (label == 0)).alias("fp"), one(~hit & (label == 1)).alias("fn")]


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0))


def action_counts(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and positives of each key; rows without a label don't count."""
    return labels.where(c("label").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.sum(F.when(c("label") == 1, 1).otherwise(0)).cast("bigint").alias("n_positive"))


def f1_at(df: DataFrame, threshold: float | Column, keys: list[str] | None = None) -> DataFrame:
    hit = c("prediction") >= (F.lit(threshold) if isinstance(threshold, float) else threshold)
    counted = (df.groupBy(*keys) if keys else df.groupBy()).agg(*_counts(hit, c("label")))
    return counted.withColumn("f1", f1(c("tp"), c("fp"), c("fn")))


def threshold_grid(df: DataFrame, steps: int = 100, keys: list[str] | None = None) -> DataFrame:
    """Counts and F1 at thresholds 0, 1/steps ... 1. Each row falls into the bucket of the highest threshold that it
    reaches; counts from the top down are running sums over steps + 1 rows, so no row meets every threshold."""
    keys = keys or []
    reached = F.floor(c("prediction") * steps + 1e-9)
    reached = F.when(c("prediction") >= (reached + 1) / steps, reached + 1).when(c("prediction") < reached / steps, reached - 1).otherwise(reached)
    part = df.groupBy(*keys, reached.cast("int").alias("step")).agg(F.sum(F.when(c("label") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(c("label") == 0, 1).otherwise(0)).alias("neg"))
    grid = df.select(*keys).distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))) if keys else df.sparkSession.range(steps + 1).select(c("id").cast("int").alias("step"))
    every = grid.join(part, [*keys, "step"], "left").fillna(0, ["pos", "neg"])
    down = Window.partitionBy(*keys).orderBy(c("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    out = every.select(*keys, (c("step") / steps).alias("threshold"), F.sum("pos").over(down).cast("bigint").alias("tp"), F.sum("neg").over(down).cast("bigint").alias("fp"), F.sum("pos").over(whole).alias("_all"))
    out = out.withColumn("fn", (c("_all") - c("tp")).cast("bigint")).drop("_all")
    return out.withColumn("f1", f1(c("tp"), c("fp"), c("fn")))


def best_threshold(df: DataFrame, steps: int = 100, keys: list[str] | None = None) -> DataFrame:
    """The threshold with the greatest F1; the smallest of equal ones. Without a positive: threshold 0, F1 0."""
    best = F.max_by(F.struct("threshold", "tp", "fp", "fn", "f1"), F.struct(F.round("f1", 12), -c("threshold"))).alias("b")
    grid = threshold_grid(df, steps, keys)
    return (grid.groupBy(*keys) if keys else grid.groupBy()).agg(best).select(*(keys or []), "b.*")


def mean_fold_threshold(df: DataFrame, steps: int = 100, keys: list[str] | None = None) -> DataFrame:
    """Mean over the folds of each fold's own best threshold."""
    keys = keys or []
    each = best_threshold(df, steps, [*keys, "fold"])
    return (each.groupBy(*keys) if keys else each.groupBy()).agg(F.avg("threshold").alias("threshold"), F.count(F.lit(1)).cast("bigint").alias("n_folds"))


def frame_set_f1(solution: DataFrame, submission: DataFrame, group: list[str]) -> DataFrame:
    """F1 of the sets of covered frames for each of group (which has video, agent, target and action)."""
    frames = lambda d: d.where("start_frame < stop_frame").select(*group, F.explode(F.sequence(c("start_frame"), c("stop_frame") - 1)).alias("frame")).distinct()
    both = frames(solution).withColumn("s", F.lit(1)).join(frames(submission).withColumn("p", F.lit(1)), [*group, "frame"], "full")
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    s, p = c("s").isNotNull(), c("p").isNotNull()
    counted = both.groupBy(*group).agg(one(s & p).alias("tp"), one(~s & p).alias("fp"), one(s & ~p).alias("fn"))
    return counted.withColumn("f1", f1(c("tp"), c("fp"), c("fn")))


def mean_f1(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("f1").alias("mean_f1"), F.median("f1").alias("median_f1"), F.count(F.lit(1)).cast("bigint").alias("n_tasks"))


def fold_means(predictions: DataFrame, keys: list[str]) -> DataFrame:
    return predictions.groupBy(*keys).agg(F.avg("prediction").alias("prediction"))


def audit(oof: DataFrame, saved: DataFrame, keys: list[str], folds: int = 5, tolerance: float = 1e-12) -> DataFrame:
    """Per task of saved (keys, threshold, f1): the recomputed F1 and whether it agrees, all folds are there, each video
    is in one fold, and predictions and labels are in range."""
    scored = oof.join(F.broadcast(saved.select(*keys, "threshold")), keys)  # a row per task
    parts = scored.groupBy(*keys).agg(
        *_counts(c("prediction") >= c("threshold"), c("label")),
        F.count_distinct("fold").alias("n_folds"), F.min("fold").alias("low_fold"), F.max("fold").alias("high_fold"),
        F.sum(F.when((c("prediction") >= 0) & (c("prediction") <= 1) & c("label").isin(0, 1), 0).otherwise(1)).alias("n_bad"),
    )
    spread = oof.groupBy(*keys, "video_id").agg(F.count_distinct("fold").alias("_f")).groupBy(*keys).agg(F.max("_f").alias("folds_of_a_video"))
    out = saved.select(*keys, c("f1").alias("saved_f1")).join(parts, keys, "left").join(spread, keys, "left").withColumn("recomputed_f1", f1(c("tp"), c("fp"), c("fn")))
    good = (F.abs(c("saved_f1") - c("recomputed_f1")) <= tolerance) & (c("n_folds") == folds) & (c("low_fold") == 0) & (c("high_fold") == folds - 1) & (c("n_bad") == 0) & (c("folds_of_a_video") == 1)
    return out.select(*keys, "saved_f1", "recomputed_f1", "n_folds", "n_bad", F.coalesce(good, F.lit(False)).alias("ok"))
