"""Training and prediction as a whole: what is done is kept with its contract, and a later run goes on from there.

A task is a (section, kind, action). Its folds are kept one by one, each with its contract and the digest of its table,
so an interrupted task goes on after its last whole fold, and a fold that isn't what it was is refused. Its out-of-fold table is written with a contract next to it: the parameters, the
features in their order and a digest of the data. A run skips a task whose contract is the same, refuses one whose
contract differs, and does the rest until a budget is spent. Files are written through Spark, so a folder may be in any
store that Spark knows; a task counts as done when its contract is there, which is written last.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.frames import Track
from trackloom.operators import decode, evaluate, model
from trackloom.sources.tables import content_digest, write_table

c = F.col


class Paused(Exception):
    """A budget is spent; what is done is kept."""


class ContractError(ValueError):
    """What is kept was made otherwise than it would be now."""


@dataclass
class Budget:
    """Limits of one run. output_bytes is the size of all that is kept in its folder, reserve_bytes what has to stay
    free in the folder's store. All are looked at before a task, and all but tasks before each of its folds."""

    tasks: int | None = None
    hours: float | None = None
    output_bytes: int | None = None
    reserve_bytes: int | None = None
    began: float = field(default_factory=time.monotonic)
    done: int = 0

    def check(self, spark: SparkSession, root: str) -> None:
        if self.tasks is not None and self.done >= self.tasks:
            raise Paused(f"{self.done} tasks are done")
        self.check_fold(spark, root)

    def check_fold(self, spark: SparkSession, root: str) -> None:
        if self.hours is not None and time.monotonic() - self.began >= self.hours * 3600:
            raise Paused(f"{self.hours} hours are over")
        if self.output_bytes is not None and (used := _used(spark, root)) >= self.output_bytes:
            raise Paused(f"{used} bytes are kept, of {self.output_bytes}")
        if self.reserve_bytes is not None and (free := _free(spark, root)) < self.reserve_bytes:
            raise Paused(f"{free} bytes are free, less than the reserve of {self.reserve_bytes}")


@dataclass(frozen=True)
class Task:
    section: int
    kind: str
    action: str

    @property
    def folder(self) -> str:
        return f"section={self.section}/kind={self.kind}/action={self.action}"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _used(spark: SparkSession, path: str) -> int:
    """Bytes of the files in a folder; 0 if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() if _exists(spark, path) else 0


def _free(spark: SparkSession, path: str) -> int:
    """Bytes that the store of a folder has left, where it tells; the folder need not be there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    while not fs.exists(p) and p.getParent() is not None:
        p = p.getParent()
    return fs.getStatus(p).getRemaining()


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON file, put in place by renaming."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    tmp, end = jvm.org.apache.hadoop.fs.Path(path + ".tmp"), jvm.org.apache.hadoop.fs.Path(path)
    fs = end.getFileSystem(conf)
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(tmp), fs.makeQualified(end), how)  # in one step


def read_json(spark: SparkSession, path: str) -> dict | None:
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if _exists(spark, path) else None


def contract(rows: DataFrame, features: list[str], trees: model.Trees, folds: int) -> dict:
    digest = rows.agg(content_digest(rows).alias("d")).first().d
    return {"features": features, "trees": asdict(trees), "folds": folds, "data": digest}


def _digest(df: DataFrame) -> str:
    return df.agg(content_digest(df).alias("d")).first().d


def kept_fold(spark: SparkSession, folder: str, fold: int, own: dict) -> bool:
    """Whether a fold is kept whole; raises if it was made with another contract, or isn't what was written."""
    done = read_json(spark, f"{folder}/folds/{fold}.json")
    if done is None:
        return False
    if done["contract"] != own:
        raise ContractError(f"fold {fold} in {folder} was made with another contract")
    if _digest(spark.read.parquet(f"{folder}/folds/oof_{fold}")) != done["oof"] or file_signature(spark, f"{folder}/model_{fold}") != done["model"]:
        raise ContractError(f"fold {fold} in {folder} is damaged: checksums differ")
    return True


def file_signature(spark: SparkSession, folder: str) -> str:
    """One digest of all data files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    names = F.replace(F.col("path"), F.lit(folder.rstrip("/")), F.lit(""))
    row = files.select(F.concat_ws(":", F.substring_index(names, "/", -2), F.sha2("content", 256)).alias("x")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256))  # a line per file
    return row.first()[0]


def train_task(rows: DataFrame, features: list[str], trees: model.Trees, folds: int, folder: str, check: Callable[[int], None] | None = None) -> dict:
    """rows: video_id, agent_id, target_id, video_frame, label and features. Writes the out-of-fold table and the fold
    models, and returns the task's report. check is called before each fold that isn't kept, and may raise Paused."""
    spark = rows.sparkSession
    own = contract(rows, features, trees, folds)
    kept = read_json(spark, f"{folder}/contract.json")
    if kept is not None:
        if {k: kept[k] for k in own} != own:
            raise ContractError(f"{folder} was made with another contract")
        return kept
    keys = ["video_id", "agent_id", "target_id", "video_frame"]
    left = [k for k in range(folds) if not kept_fold(spark, folder, k, own)]
    if left:
        known = rows.where(c("label").isNotNull()).withColumn("label", c("label").cast("double"))
        write_table(model.with_folds(known, model.assign_folds(known, folds)).select(*keys, "label", "fold", *(c(f"`{f}`") for f in features)), f"{folder}/rows")  # features are planned once for all folds
        ready = model.assembled(spark.read.parquet(f"{folder}/rows"), features).select(*keys, "label", "fold", "features")
        for k in left:
            if check is not None:
                check(k)
            fitted = model.fit_fold(ready, k, trees)
            fitted.write().overwrite().save(f"{folder}/model_{k}")
            table = model.positive(fitted, ready.where(c("fold") == k))
            write_table(table.select(*keys, c("label").cast("tinyint").alias("label"), "prediction", c("fold").cast("tinyint").alias("fold")), f"{folder}/folds/oof_{k}")
            write_json(spark, f"{folder}/folds/{k}.json", {"contract": own, "oof": _digest(spark.read.parquet(f"{folder}/folds/oof_{k}")), "model": file_signature(spark, f"{folder}/model_{k}")})
    write_table(spark.read.parquet(*(f"{folder}/folds/oof_{k}" for k in range(folds))), f"{folder}/oof")
    oof = spark.read.parquet(f"{folder}/oof")
    best = evaluate.best_threshold(oof).first()
    report = own | {"threshold": best.threshold, "f1": best.f1, "n_rows": oof.count()}
    write_json(spark, f"{folder}/contract.json", report)
    return report


def scores(spark: SparkSession, root: str) -> list[dict]:
    """The kept scores of a run: a row per task."""
    return (read_json(spark, f"{root}/scores.json") or {"tasks": []})["tasks"]


def keep_score(spark: SparkSession, root: str, row: dict) -> None:
    """Puts a task's row (section, kind, action, threshold, f1) into the scores, in place of an earlier one."""
    key = lambda r: (str(r["section"]), r["kind"], r["action"])
    write_json(spark, f"{root}/scores.json", {"tasks": [*(r for r in scores(spark, root) if key(r) != key(row)), row]})


def write_status(spark: SparkSession, root: str, status: str, new: int, error: str | None = None) -> None:
    write_json(spark, f"{root}/run_status.json", {"status": status, "trained_tasks": len(scores(spark, root)), "new_tasks_this_run": new, "updated_at": time.strftime("%Y-%m-%dT%H:%M:%S"), "error": error})


def train(tasks: list[tuple[Task, Callable[[], tuple[DataFrame, list[str]]]]], root: str, spark: SparkSession, trees: model.Trees | None = None, folds: int = 5, budget: Budget | None = None) -> list[dict]:
    """Reports of all tasks; Paused when the budget is spent. Each task comes with a function that plans its rows and
    names its features, which is only called when its turn comes. Kept tasks cost a read and a digest, no fit. The run's
    status and the tasks' scores are kept in its folder."""
    budget, out = budget or Budget(), []
    try:
        for task, plan in tasks:
            folder = f"{root}/{task.folder}"
            if not _exists(spark, f"{folder}/contract.json"):
                budget.check(spark, root)
                budget.done += 1
            rows, features = plan()
            out.append(asdict(task) | train_task(rows, features, trees or model.Trees(), folds, folder, lambda _: budget.check_fold(spark, root)))
            keep_score(spark, root, asdict(task) | {k: out[-1][k] for k in ("threshold", "f1", "n_rows")})
            write_status(spark, root, "running", budget.done)
    except Exception as error:
        write_status(spark, root, "paused" if isinstance(error, Paused) else "failed", budget.done, str(error))
        raise
    write_status(spark, root, "complete", budget.done)
    return out


def load_models(folder: str, folds: int) -> list[GBTClassificationModel]:
    return [GBTClassificationModel.load(f"{folder}/model_{k}") for k in range(folds)]


def predict_intervals(rows: DataFrame, tasks: list[Task], root: str) -> DataFrame:
    """Intervals of all rows (video_id, agent_id, target_id, frame and features) by the kept models of tasks that share
    the rows' section and kind: mean of the folds for each action, then the canonical decoding."""
    spark, cuts = rows.sparkSession, {}
    for task in tasks:
        folder = f"{root}/{task.folder}"
        report = read_json(spark, f"{folder}/contract.json")
        if report is None:
            raise ContractError(f"{folder} isn't complete")
        rows = model.predict(load_models(folder, report["folds"]), rows, report["features"]).withColumnRenamed("prediction", task.action)
        cuts[task.action] = report["threshold"]
    return decode.intervals(rows, Track(("video_id", "agent_id", "target_id")), cuts)


def report(found: DataFrame, expected: DataFrame, probabilities: DataFrame | None = None, actions: list[str] | None = None) -> dict:
    """Figures of a run: intervals, their actions, labelled behaviours that none shows, a digest of the intervals, and
    the least and greatest probability of each action."""
    keys = ["video_id", "agent_id", "target_id", "action"]
    a = found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("action").alias("actions"), F.count_distinct("video_id").alias("videos"), content_digest(found).alias("digest")).first()
    lacking = expected.select(*keys).distinct().join(found.select(*keys).distinct(), keys, "left_anti").count()
    out = {"n_intervals": a.n, "n_actions": a.actions, "n_videos": a.videos, "n_behaviours_without_interval": lacking, "digest": a.digest}
    if probabilities is not None and actions:
        ends = probabilities.agg(*(f(x).alias(f"{n}_{x}") for x in actions for n, f in (("least", F.min), ("greatest", F.max)))).first().asDict()
        out["probabilities"] = {x: [ends[f"least_{x}"], ends[f"greatest_{x}"]] for x in actions}
    return out
