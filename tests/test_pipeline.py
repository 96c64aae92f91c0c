"""Reshaping, labels, features of a whole section, and a run with resume, on a small made-up lab."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import labels, model, reshape
from trackloom.plans import features, run
from trackloom.sources import tables as io

PARTS = ["body_center", "ear_left", "ear_right", "nose", "tail_base"]
c = F.col


@pytest.fixture(scope="module")
def lab(spark, tmp_path_factory):
    """Six videos of 100 frames of two mice; the first has no right ear."""
    root = tmp_path_factory.mktemp("lab")
    r = random.Random(3407)
    notes = [(1, 1, "rear", 20, 50), (1, 2, "approach", 40, 80)]
    for v in range(6):
        rows = [(1000 * v + f, m, p, 200 + 30 * m + 8 * math.sin(f / 10 + i) + r.gauss(0, 1), 200 + 30 * m + 10 * math.cos(f / 15 + i) + r.gauss(0, 1)) for f in range(100) for m in (1, 2) for i, p in enumerate(PARTS) if v or p != "ear_right"]
        spark.createDataFrame(rows, io.TRACKING).coalesce(1).write.parquet(f"{root}/tmp_t/{v}")
        spark.createDataFrame([(a, b, x, s + 1000 * v, e + 1000 * v) for a, b, x, s, e in notes], io.ANNOTATION).coalesce(1).write.parquet(f"{root}/tmp_a/{v}")
        for kind, tmp in (("train_tracking", "tmp_t"), ("train_annotation", "tmp_a")):
            (root / kind / "Lab One").mkdir(parents=True, exist_ok=True)
            next((root / tmp / str(v)).glob("part-*.parquet")).rename(root / kind / "Lab One" / f"{v}.parquet")
    cells = '"[""mouse1,self,rear"",""mouse1,mouse2,approach""]"'
    parts = '"[' + ",".join(f'""{p}""' for p in PARTS) + ']"'
    head = "video_id,lab_id,mouse1_strain,mouse2_strain,mouse3_strain,mouse4_strain,frames_per_second,pix_per_cm_approx,video_width,video_height,arena_width_cm,arena_height_cm,arena_shape,arena_type,tracking_method,body_parts_tracked,behaviors_labeled"
    (root / "train.csv").write_text("\n".join([head, *(f"{v},Lab One,x,x,,,30,10,640,480,64,48,rectangle,enclosure,synthetic,{parts},{cells}" for v in range(6))]) + "\n")
    return root


@pytest.fixture(scope="module")
def tables(spark, lab):
    videos = io.read_videos(spark, str(lab / "train.csv")).withColumn("n_mice", reshape.n_mice([f"mouse{k}_strain" for k in (1, 2, 3, 4)]))
    return videos, io.read_tracking(spark, str(lab / "train_tracking")), io.read_annotations(spark, str(lab / "train_annotation"))


def test_sources(spark, tables, lab):
    videos, tracking, notes = tables
    assert videos.count() == 6 and videos.first().n_mice == 2
    assert {(r.lab_id, r.video_id) for r in tracking.select("lab_id", "video_id").distinct().collect()} == {("Lab One", v) for v in range(6)}
    assert notes.count() == 12
    assert len(io.dataset_signature(spark, str(lab / "train_annotation" / "*" / "*.parquet"))) == 64


def _frames(tracking):
    return tracking.where("mouse_id = 1").select("video_id", c("video_frame").alias("frame")).distinct()


@pytest.mark.parametrize(("inclusive", "want"), [(True, {"rear": 31, "approach": 41}), (False, {"rear": 30, "approach": 40})])
def test_labels(tables, inclusive, want):
    videos, tracking, notes = tables
    allowed = labels.parse_behaviours(videos.select("video_id", "behaviors_labeled")).select("video_id", "action")
    made = labels.label_frames(_frames(tracking), notes.select("video_id", "action", "start_frame", "stop_frame"), allowed, ["video_id"], inclusive)
    counted = {r.action: (r.n, r.p) for r in made.where("video_id = 3").groupBy("action").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()}
    assert counted == {k: (100, n) for k, n in want.items()}


def test_unlabelled_action_keeps_its_positives_only(spark):
    f = spark.createDataFrame([(1, k) for k in range(10)], "video_id int, frame bigint")
    marks = spark.createDataFrame([(1, "odd", 3, 5)], "video_id int, action string, start_frame bigint, stop_frame bigint")
    made = labels.label_frames(f, marks, spark.createDataFrame([(1, "rear")], "video_id int, action string"), ["video_id"])
    assert sorted((r.action, r.n, r.p) for r in made.groupBy("action").agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect()) == [("odd", 3, 3), ("rear", 10, 0)]


def test_pivot_refuses_duplicates(spark):
    df = spark.createDataFrame([(1, "nose", 1.0, 1.0), (1, "nose", 2.0, 2.0)], "frame int, bodypart string, x double, y double")
    with pytest.raises(Exception, match="twice"):
        reshape.pivot_parts(df, ["frame"], ["nose"]).collect()


def test_section_features(tables):
    videos, tracking, _ = tables
    assert len(features.buckets(tracking, videos)) == 2
    single = features.section_features(tracking, videos, PARTS, 1, "single", {"lab_id": ["Lab One"]})
    assert len(single.columns) > 250 and single.count() == 1200
    row = single.where("video_id = 0 and mouse_id = 1 and frame = 50").first()
    assert row["ear_left+ear_right"] is None and row["cx_m15"] is not None and row["lab_id=Lab One"] == 1 and row["lab_id=__NA__"] == 0
    pairs = features.section_features(tracking, videos, PARTS, 1, "pair")
    assert pairs.count() == 1200 and {"A_face_B", "speed_dtw_distance", "A_contact_duration_60"} <= set(pairs.columns)


def test_folds_keep_videos_whole(spark):
    df = spark.createDataFrame([(v, int(k < v)) for v in range(12) for k in range(20)], "video_id int, label int")
    folds = model.assign_folds(df)
    rows = folds.collect()
    assert len(rows) == 12 and {r.fold for r in rows} == {0, 1, 2, 3, 4}


def test_run_pauses_at_its_output_or_the_disk_reserve(spark, tmp_path):
    root = str(tmp_path / "run")
    for budget in (run.Budget(output_bytes=1), run.Budget(reserve_bytes=1)):
        budget.check(spark, root)
    run.write_json(spark, f"{root}/section=1/contract.json", {"f1": 1.0})

    def plan():
        raise AssertionError("no task may begin")

    for budget in (run.Budget(output_bytes=1), run.Budget(reserve_bytes=1 << 62)):
        with pytest.raises(run.Paused):
            run.train([(run.Task(1, "single", "rear"), plan)], root, spark, budget=budget)
    run.Budget(output_bytes=1 << 40, reserve_bytes=1).check(spark, root)


def test_run_resumes_and_refuses_other_contracts(spark, tables, tmp_path):
    _, tracking, notes = tables
    pos = tracking.where("mouse_id = 1 and bodypart = 'nose'").select("video_id", "video_frame", "x", "y")
    hit = labels.hit_frames(notes.where("action = 'rear'").select("video_id", "action", "start_frame", "stop_frame"), ["video_id"], True)
    rows = pos.join(hit.select("video_id", c("frame").alias("video_frame"), F.lit(1).alias("hit")), ["video_id", "video_frame"], "left")
    rows = rows.select("video_id", F.lit("mouse1").alias("agent_id"), F.lit("self").alias("target_id"), "video_frame", "x", "y", (c("video_frame") % 1000).cast("double").alias("since"), F.coalesce("hit", F.lit(0)).alias("label"))
    trees, calls = model.Trees(trees=3, depth=3), []

    def plan():
        calls.append(1)
        return rows, ["x", "y", "since"]

    tasks = [(run.Task(1, "single", "rear"), plan)]
    with pytest.raises(run.Paused):
        run.train(tasks, str(tmp_path), spark, trees, folds=3, budget=run.Budget(tasks=0))
    first = run.train(tasks, str(tmp_path), spark, trees, folds=3)
    assert run.train(tasks, str(tmp_path), spark, trees, folds=3, budget=run.Budget(tasks=0)) == first
    assert first[0]["f1"] > 0.9 and first[0]["n_rows"] == 600
    oof = spark.read.parquet(f"{tmp_path}/{tasks[0][0].folder}/oof")
    assert oof.groupBy("video_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    with pytest.raises(run.ContractError):
        run.train(tasks, str(tmp_path), spark, model.Trees(trees=2, depth=3), folds=3)
    with pytest.raises(run.ContractError):
        run.train([(tasks[0][0], lambda: (rows.where("video_id > 0"), ["x", "y", "since"]))], str(tmp_path), spark, trees, folds=3)
    found = run.predict_intervals(rows.withColumnRenamed("video_frame", "frame").drop("label"), [tasks[0][0]], str(tmp_path))
    assert found.count() >= 6 and found.where("start_frame >= stop_frame").count() == 0


def _task_rows(spark):
    rows = [(v, "mouse1", "self", f, int((f + v) % 7 < 3), float((f + v) % 7), float(f * 13 % 10)) for v in range(6) for f in range(40)]
    return spark.createDataFrame(rows, "video_id bigint, agent_id string, target_id string, video_frame bigint, label int, a double, b double"), ["a", "b"]


def test_interrupted_task_goes_on_after_its_last_fold(spark, tmp_path, monkeypatch):
    plan, trees, calls, fit = (lambda: _task_rows(spark)), model.Trees(trees=2, depth=2), [], model.fit_fold
    tasks = [(run.Task(0, "single", a), plan) for a in ("rear", "rest")]
    whole = run.train(tasks, str(tmp_path / "whole"), spark, trees, folds=3)

    def failing(rows, fold, *more):
        if fold == 1:
            raise RuntimeError("simulated interruption")
        calls.append(fold)
        return fit(rows, fold, *more)

    monkeypatch.setattr(model, "fit_fold", failing)
    with pytest.raises(RuntimeError, match="simulated"):
        run.train(tasks, str(tmp_path / "cut"), spark, trees, folds=3)
    assert calls == [0] and run.read_json(spark, f"{tmp_path}/cut/run_status.json")["status"] == "failed"
    monkeypatch.setattr(model, "fit_fold", lambda rows, fold, *more: (calls.append(fold), fit(rows, fold, *more))[1])
    assert run.train(tasks, str(tmp_path / "cut"), spark, trees, folds=3) == whole
    assert calls == [0, 1, 2, 0, 1, 2]
    status = run.read_json(spark, f"{tmp_path}/cut/run_status.json")
    assert (status["status"], status["trained_tasks"]) == ("complete", 2)
    run.keep_score(spark, str(tmp_path / "cut"), {"section": 0, "kind": "single", "action": "rear", "threshold": 0.1, "f1": 0.2, "n_rows": 3})
    assert [(r["action"], r["f1"]) for r in run.scores(spark, str(tmp_path / "cut"))] == [("rest", whole[1]["f1"]), ("rear", 0.2)]


def test_a_damaged_or_foreign_fold_is_refused(spark, tmp_path, monkeypatch):
    trees, task = model.Trees(trees=2, depth=2), run.Task(0, "single", "rear")
    fit = model.fit_fold
    monkeypatch.setattr(model, "fit_fold", lambda rows, fold, *more: fit(rows, fold, *more) if fold < 1 else (_ for _ in ()).throw(RuntimeError("stop")))
    with pytest.raises(RuntimeError, match="stop"):
        run.train([(task, lambda: _task_rows(spark))], str(tmp_path), spark, trees, folds=3)
    folder = f"{tmp_path}/{task.folder}"
    with pytest.raises(run.ContractError, match="another contract"):
        run.train_task(*_task_rows(spark), model.Trees(trees=3, depth=2), 3, folder)
    table = spark.read.parquet(f"{folder}/folds/oof_0")
    changed = table.withColumn("prediction", c("prediction") + 0.001).collect()
    spark.createDataFrame(changed, table.schema).write.mode("overwrite").parquet(f"{folder}/folds/oof_0")
    with pytest.raises(run.ContractError, match="checksums"):
        run.train_task(*_task_rows(spark), trees, 3, folder)


def test_run_pauses_after_a_fold(spark, tmp_path):
    budget, task = run.Budget(hours=1), run.Task(0, "single", "rear")
    plain = budget.check_fold

    def late(*where):
        if run._exists(spark, f"{tmp_path}/{task.folder}/folds/0.json"):
            budget.began -= 4 * 3600
        plain(*where)

    budget.check_fold = late
    with pytest.raises(run.Paused):
        run.train([(task, lambda: _task_rows(spark))], str(tmp_path), spark, model.Trees(trees=2, depth=2), folds=3, budget=budget)
    assert run.read_json(spark, f"{tmp_path}/run_status.json")["status"] == "paused"
    assert run._exists(spark, f"{tmp_path}/{task.folder}/folds/0.json") and not run._exists(spark, f"{tmp_path}/{task.folder}/folds/1.json")


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,), (0,)], "label int")
    assert sorted(r.weight for r in model.class_weights(df).collect()) == [1, 1, 1, 1, 2]


def test_trace_and_header(spark, tmp_path):
    df = spark.createDataFrame([(1, "mouse1", "self", 5, 0.25)], "video_id bigint, agent_id string, target_id string, video_frame bigint, rear double")
    io.write_trace(df, str(tmp_path / "trace"), ["rear"])
    assert spark.read.parquet(str(tmp_path / "trace")).first().probability_rear == 0.25 and (tmp_path / "trace" / "video_id=1" / "agent_id=mouse1" / "target_id=self").is_dir()
    (tmp_path / "bad.csv").write_text("row,video_id\n0,1\n")
    with pytest.raises(ValueError, match="header"):
        io.check_written(spark, str(tmp_path / "bad.csv"))


def test_prediction_needs_its_features(spark, tmp_path):
    df = spark.createDataFrame([(k % 2, float(k % 2), 0.0, k % 2) for k in range(40)], "label int, a double, b double, fold int")
    _, models = model.cross_validate(df, ["a", "b"], model.Trees(trees=1, depth=1), folds=2)
    with pytest.raises(ValueError, match="lacking"):
        model.predict(models, df.drop("b"), ["a", "b"])
    swapped = df.select("b", "a", "label")
    assert [r.prediction for r in model.predict(models, swapped, ["a", "b"]).orderBy("a").collect()] == [r.prediction for r in model.predict(models, df, ["a", "b"]).orderBy("a").collect()]


def test_intervals_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "mouse1", "self", "rear", 5, 9), (1, "mouse1", "mouse2", "chase", 0, 3), (1, "mouse1", "mouse2", "chase", 7, 8)], "video_id bigint, agent_id string, target_id string, action string, start_frame bigint, stop_frame bigint")
    io.write_intervals(df, str(tmp_path / "out"))
    assert io.check_written(spark, str(tmp_path / "out")) == 3
    assert [tuple(r) for r in spark.read.schema(io.INTERVALS).csv(str(tmp_path / "out"), header=True).orderBy("row_id").select("row_id", "video_id", "start_frame").collect()] == [(0, 1, 0), (1, 1, 7), (2, 2, 5)]


def test_streamed_intervals_equal_batch(spark, tmp_path):
    from trackloom.streaming.decode import stream_intervals

    rows = [(1, k, 0.9 if k < 5 or k == 8 else 0.1) for k in range(12)] + [(2, k, 0.9) for k in (3, 4, 7, 9)]
    spark.createDataFrame(rows, "video_id int, frame bigint, rear double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video_id int, frame bigint, rear double").parquet(str(tmp_path / "in"))
    query = stream_intervals(stream, ["video_id"], {"rear": 0.5}, idle_ms=None).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.sql("select * from found").collect()) == [("1", "rear", 0, 5), ("1", "rear", 8, 9), ("2", "rear", 3, 5), ("2", "rear", 7, 8)]
