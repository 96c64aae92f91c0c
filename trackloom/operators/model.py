"""Classifiers of behaviours, cross-validated by video.

Trees come from Spark ML; they know no missing values, so features are imputed and the missingness features tell the
rest. What is kept of the models that this follows is their procedure: folds by video, out-of-fold tables, thresholds
on a grid, the mean of fold models at prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


@dataclass(frozen=True)
class Trees:
    """Parameters of the boosted trees."""

    trees: int = 250
    rate: float = 0.08
    depth: int = 6
    min_rows: int = 10
    sample: float = 0.8
    columns: str = "0.8"
    seed: int = 3407

    def estimator(self, **more) -> GBTClassifier:
        return GBTClassifier(featuresCol="features", labelCol="label", maxIter=self.trees, stepSize=self.rate, maxDepth=self.depth, minInstancesPerNode=self.min_rows, subsamplingRate=self.sample, featureSubsetStrategy=self.columns, seed=self.seed, **more)


def assign_folds(labels: DataFrame, folds: int = 5, group: str = "video_id") -> DataFrame:
    """(group, fold): each group goes whole to the fold where the spread of positives and negatives over folds is then
    least, groups with the most uneven labels first. Counting is distributed; one row per video is placed here."""
    rows = labels.groupBy(group).agg(F.sum(F.when(c("label") == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(c("label") == 0, 1).otherwise(0)).alias("n")).collect()
    pos, neg = [0.0] * folds, [0.0] * folds
    all_pos, all_neg = max(1, sum(r.p for r in rows)), max(1, sum(r.n for r in rows))
    out = []
    for r in sorted(rows, key=lambda r: (-(r.p / all_pos - r.n / all_neg) ** 2, -(r.p + r.n), str(r[group]))):

        def cost(k: int, r=r) -> tuple[float, float]:
            p = [x + (r.p if j == k else 0) for j, x in enumerate(pos)]
            n = [x + (r.n if j == k else 0) for j, x in enumerate(neg)]
            spread = lambda v, total: sum((x / total - sum(v) / total / folds) ** 2 for x in v)
            return spread(p, all_pos) + spread(n, all_neg), pos[k] + neg[k]

        k = min(range(folds), key=cost)
        pos[k], neg[k] = pos[k] + r.p, neg[k] + r.n
        out.append((r[group], k))
    kind = labels.schema[group].dataType.simpleString()
    return labels.sparkSession.createDataFrame(out, f"{group} {kind}, fold int")


def with_folds(df: DataFrame, folds: DataFrame, group: str = "video_id") -> DataFrame:
    return df.join(F.broadcast(folds), group)  # a row per video


def trainable(labels: DataFrame, keys: list[str], least_videos: int = 5) -> DataFrame:
    """Tasks with a positive and enough videos."""
    return labels.where(c("label").isNotNull()).groupBy(*keys).agg(F.count_distinct("video_id").alias("n_videos"), F.sum(c("label").cast("int")).alias("n_positive")).where((c("n_videos") >= least_videos) & (c("n_positive") > 0)).select(*keys)


def sample_negatives(df: DataFrame, keys: list[str], share: float = 1e6, floor: int = 100, seed: int = 42) -> DataFrame:
    """All positives, and max(share * positives, floor) negatives of each key, the first by a digest of the row (md5 of the
    seed and the cells, joined by `|`); keys without a positive go."""
    counts = df.groupBy(*keys).agg(F.sum(F.when(c("label") == 1, 1).otherwise(0)).alias("_pos"), F.sum(F.when(c("label") == 1, 0).otherwise(1)).alias("_neg")).where("_pos > 0")
    made = df.join(counts, keys).withColumn("_draw", F.when(c("label") == 1, F.lit(None)).otherwise(F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(c(k).cast("string"), F.lit("")) for k in df.columns)))))
    most = F.greatest(c("_pos") * share, F.lit(floor))
    # a bucket of hash values is taken whole, left out whole, or cut: only the cut one is put in order
    made = made.withColumn("_bucket", F.conv(F.substring("_draw", 1, 3), 16, 10).cast("int"))
    sizes = made.where("_draw is not null").groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = made.where("_draw is not null").join(before, [*keys, "_bucket"]).where(c("_before") < most)
    whole = placed.where(c("_before") + c("_n") <= most)
    cut = placed.where(c("_before") + c("_n") > most).withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_draw", *df.columns)))
    out = made.where("_draw is null").select(*df.columns).unionByName(whole.select(*df.columns))
    return out.unionByName(cut.where(c("_before") + c("_nth") <= most).select(*df.columns))


def class_weights(df: DataFrame, power: float = 0.5) -> DataFrame:
    """df with weight: (negatives / positives) ** power for positives, 1 for negatives."""
    n = df.agg(F.sum(F.when(c("label") == 1, 1).otherwise(0)).alias("_p"), F.sum(F.when(c("label") == 0, 1).otherwise(0)).alias("_n"))
    heavier = F.pow(F.try_divide(c("_n"), c("_p")), F.lit(power))
    return df.crossJoin(F.broadcast(n)).withColumn("weight", F.when(c("label") == 1, F.coalesce(heavier, F.lit(1.0))).otherwise(1.0)).drop("_p", "_n")  # one row


def assembled(df: DataFrame, features: list[str], fill: float = -1.0) -> DataFrame:
    """df with a vector of the features; missing ones are fill. The order of features is part of the contract."""
    plain = df.withColumns({f"_f{k}": F.coalesce(F.nanvl(c(f"`{name}`").cast("double"), F.lit(None)), F.lit(fill)) for k, name in enumerate(features)})
    made = VectorAssembler(inputCols=[f"_f{k}" for k in range(len(features))], outputCol="features").transform(plain)
    return made.drop(*(f"_f{k}" for k in range(len(features))))


def positive(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    made = model.transform(df).withColumn("prediction", vector_to_array("probability")[1])
    return made.drop("rawPrediction", "probability", "features")


def fit_fold(rows: DataFrame, fold: int, trees: Trees, weight: str | None = None, validation: str | None = None) -> GBTClassificationModel:
    """The model of a fold, fitted on the others' assembled rows. With a column of weights; with a boolean column of rows
    to validate by, boosting stops early when they no longer gain."""
    more = {"weightCol": weight} if weight else {}
    more |= {"validationIndicatorCol": validation} if validation else {}
    return trees.estimator(**more).fit(rows.where(c("fold") != fold))


def cross_validate(df: DataFrame, features: list[str], trees: Trees | None = None, folds: int = 5, weight: str | None = None) -> tuple[DataFrame, list[GBTClassificationModel]]:
    """Out-of-fold predictions of rows with a label (columns of df, prediction), and the fold models. df has fold."""
    trees = trees or Trees()
    rows = assembled(df.where(c("label").isNotNull()).withColumn("label", c("label").cast("double")), features)
    models, out = [], None
    for k in range(folds):
        model = fit_fold(rows, k, trees, weight)
        models.append(model)
        part = positive(model, rows.where(c("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out, models


def predict(models: list[GBTClassificationModel], df: DataFrame, features: list[str]) -> DataFrame:
    """df with the mean prediction of the fold models; features must be all there, and are taken by name in the fitted order."""
    lacking = [f for f in features if f not in df.columns]
    if lacking:
        raise ValueError(f"features are lacking: {lacking}")
    if any(m.numFeatures != len(features) for m in models):
        raise ValueError("a model was fitted on another number of features")
    made = assembled(df, features)
    for k, m in enumerate(models):
        made = m.transform(made).withColumn(f"_p{k}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    total: Column = sum((c(f"_p{k}") for k in range(len(models))), F.lit(0.0))
    return made.withColumn("prediction", total / len(models)).drop("features", *(f"_p{k}" for k in range(len(models))))
