"""Models with MLlib: feature selection, a soft-voting ensemble, calibration, scoring, and a model of the model.

Classes are numbered in alphabetical order: BUY, NO_TRADE, SELL.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemark.functions.scalars import best_class
from tidemark.operators import splits, summaries
from tidemark.operators.summaries import CLASSES

WEIGHTS = {"boosted": 3.0, "forest": 2.0, "linear": 1.0}


def label_index(target: str = "target") -> Column:
    """The class number; its metadata names all classes, so that a model has them even if its rows lack the last."""
    number = (F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col(target)) - 1).cast("double")
    return number.alias("label", metadata={"ml_attr": {"name": "label", "type": "nominal", "vals": list(CLASSES)}})


def selector(names: Sequence[str]) -> VectorAssembler:
    """The chosen features of a table as one vector; missing ones must have been filled."""
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep")


def prepared(df: DataFrame, names: Sequence[str], signal_weight: float = 2.0) -> DataFrame:
    """Label, class weight and features; missing, NaN and infinite values are 0."""
    clean = {c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)) for c in names}
    weight = F.when(F.col("target") == "NO_TRADE", 1.0).otherwise(signal_weight)
    return selector(names).transform(df.withColumns({**clean, "weight": weight}).drop("label").select("*", label_index()))


def _kept(df: DataFrame, rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Rows that every tree and round reads: persisted, and a view of them in no more partitions than their number asks for."""
    held = df.select("label", "weight", "features").persist(StorageLevel.MEMORY_AND_DISK)
    return held, held.coalesce(-(-held.count() // rows) or 1)


@dataclass
class Ensemble:
    """Fitted members; ``probs`` is their weighted mean, calibrated per class if there are calibrators."""

    names: list[str]
    boosted: list = field(default_factory=list)
    forest: object = None
    linear: object = None
    calibrators: list = field(default_factory=list)

    def probabilities(self, df: DataFrame) -> DataFrame:
        """``df`` (prepared) with ``probs``."""
        inner = ("rawPrediction", "probability", "prediction")
        total = sum(WEIGHTS.values())
        for k, model in enumerate(self.boosted):
            df = model.transform(df).withColumn(f"_b{k}", F.get(vector_to_array("probability"), F.lit(1))).drop(*inner)
        for name, model in (("_f", self.forest), ("_l", self.linear)):
            df = model.transform(df).withColumn(name, vector_to_array("probability")).drop(*inner)
        boosted = F.array(*[F.col(f"_b{k}") for k in range(len(CLASSES))])
        size = F.aggregate(boosted, F.lit(0.0), lambda a, x: a + x)
        mean = [
            (WEIGHTS["boosted"] * F.col(f"_b{k}") / F.greatest(size, F.lit(1e-12)) + WEIGHTS["forest"] * F.get("_f", F.lit(k)) + WEIGHTS["linear"] * F.get("_l", F.lit(k))) / total
            for k in range(len(CLASSES))
        ]
        df = df.withColumn("probs", F.array(*mean)).drop("_f", "_l", *[f"_b{k}" for k in range(len(CLASSES))])
        return self._calibrated(df) if self.calibrators else df

    def _calibrated(self, df: DataFrame) -> DataFrame:
        for k, model in enumerate(self.calibrators):
            df = df.withColumn("_x", F.get("probs", F.lit(k)))
            df = model.transform(df).withColumnRenamed("prediction", f"_c{k}").drop("_x")
        parts = F.array(*[F.col(f"_c{k}") for k in range(len(CLASSES))])
        size = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        df = df.withColumn("probs", F.when(size > 0, F.transform(parts, lambda p: p / size)).otherwise(F.col("probs")))
        return df.drop(*[f"_c{k}" for k in range(len(CLASSES))])


def train_ensemble(train: DataFrame, names: Sequence[str], trees: int = 100, rounds: int = 40, depth: int = 5, seed: int = 42) -> Ensemble:
    """A forest, one boosted model per class (whose probabilities are renormalised), and a linear model."""
    held, df = _kept(prepared(train, names))
    out = Ensemble(list(names))

    def boost(k: int):
        one = df.withColumn("one", (F.col("label") == k).cast("double"))
        return GBTClassifier(labelCol="one", weightCol="weight", maxIter=rounds, maxDepth=3, seed=seed).fit(one)

    with ThreadPool(len(CLASSES) + 2) as pool:  # each fit is a row of small jobs, which leave the cluster idle in between
        boosted = pool.map_async(boost, range(len(CLASSES)))
        forest = pool.apply_async(RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="weight", seed=seed).fit, (df,))
        linear = pool.apply_async(LogisticRegression(weightCol="weight", family="multinomial", maxIter=20).fit, (df,))
        out.boosted, out.forest, out.linear = boosted.get(), forest.get(), linear.get()
    held.unpersist()
    return out


@dataclass(frozen=True)
class Sigmoid:
    """A logistic of one column, as a calibrator."""

    slope: float
    shift: float

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", 1 / (1 + F.exp(-(self.slope * F.col("_x") + self.shift))))


def fit_calibrator(one: DataFrame, method: str):
    """A calibrator of _x to one (0 or 1), isotonic or sigmoid."""
    if method == "isotonic":
        return IsotonicRegression(featuresCol="_x", labelCol="one").fit(one)
    if method != "sigmoid":
        raise ValueError(f"no calibration by {method}")
    fitted = LogisticRegression(featuresCol="_v", labelCol="one", maxIter=50).fit(VectorAssembler(inputCols=["_x"], outputCol="_v").transform(one))
    return Sigmoid(float(fitted.coefficients[0]), float(fitted.intercept))


def calibrate(model: Ensemble, calib: DataFrame, method: str = "isotonic") -> Ensemble:
    """Isotonic or sigmoid calibration of each class on rows that trained nothing."""
    model.calibrators = []
    df = model.probabilities(prepared(calib, model.names)).select("probs", "label").persist(StorageLevel.MEMORY_AND_DISK)  # scored once for all classes
    for k in range(len(CLASSES)):
        one = df.select(F.get("probs", F.lit(k)).alias("_x"), (F.col("label") == k).cast("double").alias("one"))
        model.calibrators.append(fit_calibrator(one, method))
    df.unpersist()
    return model


def score(model: Ensemble, df: DataFrame) -> DataFrame:
    """``df`` with probs, call and confidence."""
    out = model.probabilities(prepared(df, model.names))
    call = F.get(F.array(*[F.lit(c) for c in CLASSES]), best_class("probs"))
    return out.withColumns({"call": call, "confidence": F.array_max("probs")}).drop("features", "label", "weight")


@dataclass
class Bundle:
    """A trained ensemble with what a scan needs to use it."""

    model: Ensemble
    threshold: float
    trained_at: str  # an ISO time; bars from there on are unseen


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> None:
    """Members and calibrators as MLlib saves them, the rest as a line of JSON, in one folder of any store."""
    m = bundle.model
    for k, model in enumerate(m.boosted):
        model.write().overwrite().save(f"{path}/boosted-{k}")
    m.forest.write().overwrite().save(f"{path}/forest")
    m.linear.write().overwrite().save(f"{path}/linear")
    kinds = []
    for k, c in enumerate(m.calibrators):
        kinds.append([c.slope, c.shift] if isinstance(c, Sigmoid) else None)
        if not isinstance(c, Sigmoid):
            c.write().overwrite().save(f"{path}/calibrator-{k}")
    about = {"names": m.names, "calibrators": kinds, "threshold": bundle.threshold, "trained_at": bundle.trained_at}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    model = Ensemble(about["names"], [GBTClassificationModel.load(f"{path}/boosted-{k}") for k in range(len(CLASSES))])
    model.forest, model.linear = RandomForestClassificationModel.load(f"{path}/forest"), LogisticRegressionModel.load(f"{path}/linear")
    for k, sigmoid in enumerate(about["calibrators"]):
        model.calibrators.append(Sigmoid(*sigmoid) if sigmoid else IsotonicRegressionModel.load(f"{path}/calibrator-{k}"))
    return Bundle(model, about["threshold"], about["trained_at"])


@dataclass(frozen=True)
class Softmax:
    """A linear model in plain numpy, as any model from outside would come: rows of features to rows of probabilities."""

    weights: np.ndarray
    shift: np.ndarray

    @classmethod
    def of(cls, linear: LogisticRegressionModel) -> Softmax:
        return cls(linear.coefficientMatrix.toArray(), linear.interceptVector.toArray())

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights.T + self.shift
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def score_external(df: DataFrame, names: Sequence[str], model) -> DataFrame:
    """``df`` with probs, call and confidence of a model that is no Spark model, by Arrow batches.

    ``model`` has ``predict_proba`` of an array, classes in alphabetical order, and is sent to the tasks: it must be small
    enough for that. Missing, NaN and infinite features are 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.nan_to_num(batch[list(names)].to_numpy(float), nan=0.0, posinf=0.0, neginf=0.0)
            batch["probs"] = list(model.predict_proba(x)) if len(batch) else []
            yield batch

    out = df.mapInPandas(run, StructType([*df.schema.fields, StructField("probs", ArrayType(DoubleType()))]))
    return out.withColumns({"call": F.get(F.array(*[F.lit(c) for c in CLASSES]), best_class("probs")), "confidence": F.array_max("probs")})


def score_pipeline(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Scoring by a saved pipeline."""
    return model.transform(df).withColumn("probs", vector_to_array("probability"))


def forest_pipeline(names: Sequence[str], trees: int = 100) -> Pipeline:
    return Pipeline(stages=[selector(names), RandomForestClassifier(numTrees=trees, weightCol="weight", seed=42)])


def importances(df: DataFrame, names: Sequence[str], trees: int = 50) -> DataFrame:
    """(feature, importance) of a forest on all features; a row per feature."""
    held, ready = _kept(prepared(df, names))
    model = RandomForestClassifier(numTrees=trees, weightCol="weight", seed=42).fit(ready)
    held.unpersist()
    rows = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def importance_scan(ds: DataFrame, names: Sequence[str], essential: Sequence[str], k: int = 35, trees: int = 50) -> DataFrame:
    train = splits.embargo_split(ds).where("part = 'train'")
    return summaries.select_features(importances(train, names, trees), essential, k)


def train_and_score(ds: DataFrame, names: Sequence[str], trees: int = 100, rounds: int = 40) -> DataFrame:
    """The split's test rows, scored by an ensemble trained and calibrated on its other parts."""
    parted = splits.embargo_split(ds)
    train = parted.where("part = 'train'")
    if not train.where("target != 'NO_TRADE'").isEmpty():  # with no signal to balance, undersampling would leave no row
        train = splits.undersample(train, F.concat_ws("|", "symbol", F.col("open_time").cast("string")))
    model = train_ensemble(train, names, trees, rounds)
    calib = parted.where("part = 'calib'")
    if not calib.isEmpty():
        model = calibrate(model, calib)
    return score(model, parted.where("part = 'test'"))


def walk_forward(ds: DataFrame, names: Sequence[str], trees: int = 100, k: int = 5) -> DataFrame:
    """Mean and population deviation of a forest's accuracy over the folds."""
    folds = splits.walk_forward_folds(ds, k)
    scores = None
    for fold in range(1, k):  # a handful of models, each trained over the cluster
        part = folds.where(F.col("fold") == fold)
        if part.isEmpty():
            continue  # the last blocks may not fit after the embargo
        held, rows = _kept(prepared(part.where("part = 'train'"), names))
        model = RandomForestClassifier(numTrees=trees, seed=42).fit(rows)
        held.unpersist()
        hit = (F.col("prediction") == F.col("label")).cast("double")
        one = model.transform(prepared(part.where("part = 'test'"), names)).agg(F.avg(hit).alias("accuracy"))
        scores = one if scores is None else scores.unionByName(one)
    if scores is None:
        scores = ds.sparkSession.createDataFrame([], "accuracy double")
    return summaries.walk_forward_summary(scores.where("accuracy IS NOT NULL"))


def train_meta(held_out: DataFrame, names: Sequence[str], rounds: int = 20) -> GBTClassificationModel | None:
    """A binary model of whether a directional call is right, on rows the first model has not seen; None if it calls no direction there."""
    meta = summaries.meta_labels(held_out)
    held, df = _kept(selector(names).transform(meta.withColumns({"label": F.col("meta_label").cast("double"), "weight": F.lit(1.0)})))
    model = None if held.isEmpty() else GBTClassifier(maxIter=rounds, maxDepth=3, seed=42).fit(df)  # each round reads its rows, which a model has scored
    held.unpersist()
    return model


def meta_filter(scored: DataFrame, model: GBTClassificationModel | None, names: Sequence[str], threshold: float, meta_threshold: float) -> DataFrame:
    """Directional calls that clear both thresholds, with ``meta_p``; without a model none has one to clear them with."""
    calls = scored.where((F.col("call") != "NO_TRADE") & (F.col("confidence") >= threshold))
    if model is None:
        return calls.withColumn("meta_p", F.lit(None).cast("double")).where("meta_p IS NOT NULL")
    out = model.transform(selector(names).transform(calls)).withColumn("meta_p", F.get(vector_to_array("probability"), F.lit(1)))
    return out.where(F.col("meta_p") >= meta_threshold).drop("features", "rawPrediction", "probability", "prediction")
