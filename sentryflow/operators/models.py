"""Classifiers: MLlib estimators, and the forward pass of small binary networks as expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sentryflow.staging import staged


def sign(x: Column) -> Column:
    return F.when(x >= 0, 1.0).otherwise(-1.0)


def binary_layer(x: Column, weights: list[list[int]]) -> Column:
    """Array of the dot products of ``x`` with rows of +1/-1."""
    out = []
    for row in weights:
        total = F.lit(0.0)
        for i, w in enumerate(row):
            total = total + (x[i] if w > 0 else -x[i])
        out.append(total)
    return F.array(*out)


def pack_signs(weights) -> bytes:
    """Sign bits, 1 for non-negative, little-endian within bytes."""
    return np.packbits(np.asarray(weights).ravel() >= 0, bitorder="little").tobytes()


def packed_bytes(parameters: int) -> int:
    return (parameters + 7) // 8


def _pipeline(features: list[str], label: str, labels: list[str], estimator):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import RobustScaler, StringIndexerModel, VectorAssembler

    index = StringIndexerModel.from_labels(labels, inputCol=label, outputCol="__y", handleInvalid="keep")
    scaler = RobustScaler(inputCol="__raw", outputCol="__x", withCentering=True)
    return Pipeline(stages=[index, VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip"), scaler, estimator])


def _rows(train: DataFrame, features: list[str], label: str) -> DataFrame:
    """Label and features, staged once: a fit reads them again and again, and ``train`` may be costly."""
    return staged(train.select(*dict.fromkeys([label, *features])), "train")


def _labels(train: DataFrame, label: str) -> list[str]:
    return sorted(r[0] for r in train.select(label).distinct().collect())


def _weighted(train: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """Rows with the weight of their class, and the labels in order."""
    from sentryflow.operators.stats import class_weights

    w = staged(class_weights(train, label).select(label, F.col("weight").alias("__w")), "weights")
    return train.join(F.broadcast(w), label), _labels(w, label)  # one row a label


def fit_logistic(train: DataFrame, features: list[str], label: str, iterations: int = 30):
    from pyspark.ml.classification import LogisticRegression

    est = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=iterations, predictionCol="__p")
    rows, labels = _weighted(_rows(train, features, label), label)
    return _pipeline(features, label, labels, est).fit(rows), labels


def fit_forest(train: DataFrame, features: list[str], label: str, trees: int = 50, seed: int = 2309):
    from pyspark.ml.classification import RandomForestClassifier

    est = RandomForestClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", numTrees=trees, seed=seed, predictionCol="__p")
    rows, labels = _weighted(_rows(train, features, label), label)
    return _pipeline(features, label, labels, est).fit(rows), labels


def fit_mlp(train: DataFrame, features: list[str], label: str, hidden: tuple[int, ...] = (64, 32), iterations: int = 100, seed: int = 2309):
    """Full-precision network; rows weigh alike, as the estimator takes no weights."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    rows = _rows(train, features, label)
    labels = _labels(rows, label)
    est = MultilayerPerceptronClassifier(featuresCol="__x", labelCol="__y", layers=[len(features), *hidden, len(labels)], maxIter=iterations, seed=seed, predictionCol="__p")
    return _pipeline(features, label, labels, est).fit(rows.where(F.col(label).isNotNull())), labels


FITS = {"logistic_regression": fit_logistic, "random_forest": fit_forest, "fp32_mlp": fit_mlp}


def fit(kind: str, train: DataFrame, features: list[str], label: str, **options):
    """A model by its configured type."""
    if kind not in FITS:
        raise ValueError(f"no model of type {kind!r}; there are {sorted(FITS)}")
    return FITS[kind](train, features, label, **options)


def fit_gate(train: DataFrame, features: list[str], label: str, first: int, benign: str = "benign", **options):
    """The small model in front of the main one: benign or attack, on the first ``first`` features."""
    two = train.where(F.col(label).isNotNull()).withColumn(label, F.when(F.col(label) == benign, benign).otherwise("attack"))
    return fit_logistic(two, features[:first], label, **options)


def save(model, path: str) -> str:
    """Model and label order below ``path``, which must not exist yet."""
    fitted, labels = model
    fitted.write().save(f"{path}/model")
    SparkSession.active().createDataFrame(list(enumerate(labels)), "place int, label string").coalesce(1).write.parquet(f"{path}/labels")
    return path


def load(spark, path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), [r.label for r in spark.read.parquet(f"{path}/labels").orderBy("place").collect()]


def predict(model, df: DataFrame) -> DataFrame:
    """Adds predicted_label and an array of probabilities."""
    from pyspark.ml.functions import vector_to_array

    fitted, labels = model
    out = fitted.transform(df)
    name = F.element_at(F.array(*map(F.lit, labels)), (F.col("__p") + 1).cast("int"))
    return out.withColumn("predicted_label", name).withColumn("probabilities", vector_to_array("probability")).drop("__y", "__raw", "__x", "__p", "rawPrediction", "probability")


def focal_loss(p_true: Column, gamma: float = 2.0) -> Column:
    return F.pow(1 - p_true, gamma) * -F.log(F.greatest(p_true, F.lit(1e-12)))
