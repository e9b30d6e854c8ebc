"""Supervised regime models on windows of past rows, and bagged volatility forecasts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.draws import poisson1, with_uniform
from tidemark.operators.cross import last_n
from tidemark.operators.prep import chrono_split
from tidemark.operators.risk import moment_matrices, normal_equations
from tidemark.plans.folds import spread
from tidemark.plans.series import number_rows


def fit_regime_classifier(
    seq: DataFrame, k: int = 3, hidden: Sequence[int] | None = None, key: Sequence[str] = ("asset",), label: str = "state", validation: float = 0.2, max_iter: int = 50,
    reg: float = 1e-3, seed: int = 42, order: str = "ts",
) -> tuple[Model, float]:
    """Classifier of ``label`` from the window ``x``, and its accuracy on the last rows of each series.

    ``hidden`` gives the hidden layers of a perceptron; without it the model is multinomial logistic.
    """
    d = chrono_split(seq, key, validation, order).select("role", array_to_vector("x").alias("v"), F.col(label).cast("double").alias("y"))
    train = d.filter("role = 'train'")
    if hidden:
        width = train.select(F.size(vector_to_array("v")).alias("n")).first()["n"]
        est = MultilayerPerceptronClassifier(featuresCol="v", labelCol="y", layers=[width, *hidden, k], maxIter=max_iter, seed=seed)
    else:
        est = LogisticRegression(featuresCol="v", labelCol="y", family="multinomial", maxIter=max_iter, regParam=reg)
    model = est.fit(train)
    acc = model.transform(d.filter("role = 'validation'")).agg(F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("a")).first()["a"]
    return model, acc


def classifier_proba(seq: DataFrame, model: Model, key: Sequence[str] = ("asset",), order: str = "ts") -> DataFrame:
    """``key, ts, p`` with one probability per regime."""
    d = model.transform(seq.select(*key, order, array_to_vector("x").alias("v")))
    return d.select(*key, order, vector_to_array("probability").alias("p"))


def save_classifier(spark: SparkSession, model: Model, path: str, length: int, labels: Sequence[str] = ()) -> None:
    """The model with its own writer, and beside it what a caller needs: its kind, the window length and the label names."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(type(model).__name__, length, list(labels))], "kind string, length int, labels array<string>").write.mode("overwrite").parquet(f"{path}/about")


def load_classifier(spark: SparkSession, path: str) -> tuple[Model, int, list[str]]:
    """``(model, window length, label names)`` as saved."""
    about = spark.read.parquet(f"{path}/about").first()
    kinds = {k.__name__: k for k in (LogisticRegressionModel, MultilayerPerceptronClassificationModel)}
    return kinds[about["kind"]].load(f"{path}/model"), about["length"], about["labels"]


def predict_latest(seq: DataFrame, model: Model, key: Sequence[str] = ("asset",), order: str = "ts") -> DataFrame:
    """Probabilities of the latest row of each series; series without a full window have no row."""
    return classifier_proba(last_n(seq, 1, key, order), model, key, order)


def vol_forecast_interval(seq: DataFrame, target: str, length: int, bags: int = 100, key: Sequence[str] = ("asset",), order: str = "ts", seed: int = 42, ridge: float = 1e-6) -> DataFrame:
    """Mean and deviation, over bagged linear fits, of the forecast for the latest window of each series.

    A bag gives every row a Poisson(1) weight; its fit needs only weighted sums, which are combined before
    the shuffle, so all bags are one aggregate. ``x`` has ``length`` entries.
    """
    cols = [f"x{i}" for i in range(length)]
    d = number_rows(seq.select(*key, order, target, "x"), key, order)
    wide = d.select(*key, order, "_seq", F.col(target).alias("y"), *[F.col("x")[i].alias(c) for i, c in enumerate(cols)])
    b = spread(wide, [*key, "_seq"]).withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    b = with_uniform(b, "_u", seed, F.col("_seq"), F.col("bag")).withColumn("_w", F.sqrt(poisson1(F.col("_u")).cast("double"))).filter("_w > 0")
    # scaling a row by the root of its weight weighs all products; the constant becomes a column of its own
    b = b.select("bag", (F.col("y") * F.col("_w")).alias("y"), F.col("_w").alias("one"), *[(F.col(c) * F.col("_w")).alias(c) for c in cols])
    xs = ["one", *cols]
    eq = normal_equations(b, ["bag"], xs, "y")

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                _, _, _, xx, xy = moment_matrices(row, len(xs))
                out.append((row["bag"], list(np.linalg.solve(xx + ridge * np.eye(len(xs)), xy))))
            yield pd.DataFrame(out, columns=["bag", "beta"])

    beta = eq.mapInPandas(solve, "bag int, beta array<double>")
    # one record of bags x coefficients: its size is set by the arguments, not by the data
    all_ = beta.agg(F.collect_list("beta").alias("_betas"))
    last = last_n(wide.drop("y"), 1, key, order).join(F.broadcast(all_))
    x = F.array(F.lit(1.0), *[F.col(c) for c in cols])
    preds = F.transform("_betas", lambda bt: F.aggregate(F.zip_with(bt, x, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))
    last = last.withColumn("_p", preds)
    mean = F.aggregate("_p", F.lit(0.0), lambda s, v: s + v) / F.size("_p")
    last = last.withColumn("predicted_mean", mean)
    var = F.aggregate("_p", F.lit(0.0), lambda s, v: s + (v - F.col("predicted_mean")) * (v - F.col("predicted_mean"))) / F.size("_p")
    return last.select(*key, order, "predicted_mean", F.sqrt(var).alias("predicted_std"))
