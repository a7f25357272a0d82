"""Regression models with folds by trip, in Spark's ML library."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the reference results were made with, as fixed values.
FOREST = {"numTrees": 200, "maxDepth": 12, "minInstancesPerNode": 5}
BOOSTED = {"maxIter": 400, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}


def ridge(train: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0) -> PipelineModel:
    """Ridge with penalty alpha on standardised features. ML scales the label by its deviation, so the penalty is scaled too."""
    n, spread = train.agg(F.count("*"), F.stddev_pop(label)).first()
    assembler = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)
    model = LinearRegression(featuresCol="_x", labelCol=label, elasticNetParam=0.0, regParam=alpha / max(n, 1) * (spread or 1.0), standardization=False, solver="normal")
    return Pipeline(stages=[assembler, scaler, model]).fit(train)


def _trees(model, features: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"), model])


def forest(train: DataFrame, features: Sequence[str], label: str, **options) -> PipelineModel:
    return _trees(RandomForestRegressor(featuresCol="_x", labelCol=label, seed=42, **(FOREST | options)), features).fit(train)


def boosted(train: DataFrame, features: Sequence[str], label: str, **options) -> PipelineModel:
    return _trees(GBTRegressor(featuresCol="_x", labelCol=label, seed=42, **(BOOSTED | options)), features).fit(train)


def leave_one_trip_out(rows: DataFrame, trips: Sequence[str], trip: str, features: Sequence[str], label: str, fits: dict[str, Callable[..., PipelineModel]], naive: Column | None = None, clip_sigma: float | None = None) -> DataFrame:
    """RMSE, MAE and median error of each model on each trip, trained on all other trips.

    A trip is a prefix of the trip column. clip_sigma: training rows with a larger label are left out, test rows never.
    """
    spark, rows = rows.sparkSession, rows.persist()
    found = []
    for name in trips:
        test, train = rows.filter(F.col(trip).startswith(name)), rows.filter(~F.col(trip).startswith(name))
        if clip_sigma:
            spread = train.agg(F.stddev_pop(label)).first()[0] or 0.0
            train = train.filter(F.abs(label) < clip_sigma * spread) if spread else train
        guesses = {"naive": test.withColumn("prediction", naive)} if naive is not None else {}
        guesses |= {kind: fit(train, features, label).transform(test) for kind, fit in fits.items()}
        for kind, own in guesses.items():
            e = F.col("prediction") - F.col(label)
            found.append(own.agg(F.count("*").alias("n_test"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.median(F.abs(e)).alias("median_ae")).select(F.lit(name).alias("trip"), F.lit(kind).alias("model"), "n_test", "rmse", "mae", "median_ae"))
    try:
        reports = reduce(DataFrame.unionByName, found)
        return spark.createDataFrame(reports.collect(), reports.schema)  # a row for each trip and model
    finally:
        rows.unpersist()


def importances(model: PipelineModel, features: Sequence[str], df: DataFrame, risky: Sequence[str] = ("acc_z", "al_mag", "acc_veh_fwd")) -> DataFrame:
    """Features by importance, and whether each belongs to a signal that vibration may drive."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = df.sparkSession.createDataFrame(list(zip(features, map(float, values), strict=True)), "feature string, importance double")
    return rows.withColumn("risky", reduce(lambda a, b: a | b, (F.col("feature").startswith(r) for r in risky))).orderBy(F.desc("importance"), "feature")


def heading_by_parts(train: DataFrame, test: DataFrame, features: Sequence[str], angle: str, fit: Callable[..., PipelineModel]) -> DataFrame:
    """test with heading_pred from two regressors, of the angle's sine and cosine."""
    train = train.withColumns({"_sin": F.sin(angle), "_cos": F.cos(angle)})
    s = fit(train, features, "_sin").transform(test).withColumnRenamed("prediction", "_ps").drop("_x", "_raw")
    both = fit(train, features, "_cos").transform(s)
    return both.withColumn("heading_pred", F.pmod(F.atan2("_ps", "prediction"), F.lit(2 * np.pi))).drop("_ps", "prediction", "_x", "_raw")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
