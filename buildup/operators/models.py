"""Spark ML models on token tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildup.functions import labels
from buildup.operators import tokens

# Mixture components per event type.
COMPONENTS = {"Pass": 5, "Carry": 3}


# Training rows of one partition of a mixture fit.
PART_ROWS = 1_000_000
# A fit that has not settled by then fails; its steps are stopped by the tolerance.
MAX_STEPS = 5_000


def fit_position_mixture(
    normalized_events: DataFrame, event_type: str, keys: Sequence[str], seed: int = 42, max_iter: int = MAX_STEPS
) -> tuple[GaussianMixtureModel, DataFrame]:
    """Gaussian mixture over start and end of one event type, and its training rows.

    ``keys`` identify a row. The fit starts from rows drawn by partition; they are dealt by their key to a number
    of partitions that follows from the number of rows, so the result does not depend on how they came.
    Fails if the fit has not converged after ``max_iter`` steps.
    """
    rows = normalized_events.where(F.col("type") == event_type).dropna(subset=tokens.AXES)
    parts = 4 + rows.count() // PART_ROWS
    rows = rows.repartition(parts, F.xxhash64(*keys)).sortWithinPartitions(*keys)
    vectors = VectorAssembler(inputCols=tokens.AXES, outputCol="features").transform(rows)
    estimator = GaussianMixture(k=COMPONENTS[event_type], seed=seed, maxIter=max_iter)
    model = estimator.fit(vectors.select("features"))
    if model.summary.numIter >= max_iter:
        raise RuntimeError(f"the {event_type} mixture did not converge in {max_iter} steps")
    return model, vectors


def position_mixture(normalized_events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weight, mean and covariance per component, heaviest first, with the mean log likelihood of the type."""
    spark = normalized_events.sparkSession
    rows = []
    for event_type in COMPONENTS:
        model, vectors = fit_position_mixture(normalized_events, event_type, keys)
        n = vectors.count()
        fit, steps = float(model.summary.logLikelihood) / n, model.summary.numIter
        parts = [
            (float(w), [float(v) for v in g.mean], [float(v) for v in g.cov.toArray().ravel()])
            for w, g in zip(model.weights, model.gaussians)
        ]
        for i, (weight, mean, covariance) in enumerate(sorted(parts, reverse=True)):
            rows.append((event_type, i, n, steps, True, weight, fit, *mean, covariance))
    schema = "type string, component int, n long, iterations int, converged boolean, weight double, mean_log_likelihood double"
    means = "".join(f", mean_{a} double" for a in tokens.AXES)
    return spark.createDataFrame(rows, schema + means + ", covariance array<double>")


def next_type_rows(sequences: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per input token: current type, Fourier position features, next type id and its class weight."""
    rows = tokens.feature_rows(sequences)
    kinds = F.array(*[F.when(F.col("input_type") == t, 1.0).otherwise(0.0) for t in labels.MOVEMENT_TYPES])
    weight = F.coalesce(
        F.try_element_at(labels.literal_map(weights or {"GOAL": 1.0}), F.col("target_type")), F.lit(1.0)
    )
    return rows.select(
        "match_id",
        "possession",
        "input_type",
        "target_type",
        array_to_vector(F.concat(kinds, tokens.fourier(F.col("position")))).alias("features"),
        labels.type_id(F.col("target_type")).cast("double").alias("label"),
        weight.alias("weight"),
    )


def next_type_model(rows: DataFrame, max_iter: int = MAX_STEPS, tolerance: float = 1e-7):
    """Weighted multinomial regression of the next type; fails if it has not converged after ``max_iter`` steps."""
    estimator = LogisticRegression(
        family="multinomial", weightCol="weight", maxIter=max_iter, tol=tolerance, regParam=1e-4
    )
    model = estimator.fit(rows.select("features", "label", "weight"))
    if model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"the model of the next type did not converge in {max_iter} steps")
    return model


def class_mass(model, rows: DataFrame) -> DataFrame:
    """Weighted sum of the predicted probabilities of every type: ``(truth, mass)``."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows).select("weight", F.posexplode(vector_to_array("probability")).alias("id", "p"))
    return out.groupBy(labels.type_name(F.col("id")).alias("truth")).agg(F.sum(F.col("weight") * F.col("p")).alias("mass"))


def predict_next(model, rows: DataFrame) -> DataFrame:
    """``truth``, ``predicted``, the probability ``p`` of the truth, and its weight."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows)
    return out.select(
        F.col("target_type").alias("truth"),
        labels.type_name(F.col("prediction").cast("int")).alias("predicted"),
        F.get(vector_to_array("probability"), F.col("label").cast("int")).alias("p"),
        "weight",
    )
