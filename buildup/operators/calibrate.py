"""Calibration of scores: Platt, isotonic, beta and quadratic logit.

Every fit runs on one weighted row per distinct (score, label); the objective
is the same as on the raw rows. Logistic curves are applied as plain column
expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildup.operators import isotonic, metrics
from buildup.operators.metrics import EPSILON
from buildup.session import stage

MAX_ITERATIONS = 500
TOLERANCE = 1e-12


def clipped(p: Column) -> Column:
    """``p`` away from 0 and 1; null stays null, which ``greatest`` alone would pass over."""
    return F.when(p.isNotNull(), F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p.cast("double"))))


def logit(p: Column) -> Column:
    q = clipped(p)
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


FEATURES: dict[str, Callable[[Column], list[Column]]] = {
    "platt": lambda p: [p.cast("double")],
    "beta": lambda p: [F.ln(clipped(p)), -F.ln(1 - clipped(p))],
    "quadratic": lambda p: [logit(p), logit(p) * logit(p)],
}


@dataclass(frozen=True)
class LogisticCurve:
    """Intercept and one coefficient per feature of a fitted curve."""

    method: str
    coefficients: tuple[float, ...]
    intercept: float

    def apply(self, p: Column) -> Column:
        z = F.lit(self.intercept)
        for weight, feature in zip(self.coefficients, FEATURES[self.method](p)):
            z = z + F.lit(weight) * feature
        return sigmoid(z)


def weighted(scored: DataFrame) -> DataFrame:
    """Rows per distinct score and label, written once: a fit passes over them many times."""
    rows = scored.select("score", F.col("label").cast("double").alias("label"))
    return stage(metrics.reduce(rows).withColumn("weight", F.col("weight").cast("double")), "fit")


def fit_curve(weights: DataFrame, method: str) -> LogisticCurve:
    """Logistic fit of a ``weighted`` table on the method's features.

    Platt carries the unit L2 penalty of its usual form; beta keeps both
    coefficients non-negative; the quadratic logit has no penalty.
    """
    features = FEATURES[method](F.col("score"))
    names = [f"f{i}" for i in range(len(features))]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    table = assembler.transform(weights.withColumns(dict(zip(names, features))))
    estimator = LogisticRegression(
        weightCol="weight", maxIter=MAX_ITERATIONS, tol=TOLERANCE, standardization=False
    )
    if method == "platt":
        rows = weights.agg(F.sum("weight")).first()[0]
        estimator = estimator.setRegParam(1.0 / rows)
    if method == "beta":
        floor = Matrices.dense(1, len(names), [0.0] * len(names))
        estimator = estimator.setLowerBoundsOnCoefficients(floor)
    model = estimator.fit(table.select("features", "label", "weight"))
    if model.summary.totalIterations >= MAX_ITERATIONS:
        raise RuntimeError(f"the {method} fit did not converge in {MAX_ITERATIONS} iterations")
    return LogisticCurve(method, tuple(float(c) for c in model.coefficients), float(model.intercept))


def fit_isotonic(weights: DataFrame) -> DataFrame:
    """Steps of the monotone fit on one row per distinct score."""
    table = weights.groupBy("score").agg(
        F.sum("weight").alias("weight"), F.sum(F.col("label") * F.col("weight")).alias("total")
    )
    return isotonic.fit(table)


def _apply(weights: DataFrame, apply_to: DataFrame, method: str, name: str) -> DataFrame:
    if method == "isotonic":
        rows = apply_to.withColumn("score", F.col("score").cast("double"))
        scores = rows.select("score").where("score is not null").distinct()
        return rows.join(isotonic.with_value(scores, fit_isotonic(weights), "score", name), "score", "left")
    return apply_to.withColumn(name, fit_curve(weights, method).apply(F.col("score")))


def calibrate(fit_on: DataFrame, apply_to: DataFrame, method: str, name: str = "calibrated") -> DataFrame:
    """Fit ``method`` on one scored table and add the calibrated score to another."""
    return _apply(weighted(fit_on), apply_to, method, name)


def by_method(fit_on: DataFrame, apply_to: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Long table (``method``, ``score``, ``label``, ``weight``) of the raw and every calibrated score.

    A calibrated score depends on the score alone, so the curves are applied to distinct scores.
    """
    weights = weighted(fit_on)
    wide = stage(metrics.reduce(apply_to), "apply")
    for method in methods:
        wide = _apply(weights, wide, method, method)
    entries = [F.struct(F.lit("raw").alias("method"), "score")]
    entries += [F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods]
    return wide.select("label", "weight", F.explode(F.array(*entries)).alias("e")).select(
        "e.method", "e.score", "label", "weight"
    )
