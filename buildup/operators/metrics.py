"""Quality of a scored table (``score``, ``label``), for one or many groups.

Rows without a score or a label take no part in any metric, nor in its ``n``.

Rank metrics first reduce the rows to one per distinct score; cumulative
counts then run in sorted buckets, never in one global sort task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildup import ordered
from buildup.functions.bins import edge_bin, unit_bin
from buildup.session import stage

# Fixed value: scores are kept this far from 0 and 1 in logarithms.
EPSILON = 1e-7
BINS = 10


def _rows(weight: str | None) -> Column:
    """How many rows a row stands for."""
    return F.lit(1) if weight is None else F.col(weight)


def _mean(value: Column, weight: str | None) -> Column:
    """Mean over the rows where ``value`` is not null."""
    if weight is None:
        return F.avg(value)
    known = F.sum(F.when(value.isNotNull(), F.col(weight)))
    return F.try_divide(F.sum(value * F.col(weight)), known)


def known(scored: DataFrame, score: str = "score") -> DataFrame:
    """The rows that have a score and a label."""
    return scored.where(F.col(score).isNotNull() & F.col("label").isNotNull())


def reduce(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per distinct (``by``, ``score``, ``label``), with its number of rows as ``weight``.

    Every function below takes such a table with ``weight="weight"`` and gives
    the same result as on the rows themselves.
    """
    return known(scored).groupBy(*by, F.col("score").cast("double").alias("score"), "label").agg(
        F.sum(_rows(weight)).cast("bigint").alias("weight")
    )


def distinct_scores(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Rows and positives per distinct score."""
    return known(scored).groupBy(*by, F.col("score").cast("double").alias("score")).agg(
        F.sum(_rows(weight)).cast("bigint").alias("n"),
        F.sum(F.col("label") * _rows(weight)).cast("bigint").alias("pos"),
    )


def _cumulative(scored: DataFrame, by: Sequence[str], weight: str | None) -> DataFrame:
    by = list(by)
    table = stage(distinct_scores(scored, by, weight), "scores")
    running = ordered.running_totals(table, "score", ["n", "pos"], by)
    totals = table.groupBy(*by).agg(F.sum("pos").alias("_p"), (F.sum("n") - F.sum("pos")).alias("_q"))
    return running.join(totals, by) if by else running.crossJoin(F.broadcast(totals))


def roc_auc(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Area under the ROC curve; equal scores count half. Null when a class is missing."""
    negatives = F.col("n") - F.col("pos")
    below = F.col("cum_n") - F.col("cum_pos") - negatives
    won = F.sum(F.col("pos") * (below + negatives / F.lit(2.0)))
    pairs = F.max(F.col("_p").cast("double") * F.col("_q"))
    return _cumulative(scored, by, weight).groupBy(*by).agg(F.try_divide(won, pairs).alias("roc_auc"))


def roc_curve(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """True and false positive rate at every distinct threshold, and the origin at infinity."""
    by = list(by)
    rows = _cumulative(scored, by, weight)
    over_pos = F.col("_p") - F.col("cum_pos") + F.col("pos")
    over_neg = F.col("_q") - (F.col("cum_n") - F.col("cum_pos")) + (F.col("n") - F.col("pos"))
    points = rows.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(over_pos, F.col("_p")).alias("tpr"),
        F.try_divide(over_neg, F.col("_q")).alias("fpr"),
    )
    zero = F.lit(0.0)
    groups = rows.select(*by, F.lit(float("inf")).alias("threshold")).distinct()
    origin = groups.select(*by, "threshold", zero.alias("tpr"), zero.alias("fpr"))
    return points.unionByName(origin)


def brier_terms(score: str = "score") -> Column:
    gap = F.col(score) - F.col("label")
    return gap * gap


def log_loss_terms(score: str = "score") -> Column:
    p = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), F.col(score)))
    loss = F.when(F.col("label") == 1, -F.ln(p)).otherwise(-F.ln(1 - p))
    # greatest and least pass over nulls
    return F.when(F.col(score).isNotNull() & F.col("label").isNotNull(), loss)


def summary(
    scored: DataFrame, by: Sequence[str] = (), score: str = "score", weight: str | None = None
) -> DataFrame:
    """Every metric that is a plain mean or sum, in one aggregation."""
    p, y = F.col(score), F.col("label")
    rows = _rows(weight)
    return (
        known(scored, score)
        .groupBy(*by)
        .agg(
            F.sum(rows).cast("bigint").alias("n"),
            _mean(brier_terms(score), weight).alias("brier_score"),
            _mean(log_loss_terms(score), weight).alias("log_loss"),
            _mean(F.when(y == 1, p), weight).alias("mean_goals"),
            _mean(F.when(y == 0, p), weight).alias("mean_no_goals"),
            _mean(p, weight).alias("mean_score"),
            F.try_divide(F.sum(p * rows), F.sum(y * rows)).alias("xg_ratio"),
        )
        .withColumn("separation", F.col("mean_goals") - F.col("mean_no_goals"))
    )


def relative_drop(before: Column, after: Column) -> Column:
    return F.try_divide(before - after, before)


def score_ranges(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    return known(scored).groupBy(*by).agg(
        F.min("score").alias("min"), F.max("score").alias("max"), _mean(F.col("score"), weight).alias("mean")
    )


def _reliability(binned: DataFrame, by: Sequence[str], weight: str | None) -> DataFrame:
    return binned.groupBy(*by, "bin").agg(
        F.sum(_rows(weight)).cast("bigint").alias("n"),
        _mean(F.col("score"), weight).alias("confidence"),
        _mean(F.col("label"), weight).alias("accuracy"),
    )


def reliability(
    scored: DataFrame, by: Sequence[str] = (), bins: int = BINS, weight: str | None = None
) -> DataFrame:
    """Mean score, positive rate and rows per fixed bin of [0, 1)."""
    binned = known(scored).withColumn("bin", unit_bin(F.col("score"), bins)).where("bin is not null")
    return _reliability(binned, by, weight)


def reliability_range(
    scored: DataFrame, by: Sequence[str] = (), bins: int = BINS, weight: str | None = None
) -> DataFrame:
    """Like ``reliability`` over equal bins between the smallest and largest score."""
    by, scored = list(by), known(scored)
    limits = scored.groupBy(*by).agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    joined = scored.join(limits, by) if by else scored.crossJoin(F.broadcast(limits))
    binned = joined.withColumn("bin", edge_bin(F.col("score"), F.col("_low"), F.col("_high"), bins))
    return _reliability(binned, by, weight)


def ece(
    scored: DataFrame, by: Sequence[str] = (), bins: int = BINS, weight: str | None = None
) -> DataFrame:
    """Expected calibration error over fixed bins; rows outside the bins only count in the total."""
    with_bin = known(scored).withColumn("bin", unit_bin(F.col("score"), bins))
    table = _reliability(with_bin, by, weight)  # the null bin stays for the total
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n"))
    return table.groupBy(*by).agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")).alias("ece"))


def record(
    scored: DataFrame, by: Sequence[str] = (), digits: int = 4, weight: str | None = None
) -> DataFrame:
    """One row per group: AUC, Brier, log loss, ECE, class means, separation and score/label ratio.

    The rows are read once; all metrics come from the staged distinct scores.
    """
    by = list(by)
    table = stage(reduce(scored, by, weight), "reduced")
    out = summary(table, by, weight="weight")
    for part in (roc_auc(table, by, "weight"), ece(table, by, weight="weight")):
        out = out.join(part, by) if by else out.crossJoin(F.broadcast(part))
    plain = {*by, "n"}
    return out.select(*by, "n", *[F.round(c, digits).alias(c) for c in out.columns if c not in plain])


def accuracy_by_type(predictions: DataFrame) -> DataFrame:
    """Share of right predictions per true type (columns ``truth``, ``predicted``)."""
    right = F.when(F.col("truth") == F.col("predicted"), 1.0).otherwise(0.0)
    return predictions.groupBy("truth").agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))


def weighted_cross_entropy(predictions: DataFrame) -> DataFrame:
    """Weighted mean of ``-ln p`` over rows with a target (columns ``p``, ``weight``)."""
    loss = F.sum(F.col("weight") * -F.ln("p"))
    return predictions.agg(F.try_divide(loss, F.sum("weight")).alias("loss"))
