"""Column cleaning, scaling, dummies and collinearity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildup.session import stage

def select_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*features)


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop the columns without a single value; one scan decides for all columns."""
    counts = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c]])


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<c>_scaled``: distance from the mean in population deviations; a constant column is only centred."""
    moments = df.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    divisor = lambda c: F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
    out = df.crossJoin(F.broadcast(moments)).withColumns(
        {f"{c}_scaled": (F.col(c) - F.col(f"_m_{c}")) / divisor(c) for c in columns}
    )
    return out.drop(*moments.columns)


def dummies(df: DataFrame, column: str, values: Sequence, drop: str | None = None) -> DataFrame:
    """One 0/1 column for each of ``values`` in place of the source column; other and null rows are all zeros."""
    flags = {str(v): F.when(F.col(column).eqNullSafe(v), 1).otherwise(0) for v in values if v != drop}
    return df.withColumns(flags).drop(column)


def categories(df: DataFrame, column: str) -> DataFrame:
    """``(column, category_id)`` of every distinct value, for a vocabulary of any size.

    Ids follow the order of the values, with gaps. The table is written, so that all
    who read it see the same ids.
    """
    values = df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
    return stage(values.withColumn("category_id", F.monotonically_increasing_id()), "categories")


def sparse_dummies(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Dummy coding in long form: ``(keys, category_id)`` of the one category each row is in; null rows have none."""
    return df.select(*keys, column).join(categories(df, column), column).select(*keys, "category_id")


def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation factors without an intercept, largest first.

    One aggregation gives the p x p matrix of products; with its inverse,
    VIF_i = G_ii * (G^-1)_ii. Only that matrix reaches the driver.
    """
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    complete = df.dropna(subset=list(features))
    sums = complete.agg(
        *[F.sum(F.col(features[i]).cast("double") * F.col(features[j])).alias(f"g{i}_{j}") for i, j in pairs]
    ).first()
    gram = np.zeros((p, p))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"]
    scale = np.sqrt(np.diag(gram))
    inverse = np.linalg.inv(gram / np.outer(scale, scale))
    rows = [(features[i], float(inverse[i, i])) for i in range(p)]
    return df.sparkSession.createDataFrame(rows, "variable string, vif double").orderBy(
        F.desc("vif"), "variable"
    )


def map_names(df: DataFrame, column: str, new_name: str, mapping: DataFrame) -> DataFrame:
    """Rename ``column`` to ``new_name`` and look its short form up in (``full_name``, ``short_name``).

    Values without an entry become null. A name that the mapping has twice counts with its first
    short form, so rows are never multiplied; Catalyst broadcasts the mapping when its measured size allows.
    """
    renamed = df.withColumnRenamed(column, new_name)
    names = mapping.groupBy(F.col("full_name").alias(new_name)).agg(F.min("short_name").alias(column))
    return renamed.join(names, new_name, "left")
