"""Pitch-zone tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildup.functions import pitch
from buildup.functions.labels import MOVEMENT_TYPES

KEYS = ["match_id", "possession"]
WORD = 62  # cells in a long


def located(events: DataFrame) -> DataFrame:
    """Movement events that have a location, penalties included."""
    return events.where(F.col("type").isin(*MOVEMENT_TYPES) & F.col("x").isNotNull() & F.col("y").isNotNull())


def _with_cell(events: DataFrame, bins: int) -> DataFrame:
    return events.withColumns(
        {
            "x_bin": pitch.grid_index(F.col("x"), pitch.LENGTH, bins),
            "y_bin": pitch.grid_index(F.col("y"), pitch.WIDTH, bins),
        }
    )


def event_counts(events: DataFrame, bins: int = 25) -> DataFrame:
    return _with_cell(located(events), bins).groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))


def _rates(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("x_bin", "y_bin").agg(
        F.count("*").alias("total"), F.sum("has_shot").alias("with_shot")
    )
    return counts.withColumn("rate", F.col("with_shot") * F.lit(100.0) / F.col("total"))


def shot_rate_through(events: DataFrame, bins: int = 12) -> DataFrame:
    """Per cell: possessions that touch it and the percentage of them with a shot.

    One aggregation per possession gathers its shot flag and its cells, as bits of a few long columns: it
    stays a hash aggregation, and is merged before the shuffle.
    """
    words = -(-bins * bins // WORD)
    cell = F.expr(f"y_bin * {bins} + x_bin")
    rows = _with_cell(located(events), bins).withColumn("_cell", cell)
    touched = rows.groupBy(*KEYS).agg(
        F.max(F.when(F.col("type") == "Shot", 1).otherwise(0)).alias("has_shot"),
        *[
            F.bit_or(F.expr(f"if(_cell div {WORD} = {w}, shiftleft(1L, cast(_cell % {WORD} as int)), 0L)")).alias(f"_m{w}")
            for w in range(words)
        ],
    )
    bits = [
        f"transform(filter(sequence(0, {WORD - 1}), b -> (shiftright(_m{w}, b) & 1L) = 1L), b -> b + {w * WORD})"
        for w in range(words)
    ]
    cells = touched.select("has_shot", F.explode(F.expr(f"concat({', '.join(bits)})")).alias("_cell"))
    return _rates(
        cells.select(
            "has_shot",
            F.expr(f"cast(_cell % {bins} as int)").alias("x_bin"),
            F.expr(f"cast(_cell div {bins} as int)").alias("y_bin"),
        )
    )


def shot_rate_start(events: DataFrame, bins: int = 12) -> DataFrame:
    """Per cell: possessions whose first located movement event lies in it."""
    first = (
        located(events)
        .groupBy(*KEYS)
        .agg(
            F.max(F.when(F.col("type") == "Shot", 1).otherwise(0)).alias("has_shot"),
            F.min_by("x", "index").alias("x"),
            F.min_by("y", "index").alias("y"),
        )
    )
    return _rates(_with_cell(first, bins))


def dense(rates: DataFrame, bins: int = 12) -> DataFrame:
    """Every cell of the grid, with nulls where no possession was."""
    spark = rates.sparkSession
    axis = spark.range(bins)
    grid = axis.select(F.col("id").cast("int").alias("x_bin")).crossJoin(
        axis.select(F.col("id").cast("int").alias("y_bin"))
    )
    return grid.join(rates, ["x_bin", "y_bin"], "left")
