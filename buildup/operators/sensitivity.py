"""What one more action of a given type and length would change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildup.functions import labels, pitch
from buildup.operators import threat

# 0 to 5 pitch units in steps of a quarter.
DISTANCES = [i * 0.25 for i in range(21)]
ACTIONS = ["Carry", "Pass"]


def grid(spark: SparkSession) -> DataFrame:
    """All (type, distance) pairs: 42 rows."""
    return spark.range(len(DISTANCES)).select(
        F.explode(F.array(*[F.lit(a) for a in ACTIONS])).alias("event_type"),
        (F.col("id") * 0.25).cast("double").alias("distance_sb"),
    )


def _inputs() -> Column:
    return F.filter("events", lambda e: ~e["type"].isin(*labels.TERMINALS))


def _last_with_end(events: Column) -> Column:
    return F.try_element_at(F.filter(events, lambda e: e["end_x"].isNotNull()), F.lit(-1))


def eligible(sequences: DataFrame, max_len: int = 16) -> DataFrame:
    """Whole sequences with room for one more event and at least one end point."""
    rows = sequences.withColumn("events", _inputs())
    rows = rows.withColumn("last", _last_with_end(F.col("events")))
    return rows.where((F.size("events") < max_len - 1) & F.col("last").isNotNull())


def eligible_start(sequences: DataFrame, size: int = 3) -> DataFrame:
    """The first ``size`` events of sequences that have as many and one end point among them."""
    rows = sequences.withColumn("events", _inputs()).where(F.size("events") >= size)
    rows = rows.withColumn("events", F.slice("events", 1, size))
    return rows.withColumn("last", _last_with_end(F.col("events"))).where(F.col("last").isNotNull())


def append_event(rows: DataFrame) -> DataFrame:
    """Add the synthetic event to eligible rows joined with the grid, and to their ``events`` if they are there.

    It starts where the last event ended and moves straight forward; the pitch
    ends at 1.
    """
    start_x, start_y = F.col("last")["end_x"], F.col("last")["end_y"]
    event = F.struct(
        F.col("event_type").alias("type"),
        start_x.alias("x"),
        start_y.alias("y"),
        F.least(start_x + F.col("distance_sb") / F.lit(float(pitch.LENGTH)), F.lit(1.0)).alias("end_x"),
        start_y.alias("end_y"),
    )
    rows = rows.withColumn("added", event).withColumn("size", F.col("size") + 1)
    return rows.withColumn("events", F.concat("events", F.array(event))) if "events" in rows.columns else rows


def counterfactuals(eligible_rows: DataFrame, with_events: bool = False) -> DataFrame:
    """Every eligible sequence with every synthetic event: ``added`` and the new ``size``.

    The grid multiplies the last point of a sequence; its events are copied only ``with_events``.
    """
    eligible_rows = eligible_rows.withColumn("size", F.size("events"))
    eligible_rows = eligible_rows if with_events else eligible_rows.drop("events")
    return append_event(eligible_rows.crossJoin(F.broadcast(grid(eligible_rows.sparkSession))))


def _zone(x: Column, y: Column) -> Column:
    return pitch.cell(x * float(pitch.LENGTH), y * float(pitch.WIDTH), threat.BINS_X, threat.BINS_Y)


def summary(eligible_rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Mean, population deviation and change against the unchanged sequences, per type and distance.

    An added action is worth the chance that its type keeps the ball times the
    threat of the zone it ends in. That depends on the sequence only through
    its last point, so the sequences are counted per point before the grid
    multiplies them.
    """
    points = (
        eligible_rows.select(F.col("last")["end_x"].alias("x0"), F.col("last")["end_y"].alias("y0"))
        .groupBy("x0", "y0")
        .agg(F.count("*").alias("n"))
    )
    spark = eligible_rows.sparkSession
    keep = threat.continue_rates(moves).select(F.col("type").alias("event_type"), "keep")
    actions = grid(spark).join(F.broadcast(keep), "event_type")
    model = threat.fit(moves)
    shifted = F.least(F.col("x0") + F.col("distance_sb") / F.lit(float(pitch.LENGTH)), F.lit(1.0))
    valued = points.crossJoin(F.broadcast(model)).select(
        "x0", "y0", "n", "threat", F.get("threat", _zone(F.col("x0"), F.col("y0"))).alias("before")
    )
    baseline = valued.agg((F.sum(F.col("before") * F.col("n")) / F.sum("n")).alias("baseline"))
    worth = valued.crossJoin(F.broadcast(actions)).select(
        "event_type",
        "distance_sb",
        "n",
        (F.col("keep") * F.get("threat", _zone(shifted, F.col("y0")))).alias("v"),
    )
    sums = worth.groupBy("event_type", "distance_sb").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("v") * F.col("n")).alias("s1"),
        F.sum(F.col("v") * F.col("v") * F.col("n")).alias("s2"),
    )
    mean = F.col("s1") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.crossJoin(F.broadcast(baseline)).select(
        "event_type",
        "distance_sb",
        mean.alias("mean_xT"),
        spread.alias("std_xT"),
        (mean - F.col("baseline")).alias("delta_vs_baseline"),
    )


def differential(table: DataFrame, types: Sequence[str] = tuple(ACTIONS)) -> DataFrame:
    """First type minus second type at equal distance."""
    first, second = types
    wide = table.groupBy("distance_sb").pivot("event_type", list(types)).agg(F.first("mean_xT"))
    return wide.withColumn("difference", F.col(first) - F.col(second))


def first_gain(table: DataFrame) -> DataFrame:
    """Shortest distance per type with a positive change."""
    better = F.when(F.col("delta_vs_baseline") > 0, F.col("distance_sb"))
    return table.groupBy("event_type").agg(F.min(better).alias("first_gain_at"))
