"""Counts, lengths, null profiles, funnels and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildup import ordered
from buildup.functions import labels
from buildup.functions.bins import edge_bin
from buildup.functions.labels import share

KEYS = ["match_id", "possession"]


def type_counts(events: DataFrame) -> DataFrame:
    """Rows per type with their share, most frequent first."""
    counts = events.groupBy("type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", share(F.col("n"), total, 1)).orderBy(F.desc("n"), "type")


def top_types(events: DataFrame, n: int) -> DataFrame:
    counts = events.groupBy("type").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "type").limit(n)


def possession_lengths(events: DataFrame, name: str = "n_events") -> DataFrame:
    return events.groupBy(*KEYS).agg(F.count("*").alias(name))


def describe(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("stddev"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )


def percentiles(df: DataFrame, column: str, points: Sequence[int], accuracy: int = 10_000) -> DataFrame:
    """``p<point>`` per percentage point, from one mergeable sketch."""
    sketch = F.percentile_approx(column, [p / 100 for p in points], accuracy).alias("q")
    return df.agg(sketch).select(*[F.get("q", F.lit(i)).alias(f"p{p}") for i, p in enumerate(points)])


def length_histogram(lengths: DataFrame, column: str = "n_events", top: int = 50) -> DataFrame:
    """Unit-width bins; lengths above ``top`` count in the last bin."""
    return lengths.groupBy(F.least(F.col(column), F.lit(top)).alias("length")).agg(F.count("*").alias("n"))


def length_buckets(lengths: DataFrame, column: str = "n_events") -> DataFrame:
    bucket = labels.length_bucket(F.col(column)).alias("bucket")
    return lengths.groupBy(bucket).agg(F.count("*").alias("n")).orderBy("bucket")


def goals_by_length(possessions: DataFrame, column: str = "n_events", cap: int = 12) -> DataFrame:
    """Goals and possessions per length, lengths above ``cap`` together."""
    grouped = possessions.groupBy(labels.capped_length(F.col(column), cap).alias("length")).agg(
        F.sum("goal").alias("num_goals"), F.count("*").alias("total_possessions")
    )
    last = F.col("length").endswith("+")
    return grouped.orderBy(last, F.when(~last, F.col("length").cast("int")))


def goal_left_join(events: DataFrame) -> DataFrame:
    """Possession lengths with a 0/1 goal flag, null flags filled with 0."""
    goals = events.where(F.col("shot_outcome") == "Goal").select(*KEYS).distinct()
    joined = possession_lengths(events).join(goals.withColumn("goal", F.lit(1)), KEYS, "left")
    return joined.withColumn("goal", F.coalesce("goal", F.lit(0)))


def possession_outcomes(events: DataFrame) -> DataFrame:
    """Length, shot flag and goal flag per possession in one aggregation."""
    is_shot = F.col("type") == "Shot"
    return events.groupBy(*KEYS).agg(
        F.count("*").alias("n_events"),
        F.max(F.when(is_shot, 1).otherwise(0)).alias("has_shot"),
        F.max(F.when(is_shot & (F.col("shot_outcome") == "Goal"), 1).otherwise(0)).alias("goal"),
    )


def funnel(events: DataFrame) -> DataFrame:
    """Possessions, those with a shot, those with a goal, and their shares."""
    stats = possession_outcomes(events).agg(
        F.count("*").alias("possessions"),
        F.sum("has_shot").alias("with_shot"),
        F.sum("goal").alias("with_goal"),
    )
    n, shot, goal = F.col("possessions"), F.col("with_shot"), F.col("with_goal")
    return stats.select(
        "*",
        (n - shot).alias("no_shot"),
        (shot - goal).alias("shot_no_goal"),
        share(shot, n, 1).alias("shot_pct"),
        share(goal, n, 1).alias("goal_pct"),
        share(n - shot, n, 1).alias("no_shot_pct"),
        share(goal, shot, 1).alias("goal_of_shots_pct"),
        share(shot - goal, shot, 1).alias("no_goal_of_shots_pct"),
    )


def funnel_cells(events: DataFrame, cells: int = 100) -> DataFrame:
    """Whole grid cells per outcome; a goal always gets at least one."""
    f = funnel(events)
    part = lambda c: F.round(F.try_divide(F.col(c) * F.lit(float(cells)), F.col("possessions"))).cast("bigint")
    return f.select(
        F.greatest(part("with_goal"), F.lit(1)).alias("goal_cells"), part("shot_no_goal").alias("shot_cells")
    ).withColumn("other_cells", F.lit(cells) - F.col("goal_cells") - F.col("shot_cells"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-null and null counts of each column, from one scan."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count("*").alias("_total"), *[F.count(c).alias(c) for c in columns])
    long = counts.unpivot(["_total"], columns, "column_name", "non_null")
    nulls = F.col("_total") - F.col("non_null")
    return long.select(
        "column_name", "non_null", nulls.alias("nulls"), share(nulls, F.col("_total"), 2).alias("null_pct")
    )


def null_profile_by_type(df: DataFrame, checks: dict[str, str | None]) -> DataFrame:
    """Nulls of each column within the event type that should fill it (``None``: all events)."""
    entries = []
    for column, kind in checks.items():
        scope = F.lit(True) if kind is None else F.col("type").eqNullSafe(kind)
        entries += [
            F.count_if(scope).alias(f"t_{column}"),
            F.count_if(scope & F.col(column).isNull()).alias(f"n_{column}"),
        ]
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(kind or "All").alias("scope"),
                    F.col(f"t_{c}").alias("total"),
                    F.col(f"n_{c}").alias("nulls"),
                )
                for c, kind in checks.items()
            ]
        )
    ).alias("r")
    out = df.agg(*entries).select(rows).select("r.*")
    return out.withColumn("null_pct", share(F.col("nulls"), F.col("total"), 4))


def distance_stats(distances: DataFrame) -> DataFrame:
    """Mean, sample deviation, maximum and exact median of the distance per type."""
    moments = distances.groupBy("type").agg(
        F.count("*").alias("n"),
        F.avg("distance").alias("mean"),
        F.stddev_samp("distance").alias("stddev"),
        F.max("distance").alias("max"),
    )
    return moments.join(ordered.exact_quantiles(distances, "distance", {"median": 0.5}, ["type"]), "type")


def distance_histogram(
    distances: DataFrame, clips: dict[str, float | None], bins: int = 80
) -> DataFrame:
    """Percentage of all events of a type per bin, for the types in ``clips``.

    Values above a type's clip are counted but not binned.
    """
    rows = distances.where(F.col("type").isin(list(clips)))
    clip = F.create_map(*[F.lit(x) for k, v in clips.items() for x in (k, float("inf") if v is None else float(v))])
    inside = F.col("distance") <= clip[F.col("type")]
    shown = F.when(inside, F.col("distance"))
    # one row a type
    limits = rows.groupBy("type").agg(
        F.count("*").alias("_total"), F.min(shown).alias("_low"), F.max(shown).alias("_high")
    )
    binned = rows.where(inside).join(F.broadcast(limits), "type").withColumn(
        "bin", edge_bin(F.col("distance"), F.col("_low"), F.col("_high"), bins)
    )
    return binned.groupBy("type", "bin").agg(
        F.count("*").alias("n"),
        (F.count("*") * F.lit(100.0) / F.max("_total")).alias("pct"),
    )


# The carry thresholds that are compared.
THRESHOLDS = (1, 2, 3, 5, 8)


def carry_threshold_summary(distances: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """How many carries reach each threshold, all thresholds from one scan."""
    carries = distances.where(F.col("type") == "Carry")
    counts = carries.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("distance") >= t).alias(f"n{i}") for i, t in enumerate(thresholds)],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{i}").alias("carries_remaining"))
                for i, t in enumerate(thresholds)
            ]
        )
    ).alias("r")
    left, total = F.col("carries_remaining"), F.col("total")
    return (
        counts.select("total", rows)
        .select("total", "r.*")
        .select(
            "threshold",
            "carries_remaining",
            share(left, total, 1).alias("pct_remaining"),
            (total - left).alias("carries_removed"),
            share(total - left, total, 1).alias("pct_removed"),
        )
    )


def carry_share(events: DataFrame) -> DataFrame:
    """Events per possession by type and the carry percentage."""
    kind = lambda t: F.count_if(F.col("type") == t)
    counts = events.groupBy(*KEYS).agg(
        F.count("*").alias("total"),
        kind("Carry").alias("n_carries"),
        kind("Pass").alias("n_passes"),
        kind("Shot").alias("n_shots"),
    )
    return counts.withColumn("carry_pct", share(F.col("n_carries"), F.col("total"), 1))


def carry_share_summary(events: DataFrame, accuracy: int = 10_000) -> DataFrame:
    return carry_share(events).agg(
        F.percentile_approx("carry_pct", 0.5, accuracy).alias("median_carry_pct"),
        F.round(F.avg("carry_pct"), 1).alias("mean_carry_pct"),
        F.round(F.avg("n_carries"), 1).alias("mean_carries"),
        F.round(F.avg("n_passes"), 1).alias("mean_passes"),
        F.round(F.avg("total"), 1).alias("mean_total"),
    )


def categorical_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percentage of every value, nulls included, for several columns at once.

    The columns are stacked in one scan and counted before the shuffle.
    """
    present = [c for c in columns if c in df.columns]
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in present])
    long = texts.unpivot([], present, "column_name", "value")
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("_total"))
    joined = counts.join(F.broadcast(totals), "column_name")  # one row per column
    return joined.withColumn("pct", share(F.col("n"), F.col("_total"), 2)).drop("_total")


def dataset_summary(events: DataFrame) -> DataFrame:
    """Rows, matches, types and possessions, exact; counted on one row per possession and type."""
    small = events.groupBy(*KEYS, "type").agg(F.count("*").alias("n"))
    return small.agg(
        F.sum("n").alias("events"),
        F.count_distinct("match_id").alias("matches"),
        F.count_distinct(*KEYS).alias("possessions"),
        F.count_distinct("type").alias("event_types"),
    )
