"""Truncated, labelled event sequences, one row per possession."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildup.functions import labels, pitch

KEYS = ["match_id", "possession"]
DEFAULT_CONTEXT = 14
PASS_ONLY_CONTEXT = 12


def truncate_last(rows: DataFrame, n: int = DEFAULT_CONTEXT) -> DataFrame:
    """The last ``n`` events of each possession; ``event_rank`` 1 is the last.

    The rank filter sits directly on the window, so Spark keeps at most ``n``
    rows of a possession per input task before the shuffle.
    """
    latest = Window.partitionBy(*KEYS).orderBy(F.col("index").desc())
    return rows.withColumn("event_rank", F.row_number().over(latest)).where(F.col("event_rank") <= n)


def truncate_adaptive(rows: DataFrame, n: int = DEFAULT_CONTEXT) -> DataFrame:
    """Keep ``n`` events: the shortest carries go first, then the earliest other events.

    Read from the end of the drop order, "drop all but n" is "rank at most n",
    which needs no row count per possession and is limited before the shuffle.
    """
    is_carry = F.col("type") == "Carry"
    keep_order = Window.partitionBy(*KEYS).orderBy(
        is_carry.asc(),
        F.when(is_carry, F.col("carry_dist")).desc_nulls_last(),
        F.col("index").desc(),
    )
    kept = (
        rows.withColumn("_keep", F.row_number().over(keep_order)).where(F.col("_keep") <= n).drop("_keep")
    )
    latest = Window.partitionBy(*KEYS).orderBy(F.col("index").desc())
    return kept.withColumn("event_rank", F.row_number().over(latest))


def truncate(rows: DataFrame, n: int = DEFAULT_CONTEXT, mode: str = "nofilter") -> DataFrame:
    return truncate_adaptive(rows, n) if mode == "adaptive" else truncate_last(rows, n)


def build(truncated: DataFrame, by: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Chronological event arrays with a terminal element, their length and goal sum.

    A possession has at most the truncation length of events here, which
    bounds the collected array.
    """
    event = F.struct(
        F.col("event_rank").alias("rank"),
        "type",
        "x",
        "y",
        "end_x",
        "end_y",
        labels.goal_flag(F.col("shot_outcome")).alias("is_goal"),
    )
    end = F.struct(
        F.lit(0).alias("rank"),
        labels.terminal(F.col("goal"), strict).alias("type"),
        *[F.lit(None).cast("double").alias(c) for c in ("x", "y", "end_x", "end_y")],
        F.col("goal").alias("is_goal"),
    )
    keys = by or KEYS
    return (
        truncated.groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list(event), asc=False).alias("events"),
            F.sum(labels.goal_flag(F.col("shot_outcome"))).cast("int").alias("goal"),
        )
        .withColumn("events", F.concat("events", F.array(end)))
        .select(*keys, "events", F.size("events").alias("sequence_length"), "goal")
    )


def normalize(sequences: DataFrame) -> DataFrame:
    """Coordinates to [0, 1] with 5 decimals; rank and goal flag are dropped."""

    def scaled(e):
        return F.struct(
            e["type"].alias("type"),
            pitch.normalized(e["x"], pitch.LENGTH).alias("x"),
            pitch.normalized(e["y"], pitch.WIDTH).alias("y"),
            pitch.normalized(e["end_x"], pitch.LENGTH).alias("end_x"),
            pitch.normalized(e["end_y"], pitch.WIDTH).alias("end_y"),
        )

    return sequences.withColumn("events", F.transform("events", scaled))


def explode(sequences: DataFrame) -> DataFrame:
    """One row per element, with its 0-based ``pos``."""
    keep = [c for c in sequences.columns if c != "events"]
    return sequences.select(*keep, F.posexplode("events").alias("pos", "e")).select(*keep, "pos", "e.*")


def from_events(
    movement_rows: DataFrame, n: int = DEFAULT_CONTEXT, mode: str = "nofilter", strict: bool = True
) -> DataFrame:
    """Sequence table of already filtered and oriented events."""
    return build(truncate(movement_rows, n, mode), strict=strict)


def possession_goals(truncated: DataFrame) -> DataFrame:
    """Length and goal sum per possession, without building arrays."""
    return truncated.groupBy(*KEYS).agg(
        (F.count("*") + 1).cast("int").alias("sequence_length"),
        F.sum(labels.goal_flag(F.col("shot_outcome"))).cast("int").alias("goal"),
    )


def shape_search(sequences: DataFrame, inputs: int = 3) -> DataFrame:
    """First goal sequence, by key, with exactly ``inputs`` events before the terminal."""
    return (
        sequences.where((F.col("goal") == 1) & (F.size("events") - 1 == inputs)).orderBy(*KEYS).limit(1)
    )


def before_terminal(sequences: DataFrame, terminal: str = "GOAL") -> DataFrame:
    """How often each type comes right before the terminal."""
    ended = sequences.where(F.element_at("events", -1)["type"] == terminal)
    return ended.groupBy(F.element_at("events", -2)["type"].alias("type")).agg(F.count("*").alias("n"))
