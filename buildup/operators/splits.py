"""Reproducible splits, balancing, samples and dataset variants.

Everything is decided from an md5 of the key, so the result does not depend
on how the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildup.functions import labels
from buildup.operators import events as ev
from buildup.operators import sequences as seq
from buildup.session import stage

KEYS = ["match_id", "possession"]
SEED = 42
GOAL_SHARE = 0.05


def key_hash(part: int = 0, seed: int = SEED, keys: Sequence[str] = tuple(KEYS)) -> Column:
    """Integer below 2**32 from the md5 of the key; ``part`` 0 to 3 are independent."""
    text = F.concat_ws("-", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1 + 8 * part, 8), 16, 10).cast("bigint")


def with_split(df: DataFrame, train: int = 80, val: int = 10, seed: int = SEED) -> DataFrame:
    """``split`` of every possession, ``train``/``val`` in percent and the rest test."""
    bucket = key_hash(0, seed) % 100
    name = F.when(bucket < train, "train").when(bucket < train + val, "val").otherwise("test")
    return df.withColumn("split", name)


def balance(train: DataFrame, share: float = GOAL_SHARE, seed: int = SEED) -> DataFrame:
    """All goal possessions and a sample of the others, so goals are about ``share`` of the result.

    Possessions with a goal sum above 1 belong to neither class and leave.
    """
    counts = train.agg(
        F.count_if(F.col("goal") == 1).alias("_goals"), F.count_if(F.col("goal") == 0).alias("_others")
    )
    wanted = F.col("_goals") / F.lit(share) - F.col("_goals")
    fraction = counts.select(F.least(F.lit(1.0), F.try_divide(wanted, F.col("_others"))).alias("_fraction"))
    drawn = key_hash(1, seed) / F.lit(float(2**32)) < F.col("_fraction")
    kept = (F.col("goal") == 1) | ((F.col("goal") == 0) & drawn)
    return train.crossJoin(F.broadcast(fraction)).where(kept).drop("_fraction")


def variant_events(events: DataFrame, variant: str) -> DataFrame:
    """Movement events of a dataset variant: ``t<threshold>``, ``adaptive``, ``nofilter`` or ``passonly``."""
    if variant == "passonly":
        return ev.movement_events(events, types=("Pass", "Shot"))
    if variant in ("adaptive", "nofilter"):
        return ev.movement_events(events, mode=variant)
    return ev.movement_events(events, mode="threshold", threshold=float(variant[1:]))


def dataset(rows: DataFrame, n: int, variant: str, share: float = GOAL_SHARE, seed: int = SEED) -> DataFrame:
    """Normalised sequences with their split: training balanced, validation and test as they are."""
    mode = "adaptive" if variant == "adaptive" else "nofilter"
    table = stage(with_split(seq.normalize(seq.from_events(rows, n, mode)), seed=seed), "sequences")
    train = balance(table.where("split = 'train'"), share, seed)
    return train.unionByName(table.where("split <> 'train'"))


def fixed_sample(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """``n`` possessions drawn without replacement."""
    return df.orderBy(key_hash(2, seed), *KEYS).limit(n)


def goal_balance(df: DataFrame) -> DataFrame:
    """Possessions per split and goal value, with the share inside the split."""
    counts = df.groupBy("split", "goal").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("split"))
    return counts.withColumn("pct", labels.share(F.col("n"), total, 2))


def threshold_ranks(rows: DataFrame, thresholds: Sequence[float], longest: int) -> DataFrame:
    """The last ``longest`` events of each possession under every carry threshold.

    Thresholds are nested, so an event has one ``level``: how many thresholds
    it passes. Of each level only the latest ``longest`` events of a
    possession can matter under any threshold; that limit is applied before
    the shuffle and bounds a possession. An event that is cut has that many
    later events of its own level, so the ranks of the events that stay do not
    change. Ranks for all thresholds then come from one window pass.
    """
    steps = sorted(thresholds)
    passed = F.size(F.filter(F.array(*[F.lit(float(t)) for t in steps]), lambda t: F.col("carry_dist") >= t))
    level = F.when(F.col("type") == "Carry", passed).otherwise(len(steps))
    latest_of_level = Window.partitionBy(*KEYS, "_level").orderBy(F.col("index").desc())
    short = (
        rows.withColumn("_level", level)
        .where("_level > 0")
        .withColumn("_rank", F.row_number().over(latest_of_level))
        .where(F.col("_rank") <= longest)
    )
    latest = (
        Window.partitionBy(*KEYS)
        .orderBy(F.col("index").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = short.withColumns(
        {f"_r{i}": F.sum(F.when(F.col("_level") > i, 1).otherwise(0)).over(latest) for i in range(len(steps))}
    )
    # the threshold is a decimal here: Spark rewrites floating-point keys, which would cost a shuffle
    member = lambda i, t: F.when(
        (F.col("_level") > i) & (F.col(f"_r{i}") <= longest),
        F.struct(
            F.lit(float(t)).cast("decimal(18,6)").alias("threshold"),
            F.col(f"_r{i}").cast("int").alias("event_rank"),
        ),
    )
    memberships = F.array_compact(F.array(*[member(i, t) for i, t in enumerate(steps)]))
    return ranked.withColumn("_in", F.explode(memberships)).select(*rows.columns, "_in.*")


def variants(rows: DataFrame, thresholds: Sequence[float], contexts: Sequence[int]) -> DataFrame:
    """Truncated events of every (carry threshold, context length) pair.

    A shorter context is a prefix of the longest one, so only rows that
    survived the longest are copied.
    """
    wide_enough = F.filter(
        F.array(*[F.lit(int(c)) for c in sorted(contexts)]), lambda c: c >= F.col("event_rank")
    )
    ranked = threshold_ranks(rows, thresholds, max(contexts))
    return ranked.withColumn("context", F.explode(wide_enough))


def variant_possessions(
    rows: DataFrame, thresholds: Sequence[float], contexts: Sequence[int]
) -> DataFrame:
    """Length and goal sum per variant and possession.

    All contexts of a threshold come from one aggregation of conditional sums.
    """
    contexts = sorted(int(c) for c in contexts)
    goal = labels.goal_flag(F.col("shot_outcome"))
    counts = (
        threshold_ranks(rows, thresholds, max(contexts))
        .groupBy("threshold", *KEYS)
        .agg(
            F.count("*").alias("_n"),
            *[F.sum(F.when(F.col("event_rank") <= c, goal)).alias(f"_g{c}") for c in contexts],
        )
    )
    variant = lambda c: F.struct(
        F.lit(c).alias("context"),
        (F.least(F.col("_n"), F.lit(c)) + 1).cast("int").alias("sequence_length"),
        F.col(f"_g{c}").cast("int").alias("goal"),
    )
    each = F.explode(F.array(*[variant(c) for c in contexts])).alias("v")
    return counts.select(F.col("threshold").cast("double").alias("threshold"), *KEYS, each).select(
        "threshold", *KEYS, "v.*"
    )


def variant_sequences(truncated: DataFrame) -> DataFrame:
    """Sequence table of every variant."""
    built = seq.build(truncated, by=["threshold", "context", *KEYS])
    return built.withColumn("threshold", F.col("threshold").cast("double"))


def context_grid(lengths: DataFrame, column: str = "n_events", smallest: int = 3) -> DataFrame:
    """Distinct lengths at every 5th percentile up to the 95th, from ``smallest`` on."""
    points = [p / 100 for p in range(5, 100, 5)]
    grid = lengths.agg(F.percentile_approx(column, points, 10_000).alias("q"))
    rows = grid.select(F.explode(F.array_distinct("q")).alias("context"))
    return rows.where(F.col("context") >= smallest)
