"""Comparison of runs: one row per run with its parameters and metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildup.operators import metrics as quality
from buildup.operators import splits
from buildup.session import stage

REPLICATES = 100
INTERVAL = (0.025, 0.975)
MOST_COPIES = 12  # a draw of more has a chance below that of one hash value


def best_per_phase(runs: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """The run with the highest metric in each phase; the run name breaks ties."""
    order = Window.partitionBy("phase").orderBy(F.desc_nulls_last(metric), "run_name")
    return runs.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def delta_to(runs: DataFrame, baseline_run: str, metrics: Sequence[str]) -> DataFrame:
    """``<m>_delta``: each run's metric minus the one of ``baseline_run``.

    A baseline that occurs several times (once per phase) counts with its highest metrics; without
    a baseline every run stays, with null deltas.
    """
    # an aggregate without groups is always one row
    base = runs.where(F.col("run_name") == baseline_run).agg(*[F.max(m).alias(f"_b_{m}") for m in metrics])
    out = runs.crossJoin(F.broadcast(base))
    return out.withColumns({f"{m}_delta": F.col(m) - F.col(f"_b_{m}") for m in metrics}).drop(
        *[f"_b_{m}" for m in metrics]
    )


def poisson_levels() -> list[float]:
    """Chance of at most 0, 1, 2, ... in a Poisson draw of mean 1."""
    out, total = [], 0.0
    for k in range(MOST_COPIES):
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
    return out


def _drawn_by_four(rows: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """Each row once for every four replicates (group ``_g``), with the draws of these as ``_d0`` to ``_d3``.

    The number of draws is a Poisson draw from the hash of the keys, so rows of equal keys are drawn together,
    wherever they lie. One digest serves four replicates.
    """
    texts = [F.col(k).cast("string") for k in keys]
    groups = rows.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))))
    digest = F.md5(F.concat_ws("-", *texts, (F.lit(seed) + F.col("_g")).cast("string")))
    groups = groups.withColumn("_digest", digest)
    u = {f"_u{i}": F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("bigint") / F.lit(float(2**32)) for i in range(4)}
    groups = groups.withColumns(u)
    draws = lambda u: sum([(u >= F.lit(level)).cast("int") for level in poisson_levels()], F.lit(0))
    return groups.select(*rows.columns, "_g", *[draws(F.col(f"_u{i}")).alias(f"_d{i}") for i in range(4)])


def _by_replicate(groups: DataFrame, columns: Sequence[str], replicates: int, name: str) -> DataFrame:
    """One row a replicate (from 1) with a positive number, of rows with those of four as ``_d0`` to ``_d3``."""
    each = [F.struct((4 * F.col("_g") + i + 1).alias("replicate"), F.col(f"_d{i}").alias(name)) for i in range(4)]
    long = groups.withColumn("_d", F.explode(F.array(*each))).select(*columns, "_d.*")
    return long.where((F.col(name) > 0) & (F.col("replicate") <= replicates))


def with_draws(rows: DataFrame, keys: Sequence[str], replicates: int, seed: int = splits.SEED) -> DataFrame:
    """Each row once for every replicate that draws it, with ``replicate`` (from 1) and ``draws``."""
    return _by_replicate(_drawn_by_four(rows, keys, replicates, seed), rows.columns, replicates, "draws")


def bootstrap(
    scored: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    names: Sequence[str],
    replicates: int = REPLICATES,
    seed: int = splits.SEED,
) -> DataFrame:
    """``by``, ``replicate`` and the metrics ``names`` of every replicate; 0 is the table itself.

    One pass over the rows sums the draws of all replicates per distinct score and label; the metrics are those
    of the reduced rows.
    """
    rows = quality.known(scored).withColumn("score", F.col("score").cast("double"))
    # the draws of a key are made once for all its rows of a score
    rows = rows.groupBy(*by, "score", "label", *keys).agg(F.count("*").alias("_n"))
    rows = stage(rows, "keyed")
    cell = [*by, "score", "label"]
    # draws are summed before they are spread over the replicates: four replicates a row until then
    fours = _drawn_by_four(rows, keys, replicates, seed).groupBy(*cell, "_g")
    fours = fours.agg(*[F.sum(F.col("_n") * F.col(f"_d{i}")).alias(f"_d{i}") for i in range(4)])
    drawn = _by_replicate(fours, cell, replicates, "weight")
    whole = rows.groupBy(*cell).agg(F.sum("_n").alias("weight")).withColumn("replicate", F.lit(0))
    sums = stage(drawn.unionByName(whole), "replicates")
    return quality.record(sums, [*by, "replicate"], digits=12, weight="weight").select(*by, "replicate", *names)


def intervals(replicates: DataFrame, by: Sequence[str], names: Sequence[str], quantiles: Sequence[float] = INTERVAL) -> DataFrame:
    """Per group and metric: the value of the table, and the quantiles over the replicates."""
    long = replicates.select(
        *by, "replicate", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("m")
    )
    drawn = F.when(F.col("replicate") > 0, F.col("m.v"))
    low, high = quantiles
    return long.groupBy(*by, "m.metric").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("m.v"))).alias("value"),
        F.percentile(drawn, F.lit(low)).alias("low"),
        F.percentile(drawn, F.lit(high)).alias("high"),
        F.count(drawn).alias("replicates"),
    )


def delta_replicates(replicates: DataFrame, run: str, baseline: str, names: Sequence[str]) -> DataFrame:
    """``<name>_delta`` of every run and replicate against the baseline run in the same replicate."""
    base = replicates.where(F.col(run) == baseline).select("replicate", *[F.col(n).alias(f"_b_{n}") for n in names])
    out = replicates.join(base, "replicate")
    return out.select("replicate", run, *[(F.col(n) - F.col(f"_b_{n}")).alias(f"{n}_delta") for n in names])
