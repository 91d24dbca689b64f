"""Gaussian mixture of event positions whose weights depend on the context of the event.

A component has a mean over start and end, one deviation for both start axes and one for each end axis. The
context is the type of the previous event and the coarse zone it started in. Every step of the fit
(expectation maximisation) is one aggregation over the rows, grouped by context and component: the sums are
``contexts x components`` rows whatever the number of events, and give all parameters. No step lowers the
likelihood. Deviations are kept within bounds, which the step's optimum is clipped to.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildup.functions import labels
from buildup.operators import tokens

AXES = tokens.AXES
ZONES_X, ZONES_Y = 6, 4
ZONES = ZONES_X * ZONES_Y + 1  # one for no place
CONTEXTS = len(labels.MOVEMENT_TYPES) * ZONES

# Least and greatest deviation of starts and of ends, in units of the pitch.
START_BOUNDS = (0.005, 0.1)
END_BOUNDS = (0.01, 0.5)

TOLERANCE = 1e-5  # gain of the mean log likelihood of a row at which the fit stops
MAX_STEPS = 1_000
NEVER = -1e9  # log weight of a component that a context does not use


@dataclass(frozen=True)
class Component:
    mean: tuple[float, ...]
    deviation: tuple[float, ...]


@dataclass(frozen=True)
class Mixture:
    """Components, their weights in each context of the training rows and overall, and the likelihood after each step."""

    components: tuple[Component, ...]
    weights: dict[int, tuple[float, ...]]
    overall: tuple[float, ...]
    trace: tuple[float, ...] = field(default=())

    def numbers(self, spark: SparkSession) -> DataFrame:
        """One row for every context: the components' log weights, then constant, means and deviations of each.

        Contexts not seen have the overall weights.
        """
        shared = []
        for part in self.components:
            shared.append(-2 * math.log(2 * math.pi) - sum(map(math.log, part.deviation)))
            shared += [*part.mean, *part.deviation]
        rows = [
            [math.log(w) if w > 0 else NEVER for w in self.weights.get(c, self.overall)] + shared
            for c in range(CONTEXTS)
        ]
        table = {"context": pa.array(range(CONTEXTS), pa.int32()), "_p": pa.array(rows, pa.list_(pa.float64()))}
        return spark.createDataFrame(pa.table(table))


def zone(x: Column, y: Column) -> Column:
    """Coarse cell of a normalised point, 0 where there is none."""
    at = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v * n).cast("int")))
    inside = x.isNotNull() & y.isNotNull()
    return F.when(inside, 1 + at(x, ZONES_X) + ZONES_X * at(y, ZONES_Y)).otherwise(0).cast("int")


def context_of(event_type: Column, x: Column, y: Column) -> Column:
    """Number of the context that an event is for the next one, below ``CONTEXTS``."""
    place = F.array_position(F.array(*[F.lit(t) for t in labels.MOVEMENT_TYPES]), event_type) - 1
    return (place * ZONES + zone(x, y)).cast("int")


def targets(normalized_sequences: DataFrame) -> DataFrame:
    """One row per event that follows another: keys, ``pos``, ``type``, the position and the ``context``."""
    n = F.size("events") - 2  # without the terminal

    def row(a, b):
        ctx = context_of(a["type"], a["x"], a["y"]).alias("context")
        return F.struct(b["type"].alias("type"), *[b[c].alias(c) for c in AXES], ctx)

    pairs = F.zip_with(F.slice("events", 1, F.greatest(n, F.lit(0))), F.slice("events", 2, F.greatest(n, F.lit(0))), row)
    keep = [c for c in normalized_sequences.columns if c != "events"]
    rows = normalized_sequences.select(*keep, F.posexplode(pairs).alias("pos", "r"))
    return rows.select(*keep, (F.col("pos") + 1).alias("pos"), "r.*").dropna(subset=AXES)


def _scored(rows: DataFrame, model: Mixture) -> tuple[DataFrame, list[str]]:
    """Add log weight plus log density for each component, and ``log_density`` of all.

    The parameters come by a join with one row per context, so that all steps of a fit share their generated code.
    """
    k, width, axes = len(model.components), 1 + 2 * len(AXES), len(AXES)
    parts = {}
    for i in range(k):
        base = k + i * width
        gaps = [f"(({a} - get(_p, {base + 1 + j})) / get(_p, {base + 1 + axes + j}))" for j, a in enumerate(AXES)]
        squares = " + ".join(f"{g} * {g}" for g in gaps)
        parts[f"_l{i}"] = F.expr(f"get(_p, {i}) + get(_p, {base}) - 0.5D * ({squares})")
    names = list(parts)
    joined = rows.join(F.broadcast(model.numbers(rows.sparkSession)), "context").withColumns(parts)
    joined = joined.withColumn("_most", F.greatest(*names) if k > 1 else F.col(names[0]))
    total = " + ".join(f"exp({n} - _most)" for n in names)
    return joined.withColumn("log_density", F.expr(f"_most + ln({total})")), names


def with_log_density(rows: DataFrame, model: Mixture) -> DataFrame:
    """Add ``log_density`` of the position of every row given its context."""
    scored, names = _scored(rows, model)
    return scored.drop(*names, "_most", "_p")


def sufficient(rows: DataFrame, model: Mixture) -> DataFrame:
    """Expected counts, sums and sums of squares by context and component, with the rows' log likelihood."""
    scored, names = _scored(rows, model)
    share = F.expr("array(" + ", ".join(f"exp({n} - log_density)" for n in names) + ")")
    long = scored.select("context", *AXES, "log_density", F.posexplode(share).alias("component", "share"))
    sums = ["count_if(component = 0) AS rows", "sum(if(component = 0, log_density, null)) AS log_likelihood"]
    sums.append("sum(share) AS n")
    for axis in AXES:
        sums += [f"sum(share * {axis}) AS s_{axis}", f"sum(share * {axis} * {axis}) AS q_{axis}"]
    return long.groupBy("context", "component").agg(*[F.expr(x) for x in sums])


def _bounded(variance: float, bounds: tuple[float, float]) -> float:
    return math.sqrt(min(max(variance, bounds[0] ** 2), bounds[1] ** 2))


def maximised(sums: Sequence, before: Mixture) -> tuple[Mixture, float]:
    """The parameters that ``sufficient`` rows lead to, and the mean log likelihood before."""
    k = len(before.components)
    by_context: dict[int, list[float]] = {}
    total = [dict.fromkeys(["n", *[f"{p}_{a}" for p in "sq" for a in AXES]], 0.0) for _ in range(k)]
    for row in sorted(sums, key=lambda r: (r["context"], r["component"])):
        by_context.setdefault(row["context"], [0.0] * k)[row["component"]] = row["n"]
        for name in total[row["component"]]:
            total[row["component"]][name] += row[name]
    rows = sum(r["rows"] for r in sums)
    likelihood = math.fsum(r["log_likelihood"] or 0.0 for r in sums) / rows
    parts = []
    for old, t in zip(before.components, total):
        if t["n"] <= 0:
            parts.append(old)
            continue
        mean = [t[f"s_{a}"] / t["n"] for a in AXES]
        variance = [max(0.0, t[f"q_{a}"] / t["n"] - m * m) for a, m in zip(AXES, mean)]
        start = _bounded((variance[0] + variance[1]) / 2, START_BOUNDS)
        ends = [_bounded(v, END_BOUNDS) for v in variance[2:]]
        parts.append(Component(tuple(mean), (start, start, *ends)))
    weights = {c: tuple(v / math.fsum(row) for v in row) for c, row in by_context.items()}
    counts = [t["n"] for t in total]
    overall = tuple(c / math.fsum(counts) for c in counts)
    return Mixture(tuple(parts), weights, overall, (*before.trace, likelihood)), likelihood


def start(rows: DataFrame, components: int) -> Mixture:
    """First parameters: means spread around the mean of the rows along alternating directions."""
    sums = rows.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    parts = []
    for i in range(components):
        turn = 2 * math.pi * i / components
        lean = (math.cos(turn), math.sin(turn), math.cos(2 * turn + 1), math.sin(2 * turn + 1))
        mean = tuple(sums[f"m_{a}"] + lean_ * sums[f"d_{a}"] for a, lean_ in zip(AXES, lean))
        deviation = (START_BOUNDS[1], START_BOUNDS[1], *[_bounded(sums[f"d_{a}"] ** 2, END_BOUNDS) for a in AXES[2:]])
        parts.append(Component(mean, deviation))
    return Mixture(tuple(parts), {}, (1.0 / components,) * components)


def fit(rows: DataFrame, components: int, tolerance: float = TOLERANCE, max_steps: int = MAX_STEPS) -> Mixture:
    """The mixture of staged ``targets`` rows; fails if it has not settled after ``max_steps``."""
    model, last = start(rows, components), -math.inf
    for _ in range(max_steps):
        model, likelihood = maximised(sufficient(rows, model).collect(), model)
        if likelihood - last < tolerance:
            return model
        last = likelihood
    raise RuntimeError(f"the mixture did not settle in {max_steps} steps")
