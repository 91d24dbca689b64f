"""Queries on the mixture of positions whose weights depend on the context."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from buildup.functions import labels
from buildup.operators import mixture, models, splits
from buildup.operators import sequences as seq
from buildup.plans import views
from buildup.plans.evaluation import rounded
from buildup.plans.models import normalized
from buildup.plans.registry import query
from buildup.session import stage

KEYS = seq.KEYS
AXES = mixture.AXES


def targets(spark, sf_dir):
    return stage(mixture.targets(normalized(spark, sf_dir)), "positions")


def given(components: int) -> mixture.Mixture:
    """Stated parameters, other ones in every context."""
    parts = []
    for i in range(components):
        at = 0.2 + 0.15 * i
        parts.append(mixture.Component((at, 0.9 - at, 1 - at, 0.3 + 0.1 * i), (0.08, 0.08, 0.2 + 0.02 * i, 0.3)))
    share = components * (components + 1) / 2
    weights = {c: tuple((1 + (c + i) % components) / share for i in range(components)) for c in range(mixture.CONTEXTS)}
    return mixture.Mixture(tuple(parts), weights, (1.0 / components,) * components)


_ZONE = f"""CASE WHEN {{t}}.x IS NULL OR {{t}}.y IS NULL THEN 0
  ELSE 1 + greatest(0, least({mixture.ZONES_X - 1}, CAST(floor({{t}}.x * {mixture.ZONES_X}) AS BIGINT)))
    + {mixture.ZONES_X} * greatest(0, least({mixture.ZONES_Y - 1}, CAST(floor({{t}}.y * {mixture.ZONES_Y}) AS BIGINT))) END""".format(t="a")
_KIND = "CASE a.type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(labels.MOVEMENT_TYPES)) + " END"

_TARGETS = f"""{views.NORM}, targets AS (
  SELECT b.match_id, b.possession, b.pos, b.type, {', '.join(f'b.{a}' for a in AXES)},
    {_KIND} * {mixture.ZONES} + {_ZONE} AS context
  FROM norm a JOIN norm b ON a.match_id = b.match_id AND a.possession = b.possession AND b.pos = a.pos + 1
  WHERE b.type NOT IN ('GOAL', 'NO_GOAL') AND {' AND '.join(f'b.{a} IS NOT NULL' for a in AXES)})"""


def _given_sql() -> str:
    rows = []
    for event_type, k in models.COMPONENTS.items():
        for i, part in enumerate(given(k).components):
            rows.append(f"('{event_type}', {i}, {k}, {', '.join(map(repr, (*part.mean, *part.deviation)))})")
    names = ", ".join([f"m_{a}" for a in AXES] + [f"d_{a}" for a in AXES])
    doubles = ", ".join(f"{n}::DOUBLE AS {n}" for n in names.split(", "))
    return f"given AS (SELECT type, component, k, {doubles} FROM (VALUES {', '.join(rows)}) v(type, component, k, {names}))"


_GAPS = " + ".join(f"(({a} - m_{a}) / d_{a}) * (({a} - m_{a}) / d_{a})" for a in AXES)
_PARTS = f"""{_TARGETS}, {_given_sql()}, parts AS (
  SELECT t.*, component, ln((1 + (context + component) % k) / (k * (k + 1) / 2.0::DOUBLE))
    - {2 * math.log(2 * math.pi)!r}::DOUBLE - ({' + '.join(f'ln(d_{a})' for a in AXES)}) - 0.5::DOUBLE * ({_GAPS}) AS l
  FROM targets t JOIN given USING (type)),
shares AS (
  SELECT *, most + ln(sum(exp(l - most)) OVER row_) AS log_density, exp(l - most) / sum(exp(l - most)) OVER row_ AS share
  FROM (SELECT *, max(l) OVER (PARTITION BY match_id, possession, pos) AS most FROM parts) q
  WINDOW row_ AS (PARTITION BY match_id, possession, pos)),
sums AS (
  SELECT type, component, sum(share) AS n, avg(log_density) AS log_likelihood,
    {', '.join(f'sum(share * {a}) / sum(share) AS mean_{a}' for a in AXES)},
    {', '.join(f'sum(share * {a} * {a}) / sum(share) AS square_{a}' for a in AXES)}
  FROM shares GROUP BY type, component)"""


def _deviation(axis: str) -> str:
    low, high = mixture.START_BOUNDS if axis in AXES[:2] else mixture.END_BOUNDS
    own = [axis] if axis not in AXES[:2] else list(AXES[:2])
    variance = "(" + " + ".join(f"square_{a} - mean_{a} * mean_{a}" for a in own) + f") / {len(own)}"
    return f"round(sqrt(greatest({low ** 2!r}::DOUBLE, least({high ** 2!r}::DOUBLE, {variance}))), 5) AS deviation_{axis}"


def _stepped(rows, event_type: str, k: int):
    sums = mixture.sufficient(rows.where(F.col("type") == event_type), given(k)).collect()
    return mixture.maximised(sums, given(k)) if sums else None


def _component_rows(event_type: str, model: mixture.Mixture) -> list[tuple]:
    return [
        (event_type, i, w, *part.mean, *part.deviation)
        for i, (w, part) in enumerate(zip(model.overall, model.components))
    ]


_COMPONENT = "type string, component bigint, weight double, " + ", ".join(
    [f"mean_{a} double" for a in AXES] + [f"deviation_{a} double" for a in AXES]
)


@query("mixture_log_density", f"""{_PARTS}
SELECT match_id, possession, pos, type, round(any_value(log_density), 5) AS log_density
FROM shares GROUP BY match_id, possession, pos, type""")
def mixture_log_density(spark, sf_dir):
    """Log density of every position under the stated parameters."""
    rows = targets(spark, sf_dir)
    scored = [mixture.with_log_density(rows.where(F.col("type") == t), given(k)) for t, k in models.COMPONENTS.items()]
    out = scored[0].unionByName(scored[1])
    return out.select(
        *KEYS, F.col("pos").cast("bigint").alias("pos"), "type", F.round("log_density", 5).alias("log_density")
    )


@query("mixture_step", f"""{_PARTS}
SELECT type, component::BIGINT AS component, round(n / sum(n) OVER (PARTITION BY type), 5) AS weight,
  {', '.join(f'round(mean_{a}, 5) AS mean_{a}' for a in AXES)}, {', '.join(map(_deviation, AXES))},
  round(log_likelihood, 5) AS log_likelihood FROM sums""")
def mixture_step(spark, sf_dir):
    """The components after one whole step from the stated parameters, and the likelihood before it."""
    rows, out = targets(spark, sf_dir), []
    for event_type, k in models.COMPONENTS.items():
        found = _stepped(rows, event_type, k)
        if found:
            out += [(*row, found[1]) for row in _component_rows(event_type, found[0])]
    frame = spark.createDataFrame(out, _COMPONENT + ", log_likelihood double")
    return rounded(frame, *frame.columns[2:], digits=5)


@query("mixture_step_weights", f"""{_PARTS}
SELECT type, context::BIGINT AS context, component::BIGINT AS component,
  round(sum(share) / sum(sum(share)) OVER (PARTITION BY type, context), 5) AS weight
FROM shares GROUP BY type, context, component""")
def mixture_step_weights(spark, sf_dir):
    """The weights of every context after the same step."""
    rows, out = targets(spark, sf_dir), []
    for event_type, k in models.COMPONENTS.items():
        found = _stepped(rows, event_type, k)
        for context, weights in (found[0].weights if found else {}).items():
            out += [(event_type, context, i, w) for i, w in enumerate(weights)]
    frame = spark.createDataFrame(out, "type string, context bigint, component bigint, weight double")
    return rounded(frame, "weight", digits=5)


@query("conditional_mixture")
def conditional_mixture(spark, sf_dir):
    """Components fitted on the training split, with the steps and the mean log likelihoods of training and other rows.

    ``gain`` is what the contexts add on the rows that were not learnt from, against the overall weights.
    """
    rows = stage(splits.with_split(targets(spark, sf_dir)), "positions")
    out = []
    for event_type, k in models.COMPONENTS.items():
        own = stage(rows.where(F.col("type") == event_type), "positions-of-type")
        model = mixture.fit(own.where("split = 'train'"), k)
        plain = mixture.Mixture(model.components, {}, model.overall)
        held = [
            mixture.with_log_density(own.where("split <> 'train'"), m).agg(F.avg("log_density")).first()[0]
            for m in (model, plain)
        ]
        held = [None, None] if held[0] is None else held
        fit = (len(model.trace), model.trace[0], model.trace[-1], held[0], held[0] and held[0] - held[1])
        out += [(*row, *fit) for row in _component_rows(event_type, model)]
    schema = ", steps bigint, first_likelihood double, likelihood double, held_out double, gain double"
    return spark.createDataFrame(out, _COMPONENT + schema)
