"""Queries on zone threat, contexts, contributions and sensitivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildup import ordered
from buildup.functions import labels
from buildup.functions.labels import signed_text
from buildup.operators import context, metrics, sensitivity, splits, threat
from buildup.operators import sequences as seq
from buildup.operators import tokens
from buildup.plans import views
from buildup.plans.evaluation import BINS_SQL, rounded
from buildup.plans.movement import all_events, big, moves, sequences
from buildup.plans.registry import query

KEYS = seq.KEYS


def _iterations(n: int) -> str:
    """Threat values by ``n`` unrolled steps."""
    steps = ["v0 AS (SELECT zone, 0.0::DOUBLE AS v FROM zgrid)"]
    for i in range(1, n + 1):
        steps.append(f"""v{i} AS MATERIALIZED (
  SELECT d.zone, d.direct + coalesce(sum(m.p * w.v), 0) AS v FROM zdirect d
  LEFT JOIN zmove m ON m.zone = d.zone LEFT JOIN v{i - 1} w ON w.zone = m.end_zone
  GROUP BY d.zone, d.direct)""")
    return ", ".join(steps) + f", threat AS (SELECT zone, v AS threat FROM v{n})"


_ZONED = f"""zoned AS (
  SELECT *, {views.cell('x', 'y')} AS zone,
    CASE WHEN end_x IS NOT NULL THEN {views.cell('end_x', 'end_y')} END AS end_zone,
    lead(index) OVER (PARTITION BY match_id, possession ORDER BY index) IS NOT NULL AS goes_on
  FROM mv)"""

_MODEL = f"""{_ZONED}, zgrid AS (SELECT range AS zone FROM range(144)),
zstat AS (SELECT zone, count(*) AS events, count(*) FILTER (type = 'Shot') AS shots,
    count(*) FILTER (shot_outcome = 'Goal') AS goals FROM zoned GROUP BY zone),
zdirect AS (SELECT zone, CASE WHEN coalesce(shots, 0) = 0 THEN 0.0::DOUBLE
    ELSE (shots / events::DOUBLE) * (goals / shots::DOUBLE) END AS direct
  FROM zgrid LEFT JOIN zstat USING (zone)),
zmove AS MATERIALIZED (SELECT zone, end_zone, count(*) / any_value(events)::DOUBLE AS p
  FROM zoned JOIN zstat USING (zone)
  WHERE type IN ('Pass', 'Carry') AND end_zone IS NOT NULL AND goes_on GROUP BY zone, end_zone),
{_iterations(5)}"""

THREAT = f"{views.MV}, {_MODEL}"


@query("zone_threat", f"{THREAT} SELECT zone, round(threat, 6) AS threat FROM threat")
def zone_threat(spark, sf_dir):
    rows = threat.zone_threat(moves(spark, sf_dir))
    return rows.select(*big("zone"), F.round("threat", 6).alias("threat"))


def _grid_model(bins_x: int, bins_y: int, iterations: int) -> str:
    """Values of the zones with events on another grid."""
    model = _MODEL.replace(_iterations(5), _iterations(iterations))
    model = model.replace(views.cell("x", "y"), views.cell("x", "y", bins_x, bins_y))
    model = model.replace(views.cell("end_x", "end_y"), views.cell("end_x", "end_y", bins_x, bins_y))
    model = model.replace("range(144)", f"range({bins_x * bins_y})")
    return f"""{views.MV}, {model}
SELECT zone::BIGINT AS zone, round(threat, 5) AS threat FROM threat JOIN zstat USING (zone)"""


def _sparse(spark, sf_dir, bins_x, bins_y, **options):
    rows = threat.sparse_threat(moves(spark, sf_dir), bins_x, bins_y, **options)
    return rows.select(*big("zone"), F.round("threat", 5).alias("threat"))


@query("zone_threat_sparse", _grid_model(12, 12, 5))
def zone_threat_sparse(spark, sf_dir):
    return _sparse(spark, sf_dir, 12, 12, iterations=5)


@query("zone_threat_fine", _grid_model(120, 80, 5))
def zone_threat_fine(spark, sf_dir):
    """On zones of one unit, where most pairs of zones have no move."""
    return _sparse(spark, sf_dir, 120, 80, iterations=5)


@query("zone_threat_settled", _grid_model(24, 16, 120))
def zone_threat_settled(spark, sf_dir):
    """Until the values no longer change."""
    return _sparse(spark, sf_dir, 24, 16, tolerance=1e-10)


@query("zone_moves", f"""{views.MV}, {_ZONED}
SELECT zone, end_zone, count(*) FILTER (goes_on) AS n FROM zoned
WHERE type IN ('Pass', 'Carry') AND end_zone IS NOT NULL GROUP BY zone, end_zone""")
def zone_moves(spark, sf_dir):
    rows = threat.zone_moves(threat.with_zones(moves(spark, sf_dir)))
    return rows.select(*big("zone", "end_zone"), "n")


@query("type_transitions", f"""{views.SEQ}, pairs AS (
  SELECT a.type AS input_type, b.type AS target_type FROM tok a JOIN tok b
  ON a.match_id = b.match_id AND a.possession = b.possession AND b.pos = a.pos + 1),
counts AS (SELECT input_type, target_type, count(*) AS n FROM pairs GROUP BY ALL)
SELECT *, CAST(sum(n) OVER (PARTITION BY input_type) AS BIGINT) AS total,
  round(n / sum(n) OVER (PARTITION BY input_type), 6) AS p FROM counts""")
def type_transitions(spark, sf_dir):
    return rounded(threat.type_transitions(tokens.causal_pairs(sequences(spark, sf_dir))), "p")


@query("type_transitions_by_cell", f"""{views.MV}, nexts AS (
  SELECT type AS input_type, {views.cell('x', 'y', 6, 4)} AS cell,
    coalesce(lead(type) OVER (PARTITION BY match_id, possession ORDER BY index), 'END') AS target_type FROM mv),
counts AS (SELECT cell, input_type, target_type, count(*) AS n FROM nexts GROUP BY ALL)
SELECT *, CAST(sum(n) OVER (PARTITION BY cell, input_type) AS BIGINT) AS total,
  round(n / sum(n) OVER (PARTITION BY cell, input_type), 6) AS p FROM counts""")
def type_transitions_by_cell(spark, sf_dir):
    from buildup.functions import pitch

    rows = ordered.following(moves(spark, sf_dir), KEYS, "index", F.col("type"), "target_type")
    pairs = rows.select(
        pitch.cell(F.col("x"), F.col("y"), 6, 4).cast("bigint").alias("cell"),
        F.col("type").alias("input_type"),
        F.coalesce("target_type", F.lit("END")).alias("target_type"),
    )
    return rounded(threat.type_transitions(pairs, ["cell"]), "p")


# ---- contexts

_WORD = f"concat(type, ':', {views.cell('x', 'y', 6, 4)})"


def _rates(keyed: str) -> str:
    """Context scores from ``keyed`` (k3, k2, k1, label, training), by four left joins."""
    level = lambda k: (
        f"SELECT {k}, count(*) AS n, sum(label) AS g FROM {keyed} WHERE training GROUP BY {k}"
    )
    rate = lambda a: f"({a}.g + 20 * base) / ({a}.n + 20)"
    return f"""base AS (SELECT sum(label) / count(*)::DOUBLE AS base FROM {keyed} WHERE training),
r3 AS ({level('k3')}), r2 AS ({level('k2')}), r1 AS ({level('k1')}),
rated AS (SELECT c.*, coalesce({rate('r3')}, {rate('r2')}, {rate('r1')}, base) AS score,
    CASE WHEN r3.n > 0 THEN 3 WHEN r2.n > 0 THEN 2 WHEN r1.n > 0 THEN 1 ELSE 0 END::BIGINT AS level
  FROM {keyed} c LEFT JOIN r3 ON r3.k3 = c.k3 LEFT JOIN r2 ON r2.k2 = c.k2 LEFT JOIN r1 ON r1.k1 = c.k1, base)"""


_START = f"""{views.SEQ}, words AS (
  SELECT t.match_id, t.possession, pos, {_WORD} AS w FROM tok t
  WHERE type IN ('Pass', 'Carry', 'Shot') AND pos < 3),
skeys AS (
  SELECT match_id, possession, string_agg(w, '|' ORDER BY pos) AS k3,
    string_agg(w, '|' ORDER BY pos) FILTER (pos < 2) AS k2, string_agg(w, '|') FILTER (pos < 1) AS k1
  FROM words GROUP BY match_id, possession),
keyed AS (
  SELECT s.*, CASE WHEN goal = 1 THEN 1 ELSE 0 END AS label, {views.SPLIT_OF} AS split,
    {views.digits(0)} % 100 < 80 AS training
  FROM skeys s JOIN poss p USING (match_id, possession)),
{_rates('keyed')}"""


def scored_possessions(spark, sf_dir):
    rows = splits.with_split(sequences(spark, sf_dir))
    return context.score_possessions(rows, F.col("split") == "train")


@query("context_goal_rate", f"""{_START}
SELECT DISTINCT k3 AS context, level, round(score, 6) AS score FROM rated""")
def context_goal_rate(spark, sf_dir):
    rows = splits.with_split(sequences(spark, sf_dir))
    rows = rows.withColumn("label", F.when(F.col("goal") == 1, 1).otherwise(0))
    rates = context.rates(context.start_keys(rows), F.col("split") == "train")
    return rates.select(context.context_text(F.col("context")).alias("context"), *big("level"), F.round("score", 6).alias("score"))


@query("score_possessions", f"""{_START}
SELECT match_id, possession, split, round(score, 6) AS score, CAST(label AS BIGINT) AS label FROM rated""")
def score_possessions(spark, sf_dir):
    rows = scored_possessions(spark, sf_dir)
    return rows.select(*KEYS, "split", F.round("score", 6).alias("score"), *big("label"))


@query("start_context", f"""{views.SEQ}
SELECT t.match_id, t.possession, p.sequence_length - 1 AS real_length,
  count(*) FILTER (pos < 3) AS context_size, string_agg(type, '>' ORDER BY pos) FILTER (pos < 3) AS shape
FROM tok t JOIN poss p USING (match_id, possession) WHERE type NOT IN ('GOAL', 'NO_GOAL') GROUP BY ALL""")
def start_context(spark, sf_dir):
    rows = tokens.start_context(sequences(spark, sf_dir))
    ids = F.transform("events", lambda e: labels.type_id(e["type"]))
    # inputs of a training row: all but the terminal, filled up with padding
    pad = F.array_repeat(F.lit(labels.VOCAB["<pad>"]), F.greatest(F.lit(0), F.lit(16) - F.size("events")))
    rows = rows.withColumn("_ids", F.concat(F.slice(ids, F.lit(1), F.size("events") - 1), pad))
    return rows.select(
        *KEYS,
        tokens.real_length("_ids").cast("bigint").alias("real_length"),
        F.size("context").cast("bigint").alias("context_size"),
        F.array_join(F.transform("context", lambda e: e["type"]), ">").alias("shape"),
    )


_SLIDING = f"""{views.SEQ}, w0 AS (
  SELECT match_id, possession, index, type, x, y, {_WORD} AS w FROM mv),
w1 AS (SELECT *, lag(w) OVER o AS p1, lag(w, 2) OVER o AS p2 FROM w0
       WINDOW o AS (PARTITION BY match_id, possession ORDER BY index)),
w2 AS (SELECT *, concat_ws('|', p2, p1, w) AS k3, concat_ws('|', p1, w) AS k2, w AS k1,
    1 + (p1 IS NOT NULL)::INT + (p2 IS NOT NULL)::INT AS size FROM w1)"""


@query("sliding_context", f"""{_SLIDING}
SELECT match_id, possession, index, k3 AS context, CAST(size AS BIGINT) AS context_size FROM w2""")
def sliding_context(spark, sf_dir):
    rows = context.sliding_keys(moves(spark, sf_dir))
    return rows.select(
        *KEYS, "index", context.context_text(F.col("context"), latest_last=True).alias("context"), *big("context_size")
    )


ACTIONS = f"""{_SLIDING}, keyed AS (
  SELECT w2.*, CASE WHEN goal = 1 THEN 1 ELSE 0 END AS label, {views.digits(0)} % 100 < 80 AS training
  FROM w2 JOIN poss USING (match_id, possession)),
{_rates('keyed')}"""


@query("score_actions", f"""{ACTIONS}
SELECT match_id, possession, index, type, CAST(size AS BIGINT) AS context_size, round(score, 6) AS score
FROM rated""")
def score_actions(spark, sf_dir):
    rows = scored_actions(spark, sf_dir)
    return rows.select(*KEYS, "index", "type", *big("context_size"), F.round("score", 6).alias("score"))


def scored_actions(spark, sf_dir):
    """Events with the context score of their possession's goal."""
    events = moves(spark, sf_dir)
    labels = seq.possession_goals(seq.truncate_last(events)).select(
        *KEYS, F.when(F.col("goal") == 1, 1).otherwise(0).alias("label")
    )
    return context.score_actions(events, splits.with_split(labels), F.col("split") == "train")


_CONTRIB = f"""{THREAT}, ps AS (
  SELECT match_id, possession, index, type, threat AS score,
    lead(threat) OVER (PARTITION BY match_id, possession ORDER BY index) AS nxt
  FROM zoned JOIN threat USING (zone) WHERE type IN ('Pass', 'Shot')),
contrib AS (
  SELECT *, coalesce(round(nxt - score, 3), 0) AS rise,
    CASE WHEN type = 'Shot' THEN round(1 - score, 3) ELSE coalesce(round(nxt - score, 3), 0) END AS contribution
  FROM ps)"""


def contributions(spark, sf_dir):
    """Contribution of passes and shots under the zone threat of their start."""
    events = moves(spark, sf_dir)
    zoned = threat.with_zones(events).where(F.col("type").isin("Pass", "Shot"))
    scored = threat.with_threat(
        zoned.select(*KEYS, "index", "type", "zone"), threat.fit(events), F.col("zone")
    )
    return context.with_contribution(scored)


@query("contribution", f"""{_CONTRIB}
SELECT match_id, possession, index, type, round(score, 6) AS score, rise, contribution,
  CASE WHEN contribution = 0 THEN '0.000'
    ELSE CASE WHEN contribution > 0 THEN '+' ELSE '' END || printf('%.3f', contribution) END AS label FROM contrib""")
def contribution(spark, sf_dir):
    rows = contributions(spark, sf_dir)
    return rows.select(
        *KEYS, "index", "type", F.round("score", 6).alias("score"), "rise", "contribution",
        signed_text(F.col("contribution")).alias("label"),
    )


@query("contribution_summary", f"""{_CONTRIB}
SELECT match_id, possession, round(sum(contribution), 6) AS total, round(avg(contribution), 9) AS mean,
  max(contribution) AS largest, min(contribution) AS smallest,
  first(index ORDER BY contribution DESC, index) AS largest_at,
  first(index ORDER BY contribution, index) AS smallest_at FROM contrib GROUP BY match_id, possession""")
def contribution_summary(spark, sf_dir):
    rows = context.contribution_summary(contributions(spark, sf_dir))
    return rounded(rounded(rows, "total"), "mean", digits=9)


@query("score_zip", f"""{THREAT}, ps AS (
  SELECT match_id, possession, index, threat AS score FROM zoned JOIN threat USING (zone)
  WHERE type IN ('Pass', 'Shot'))
SELECT mv.match_id, mv.possession, mv.index, type, round(score, 6) AS score,
  CASE WHEN type IN ('Pass', 'Shot') THEN count(*) FILTER (type IN ('Pass', 'Shot')) OVER (
    PARTITION BY mv.match_id, mv.possession ORDER BY mv.index ROWS UNBOUNDED PRECEDING) - 1 END AS token_idx
FROM mv LEFT JOIN ps ON ps.match_id = mv.match_id AND ps.possession = mv.possession AND ps.index = mv.index""")
def score_zip(spark, sf_dir):
    """Scores by ordinal, as a scoring run returns them, put back on the full event list."""
    events = moves(spark, sf_dir)
    scored = threat.with_threat(tokens.scoring_tokens(threat.with_zones(events)), threat.fit(events), F.col("zone"))
    scores = scored.select(*KEYS, "token_idx", "score")
    rows = context.attach_scores(events.select(*KEYS, "index", "type"), scores, ["Pass", "Shot"])
    return rows.select(*KEYS, "index", "type", "token_idx", F.round("score", 6).alias("score"))


@query("actor_changes", f"""{views.MV}, p AS (
  SELECT match_id, possession, index, player,
    lag(player) OVER (PARTITION BY match_id, possession ORDER BY index) AS before FROM mv)
SELECT match_id, possession, index, CASE WHEN player IS DISTINCT FROM before THEN player END AS label FROM p""")
def actor_changes(spark, sf_dir):
    rows = ordered.previous(moves(spark, sf_dir), KEYS, "index", F.col("player"), "before")
    changed = F.when(~F.col("player").eqNullSafe(F.col("before")), F.col("player"))
    return rows.select(*KEYS, "index", changed.alias("label"))


@query("scoring_tokens", f"""{views.MV}
SELECT match_id, possession, index, row_number() OVER (PARTITION BY match_id, possession ORDER BY index) - 1
    AS token_idx, CASE type WHEN 'Pass' THEN 0 WHEN 'Shot' THEN 1 END::BIGINT AS type_id,
  round(x / 120.0, 6) AS x, round(y / 80.0, 6) AS y, round(end_x / 120.0, 6) AS end_x, round(end_y / 80.0, 6) AS end_y
FROM mv WHERE type IN ('Pass', 'Shot')""")
def scoring_tokens(spark, sf_dir):
    rows = tokens.scoring_tokens(moves(spark, sf_dir))
    return rows.select(
        *KEYS, "index", "token_idx", *big("type_id"),
        *[F.round(c, 6).alias(c) for c in ("x", "y", "end_x", "end_y")],
    )


# ---- sensitivity

_LAST_END = f"""{views.NORM}, lens AS (
  SELECT match_id, possession, count(*) FILTER (type NOT IN ('GOAL', 'NO_GOAL')) AS n FROM norm GROUP BY ALL),
whole AS (
  SELECT match_id, possession, any_value(n) AS n, max_by(end_x, pos) AS x0, max_by(end_y, pos) AS y0
  FROM norm JOIN lens USING (match_id, possession) WHERE end_x IS NOT NULL AND n < 15 GROUP BY ALL),
starts AS (
  SELECT match_id, possession, 3 AS n, max_by(end_x, pos) AS x0, max_by(end_y, pos) AS y0
  FROM norm JOIN lens USING (match_id, possession) WHERE end_x IS NOT NULL AND n >= 3 AND pos < 3 GROUP BY ALL),
actions AS (SELECT event_type, d * 0.25::DOUBLE AS distance_sb
  FROM (SELECT unnest(['Carry', 'Pass']) AS event_type) a, (SELECT unnest(range(21)) AS d) b)"""


def normalized(spark, sf_dir):
    return seq.normalize(sequences(spark, sf_dir))


@query("sensitivity_eligible", f"""{_LAST_END}
SELECT 'whole' AS rule, match_id, possession, CAST(n AS BIGINT) AS n, x0, y0 FROM whole UNION ALL
SELECT 'start', match_id, possession, n, x0, y0 FROM starts""")
def sensitivity_eligible(spark, sf_dir):
    rows = normalized(spark, sf_dir)
    shape = lambda df, rule: df.select(
        F.lit(rule).alias("rule"), *KEYS, F.size("events").cast("bigint").alias("n"),
        F.col("last")["end_x"].alias("x0"), F.col("last")["end_y"].alias("y0"),
    )
    return shape(sensitivity.eligible(rows), "whole").union(shape(sensitivity.eligible_start(rows), "start"))


@query("counterfactual_events", f"""{_LAST_END}
SELECT match_id, possession, event_type, distance_sb, n + 1 AS size, x0 AS x, y0 AS y,
  round(least(x0 + distance_sb / 120.0, 1), 6) AS end_x, y0 AS end_y
FROM whole, actions""")
def counterfactual_events(spark, sf_dir):
    rows = sensitivity.counterfactuals(sensitivity.eligible(normalized(spark, sf_dir)))
    return rows.select(
        *KEYS, "event_type", "distance_sb", *big("size"),
        "added.x", "added.y", F.round("added.end_x", 6).alias("end_x"), "added.end_y",
    )


def _at(x: str, y: str) -> str:
    return views.cell(f"({x} * 120.0::DOUBLE)", f"({y} * 80.0::DOUBLE)")


_SENSITIVITY = f"""{_LAST_END}, {_MODEL},
keep AS (SELECT type AS event_type, 1 - count(*) FILTER (NOT goes_on) / count(*)::DOUBLE AS keep
         FROM zoned GROUP BY type),
baseline AS (SELECT avg(threat) AS baseline FROM whole JOIN threat ON zone = {_at('x0', 'y0')}),
worth AS (SELECT event_type, distance_sb, keep * threat AS v FROM whole, actions JOIN keep USING (event_type), threat
  WHERE threat.zone = {_at('least(x0 + distance_sb / 120.0::DOUBLE, 1)', 'y0')}),
sens AS (SELECT event_type, distance_sb, avg(v) AS mean, stddev_pop(v) AS std FROM worth GROUP BY ALL)"""


_SENSITIVITY_START = _SENSITIVITY.replace("FROM whole JOIN threat", "FROM starts JOIN threat").replace(
    "FROM whole, actions JOIN keep", "FROM starts, actions JOIN keep"
)


def sensitivity_table(spark, sf_dir, rule=sensitivity.eligible):
    return sensitivity.summary(rule(normalized(spark, sf_dir)), moves(spark, sf_dir))


@query("sensitivity_summary", f"""{_SENSITIVITY}
SELECT event_type, distance_sb, round(mean, 6) AS "mean_xT", round(std, 6) AS "std_xT",
  round(mean - baseline, 6) AS delta_vs_baseline FROM sens, baseline""")
def sensitivity_summary(spark, sf_dir):
    return rounded(sensitivity_table(spark, sf_dir), "mean_xT", "std_xT", "delta_vs_baseline")


@query("sensitivity_differential", f"""{_SENSITIVITY}
SELECT a.distance_sb, round(a.mean, 6) AS "Carry", round(b.mean, 6) AS "Pass", round(a.mean - b.mean, 6) AS difference
FROM sens a JOIN sens b USING (distance_sb) WHERE a.event_type = 'Carry' AND b.event_type = 'Pass'""")
def sensitivity_differential(spark, sf_dir):
    rows = sensitivity.differential(sensitivity_table(spark, sf_dir))
    return rounded(rows, "Carry", "Pass", "difference")


@query("sensitivity_first_gain", f"""{_SENSITIVITY}
SELECT event_type, min(distance_sb) FILTER (mean > baseline) AS first_gain_at FROM sens, baseline GROUP BY event_type""")
def sensitivity_first_gain(spark, sf_dir):
    return sensitivity.first_gain(sensitivity_table(spark, sf_dir))


@query("sensitivity_start_summary", f"""{_SENSITIVITY_START}
SELECT event_type, distance_sb, round(mean, 6) AS "mean_xT", round(std, 6) AS "std_xT",
  round(mean - baseline, 6) AS delta_vs_baseline FROM sens, baseline""")
def sensitivity_start_summary(spark, sf_dir):
    """The same over the first three events of each possession."""
    rows = sensitivity_table(spark, sf_dir, sensitivity.eligible_start)
    return rounded(rows, "mean_xT", "std_xT", "delta_vs_baseline")


@query("sensitivity_start_differential", f"""{_SENSITIVITY_START}
SELECT a.distance_sb, round(a.mean, 6) AS "Carry", round(b.mean, 6) AS "Pass", round(a.mean - b.mean, 6) AS difference
FROM sens a JOIN sens b USING (distance_sb) WHERE a.event_type = 'Carry' AND b.event_type = 'Pass'""")
def sensitivity_start_differential(spark, sf_dir):
    rows = sensitivity.differential(sensitivity_table(spark, sf_dir, sensitivity.eligible_start))
    return rounded(rows, "Carry", "Pass", "difference")


@query("sensitivity_start_first_gain", f"""{_SENSITIVITY_START}
SELECT event_type, min(distance_sb) FILTER (mean > baseline) AS first_gain_at FROM sens, baseline GROUP BY event_type""")
def sensitivity_start_first_gain(spark, sf_dir):
    return sensitivity.first_gain(sensitivity_table(spark, sf_dir, sensitivity.eligible_start))


@query("evaluate_possessions", f"""{_START}, {BINS_SQL}, ranked AS (
  SELECT *, rank() OVER (PARTITION BY split ORDER BY score)
    + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0::DOUBLE AS r FROM rated WHERE split <> 'train'),
quality AS (SELECT split, count(*) AS n, avg((score - label) * (score - label)) AS brier,
    avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0) AS separation,
    (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
      / nullif(sum(label)::DOUBLE * (count(*) - sum(label)), 0) AS auc FROM ranked GROUP BY split),
cells AS (SELECT split, bin, count(*) AS m, abs(avg(score) - avg(label)) AS gap
  FROM ranked JOIN bins ON score >= low AND score < high GROUP BY split, bin),
total AS (SELECT split, sum(m * gap) AS gaps FROM cells GROUP BY split)
SELECT split, n, round(auc, 4) AS roc_auc, round(brier, 4) AS brier_score, round(separation, 4) AS separation,
  round(gaps / n, 4) AS ece FROM quality JOIN total USING (split)""")
def evaluate_possessions(spark, sf_dir):
    """Quality of the possession scores on the splits that were not learnt from."""
    rows = scored_possessions(spark, sf_dir).where("split <> 'train'")
    return metrics.record(rows, ["split"]).select("split", "n", "roc_auc", "brier_score", "separation", "ece")
