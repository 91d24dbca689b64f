"""Queries on filtered, oriented events and on sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildup import ordered
from buildup.functions import labels, pitch
from buildup.operators import events as ev
from buildup.operators import sequences as seq
from buildup.plans import views
from buildup.plans.registry import query
from buildup.sources import standin

KEYS = seq.KEYS
COORDS = ["x", "y", "end_x", "end_y"]


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def all_events(spark, sf_dir):
    return standin.events(spark, sf_dir)


def moves(spark, sf_dir, **options):
    return ev.movement_events(standin.events(spark, sf_dir), **options)


def sequences(spark, sf_dir):
    return seq.from_events(moves(spark, sf_dir))


@query("truncate_last_n", f"""{views.MV}, {views.truncated()}
SELECT match_id, possession, index, event_rank, type, x, y, end_x, end_y FROM trunc""")
def truncate_last_n(spark, sf_dir):
    rows = seq.truncate_last(moves(spark, sf_dir))
    return rows.select(*KEYS, "index", *big("event_rank"), "type", *COORDS)


@query("possession_goal", f"""{views.SEQ}
SELECT match_id, possession, sequence_length, goal,
       CASE WHEN goal = 1 THEN 'GOAL' ELSE 'NO_GOAL' END AS terminal FROM poss""")
def possession_goal(spark, sf_dir):
    rows = seq.possession_goals(seq.truncate_last(moves(spark, sf_dir)))
    return rows.select(
        *KEYS, *big("sequence_length", "goal"), labels.terminal(F.col("goal")).alias("terminal")
    )


@query("movement_type_counts", f"""{views.EV}
SELECT type, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS share
FROM ev WHERE type IN ('Pass', 'Carry', 'Shot')
  AND NOT (type = 'Shot' AND shot_type IS NOT DISTINCT FROM 'Penalty')
GROUP BY type""")
def movement_type_counts(spark, sf_dir):
    from buildup.operators import profile

    return profile.type_counts(ev.movement(all_events(spark, sf_dir)))


@query("carry_threshold_filter", f"""{views.MV}
SELECT match_id, possession, index, type, round(carry_dist, 6) AS carry_dist FROM mv
WHERE type <> 'Carry' OR carry_dist >= 3""")
def carry_threshold_filter(spark, sf_dir):
    rows = moves(spark, sf_dir, mode="threshold", threshold=3)
    return rows.select(*KEYS, "index", "type", F.round("carry_dist", 6).alias("carry_dist"))


@query("oriented_events", f"""{views.MV}
SELECT match_id, possession, index, type, x, y, pass_x, pass_y, carry_x, carry_y FROM turned""")
def oriented_events(spark, sf_dir):
    rows = ev.orient(ev.with_coordinates(ev.movement(all_events(spark, sf_dir))))
    return rows.select(*KEYS, "index", "type", "x", "y", "pass_x", "pass_y", "carry_x", "carry_y")


@query("oriented_events_raw", f"""{views.EV}, ends AS (
  SELECT *, CASE type WHEN 'Pass' THEN pass_x WHEN 'Carry' THEN carry_x END AS ex,
            CASE type WHEN 'Pass' THEN pass_y WHEN 'Carry' THEN carry_y END AS ey
  FROM ev WHERE type IN ('Pass', 'Carry', 'Shot'))
SELECT match_id, possession, index,
  round(CASE WHEN team <> possession_team THEN 120 - x ELSE x END, 6) AS x,
  round(CASE WHEN team <> possession_team THEN 80 - y ELSE y END, 6) AS y,
  round(CASE WHEN team <> possession_team THEN 120 - ex ELSE ex END, 6) AS end_x,
  round(CASE WHEN team <> possession_team THEN 80 - ey ELSE ey END, 6) AS end_y FROM ends""")
def oriented_events_raw(spark, sf_dir):
    rows = ev.with_coordinates(ev.movement(all_events(spark, sf_dir), penalties=True))
    rows = ev.unify_end(ev.orient(rows, digits=None), include_shots=True)
    return rows.select(*KEYS, "index", *[F.round(c, 6).alias(c) for c in COORDS])


@query("unified_end", f"""{views.EV}
SELECT match_id, possession, index, type,
  CASE type WHEN 'Pass' THEN pass_x WHEN 'Carry' THEN carry_x END AS end_x,
  CASE type WHEN 'Pass' THEN pass_y WHEN 'Carry' THEN carry_y END AS end_y FROM ev""")
def unified_end(spark, sf_dir):
    rows = ev.unify_end(ev.with_coordinates(all_events(spark, sf_dir)), include_shots=True)
    return rows.select(*KEYS, "index", "type", "end_x", "end_y")


@query("event_distances", f"""{views.EV}, ends AS (
  SELECT *, CASE type WHEN 'Pass' THEN pass_x ELSE carry_x END AS ex,
            CASE type WHEN 'Pass' THEN pass_y ELSE carry_y END AS ey
  FROM ev WHERE type IN ('Pass', 'Carry'))
SELECT match_id, index, type, round(sqrt((ex - x) * (ex - x) + (ey - y) * (ey - y)), 6) AS distance
FROM ends WHERE ex IS NOT NULL AND ey IS NOT NULL""")
def event_distances(spark, sf_dir):
    rows = ev.event_distances(all_events(spark, sf_dir))
    return rows.select("match_id", "index", "type", F.round("distance", 6).alias("distance"))


@query("adaptive_truncation", f"""{views.MV}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY match_id, possession ORDER BY
      CASE WHEN type = 'Carry' THEN 1 ELSE 2 END,
      CASE WHEN type = 'Carry' THEN carry_dist ELSE 9999.0 END NULLS FIRST, index) AS drop_rank,
    count(*) OVER (PARTITION BY match_id, possession) AS total FROM mv)
SELECT match_id, possession, index, type,
  row_number() OVER (PARTITION BY match_id, possession ORDER BY index DESC) AS event_rank
FROM ranked WHERE drop_rank > total - 14""")
def adaptive_truncation(spark, sf_dir):
    rows = seq.truncate_adaptive(moves(spark, sf_dir, mode="adaptive"), 14)
    return rows.select(*KEYS, "index", "type", *big("event_rank"))


@query("reverse_rank", f"""{views.MV}
SELECT match_id, possession, index,
  row_number() OVER (PARTITION BY match_id, possession ORDER BY index DESC) AS event_rank FROM mv""")
def reverse_rank(spark, sf_dir):
    rows = moves(spark, sf_dir).select(*KEYS, "index")
    return ordered.position(rows, KEYS, "index", "event_rank", descending=True)


@query("sequence_tokens", f"{views.SEQ} SELECT * FROM tok")
def sequence_tokens(spark, sf_dir):
    rows = seq.explode(sequences(spark, sf_dir).select(*KEYS, "events"))
    return rows.select(*KEYS, *big("pos"), "type", *COORDS, *big("is_goal"))


@query("sequences_nofilter", f"""{views.SEQ}
SELECT match_id, possession, sequence_length, goal,
  (SELECT string_agg(type, '>' ORDER BY pos) FROM tok t
   WHERE t.match_id = p.match_id AND t.possession = p.possession) AS shape FROM poss p""")
def sequences_nofilter(spark, sf_dir):
    shape = F.array_join(F.transform("events", lambda e: e["type"]), ">").alias("shape")
    return sequences(spark, sf_dir).select(*KEYS, *big("sequence_length", "goal"), shape)


@query("sequence_lengths", f"{views.SEQ} SELECT sequence_length, count(*) AS n FROM poss GROUP BY 1")
def sequence_lengths(spark, sf_dir):
    rows = seq.possession_goals(seq.truncate_last(moves(spark, sf_dir)))
    return rows.groupBy(*big("sequence_length")).agg(F.count("*").alias("n"))


@query("normalized_events", f"{views.NORM} SELECT * FROM norm")
def normalized_events(spark, sf_dir):
    rows = seq.explode(seq.normalize(sequences(spark, sf_dir)).select(*KEYS, "events"))
    return rows.select(*KEYS, *big("pos"), "type", *COORDS)


@query("pass_only_sequences", f"""{views.EV}, passes AS (
  SELECT * FROM ev WHERE type IN ('Pass', 'Shot')
    AND NOT (type = 'Shot' AND shot_type IS NOT DISTINCT FROM 'Penalty')),
{views.truncated(12, 'passes')}, {views.POSS} SELECT * FROM poss""")
def pass_only_sequences(spark, sf_dir):
    rows = moves(spark, sf_dir, types=labels.PASS_ONLY_TYPES)
    rows = seq.possession_goals(seq.truncate_last(rows, seq.PASS_ONLY_CONTEXT))
    return rows.select(*KEYS, *big("sequence_length", "goal"))


@query("sequence_shape_search", f"""{views.SEQ}, hit AS (
  SELECT match_id, possession FROM poss WHERE goal = 1 AND sequence_length - 1 = 3
  ORDER BY match_id, possession LIMIT 1)
SELECT t.match_id, t.possession, pos, type FROM tok t JOIN hit USING (match_id, possession)""")
def sequence_shape_search(spark, sf_dir):
    rows = seq.explode(seq.shape_search(sequences(spark, sf_dir)).select(*KEYS, "events"))
    return rows.select(*KEYS, *big("pos"), "type")


@query("before_terminal_counts", f"""{views.SEQ}
SELECT t.type, count(*) AS n FROM tok t JOIN poss p USING (match_id, possession)
WHERE p.goal = 1 AND t.pos = p.sequence_length - 2 GROUP BY t.type""")
def before_terminal_counts(spark, sf_dir):
    return seq.before_terminal(sequences(spark, sf_dir))


@query("possession_lookup", f"""{views.EV}
SELECT match_id, possession, index, type, player, x, y FROM ev WHERE match_id = 8 AND possession = 1""")
def possession_lookup(spark, sf_dir):
    rows = ev.possession_events(all_events(spark, sf_dir), 8, 1)
    return ev.with_coordinates(rows).select(*KEYS, "index", "type", "player", "x", "y")


@query("goal_possession_events", f"""{views.EV}
SELECT match_id, possession, index, type, shot_outcome FROM ev WHERE (match_id, possession) IN (
  SELECT (match_id, possession) FROM ev WHERE type = 'Shot' AND shot_outcome = 'Goal')""")
def goal_possession_events(spark, sf_dir):
    rows = ev.goal_possession_events(all_events(spark, sf_dir))
    return rows.select(*KEYS, "index", "type", "shot_outcome")


@query("causal_pairs", f"""{views.SEQ}
SELECT a.match_id, a.possession, a.pos, a.type AS input_type, b.type AS target_type
FROM tok a JOIN tok b ON a.match_id = b.match_id AND a.possession = b.possession AND b.pos = a.pos + 1""")
def causal_pairs(spark, sf_dir):
    from buildup.operators import tokens

    return tokens.causal_pairs(sequences(spark, sf_dir)).select(
        *KEYS, *big("pos"), "input_type", "target_type"
    )


@query("grid_tokens", f"""{views.SEQ}
SELECT match_id, possession, string_agg(CASE WHEN type IN ('Pass', 'Carry') THEN
    concat(type, '_LOC_', CAST(floor(x / 5) * 5 AS BIGINT), '_', CAST(floor(y / 5) * 5 AS BIGINT))
  ELSE type END, ' ' ORDER BY pos) AS tokens FROM (
    SELECT * FROM tok UNION ALL
    SELECT match_id, possession, -1, 'START', NULL, NULL, NULL, NULL, 0 FROM poss) s
GROUP BY match_id, possession""")
def grid_tokens(spark, sf_dir):
    from buildup.operators import tokens

    return tokens.grid_text(sequences(spark, sf_dir)).select(*KEYS, "tokens")


@query("event_zone", f"""{views.MV}
SELECT match_id, index, {views.cell('x', 'y')} AS cell FROM mv""")
def event_zone(spark, sf_dir):
    rows = moves(spark, sf_dir)
    return rows.select(
        "match_id", "index", pitch.cell(F.col("x"), F.col("y"), 12, 12).cast("bigint").alias("cell")
    )
