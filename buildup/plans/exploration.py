"""Queries that profile events, possessions and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildup.operators import events as ev
from buildup.operators import profile
from buildup.operators import sequences as seq
from buildup.plans import views
from buildup.plans.movement import all_events, big, moves
from buildup.plans.registry import query
from buildup.sources import standin

KEYS = seq.KEYS
# The percentiles of possession lengths.
POINTS = [10, 25, 50, 75, 80, 85, 90, 95, 99, 100]

_LENGTHS = f"""{views.EV}, len AS (
  SELECT match_id, possession, count(*) AS n_events FROM ev
  WHERE type IN ('Pass', 'Carry', 'Shot')
    AND NOT (type = 'Shot' AND shot_type IS NOT DISTINCT FROM 'Penalty')
  GROUP BY match_id, possession)"""

_OUTCOMES = f"""{views.EV}, outcome AS (
  SELECT match_id, possession, count(*) AS n_events,
    max(CASE WHEN type = 'Shot' THEN 1 ELSE 0 END) AS has_shot,
    max(CASE WHEN type = 'Shot' AND shot_outcome = 'Goal' THEN 1 ELSE 0 END) AS goal
  FROM ev GROUP BY match_id, possession)"""

_DIST = f"""{views.EV}, ends AS (
  SELECT *, CASE type WHEN 'Pass' THEN pass_x ELSE carry_x END AS ex,
            CASE type WHEN 'Pass' THEN pass_y ELSE carry_y END AS ey
  FROM ev WHERE type IN ('Pass', 'Carry')),
dist AS (SELECT type, sqrt((ex - x) * (ex - x) + (ey - y) * (ey - y)) AS distance FROM ends
  WHERE ex IS NOT NULL AND ey IS NOT NULL)"""


def lengths(spark, sf_dir):
    return profile.possession_lengths(ev.movement(all_events(spark, sf_dir)))


def pct(part: str, total: str, places: int) -> str:
    return f"round(100.0::DOUBLE * ({part}) / nullif({total}, 0), {places})"


@query("possession_lengths", f"""{views.EV}
SELECT match_id, possession, count(*) AS n_events FROM ev GROUP BY match_id, possession""")
def possession_lengths(spark, sf_dir):
    return profile.possession_lengths(all_events(spark, sf_dir))


@query("movement_lengths", f"{_LENGTHS} SELECT * FROM len")
def movement_lengths(spark, sf_dir):
    return lengths(spark, sf_dir)


@query("length_describe", f"""{_LENGTHS}
SELECT count(n_events) AS count, round(avg(n_events), 6) AS mean, round(stddev_samp(n_events), 6) AS stddev,
  min(n_events) AS min, max(n_events) AS max FROM len""")
def length_describe(spark, sf_dir):
    out = profile.describe(lengths(spark, sf_dir), "n_events")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


_quantiles = ", ".join(f"quantile_disc(n_events, {p / 100}) AS p{p}" for p in POINTS)


@query("length_percentiles", f"{_LENGTHS} SELECT {_quantiles} FROM len")
def length_percentiles(spark, sf_dir):
    return profile.percentiles(lengths(spark, sf_dir), "n_events", POINTS)


@query("length_buckets", f"""{_LENGTHS}
SELECT CASE WHEN n_events <= 3 THEN '1-3' WHEN n_events <= 6 THEN '4-6' WHEN n_events <= 10 THEN '7-10'
  WHEN n_events <= 15 THEN '11-15' WHEN n_events <= 20 THEN '16-20' WHEN n_events <= 30 THEN '21-30'
  WHEN n_events <= 50 THEN '31-50' ELSE '51+' END AS bucket, count(*) AS n FROM len GROUP BY 1""")
def length_buckets(spark, sf_dir):
    return profile.length_buckets(lengths(spark, sf_dir))


@query("length_histogram", f"{_LENGTHS} SELECT least(n_events, 50) AS length, count(*) AS n FROM len GROUP BY 1")
def length_histogram(spark, sf_dir):
    return profile.length_histogram(lengths(spark, sf_dir), top=50)


@query("goals_by_length", f"""{_LENGTHS}, goals AS (
  SELECT DISTINCT match_id, possession, 1 AS goal FROM ev WHERE shot_outcome = 'Goal'
    AND shot_type IS DISTINCT FROM 'Penalty')
SELECT CASE WHEN n_events > 12 THEN '13+' ELSE CAST(n_events AS VARCHAR) END AS length,
  CAST(sum(coalesce(goal, 0)) AS BIGINT) AS num_goals, count(*) AS total_possessions
FROM len LEFT JOIN goals USING (match_id, possession) GROUP BY 1""")
def goals_by_length(spark, sf_dir):
    return profile.goals_by_length(profile.goal_left_join(ev.movement(all_events(spark, sf_dir))))


@query("possession_goal_left_join", f"""{_LENGTHS}, goals AS (
  SELECT DISTINCT match_id, possession, 1 AS goal FROM ev WHERE shot_outcome = 'Goal'
    AND shot_type IS DISTINCT FROM 'Penalty')
SELECT match_id, possession, n_events, CAST(coalesce(goal, 0) AS BIGINT) AS goal
FROM len LEFT JOIN goals USING (match_id, possession)""")
def possession_goal_left_join(spark, sf_dir):
    rows = profile.goal_left_join(ev.movement(all_events(spark, sf_dir)))
    return rows.select(*KEYS, "n_events", *big("goal"))


@query("possession_goal_rate", f"""{_OUTCOMES}
SELECT match_id, possession, n_events, CAST(goal AS BIGINT) AS goal FROM outcome""")
def possession_goal_rate(spark, sf_dir):
    rows = profile.possession_outcomes(all_events(spark, sf_dir))
    return rows.select(*KEYS, "n_events", *big("goal"))


_FUNNEL = f"""{_OUTCOMES}, f AS (SELECT count(*) AS p, CAST(sum(has_shot) AS BIGINT) AS s,
  CAST(sum(goal) AS BIGINT) AS g FROM outcome)"""


@query("possession_funnel", f"""{_FUNNEL}
SELECT p AS possessions, s AS with_shot, g AS with_goal, p - s AS no_shot, s - g AS shot_no_goal,
  {pct('s', 'p', 1)} AS shot_pct, {pct('g', 'p', 1)} AS goal_pct, {pct('p - s', 'p', 1)} AS no_shot_pct,
  {pct('g', 's', 1)} AS goal_of_shots_pct, {pct('s - g', 's', 1)} AS no_goal_of_shots_pct FROM f""")
def possession_funnel(spark, sf_dir):
    return profile.funnel(all_events(spark, sf_dir))


@query("funnel_cells", f"""{_FUNNEL}, c AS (
  SELECT greatest(CAST(round(g * 100.0::DOUBLE / p) AS BIGINT), 1) AS goal_cells,
    CAST(round((s - g) * 100.0::DOUBLE / p) AS BIGINT) AS shot_cells FROM f)
SELECT *, 100 - goal_cells - shot_cells AS other_cells FROM c""")
def funnel_cells(spark, sf_dir):
    return profile.funnel_cells(all_events(spark, sf_dir))


@query("no_shot_possessions", f"{_OUTCOMES} SELECT match_id, possession, n_events FROM outcome WHERE has_shot = 0")
def no_shot_possessions(spark, sf_dir):
    rows = profile.possession_outcomes(all_events(spark, sf_dir))
    return rows.where("has_shot = 0").select(*KEYS, "n_events")


@query("goal_count", f"{views.EV} SELECT count(*) AS goals FROM ev WHERE type = 'Shot' AND shot_outcome = 'Goal'")
def goal_count(spark, sf_dir):
    goals = all_events(spark, sf_dir).where("type = 'Shot' and shot_outcome = 'Goal'")
    return goals.agg(F.count("*").alias("goals"))


@query("distinct_possessions", f"{views.EV} SELECT DISTINCT match_id, possession FROM ev")
def distinct_possessions(spark, sf_dir):
    return all_events(spark, sf_dir).select(*KEYS).distinct()


@query("distinct_actors", f"{views.EV} SELECT DISTINCT player FROM ev WHERE team = 'H'")
def distinct_actors(spark, sf_dir):
    return all_events(spark, sf_dir).where("team = 'H'").select("player").distinct()


@query("top_event_types", f"""{views.EV}
SELECT type, count(*) AS n FROM ev GROUP BY type ORDER BY n DESC, type LIMIT 10""")
def top_event_types(spark, sf_dir):
    return profile.top_types(all_events(spark, sf_dir), 10)


@query("dataset_summary", f"""{views.EV}
SELECT count(*) AS events, count(DISTINCT match_id) AS matches,
  count(DISTINCT (match_id, possession)) AS possessions, count(DISTINCT type) AS event_types FROM ev""")
def dataset_summary(spark, sf_dir):
    return profile.dataset_summary(all_events(spark, sf_dir))


_PROFILED = ["type", "location", "pass_end_location", "carry_end_location", "shot_outcome", "player"]
_SQL_NAME = {"location": "x", "pass_end_location": "pass_x", "carry_end_location": "carry_x"}
_null_sql = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({_SQL_NAME.get(c, c)}) AS non_null,"
    f" count(*) - count({_SQL_NAME.get(c, c)}) AS nulls,"
    f" {pct(f'count(*) - count({_SQL_NAME.get(c, c)})', 'count(*)', 2)} AS null_pct FROM ev"
    for c in _PROFILED
)


@query("null_profile", f"{views.EV} {_null_sql}")
def null_profile(spark, sf_dir):
    return profile.null_profile(all_events(spark, sf_dir), _PROFILED)


_CHECKS = {"location": None, "pass_end_location": "Pass", "carry_end_location": "Carry", "shot_outcome": "Shot"}
_scoped_sql = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t or 'All'}' AS scope, count(*) AS total,"
    f" count(*) - count({_SQL_NAME.get(c, c)}) AS nulls,"
    f" {pct(f'count(*) - count({_SQL_NAME.get(c, c)})', 'count(*)', 4)} AS null_pct"
    f" FROM ev {f'WHERE type = {chr(39)}{t}{chr(39)}' if t else ''}"
    for c, t in _CHECKS.items()
)


@query("null_profile_by_type", f"{views.EV} {_scoped_sql}")
def null_profile_by_type(spark, sf_dir):
    return profile.null_profile_by_type(all_events(spark, sf_dir), _CHECKS)


@query("distance_stats", f"""{_DIST}
SELECT type, count(*) AS n, round(avg(distance), 6) AS mean, round(median(distance), 6) AS median,
  round(stddev_samp(distance), 6) AS stddev, round(max(distance), 6) AS max FROM dist GROUP BY type""")
def distance_stats(spark, sf_dir):
    rows = profile.distance_stats(ev.event_distances(all_events(spark, sf_dir)))
    return rows.select("type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "stddev", "max")])


# The longest distance shown of each type.
CLIPS = {"Pass": None, "Carry": 40.0}


@query("distance_histogram", f"""{_DIST}, mine AS (
  SELECT type, distance, CASE type WHEN 'Carry' THEN 40.0::DOUBLE ELSE 'Infinity'::DOUBLE END AS clip FROM dist
  WHERE type IN ('Pass', 'Carry')),
lim AS (SELECT type, count(*) AS total, min(distance) FILTER (distance <= clip) AS low,
    (max(distance) FILTER (distance <= clip) - min(distance) FILTER (distance <= clip)) / 80.0::DOUBLE AS step
  FROM mine GROUP BY type),
edges AS (SELECT type, range AS bin, low + range * step AS a,
    CASE WHEN range = 79 THEN 'Infinity'::DOUBLE ELSE low + (range + 1) * step END AS b FROM lim, range(80))
SELECT type, bin, count(*) AS n, round(count(*) * 100.0::DOUBLE / max(total), 6) AS pct
FROM mine JOIN lim USING (type) JOIN edges USING (type) WHERE distance <= clip AND distance >= a AND distance < b
GROUP BY type, bin""")
def distance_histogram(spark, sf_dir):
    rows = ev.event_distances(all_events(spark, sf_dir))
    out = profile.distance_histogram(rows, CLIPS)
    return out.withColumn("pct", F.round("pct", 6))


_thresholds_sql = " UNION ALL ".join(
    f"""SELECT {t}.0::DOUBLE AS threshold, count(*) FILTER (distance >= {t}) AS carries_remaining,
  {pct(f'count(*) FILTER (distance >= {t})', 'count(*)', 1)} AS pct_remaining,
  count(*) FILTER (distance < {t}) AS carries_removed,
  {pct(f'count(*) FILTER (distance < {t})', 'count(*)', 1)} AS pct_removed FROM dist WHERE type = 'Carry'"""
    for t in (1, 2, 3, 5, 8)
)


@query("carry_threshold_summary", f"{_DIST} {_thresholds_sql}")
def carry_threshold_summary(spark, sf_dir):
    return profile.carry_threshold_summary(ev.event_distances(all_events(spark, sf_dir)))


_SHARE = f"""{views.EV}, share AS (
  SELECT match_id, possession, count(*) AS total, count(*) FILTER (type = 'Carry') AS n_carries,
    count(*) FILTER (type = 'Pass') AS n_passes, count(*) FILTER (type = 'Shot') AS n_shots,
    {pct("count(*) FILTER (type = 'Carry')", "count(*)", 1)} AS carry_pct
  FROM ev WHERE type IN ('Pass', 'Carry', 'Shot')
    AND NOT (type = 'Shot' AND shot_type IS NOT DISTINCT FROM 'Penalty')
  GROUP BY match_id, possession)"""


@query("carry_share", f"{_SHARE} SELECT * FROM share")
def carry_share(spark, sf_dir):
    return profile.carry_share(ev.movement(all_events(spark, sf_dir)))


@query("carry_share_summary", f"""{_SHARE}
SELECT quantile_disc(carry_pct, 0.5) AS median_carry_pct, round(avg(carry_pct), 1) AS mean_carry_pct,
  round(avg(n_carries), 1) AS mean_carries, round(avg(n_passes), 1) AS mean_passes,
  round(avg(total), 1) AS mean_total FROM share""")
def carry_share_summary(spark, sf_dir):
    return profile.carry_share_summary(ev.movement(all_events(spark, sf_dir)))


_CATS = ["type", "team", "shot_outcome", "shot_type"]
_cat_sql = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {c} AS value, count(*) AS n,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM ev), 2) AS pct FROM ev GROUP BY {c}"""
    for c in _CATS
)


@query("categorical_distribution", f"{views.EV} {_cat_sql}")
def categorical_distribution(spark, sf_dir):
    return profile.categorical_distribution(all_events(spark, sf_dir), _CATS)


_cat_docs_sql = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {c} AS value, count(*) AS n,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 2) AS pct FROM documents GROUP BY {c}"""
    for c in ("lang", "source")
)


@query("categorical_distribution_documents", _cat_docs_sql)
def categorical_distribution_documents(spark, sf_dir):
    docs = standin.table(spark, sf_dir, "documents")
    return profile.categorical_distribution(docs, ["lang", "source"])
