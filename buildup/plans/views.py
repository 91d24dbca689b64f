"""SQL views shared by the checks: the same tables the Spark jobs start from."""

from __future__ import annotations


def _tenths(expression: str, modulus: int) -> str:
    return f"(({expression}) % {modulus}) / 10.0::DOUBLE"


_X = _tenths("v * 7 + index * 13", 1201)
_Y = _tenths("v * 11 + index * 17", 801)

# all events of the stand-in event table, with scalar coordinates
EV = f"""WITH raw AS (
  SELECT event_id AS index, user_id AS match_id, epoch_us(ts) AS us, event_type,
         CAST(round(value * 100) AS BIGINT) AS v,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
marked AS (
  SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY match_id ORDER BY index) <= 86400000000
            THEN 0 ELSE 1 END AS cut FROM raw),
numbered AS (
  SELECT *, CAST(sum(cut) OVER (PARTITION BY match_id ORDER BY index
                                ROWS UNBOUNDED PRECEDING) AS BIGINT) AS possession FROM marked),
typed AS (
  SELECT *, CASE WHEN event_type IN ('click', 'signup') THEN 'Pass'
                 WHEN event_type = 'view' THEN 'Carry'
                 WHEN event_type = 'purchase' THEN 'Shot' ELSE 'Pressure' END AS type,
         CASE WHEN possession % 2 = 0 THEN 'H' ELSE 'A' END AS possession_team,
         CASE WHEN possession % 2 = 0 THEN 'A' ELSE 'H' END AS other,
         {_X} AS x0, {_Y} AS y0
  FROM numbered),
ev AS (
  SELECT match_id, possession, index, type,
         CASE WHEN k % 10 = 0 THEN other ELSE possession_team END AS team, possession_team,
         CASE WHEN type = 'Pressure' AND k < 5 THEN NULL ELSE x0 END AS x,
         CASE WHEN type = 'Pressure' AND k < 5 THEN NULL ELSE y0 END AS y,
         CASE WHEN type = 'Pass' THEN {_tenths('v * 3 + index * 29', 1201)} END AS pass_x,
         CASE WHEN type = 'Pass' THEN {_tenths('v * 5 + index * 31', 801)} END AS pass_y,
         CASE WHEN type = 'Carry' THEN least(greatest(x0 + ((k % 25) - 8) / 2.0::DOUBLE, 0), 120) END AS carry_x,
         CASE WHEN type = 'Carry' THEN least(greatest(y0 + ((k % 13) - 6) / 2.0::DOUBLE, 0), 80) END AS carry_y,
         CASE WHEN type = 'Shot' THEN CASE WHEN k < 10 THEN 'Goal' ELSE 'Saved' END END AS shot_outcome,
         CASE WHEN type = 'Shot' THEN CASE WHEN k % 20 = 19 THEN 'Penalty' ELSE 'Open Play' END END AS shot_type,
         concat('P', k % 11) AS player,
         (us // 60000000) % 60 AS minute, (us // 1000000) % 60 AS second
  FROM typed)"""

_FLIP = "team <> possession_team"


def _turn(column: str, size: int) -> str:
    return f"CASE WHEN {_FLIP} THEN round({size} - {column}, 1) ELSE {column} END"


# movement events without penalties, with carry distance, oriented, one end point
MV = f"""{EV},
kept AS (
  SELECT *, CASE WHEN type = 'Carry' THEN
              sqrt((carry_x - x) * (carry_x - x) + (carry_y - y) * (carry_y - y)) END AS carry_dist
  FROM ev WHERE type IN ('Pass', 'Carry', 'Shot')
    AND NOT (type = 'Shot' AND shot_type IS NOT DISTINCT FROM 'Penalty')),
turned AS (
  SELECT * REPLACE ({_turn('x', 120)} AS x, {_turn('y', 80)} AS y,
    {_turn('pass_x', 120)} AS pass_x, {_turn('pass_y', 80)} AS pass_y,
    {_turn('carry_x', 120)} AS carry_x, {_turn('carry_y', 80)} AS carry_y)
  FROM kept),
mv AS (
  SELECT match_id, possession, index, type, team, possession_team, player, x, y,
         CASE type WHEN 'Pass' THEN pass_x WHEN 'Carry' THEN carry_x END AS end_x,
         CASE type WHEN 'Pass' THEN pass_y WHEN 'Carry' THEN carry_y END AS end_y,
         carry_dist, shot_outcome
  FROM turned)"""


def truncated(n: int = 14, source: str = "mv", name: str = "trunc") -> str:
    """CTE with the last ``n`` events of each possession of ``source``."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY match_id, possession ORDER BY index DESC) AS event_rank
    FROM {source}) t WHERE event_rank <= {n})"""


# possession table of the truncated events
POSS = """poss AS (
  SELECT match_id, possession, CAST(count(*) + 1 AS BIGINT) AS sequence_length,
         CAST(sum(CASE WHEN shot_outcome = 'Goal' THEN 1 ELSE 0 END) AS BIGINT) AS goal
  FROM trunc GROUP BY match_id, possession)"""

# one row per sequence element, 0-based position, terminal last
TOKENS = """tok AS (
  SELECT t.match_id, t.possession, p.sequence_length - 1 - event_rank AS pos, type, x, y, end_x, end_y,
         CASE WHEN shot_outcome = 'Goal' THEN 1 ELSE 0 END AS is_goal
  FROM trunc t JOIN poss p USING (match_id, possession)
  UNION ALL
  SELECT match_id, possession, sequence_length - 1,
         CASE WHEN goal = 1 THEN 'GOAL' ELSE 'NO_GOAL' END, NULL, NULL, NULL, NULL, goal
  FROM poss)"""

SEQ = f"{MV}, {truncated()}, {POSS}, {TOKENS}"

# normalised tokens
NORM = f"""{SEQ},
norm AS (
  SELECT match_id, possession, pos, type, round(x / 120.0, 5) AS x, round(y / 80.0, 5) AS y,
         round(end_x / 120.0, 5) AS end_x, round(end_y / 80.0, 5) AS end_y
  FROM tok)"""


def digits(part: int) -> str:
    """Integer from 8 hex digits of the possession key's md5; ``part`` counts from 0."""
    return f"('0x' || substr(md5(concat(match_id, '-', possession, '-42')), {1 + 8 * part}, 8))::BIGINT"


SPLIT_OF = f"""CASE WHEN {digits(0)} % 100 < 80 THEN 'train'
  WHEN {digits(0)} % 100 < 90 THEN 'val' ELSE 'test' END"""


def cell(x: str, y: str, bins_x: int = 12, bins_y: int = 12) -> str:
    gx = f"least(greatest(CAST(floor({x} * {bins_x} / 120.0::DOUBLE) AS BIGINT), 0), {bins_x - 1})"
    gy = f"least(greatest(CAST(floor({y} * {bins_y} / 80.0::DOUBLE) AS BIGINT), 0), {bins_y - 1})"
    return f"({gy} * {bins_x} + {gx})"


# scored table
SCORED = """WITH scored AS (
  SELECT event_id, user_id, event_type, (floor(value) % 100) / 100.0::DOUBLE AS score,
         CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label
  FROM events)"""

# shot table
SHOTS = """WITH shots AS (
  SELECT o_orderkey AS shot_id, o_custkey AS player_id,
         90 + ((o_orderkey * 7) % 301) / 10.0::DOUBLE AS x,
         ((o_orderkey * 11) % 801) / 10.0::DOUBLE AS y,
         CASE WHEN o_orderkey % 29 = 0 THEN 'Other'
              WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Right Foot'
              WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'Left Foot'
              WHEN o_orderpriority = '5-LOW' THEN 'Head' END AS shot_body_part
  FROM orders)"""
