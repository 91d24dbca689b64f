"""From raw events to oriented movement events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildup.functions import pitch
from buildup.functions.labels import MOVEMENT_TYPES

MODES = ("threshold", "adaptive", "nofilter")
LOCATIONS = {
    "location": "",
    "pass_end_location": "pass_",
    "carry_end_location": "carry_",
    "shot_end_location": "shot_",
}


def check_mode(mode: str, threshold: float | None) -> None:
    """A threshold run needs a positive threshold; other modes take none."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "threshold" and (threshold is None or threshold <= 0):
        raise ValueError("threshold mode needs a threshold above 0")


def not_penalty() -> Column:
    return ~((F.col("type") == "Shot") & F.col("shot_type").eqNullSafe("Penalty"))


def movement(
    events: DataFrame, types: Sequence[str] = tuple(MOVEMENT_TYPES), penalties: bool = False
) -> DataFrame:
    """Events of the given types, without penalty shots unless ``penalties``."""
    out = events.where(F.col("type").isin(*types))
    return out if penalties else out.where(not_penalty())


def with_coordinates(events: DataFrame) -> DataFrame:
    """Replace the location arrays by scalar columns."""
    found = {column: prefix for column, prefix in LOCATIONS.items() if column in events.columns}
    scalars = {
        f"{prefix}{axis}": pitch.coordinate(column, i)
        for column, prefix in found.items()
        for i, axis in enumerate(("x", "y"))
    }
    return events.withColumns(scalars).drop(*found)


def with_carry_distance(events: DataFrame) -> DataFrame:
    """``carry_dist`` of carries, null for other types."""
    moved = "sqrt((carry_x - x) * (carry_x - x) + (carry_y - y) * (carry_y - y))"
    return events.withColumn("carry_dist", F.expr(f"if(type = 'Carry', {moved}, null)"))


def carry_filter(events: DataFrame, threshold: float) -> DataFrame:
    """Drop carries shorter than ``threshold``; a carry without a distance is dropped too."""
    return events.where((F.col("type") != "Carry") | (F.col("carry_dist") >= threshold))


def orient(events: DataFrame, digits: int | None = 1) -> DataFrame:
    """Turn coordinates of the team out of possession to the attacking direction."""
    turned = {
        f"{prefix}{axis}": pitch.flipped(f"{prefix}{axis}", size, "team != possession_team", digits)
        for prefix in LOCATIONS.values()
        for axis, size in (("x", pitch.LENGTH), ("y", pitch.WIDTH))
    }
    return events.withColumns({name: c for name, c in turned.items() if name in events.columns})


def unify_end(events: DataFrame, include_shots: bool = False) -> DataFrame:
    """``end_x``/``end_y`` from the end column that belongs to the event's type."""
    shot = "when 'Shot' then shot_{axis}" if include_shots else ""
    case = "case type when 'Pass' then pass_{axis} when 'Carry' then carry_{axis} " + shot + " end"
    return events.withColumns({f"end_{axis}": F.expr(case.format(axis=axis)) for axis in ("x", "y")})


def movement_events(
    events: DataFrame,
    mode: str = "nofilter",
    threshold: float | None = None,
    types: Sequence[str] = tuple(MOVEMENT_TYPES),
) -> DataFrame:
    """Filtered, oriented events with one end point: the input of the sequence jobs."""
    check_mode(mode, threshold)
    rows = with_carry_distance(with_coordinates(movement(events, types)))
    if mode == "threshold":
        rows = carry_filter(rows, threshold)
    return unify_end(orient(rows)).select(
        "match_id", "possession", "index", "type", "team", "possession_team", "player",
        "x", "y", "end_x", "end_y", "carry_dist", "shot_outcome",
    )


def goal_possession_events(events: DataFrame) -> DataFrame:
    """All events of possessions that hold a goal; a possession with two goals comes once."""
    keys = ["match_id", "possession"]
    goals = events.where((F.col("type") == "Shot") & (F.col("shot_outcome") == "Goal"))
    return events.join(goals.select(*keys).distinct(), keys, "left_semi")


def event_distances(events: DataFrame) -> DataFrame:
    """Length of passes and carries in pitch units, from one scan."""
    rows = unify_end(with_coordinates(events.where(F.col("type").isin("Pass", "Carry"))))
    moved = pitch.distance(F.col("x"), F.col("y"), F.col("end_x"), F.col("end_y"))
    return rows.where("end_x is not null and end_y is not null").withColumn("distance", moved)


def possession_events(events: DataFrame, match_id: int, possession: int) -> DataFrame:
    wanted = (F.col("match_id") == match_id) & (F.col("possession") == possession)
    return events.where(wanted).orderBy("index")
