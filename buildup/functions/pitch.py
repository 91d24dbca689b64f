"""Column functions on pitch coordinates. The pitch is 120 x 80 units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH = 120
WIDTH = 80
GOAL_X, GOAL_Y = 120, 40
LEFT_POST_Y, RIGHT_POST_Y = 36, 44


def coordinate(location: str, axis: int) -> Column:
    """Element ``axis`` of the location column if it has at least two elements, else null."""
    return F.expr(f"if(size({location}) >= 2, cast(get({location}, {axis}) as double), null)")


def flipped(value: str, size: int, flip: str, digits: int | None = 1) -> Column:
    """``size - value`` where ``flip`` holds; null values and a null ``flip`` change nothing."""
    turned = f"{size} - {value}" if digits is None else f"round({size} - {value}, {digits})"
    return F.expr(f"if({flip}, {turned}, {value})")


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def normalized(value: Column, size: int, digits: int | None = 5) -> Column:
    scaled = value / F.lit(float(size))
    return scaled if digits is None else F.round(scaled, digits)


def grid_index(value: Column, size: int, bins: int) -> Column:
    """Index of the equal-width step that holds ``value``, clipped to the grid."""
    step = F.floor(value * F.lit(bins) / F.lit(float(size))).cast("int")
    return F.least(F.greatest(step, F.lit(0)), F.lit(bins - 1))


def cell(x: Column, y: Column, bins_x: int, bins_y: int) -> Column:
    """Row-major number of the grid cell, null when a coordinate is null."""
    number = grid_index(y, WIDTH, bins_y) * bins_x + grid_index(x, LENGTH, bins_x)
    return F.when(x.isNotNull() & y.isNotNull(), number)


def shot_distance(x: Column, y: Column) -> Column:
    across = F.abs(F.lit(GOAL_Y) - y)
    return F.sqrt((F.lit(GOAL_X) - x) * (F.lit(GOAL_X) - x) + across * across)


def shot_angle(x: Column, y: Column) -> Column:
    """Angle in degrees under which the goal is seen; null on a post."""
    dx = F.lit(GOAL_X) - x
    left, right = F.lit(LEFT_POST_Y) - y, F.lit(RIGHT_POST_Y) - y
    cosine = F.try_divide(
        dx * dx + left * right, F.sqrt(dx * dx + left * left) * F.sqrt(dx * dx + right * right)
    )
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))  # both skip a null
    return F.when(cosine.isNotNull(), F.degrees(F.acos(bounded)))
