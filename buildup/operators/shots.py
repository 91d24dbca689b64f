"""Shot features: location text, geometry, foot, freeze frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildup.functions import pitch
from buildup.sources.schemas import FREEZE_FRAME

FEET = ["Right Foot", "Left Foot"]
REFINED = ["better_foot", "worse_foot", "head"]
KEEPER = "Goalkeeper"


def to_binary(df: DataFrame, column: str, positive: str) -> DataFrame:
    """Replace a column by 1 where it equals ``positive``, else 0; null counts as 0."""
    return df.withColumn(column, F.when(F.col(column).eqNullSafe(positive), 1).otherwise(0))


def parse_location(df: DataFrame, column: str = "location") -> DataFrame:
    """``x``, ``y`` from a text with exactly two unsigned numbers, and the distance to the end line."""
    found = df.withColumn("_numbers", F.regexp_extract_all(column, F.lit(r"\d*\.\d+|\d+"), F.lit(0)))
    at = lambda i: F.expr(f"if(size(_numbers) = 2, cast(get(_numbers, {i}) as double), null)")
    return found.withColumns({"x": at(0), "y": at(1)}).drop("_numbers").withColumn(
        "distance_to_end_line", F.lit(pitch.LENGTH) - F.col("x")
    )


def with_geometry(df: DataFrame) -> DataFrame:
    """Distance to the goal centre and the angle between the posts in degrees."""
    x, y = F.col("x"), F.col("y")
    return df.withColumns({"distance": pitch.shot_distance(x, y), "angle": pitch.shot_angle(x, y)})


def foot_dominance(shots: DataFrame) -> DataFrame:
    """Stronger foot per player; an even share counts as left."""
    feet = shots.where(F.col("shot_body_part").isin(*FEET))
    right = F.when(F.col("shot_body_part") == "Right Foot", 1.0).otherwise(0.0)
    shares = feet.groupBy("player_id").agg(F.avg(right).alias("right_share"))
    kind = F.when(F.col("right_share") <= 0.5, "dominant_left").otherwise("dominant_right")
    return shares.withColumn("foot_type", kind)


def refine_body_part(shots: DataFrame) -> DataFrame:
    """Better foot, worse foot or head; other body parts leave."""
    joined = shots.join(foot_dominance(shots).select("player_id", "foot_type"), "player_id", "left")
    part = F.col("shot_body_part")
    strong = F.when(F.col("foot_type") == "dominant_right", "Right Foot").when(
        F.col("foot_type") == "dominant_left", "Left Foot"
    )
    refined = (
        F.when(part == "Head", "head")
        .when(part.isin(*FEET) & (part == strong), "better_foot")
        .when(part.isin(*FEET) & strong.isNotNull(), "worse_foot")
        .otherwise(part)
    )
    return joined.withColumn("refined_body_part", refined).where(
        F.col("refined_body_part").isin(*REFINED)
    )


# Python literals and their JSON forms.
_LITERALS = (("True", "true"), ("False", "false"), ("None", "null"))


def parse_frame(text: Column) -> Column:
    """Freeze frame from JSON or Python-literal text; null when the text is no list of players.

    The usual spelling ``key: True`` is rewritten by plain replacement; only a
    text that still fails goes through the patterns that allow any spacing.
    """
    usual, spaced = text, text
    for word, plain in _LITERALS:
        usual = F.replace(usual, F.lit(f": {word}"), F.lit(f": {plain}"))
        spaced = F.regexp_replace(spaced, rf"([:,\[]\s*){word}\b", f"$1{plain}")
    read = lambda t: F.from_json(t, FREEZE_FRAME, {"mode": "PERMISSIVE"})
    return F.coalesce(read(usual), read(spaced))


def _left_of(x: Column, y: Column, post_y: int, px: Column, py: Column) -> Column:
    ahead = F.lit(pitch.GOAL_X) - x
    return ahead * (py - y) - (F.lit(post_y) - y) * (px - x) > 0


def in_shot_path(x: Column, y: Column, px: Column, py: Column) -> Column:
    """Player between the lines from the shooter to the posts, and ahead of the shooter."""
    sides = _left_of(x, y, pitch.LEFT_POST_Y, px, py) != _left_of(x, y, pitch.RIGHT_POST_Y, px, py)
    return sides & (px > x)


def path_from_frames(shots: DataFrame, frame: str = "shot_freeze_frame") -> DataFrame:
    """Opponents and keeper in the shot triangle from an array column; null frames give nulls."""

    def blocks(keeper: bool):
        def test(p):
            name = F.coalesce(p["position"]["name"], F.lit(""))
            inside = in_shot_path(
                F.col("x"), F.col("y"), F.get(p["location"], F.lit(0)), F.get(p["location"], F.lit(1))
            )
            opponent = ~F.coalesce(p["teammate"], F.lit(True)) & p["location"].isNotNull()
            return opponent & inside & ((name == KEEPER) if keeper else (name != KEEPER))

        return test

    known = F.col(frame).isNotNull()
    return shots.withColumns(
        {
            "defenders_in_path": F.when(known, F.size(F.filter(frame, blocks(False)))),
            "goalkeeper_in_path": F.when(known, F.exists(frame, blocks(True)).cast("int")),
        }
    )


def path_from_rows(shots: DataFrame, frame_rows: DataFrame) -> DataFrame:
    """The same counts from one row per player; shots without rows get nulls.

    Nothing is collected per shot: a player row joins its shooter, is tested
    and summed before the shuffle. AQE splits the join when one shot has very
    many rows.
    """
    opponent = ~F.coalesce("teammate", F.lit(True)) & F.col("location").isNotNull()
    inside = in_shot_path(
        F.col("x"), F.col("y"), F.get("location", F.lit(0)), F.get("location", F.lit(1))
    )
    keeper = F.coalesce(F.col("position_name") == KEEPER, F.lit(False))
    counts = (
        frame_rows.join(shots.select("shot_id", "x", "y"), "shot_id")
        .groupBy("shot_id")
        .agg(
            F.count_if(opponent & inside & ~keeper).alias("defenders_in_path"),
            F.max(F.when(opponent & inside & keeper, 1).otherwise(0)).alias("goalkeeper_in_path"),
        )
    )
    return shots.join(counts, "shot_id", "left")
