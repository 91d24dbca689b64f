"""Column functions on event types and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token ids that stored sequences use.
VOCAB = {"Pass": 0, "Shot": 1, "GOAL": 2, "NO_GOAL": 3, "<pad>": 4, "Carry": 5}
PASS_ONLY_VOCAB = {"Pass": 0, "Shot": 1, "GOAL": 2, "NO_GOAL": 3, "<pad>": 4}
IGNORED_TARGET = -100
MOVEMENT_TYPES = ["Pass", "Carry", "Shot"]
PASS_ONLY_TYPES = ["Pass", "Shot"]
TERMINALS = ["GOAL", "NO_GOAL"]

# Upper length of each bucket and its label.
LENGTH_BUCKETS = [
    (3, "1-3"), (6, "4-6"), (10, "7-10"), (15, "11-15"), (20, "16-20"), (30, "21-30"), (50, "31-50"),
]
LAST_LENGTH_BUCKET = "51+"


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in entries.items() for part in pair])


def type_id(event_type: Column, vocab: dict[str, int] = VOCAB) -> Column:
    """Token id; an unknown type is an error."""
    known = F.try_element_at(literal_map(vocab), event_type)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown type "), event_type)).cast("int"))


def type_name(token_id: Column, vocab: dict[str, int] = VOCAB) -> Column:
    return F.try_element_at(literal_map({v: k for k, v in vocab.items()}), token_id)


def goal_flag(shot_outcome: Column) -> Column:
    return F.when(shot_outcome == "Goal", 1).otherwise(0)


def terminal(goal: Column, strict: bool = True) -> Column:
    """Terminal token; ``strict`` keeps the rule that only a goal sum of exactly 1 is a goal."""
    scored = goal == 1 if strict else goal >= 1
    return F.when(scored, "GOAL").otherwise("NO_GOAL")


def length_bucket(length: Column) -> Column:
    out = F
    for top, label in LENGTH_BUCKETS:
        out = out.when(length <= top, label)
    return out.otherwise(LAST_LENGTH_BUCKET)


def capped_length(length: Column, cap: int = 12) -> Column:
    return F.when(length > cap, f"{cap + 1}+").otherwise(length.cast("string"))


def season_label(season: Column) -> Column:
    return F.replace(season, F.lit("/"), F.lit("_"))


def signed_text(value: Column) -> Column:
    """Three decimals, with a plus sign on positive values and no sign on zero."""
    return (
        F.when(value > 0, F.format_string("+%.3f", value))
        .when(value == 0, "0.000")
        .otherwise(F.format_string("%.3f", value))
    )


def share(part: Column, total: Column, digits: int) -> Column:
    """Percentage of ``total``, rounded; null on an empty total."""
    return F.round(F.try_divide(part * F.lit(100.0), total), digits)
