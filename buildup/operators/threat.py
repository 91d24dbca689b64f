"""Zone threat: the chance that a possession reaches a goal from a pitch zone.

The published zone Markov model: in a zone the player shoots or moves the
ball; a shot scores with the zone's rate, a move that is followed by another
event leads to the value of its end zone, and anything else loses the ball.
The state is bounded by the grid, so the tables are reduced to one row per
zone first. On a coarse grid the fixed number of iterations runs on one array;
``sparse_threat`` is for fine grids and for values that have settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildup.functions import pitch
from buildup.session import stage

KEYS = ["match_id", "possession"]
BINS_X, BINS_Y = 12, 12
ITERATIONS = 5
MOST_BROADCAST = 1_000_000  # zones, of 16 bytes
STEPS_STAGED = 4


def with_zones(moves: DataFrame, bins_x: int = BINS_X, bins_y: int = BINS_Y) -> DataFrame:
    """Zone of the start and of the end of every event; null where a point is missing."""
    return moves.withColumns(
        {
            "zone": pitch.cell(F.col("x"), F.col("y"), bins_x, bins_y),
            "end_zone": pitch.cell(F.col("end_x"), F.col("end_y"), bins_x, bins_y),
        }
    )


def zone_counts(zoned: DataFrame) -> DataFrame:
    """Events, shots and goals per zone."""
    shot = F.col("type") == "Shot"
    return (
        zoned.where("zone is not null")
        .groupBy("zone")
        .agg(
            F.count("*").alias("events"),
            F.count_if(shot).alias("shots"),
            F.count_if(shot & (F.col("shot_outcome") == "Goal")).alias("goals"),
        )
    )


def _last_events(zoned: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("type", "zone", "end_zone"), "index").alias("e")
    return zoned.groupBy(*KEYS).agg(last).select("e.*")


def zone_moves(zoned: DataFrame) -> DataFrame:
    """Passes and carries from zone to zone that are followed by another event.

    Counted as all moves minus the moves that end a possession: two small
    aggregations instead of ordering every possession.
    """
    is_move = F.col("type").isin("Pass", "Carry") & F.col("zone").isNotNull() & F.col("end_zone").isNotNull()
    pairs = ["zone", "end_zone"]
    every = zoned.where(is_move).groupBy(*pairs).agg(F.count("*").alias("n"))
    ending = _last_events(zoned).where(is_move).groupBy(*pairs).agg((-F.count("*")).alias("n"))
    return every.unionByName(ending).groupBy(*pairs).agg(F.sum("n").alias("n"))


def zone_model(zoned: DataFrame, bins_x: int = BINS_X, bins_y: int = BINS_Y) -> DataFrame:
    """One row per zone of the grid: direct goal chance and move chances."""
    zones = bins_x * bins_y
    moves = zone_moves(zoned).groupBy("zone").agg(
        F.collect_list(F.struct(F.col("end_zone").alias("to"), "n")).alias("moves")
    )
    grid = zoned.sparkSession.range(zones).select(F.col("id").cast("int").alias("zone"))
    joined = grid.join(zone_counts(zoned), "zone", "left").join(moves, "zone", "left")
    direct = F.try_divide(F.col("goals"), F.col("events"))
    chances = F.expr("transform(moves, m -> struct(m.to as to, m.n / events as p))")
    return joined.select(
        "zone",
        F.coalesce("events", F.lit(0)).alias("events"),
        F.coalesce(direct, F.lit(0.0)).alias("direct"),
        F.coalesce(chances, F.expr("cast(array() as array<struct<to:int,p:double>>)")).alias("moves"),
    )


def threat_array(model: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """One row with ``threat``: the value of every zone, in zone order."""
    rows = model.agg(F.sort_array(F.collect_list(F.struct("zone", "direct", "moves"))).alias("zones"))
    step = (
        "transform(zones, z -> z.direct + aggregate(z.moves, 0D, (s, m) -> s + m.p * get(v, m.to)))"
    )
    threat = f"aggregate(sequence(1, {iterations}), transform(zones, z -> 0D), (v, i) -> {step})"
    return rows.select(F.expr(threat).alias("threat"))


def zone_threat(
    moves: DataFrame, iterations: int = ITERATIONS, bins_x: int = BINS_X, bins_y: int = BINS_Y
) -> DataFrame:
    """Value per zone."""
    model = zone_model(with_zones(moves, bins_x, bins_y), bins_x, bins_y)
    return threat_array(model, iterations).select(F.posexplode("threat").alias("zone", "threat"))


def fit(moves: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """The fitted model: one staged row, for any number of uses."""
    return stage(threat_array(zone_model(with_zones(moves)), iterations), "threat")


def with_threat(rows: DataFrame, model: DataFrame, zone: Column, name: str = "score") -> DataFrame:
    """Add the model's value of ``zone`` to every row; null without a zone. The model has a row for each zone of a grid."""
    values = model.select(F.posexplode("threat").alias("_zone", name))
    return rows.join(F.broadcast(values), zone == F.col("_zone"), "left").drop("_zone")


def sparse_model(zoned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged ``(zone, direct)`` of the zones with events, and ``(zone, end_zone, p)`` of the moves between them."""
    counts = stage(zone_counts(zoned), "zone-counts")
    direct = counts.select("zone", (F.col("goals") / F.col("events")).alias("direct"))
    moves = zone_moves(zoned).join(counts.select("zone", "events"), "zone")
    moves = moves.where("n > 0").select("zone", "end_zone", (F.col("n") / F.col("events")).alias("p"))
    return direct, stage(moves, "zone-moves")


def _advance(values: DataFrame, direct: DataFrame, moves: DataFrame, few: bool) -> DataFrame:
    """One step: ``direct`` plus the moves' chances times the values of their ends, with the change of each value."""
    ends = values.select(F.col("zone").alias("end_zone"), "threat")
    met = moves.join(F.broadcast(ends) if few else ends, "end_zone")
    zero = F.lit(0.0)
    parts = met.select("zone", (F.col("p") * F.col("threat")).alias("new"), zero.alias("old"))
    parts = parts.unionByName(direct.select("zone", F.col("direct").alias("new"), zero.alias("old")))
    parts = parts.unionByName(values.select("zone", zero.alias("new"), F.col("threat").alias("old")))
    sums = parts.groupBy("zone").agg(F.sum("new").alias("threat"), F.sum("old").alias("old"))
    return sums.select("zone", "threat", F.abs(F.col("threat") - F.col("old")).alias("change"))


def sparse_threat(
    moves: DataFrame,
    bins_x: int,
    bins_y: int,
    iterations: int | None = None,
    tolerance: float = 1e-10,
    max_iterations: int = 10_000,
) -> DataFrame:
    """``(zone, threat)`` of the zones with events on a grid of any size.

    The moves are a sparse matrix: a step is a join with the values and an aggregation, and the result of every few is
    staged. Runs ``iterations`` steps, or until no value changes by more than ``tolerance`` in one; fails if that
    takes ``max_iterations``. The values are broadcast if the grid has few zones.
    """
    zoned = stage(with_zones(moves, bins_x, bins_y).select(*KEYS, "index", "type", "shot_outcome", "zone", "end_zone"), "zoned")
    direct, pairs = sparse_model(zoned)
    few = bins_x * bins_y <= MOST_BROADCAST
    values, done = direct.select("zone", F.col("direct").alias("threat")), 1
    last = iterations or max_iterations
    while done < last:
        for _ in range(min(STEPS_STAGED, last - done)):
            values, done = _advance(values.select("zone", "threat"), direct, pairs, few), done + 1
        values = stage(values, "threat")
        if iterations is None and (values.agg(F.max("change")).first()[0] or 0.0) <= tolerance:
            break
    else:
        if iterations is None:
            raise RuntimeError(f"the threat did not settle in {max_iterations} steps")
    return values.select("zone", "threat")


def continue_rates(moves: DataFrame) -> DataFrame:
    """Share of the events of each type that are followed by another event."""
    every = moves.groupBy("type").agg(F.count("*").alias("n"), F.lit(0).cast("bigint").alias("ended"))
    last = (
        moves.groupBy(*KEYS).agg(F.max_by("type", "index").alias("type")).groupBy("type").agg(
            F.lit(0).cast("bigint").alias("n"), F.count("*").alias("ended")
        )
    )
    sums = every.unionByName(last).groupBy("type").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended"))
    return sums.select("type", "n", (F.lit(1.0) - F.col("ended") / F.col("n")).alias("keep"))


def type_transitions(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """P(next type | type), or per further columns ``by``; from causal pairs."""
    keys = [*(by or []), "input_type"]
    counts = pairs.groupBy(*keys, "target_type").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals) if not by else totals, keys).withColumn(
        "p", F.col("n") / F.col("total")
    )
