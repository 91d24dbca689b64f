"""Queries on files that are skipped and on stored summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildup import session
from buildup.operators import events as ev
from buildup.operators import profile, sketches
from buildup.plans import views
from buildup.plans.movement import KEYS, all_events
from buildup.plans.registry import query
from buildup.session import stage
from buildup.sources import readers, sinks

POINTS = [0.05, 0.25, 0.5, 0.75, 0.95]
ERROR = 0.01


def lookup_table(spark, sf_dir, group_bytes: int = 1 << 16) -> str:
    path = session.new_table_path(spark, "lookup")
    sinks.write_for_lookup(all_events(spark, sf_dir), path, KEYS, "index", group_bytes)
    return path


@query("possession_lookup_skipping", f"""{views.EV}
SELECT match_id, possession, index, type, player, x, y FROM ev WHERE match_id = 8 AND possession = 1""")
def possession_lookup_skipping(spark, sf_dir):
    """One possession from a sorted table: other row groups are not read."""
    rows = ev.possession_events(readers.read_events(spark, lookup_table(spark, sf_dir)), 8, 1)
    return ev.with_coordinates(rows).select(*KEYS, "index", "type", "player", "x", "y")


def match_sets(spark, sf_dir):
    """Every match in the set of all and in one of three."""
    matches = all_events(spark, sf_dir).select("match_id").distinct()
    third = F.concat(F.lit("third "), (F.col("match_id") % 3).cast("string"))
    return matches.select("match_id", F.explode(F.array(F.lit("all"), third)).alias("name"))


@query("sketch_distincts", f"""{views.EV}, named AS (
  SELECT *, unnest(['all', 'third ' || match_id % 3]) AS name FROM ev)
SELECT name, count(DISTINCT player) AS players, count(DISTINCT type) AS types, count(DISTINCT (match_id, possession)) AS possessions
FROM named GROUP BY name""")
def sketch_distincts(spark, sf_dir):
    """Distinct counts of sets of matches, from bitmaps stored per match."""
    events, sets = all_events(spark, sf_dir), match_sets(spark, sf_dir)
    out = None
    for name, column in (("players", "player"), ("types", "type")):
        coded = events.select("match_id", column).join(sketches.codes(events, column), column)
        stored = stage(sketches.bitmaps(coded, F.col("code")), "bitmaps")
        found = sketches.distinct_codes(stored, sets, ["name"]).withColumnRenamed("n", name)
        out = found if out is None else out.join(found, "name")
    # a possession belongs to one match, so the matches' own numbers add up
    stored = stage(sketches.bitmaps(events, F.col("possession")), "bitmaps")
    each = sketches.distinct_codes(stored, sets, ["name", "match_id"])
    return out.join(each.groupBy("name").agg(F.sum("n").alias("possessions")), "name")


@query("sketch_percentiles", f"""{views.EV}, len AS (
  SELECT match_id, possession FROM ev WHERE type IN ('Pass', 'Carry', 'Shot')
    AND NOT (type = 'Shot' AND shot_type IS NOT DISTINCT FROM 'Penalty') GROUP BY match_id, possession),
named AS (SELECT unnest(['all', 'third ' || match_id % 3]) AS name FROM len)
SELECT name, point::DOUBLE AS point, n, true AS within FROM (SELECT name, count(*) AS n FROM named GROUP BY name) s,
  (SELECT unnest({POINTS}) AS point) p""")
def sketch_percentiles(spark, sf_dir):
    """Length percentiles of sets of matches from stored sketches, checked against the exact ranks."""
    lengths = stage(profile.possession_lengths(ev.movement(all_events(spark, sf_dir))), "lengths")
    sets = match_sets(spark, sf_dir)
    found = sketches.merged_quantiles(stage(sketches.length_sketches(lengths), "sketches"), sets, ["name"], POINTS)
    counts = lengths.join(sets, "match_id").groupBy("name", "n_events").agg(F.count("*").alias("c"))
    # the ranks that the length takes up in its set
    own = found.join(counts, "name").groupBy("name", "point", "length", "n").agg(
        F.sum(F.when(F.col("n_events") < F.col("length"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("n_events") <= F.col("length"), F.col("c")).otherwise(0)).alias("upto"),
    )
    low, high = F.col("below") / F.col("n"), F.col("upto") / F.col("n")
    near = (low - ERROR <= F.col("point")) & (F.col("point") <= high + ERROR)
    return own.select("name", "point", F.col("n").cast("bigint").alias("n"), near.alias("within"))
