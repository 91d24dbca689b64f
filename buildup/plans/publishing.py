"""Queries on resumable publishing, bucketed tables and checked modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildup import session
from buildup.operators import events as ev
from buildup.operators import sequences as seq
from buildup.operators import splits
from buildup.plans import views
from buildup.plans.movement import COORDS, all_events, big, moves
from buildup.plans.registry import query
from buildup.sources import publish, sinks

KEYS = seq.KEYS
BY = ["variant", "split"]
SPLITS = ["train", "val", "test"]
# variants by the least distance of a carry
LEAST = {"nofilter_ctx14": 0, "t2_ctx14": 2, "t5_ctx14": 5}
PARTS = [(v, s) for v in LEAST for s in SPLITS]
LOST, BROKEN = ("t2_ctx14", "val"), ("t5_ctx14", "test")


def build_parts(spark, sf_dir):
    """Sequences of the wanted variants; each is built only if one of its parts is wanted."""

    def build(parts):
        out = None
        for variant in dict.fromkeys(v for v, _ in parts):
            rows = moves(spark, sf_dir, mode="threshold", threshold=LEAST[variant]) if LEAST[variant] else moves(spark, sf_dir)
            table = splits.with_split(seq.normalize(seq.from_events(rows))).withColumn("variant", F.lit(variant))
            out = table if out is None else out.unionByName(table)
        return out

    return build


def _variant_sql(name: str, least: int) -> str:
    kept = f"(SELECT * FROM mv WHERE type <> 'Carry' OR carry_dist >= {least})" if least else "mv"
    return f"""SELECT '{name}' AS variant, match_id, possession, shot_outcome FROM (
      SELECT *, row_number() OVER (PARTITION BY match_id, possession ORDER BY index DESC) AS event_rank FROM {kept} k) t
    WHERE event_rank <= 14"""


@query("publish_resume", f"""{views.MV}, cut AS ({' UNION ALL '.join(_variant_sql(v, t) for v, t in LEAST.items())}),
found AS (
  SELECT variant, match_id, possession, {views.SPLIT_OF} AS split, count(*) + 1 AS tokens,
    sum(CASE WHEN shot_outcome = 'Goal' THEN 1 ELSE 0 END) AS goals
  FROM cut GROUP BY variant, match_id, possession)
SELECT variant, split, count(*) AS possessions, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(goals) AS BIGINT) AS goals,
  CASE WHEN (variant, split) IN ({LOST}, {BROKEN}) THEN 2 ELSE 1 END::BIGINT AS builds
FROM found GROUP BY variant, split""")
def publish_resume(spark, sf_dir):
    """All parts published; one is lost and one gets a stray file; publishing again builds these two alone."""
    path = session.new_table_path(spark, "published")
    build = build_parts(spark, sf_dir)
    schema = build(PARTS[:1]).schema
    publish.publish(spark, path, BY, PARTS, build)
    publish.drop(spark, path, BY, LOST)
    stray = publish.read(spark, path, schema).where("variant = 'nofilter_ctx14' and split = 'test'").drop(*BY).limit(1)
    stray.write.mode("append").parquet(publish.part_path(path, BY, BROKEN))
    publish.publish(spark, path, BY, PARTS, build)
    builds = publish.latest(publish.manifest(spark, path, BY), BY).select(*BY, "builds")
    sums = publish.read(spark, path, schema).groupBy(*BY).agg(
        F.count("*").alias("possessions"),
        F.sum(F.size("events")).cast("bigint").alias("tokens"),
        F.sum("goal").cast("bigint").alias("goals"),
    )
    return sums.join(F.broadcast(builds), BY)


@query("sequence_tokens_bucketed", f"{views.SEQ} SELECT * FROM tok")
def sequence_tokens_bucketed(spark, sf_dir):
    """Sequences from events that lie bucketed and sorted by possession: no exchange between scan and result."""
    rows = sinks.bucketed(all_events(spark, sf_dir), session.new_table_path(spark, "bucketed"), KEYS, "index")
    rows = seq.explode(seq.from_events(ev.movement_events(rows)).select(*KEYS, "events"))
    return rows.select(*KEYS, *big("pos"), "type", *COORDS, *big("is_goal"))


_MODES = ["nofilter", "threshold", "adaptive", "everything", ""]


@query("mode_validation", f"""{views.MV}, modes AS (SELECT unnest({_MODES}) AS mode)
SELECT mode, mode NOT IN ('nofilter', 'threshold', 'adaptive') AS rejected,
  CASE WHEN mode IN ('nofilter', 'adaptive') THEN (SELECT count(*) FROM mv)
    WHEN mode = 'threshold' THEN (SELECT count(*) FROM mv WHERE type <> 'Carry' OR carry_dist >= 3) ELSE 0 END AS n FROM modes""")
def mode_validation(spark, sf_dir):
    """Events under every mode; a mode that does not exist is refused before anything is read."""
    out = None
    for mode in _MODES:
        try:
            rows = moves(spark, sf_dir, mode=mode, **({"threshold": 3} if mode == "threshold" else {}))
            found = rows.agg(F.lit(mode).alias("mode"), F.lit(False).alias("rejected"), F.count("*").alias("n"))
        except ValueError:
            found = spark.range(1).select(F.lit(mode).alias("mode"), F.lit(True).alias("rejected"), F.lit(0).cast("bigint").alias("n"))
        out = found if out is None else out.unionByName(found)
    return out
