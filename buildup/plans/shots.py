"""Queries on shots and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildup.operators import features, shots
from buildup.plans import views
from buildup.plans.evaluation import rounded
from buildup.plans.movement import big
from buildup.plans.registry import query
from buildup.sources import standin

_GEOMETRY = f"""{views.SHOTS}, geo AS (
  SELECT *, 120 - x AS dx, sqrt((120 - x) * (120 - x) + abs(40 - y) * abs(40 - y)) AS distance,
    ((120 - x) * (120 - x) + (36 - y) * (44 - y)) AS dot,
    sqrt((120 - x) * (120 - x) + (36 - y) * (36 - y)) * sqrt((120 - x) * (120 - x) + (44 - y) * (44 - y)) AS len
  FROM shots),
shape AS (
  SELECT shot_id, x, y, dx AS distance_to_end_line, distance,
    CASE WHEN len = 0 THEN NULL ELSE degrees(acos(greatest(-1, least(1, dot / len)))) END AS angle FROM geo)"""


def shot_table(spark, sf_dir):
    return standin.shots(spark, sf_dir)


def shaped(spark, sf_dir):
    return shots.with_geometry(shots.parse_location(shot_table(spark, sf_dir).drop("x", "y")))


@query("binary_recode", f"""{views.SHOTS}
SELECT shot_id, CASE WHEN shot_body_part = 'Head' THEN 1 ELSE 0 END::BIGINT AS shot_body_part FROM shots""")
def binary_recode(spark, sf_dir):
    rows = shots.to_binary(shot_table(spark, sf_dir), "shot_body_part", "Head")
    return rows.select("shot_id", *big("shot_body_part"))


@query("parse_xy_text", f"{views.SHOTS} SELECT shot_id, x, y, round(120 - x, 6) AS distance_to_end_line FROM shots")
def parse_xy_text(spark, sf_dir):
    rows = shots.parse_location(shot_table(spark, sf_dir).drop("x", "y"))
    return rounded(rows.select("shot_id", "x", "y", "distance_to_end_line"), "distance_to_end_line")


@query("shot_geometry", f"""{_GEOMETRY}
SELECT shot_id, round(distance_to_end_line, 6) AS distance_to_end_line, round(distance, 6) AS distance,
  round(angle, 6) AS angle FROM shape""")
def shot_geometry(spark, sf_dir):
    rows = shaped(spark, sf_dir).select("shot_id", "distance_to_end_line", "distance", "angle")
    return rounded(rows, "distance_to_end_line", "distance", "angle")


_FEET = f"""{views.SHOTS}, feet AS (
  SELECT player_id, avg(CASE WHEN shot_body_part = 'Right Foot' THEN 1.0 ELSE 0.0 END) AS right_share
  FROM shots WHERE shot_body_part IN ('Right Foot', 'Left Foot') GROUP BY player_id),
typed AS (SELECT *, CASE WHEN right_share <= 0.5 THEN 'dominant_left' ELSE 'dominant_right' END AS foot_type
  FROM feet)"""


@query("foot_dominance", f"{_FEET} SELECT player_id, round(right_share, 6) AS right_share, foot_type FROM typed")
def foot_dominance(spark, sf_dir):
    return rounded(shots.foot_dominance(shot_table(spark, sf_dir)), "right_share")


@query("refined_body_part", f"""{_FEET}, refined AS (
  SELECT shot_id, CASE WHEN shot_body_part = 'Head' THEN 'head'
    WHEN shot_body_part NOT IN ('Right Foot', 'Left Foot') THEN shot_body_part
    WHEN (shot_body_part = 'Right Foot') = (foot_type = 'dominant_right') THEN 'better_foot'
    ELSE 'worse_foot' END AS refined_body_part
  FROM shots LEFT JOIN typed USING (player_id))
SELECT * FROM refined WHERE refined_body_part IN ('better_foot', 'worse_foot', 'head')""")
def refined_body_part(spark, sf_dir):
    return shots.refine_body_part(shot_table(spark, sf_dir)).select("shot_id", "refined_body_part")


_FRAMES = f"""{views.SHOTS}, frame AS (
  SELECT l_orderkey AS shot_id, l_linenumber, l_partkey, l_returnflag = 'A' AS teammate,
    CASE WHEN NOT (l_returnflag = 'R' AND l_linenumber = 7)
      THEN 80 + ((l_partkey * l_linenumber) % 401) / 10.0::DOUBLE END AS px,
    CASE WHEN NOT (l_returnflag = 'R' AND l_linenumber = 7)
      THEN ((l_suppkey * 13 + l_linenumber * 97) % 801) / 10.0::DOUBLE END AS py,
    l_linenumber = 1 AS keeper FROM lineitem),
tested AS (
  SELECT f.*, NOT teammate AND px IS NOT NULL AND px > x
    AND (((120 - x) * (py - y) - (36 - y) * (px - x)) > 0) <> (((120 - x) * (py - y) - (44 - y) * (px - x)) > 0)
    AS inside
  FROM frame f JOIN shots s USING (shot_id))"""


@query("freeze_frame", f"""{_FRAMES}, counts AS (
  SELECT shot_id, count(*) FILTER (inside AND NOT keeper) AS defenders_in_path,
    max(CASE WHEN inside AND keeper THEN 1 ELSE 0 END)::BIGINT AS goalkeeper_in_path
  FROM tested GROUP BY shot_id)
SELECT shot_id, defenders_in_path, goalkeeper_in_path FROM shots LEFT JOIN counts USING (shot_id)""")
def freeze_frame(spark, sf_dir):
    rows = shots.path_from_rows(shot_table(spark, sf_dir), standin.frame_rows(spark, sf_dir))
    return rows.select("shot_id", *big("defenders_in_path", "goalkeeper_in_path"))


@query("freeze_frame_text", f"""{_FRAMES}
SELECT shot_id, count(*) AS players, count(*) FILTER (inside AND NOT keeper) AS defenders,
  count(*) FILTER (inside AND keeper) AS keepers FROM tested GROUP BY shot_id""")
def freeze_frame_text(spark, sf_dir):
    """The frame of each shot as one list in Python-literal text, parsed and tested."""
    player = standin.frame_rows(spark, sf_dir)
    text = F.concat(
        F.lit("{'teammate': "),
        F.when(F.col("teammate"), "True").otherwise("False"),
        F.when(
            F.col("location").isNotNull(),
            F.concat(F.lit(", 'location': ["), F.array_join(F.col("location").cast("array<string>"), ", "), F.lit("]")),
        ).otherwise(""),
        F.lit(", 'position': {'name': '"),
        F.col("position_name"),
        F.lit("'}}"),
    )
    # a frame holds the players of one pitch
    texts = player.groupBy("shot_id").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(text), ", "), F.lit("]")).alias("text")
    )
    rows = shot_table(spark, sf_dir).select("shot_id", "x", "y").join(texts, "shot_id")
    rows = shots.path_from_frames(rows.withColumn("shot_freeze_frame", shots.parse_frame(F.col("text"))))
    return rows.select(
        "shot_id",
        F.size("shot_freeze_frame").cast("bigint").alias("players"),
        F.col("defenders_in_path").cast("bigint").alias("defenders"),
        F.col("goalkeeper_in_path").cast("bigint").alias("keepers"),
    )


@query("standardize", f"""{_GEOMETRY}
SELECT shot_id, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS x_scaled,
  round((distance - avg(distance) OVER ()) / stddev_pop(distance) OVER (), 6) AS distance_scaled FROM shape""")
def standardize(spark, sf_dir):
    rows = features.standardize(shaped(spark, sf_dir), ["x", "distance"])
    return rounded(rows.select("shot_id", "x_scaled", "distance_scaled"), "x_scaled", "distance_scaled")


# The body parts of a shot.
BODY_PARTS = ["Head", "Left Foot", "Other", "Right Foot"]


@query("dummies", f"""{views.SHOTS}
SELECT shot_id, (shot_body_part = 'Head')::INT::BIGINT AS "Head", (shot_body_part = 'Left Foot')::INT::BIGINT AS "Left Foot",
  (shot_body_part = 'Right Foot')::INT::BIGINT AS "Right Foot" FROM shots""")
def dummies(spark, sf_dir):
    rows = features.dummies(shot_table(spark, sf_dir), "shot_body_part", BODY_PARTS, drop="Other")
    return rows.select("shot_id", *big("Head", "Left Foot", "Right Foot"))



@query("vif", """WITH f AS (SELECT o_orderkey, 90 + ((o_orderkey * 7) % 301) / 10.0::DOUBLE AS a,
  ((o_orderkey * 11) % 801) / 10.0::DOUBLE AS b, o_totalprice AS c FROM orders),
g AS (SELECT sum(a * a) AS aa, sum(b * b) AS bb, sum(c * c) AS cc, sum(a * b) AS ab, sum(a * c) AS ac,
  sum(b * c) AS bc FROM f),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM g)
SELECT 'x' AS variable, round(aa * (bb * cc - bc * bc) / det, 4) AS vif FROM d UNION ALL
SELECT 'y', round(bb * (aa * cc - ac * ac) / det, 4) FROM d UNION ALL
SELECT 'price', round(cc * (aa * bb - ab * ab) / det, 4) FROM d""")
def vif(spark, sf_dir):
    rows = shot_table(spark, sf_dir).join(
        standin.table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("shot_id"), F.col("o_totalprice").alias("price")
        ),
        "shot_id",
    )
    return rounded(features.vif(rows, ["x", "y", "price"]), "vif", digits=4)


@query("select_features", f"{_GEOMETRY} SELECT round(angle, 6) AS angle, round(distance, 6) AS distance FROM shape")
def select_features(spark, sf_dir):
    return rounded(features.select_features(shaped(spark, sf_dir), ["angle", "distance"]), "angle", "distance")
