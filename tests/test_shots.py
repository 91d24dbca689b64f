"""Freeze frames, geometry and feature tables."""

import pytest
from pyspark.sql import functions as F

from buildup.operators import features, shots

FRAMES = {
    "none": None,
    "defender": "[{'teammate': False, 'location': [115.0, 40.0], 'position': {'name': 'Center Back'}}]",
    "keeper": "[{'teammate': False, 'location': [119.0, 40.0], 'position': {'name': 'Goalkeeper'}}]",
    "behind": "[{'teammate': False, 'location': [100.0, 40.0], 'position': {'name': 'Center Back'}}]",
    "wide": "[{'teammate': False, 'location': [115.0, 60.0], 'position': {'name': 'Center Back'}}]",
    "mate": "[{'teammate': True, 'location': [115.0, 40.0], 'position': {'name': 'Striker'}}]",
    "no place": "[{'teammate': False, 'position': {'name': 'Center Back'}}]",
    "no team": "[{'location': [115.0, 40.0]}]",
    "json": '[{"teammate":false,"location":[115.0,40.0],"position":{"name":"Center Back"}},'
    '{"teammate":false,"location":[116.0,40.0]}]',
    "spaced": "[{'teammate':   False,'location':[115.0, 40.0], 'position': None}]",
    "broken": "[{'teammate': ",
}
WANT = {
    "none": (None, None), "defender": (1, 0), "keeper": (0, 1), "behind": (0, 0), "wide": (0, 0),
    "mate": (0, 0), "no place": (0, 0), "no team": (0, 0), "json": (2, 0), "spaced": (1, 0),
    "broken": (None, None),
}


def test_frames_from_text(spark):
    df = spark.createDataFrame([(k, v, 108.0, 40.0) for k, v in FRAMES.items()], "k string, t string, x double, y double")
    rows = shots.path_from_frames(df.withColumn("shot_freeze_frame", shots.parse_frame(F.col("t"))))
    got = {r.k: (r.defenders_in_path, r.goalkeeper_in_path) for r in rows.collect()}
    assert got == WANT


def test_rows_and_arrays_agree(spark):
    df = spark.createDataFrame([(k, v, 108.0, 40.0) for k, v in FRAMES.items()], "shot_id string, t string, x double, y double")
    df = df.withColumn("shot_freeze_frame", shots.parse_frame(F.col("t")))
    rows = df.select("shot_id", F.explode("shot_freeze_frame").alias("p")).select(
        "shot_id", "p.teammate", "p.location", F.col("p.position.name").alias("position_name")
    )
    a = shots.path_from_frames(df).select("shot_id", "defenders_in_path", "goalkeeper_in_path")
    b = shots.path_from_rows(df.select("shot_id", "x", "y"), rows)
    b = b.select("shot_id", "defenders_in_path", "goalkeeper_in_path")
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_geometry(spark):
    df = spark.createDataFrame([("[108.0, 40.0]",), ("[120, 36]",), ("[1.0]",)], "location string")
    rows = shots.with_geometry(shots.parse_location(df)).collect()
    assert rows[0].distance == 12.0 and rows[0].angle == pytest.approx(36.8698976)
    assert rows[1].angle is None  # on a post
    assert rows[2].x is None and rows[2].distance is None


def test_body_part(spark):
    rows = [(1, "Right Foot"), (1, "Right Foot"), (1, "Left Foot"), (2, "Left Foot"), (2, "Right Foot"),
            (3, "Head"), (3, "Other")]
    df = spark.createDataFrame(rows, "player_id long, shot_body_part string")
    got = sorted((r.player_id, r.shot_body_part, r.refined_body_part) for r in shots.refine_body_part(df).collect())
    assert got == [
        (1, "Left Foot", "worse_foot"), (1, "Right Foot", "better_foot"), (1, "Right Foot", "better_foot"),
        (2, "Left Foot", "better_foot"), (2, "Right Foot", "worse_foot"), (3, "Head", "head"),
    ]


def test_features(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 5.0, None), ("b", 2.0, 5.0, None), (None, 6.0, 5.0, None)], "c string, v double, k double, n int"
    )
    assert features.drop_all_null_columns(df).columns == ["c", "v", "k"]
    flags = features.dummies(df, "c", ["a", "b"], drop="a")
    assert "c" not in flags.columns and [r.b for r in flags.orderBy("v").collect()] == [0, 1, 0]
    scaled = features.standardize(df, ["v", "k"]).collect()
    assert sum(r.v_scaled for r in scaled) == pytest.approx(0) and {r.k_scaled for r in scaled} == {0.0}


def test_dummies_of_many_categories(spark):
    df = spark.range(3000).selectExpr("id", "if(id = 7, null, concat('c', id % 1500)) as c")
    wide = features.dummies(df, "c", [f"c{i}" for i in range(1500)])
    assert len(wide.columns) == 1501
    assert wide.where("id in (5, 1505)").select(F.sum("c5")).first()[0] == 2
    long = features.sparse_dummies(df, ["id"], "c").collect()
    assert len(long) == 2999 and len({r.category_id for r in long}) == 1500
    ids = {r.id: r.category_id for r in long}
    assert ids[5] == ids[1505] != ids[6] and 7 not in ids


def test_a_name_with_two_short_forms_keeps_one_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, player string")
    names = spark.createDataFrame([("a", "y"), ("a", "x")], "full_name string, short_name string")
    got = features.map_names(df, "player", "full_name", names).collect()
    assert sorted((r.id, r.player) for r in got) == [(1, "x"), (2, None), (3, None)]


def test_vif_of_independent_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)], "a double, b double")
    assert [r.vif for r in features.vif(df, ["a", "b"]).collect()] == pytest.approx([1.0, 1.0])
