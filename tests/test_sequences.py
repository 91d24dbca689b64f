"""Invariants and hand cases of events, sequences and tokens."""

import math

import pytest
from pyspark.sql import functions as F

from buildup.functions import labels, pitch
from buildup.operators import events as ev
from buildup.operators import sequences as seq
from buildup.operators import splits, tokens
from buildup.plans.movement import moves
from buildup.sources import schemas, standin


def event(index, kind, start, end=None, outcome=None, team="A", possession=1, shot_type=None):
    """One row of the event schema."""
    return {
        "id": str(index), "match_id": 9, "possession": possession, "index": index, "type": kind,
        "team": team, "possession_team": "A", "location": start,
        "pass_end_location": end if kind == "Pass" else None,
        "carry_end_location": end if kind == "Carry" else None,
        "shot_end_location": [120.0, 40.0, 1.2] if kind == "Shot" else None,
        "shot_outcome": outcome, "shot_type": shot_type or ("Open Play" if kind == "Shot" else None),
        "player": f"p{index % 3}", "timestamp": None, "period": 1, "minute": 0, "second": index,
    }


ATTACK = [
    event(1, "Pass", [60.0, 40.0], [70.0, 40.0]),
    event(2, "Carry", [70.0, 40.0], [71.0, 40.0]),
    event(3, "Pressure", None),
    event(4, "Pass", [20.0, 10.0], [10.0, 15.0], team="B"),
    event(5, "Carry", [80.0, 30.0], [90.0, 30.0]),
    event(6, "Pass", [90.0, 30.0], [110.0, 38.0]),
    event(7, "Shot", [110.0, 38.0], outcome="Goal"),
]


@pytest.fixture(scope="module")
def attack(spark):
    return spark.createDataFrame([tuple(e[f] for f in schemas.EVENT.names) for e in ATTACK], schemas.EVENT)


def table(spark, rows):
    return spark.createDataFrame([tuple(e[f] for f in schemas.EVENT.names) for e in rows], schemas.EVENT)


def test_other_team_is_turned(attack):
    row = ev.movement_events(attack).where("index = 4").first()
    assert (row.x, row.y, row.end_x, row.end_y) == (100.0, 70.0, 110.0, 65.0)


def test_turning_twice_changes_nothing(spark, sf_dir):
    rows = ev.with_coordinates(ev.movement(standin.events(spark, sf_dir)))
    coordinates = [F.round(c, 1).alias(c) for c in ("x", "y", "pass_x", "pass_y", "carry_x", "carry_y")]
    pick = lambda df: sorted(map(str, df.select("index", *coordinates).collect()))
    assert pick(ev.orient(ev.orient(rows))) == pick(rows)


def test_short_and_missing_locations_are_null(spark):
    df = spark.createDataFrame([([],), ([1.0],), ([1.0, 2.0, 3.0],), (None,)], "location array<double>")
    got = ev.with_coordinates(df).collect()
    assert [(r.x, r.y) for r in got] == [(None, None), (None, None), (1.0, 2.0), (None, None)]


def test_threshold_and_mode_check(attack):
    kept = ev.movement_events(attack, mode="threshold", threshold=2)
    assert [r["index"] for r in kept.orderBy("index").collect()] == [1, 4, 5, 6, 7]
    for bad in (("threshold", None), ("threshold", 0), ("other", 1)):
        with pytest.raises(ValueError):
            ev.check_mode(*bad)


def test_penalty_leaves_but_unknown_shot_type_stays(spark):
    rows = [
        event(1, "Shot", [110.0, 40.0], outcome="Goal", shot_type="Penalty"),
        {**event(2, "Shot", [110.0, 40.0], outcome="Saved"), "shot_type": None},
    ]
    assert [r["index"] for r in ev.movement(table(spark, rows)).collect()] == [2]


def test_sequence_of_the_attack(attack):
    row = seq.from_events(ev.movement_events(attack), 4).first()
    assert [e.type for e in row.events] == ["Pass", "Carry", "Pass", "Shot", "GOAL"]
    assert [e.rank for e in row.events] == [4, 3, 2, 1, 0]
    assert (row.sequence_length, row.goal) == (5, 1)
    assert row.events[-1].x is None


def test_adaptive_keeps_passes_and_long_carries(attack):
    rows = seq.truncate_adaptive(ev.movement_events(attack, mode="adaptive"), 5)
    assert sorted((r["index"], r.event_rank) for r in rows.collect()) == [(1, 5), (4, 4), (5, 3), (6, 2), (7, 1)]


def test_two_goals_are_no_goal_when_strict(spark):
    rows = table(spark, [
        event(1, "Shot", [110.0, 40.0], outcome="Goal"), event(2, "Shot", [111.0, 40.0], outcome="Goal")
    ])
    moved = ev.movement_events(rows)
    assert seq.from_events(moved).first().events[-1].type == "NO_GOAL"
    assert seq.from_events(moved, strict=False).first().events[-1].type == "GOAL"


def test_goal_before_the_kept_events_is_not_seen(spark):
    rows = [event(1, "Shot", [110.0, 40.0], outcome="Goal")]
    rows += [event(i, "Pass", [50.0, 40.0], [60.0, 40.0]) for i in range(2, 5)]
    assert seq.from_events(ev.movement_events(table(spark, rows)), 3).first().goal == 0


def test_lengths_and_terminals(spark, sf_dir):
    rows = seq.from_events(moves(spark, sf_dir), 6)
    bad = rows.where(
        (F.col("sequence_length") > 7)
        | ~F.element_at("events", -1)["type"].isin(*labels.TERMINALS)
        | (F.size(F.filter("events", lambda e: e["type"].isin(*labels.TERMINALS))) != 1)
    )
    assert bad.count() == 0


def test_normalized_range(spark, sf_dir):
    rows = seq.explode(seq.normalize(seq.from_events(moves(spark, sf_dir))))
    out = rows.where("x < 0 or x > 1 or y < 0 or y > 1 or end_x < 0 or end_x > 1 or end_y < 0 or end_y > 1")
    assert out.count() == 0


@pytest.mark.parametrize("partitions", [3, 7])
def test_results_do_not_depend_on_partitioning(spark, sf_dir, partitions):
    base = moves(spark, sf_dir)

    def run(df):
        rows = splits.with_split(seq.possession_goals(seq.truncate_last(df, 5)))
        balanced = splits.balance(rows.where("split = 'train'"))
        sample = splits.fixed_sample(rows, 20)
        return [sorted(map(tuple, d.collect())) for d in (rows, balanced, sample)]

    assert run(base.repartition(partitions)) == run(base.coalesce(1))


def test_splits_are_complete_and_disjoint(spark, sf_dir):
    rows = splits.with_split(seq.possession_goals(seq.truncate_last(moves(spark, sf_dir))))
    assert rows.count() == rows.select("match_id", "possession").distinct().count()
    assert {r.split for r in rows.select("split").distinct().collect()} == {"train", "val", "test"}


def test_balance_reaches_the_share(spark):
    rows = spark.range(20_000).selectExpr("id as match_id", "0 as possession", "if(id % 100 = 0, 1, 0) as goal")
    out = {r.goal: r["count"] for r in splits.balance(rows).groupBy("goal").count().collect()}
    assert out[1] == 200
    assert out[0] == pytest.approx(3800, rel=0.1)
    few = rows.where("id < 200").withColumn("goal", F.when(F.col("match_id") < 100, 1).otherwise(0))
    assert splits.balance(few).count() == 200  # the fraction is capped at 1


def test_variants_equal_single_runs(spark, sf_dir):
    base = moves(spark, sf_dir)
    many = splits.variant_possessions(base, [1, 5], [3, 8])
    for threshold in (1, 5):
        for n in (3, 8):
            one = seq.possession_goals(seq.truncate_last(ev.carry_filter(base, threshold), n))
            got = many.where((F.col("threshold") == threshold) & (F.col("context") == n))
            names = ["match_id", "possession", "sequence_length", "goal"]
            assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, one.select(names).collect()))


def test_token_table_pads_and_never_cuts(attack):
    rows = seq.normalize(seq.from_events(ev.movement_events(attack)))
    wide = tokens.token_table(rows, 8).first()
    assert wide.input_types == [0, 5, 0, 5, 0, 1, 4, 4]
    assert wide.target_types == [5, 0, 5, 0, 1, 2, -100, -100]
    assert wide.input_end_mask == [True] * 5 + [False] * 3
    assert wide.input_positions[5][2:] == [0.0, 0.0]
    assert len(tokens.token_table(rows, 2).first().input_types) == 6
    assert tokens.token_table(rows, 8).select(tokens.real_length("input_types")).first()[0] == 6


def test_unknown_type_is_an_error(spark):
    df = spark.createDataFrame([("Throw",)], "t string")
    with pytest.raises(Exception, match="unknown type"):
        df.select(labels.type_id(F.col("t"))).collect()


def test_fourier_order(spark):
    row = spark.range(1).select(tokens.fourier(F.array(F.lit(0.25), F.lit(0.5)), (1, 2)).alias("v")).first()
    want = [f(p * r) for p in (0.25, 0.5) for r in (1, 2) for f in (math.sin, math.cos)]
    assert row.v == pytest.approx(want)


def test_labels(spark):
    df = spark.createDataFrame([(3, 0.5), (4, 0.0), (51, -0.25)], "n int, v double")
    rows = df.select(
        labels.length_bucket(F.col("n")).alias("b"), labels.capped_length(F.col("n")).alias("c"),
        labels.signed_text(F.col("v")).alias("t"),
    ).collect()
    assert [tuple(r) for r in rows] == [("1-3", "3", "+0.500"), ("4-6", "4", "0.000"), ("51+", "13+", "-0.250")]


def test_grid_edges(spark):
    df = spark.createDataFrame([(0.0,), (9.9,), (10.0,), (119.9,), (120.0,), (130.0,), (-1.0,)], "x double")
    got = [r[0] for r in df.select(pitch.grid_index(F.col("x"), 120, 12)).collect()]
    assert got == [0, 0, 1, 11, 11, 11, 0]


def test_variant_sequences_have_the_variant_lengths(spark, sf_dir):
    base = moves(spark, sf_dir)
    built = splits.variant_sequences(splits.variants(base, [1, 5], [3, 8]))
    counted = splits.variant_possessions(base, [1, 5], [3, 8])
    names = ["threshold", "context", "match_id", "possession", "sequence_length", "goal"]
    assert sorted(map(tuple, built.select(names).collect())) == sorted(map(tuple, counted.select(names).collect()))
