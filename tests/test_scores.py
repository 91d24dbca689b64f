"""Metrics, calibration, threat, contexts and sensitivity."""

import random

import pytest
from pyspark.sql import functions as F

from buildup.functions.bins import edge_bin, unit_bin
from buildup.operators import calibrate, context, experiments, metrics, sensitivity, threat
from buildup.operators import sequences as seq
from buildup.plans.models import halves
from buildup.plans.movement import moves


def scored(spark, rows):
    return spark.createDataFrame(rows, "score double, label int")


def test_constant_score_has_auc_half(spark):
    df = scored(spark, [(0.4, 1), (0.4, 0), (0.4, 0)])
    assert metrics.roc_auc(df).first()[0] == 0.5


def test_perfect_and_reversed_ranking(spark):
    df = scored(spark, [(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)])
    assert metrics.roc_auc(df).first()[0] == 1.0
    assert metrics.roc_auc(df.withColumn("score", 1 - F.col("score"))).first()[0] == 0.0


def test_auc_without_a_class_is_null(spark):
    assert metrics.roc_auc(scored(spark, [(0.3, 0), (0.4, 0)])).first()[0] is None


def test_auc_equals_pair_counting(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(300)]
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(scored(spark, rows)).first()[0] == pytest.approx(want)


def test_ece_of_sure_scores(spark):
    df = scored(spark, [(0.0, 0), (0.0, 0)])
    assert metrics.ece(df).first()[0] == 0.0
    # a score of exactly 1 is in no bin
    assert metrics.ece(scored(spark, [(1.0, 0), (0.0, 0)])).first()[0] == 0.0


def test_bin_edges_follow_double_steps(spark):
    values = [0.0, 0.1, 0.2, 0.3, 0.6, 0.7, 0.95, 1.0]
    want = [sum(v >= i * 0.1 for i in range(1, 10)) for v in values[:-1]] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(unit_bin(F.col("v"), 10)).collect()] == want
    assert df.select(edge_bin(F.lit(0.5), F.lit(0.5), F.lit(0.5), 4)).first()[0] == 0


def test_weighted_table_gives_the_same_metrics(spark, sf_dir):
    rows, _ = halves(spark, sf_dir)
    table = metrics.reduce(rows)
    for name in ("summary", "roc_auc", "ece"):
        plain = getattr(metrics, name)(rows).first()
        reduced = getattr(metrics, name)(table, weight="weight").first()
        assert tuple(reduced) == pytest.approx(tuple(plain))


def test_roc_curve_ends(spark, sf_dir):
    rows, _ = halves(spark, sf_dir)
    points = metrics.roc_curve(rows).orderBy(F.desc("threshold")).collect()
    assert (points[0].tpr, points[0].fpr) == (0.0, 0.0)
    assert (points[-1].tpr, points[-1].fpr) == (1.0, 1.0)
    assert all(a.tpr <= b.tpr and a.fpr <= b.fpr for a, b in zip(points, points[1:]))


def test_isotonic_rises_and_beta_stays_in_range(spark, sf_dir):
    fit_on, apply_to = halves(spark, sf_dir)
    iso = calibrate.calibrate(fit_on, apply_to, "isotonic").orderBy("score").collect()
    assert all(a.calibrated <= b.calibrated + 1e-12 for a, b in zip(iso, iso[1:]))
    curve = calibrate.fit_curve(calibrate.weighted(fit_on), "beta")
    assert min(curve.coefficients) >= 0


def test_beta_recovers_its_own_curve(spark):
    """Scores whose true rate is a beta curve: the fit finds the coefficients again."""
    rows = []
    for i in range(1, 20):
        p = i / 20
        z = 1.0 / (1.0 + ((1 - p) ** 2 / p) * 2.0)
        good = round(20_000 * z)
        rows += [(p, 1.0, float(good)), (p, 0.0, float(20_000 - good))]
    weights = spark.createDataFrame(rows, "score double, label double, weight double")
    curve = calibrate.fit_curve(weights, "beta")
    assert curve.coefficients == pytest.approx((1.0, 2.0), abs=0.01)


def tiny_moves(spark):
    """Zone 0 passes to the last zone once out of two; the last zone scores once out of two shots."""
    rows = [
        (1, 1, 1, "Pass", 5.0, 3.0, 115.0, 78.0, None),
        (1, 1, 2, "Shot", 115.0, 78.0, None, None, "Goal"),
        (1, 2, 1, "Pass", 5.0, 3.0, 115.0, 78.0, None),
        (1, 3, 1, "Shot", 115.0, 78.0, None, None, "Saved"),
    ]
    return spark.createDataFrame(
        rows,
        "match_id long, possession long, index long, type string, x double, y double, end_x double,"
        " end_y double, shot_outcome string",
    )


def test_zone_threat_by_hand(spark):
    got = {r.zone: r.threat for r in threat.zone_threat(tiny_moves(spark)).collect()}
    assert len(got) == 144
    assert got[143] == pytest.approx(0.5)
    assert got[0] == pytest.approx(0.25)  # one of two passes goes on, into a zone worth 0.5
    once = {r.zone: r.threat for r in threat.zone_threat(tiny_moves(spark), iterations=1).collect()}
    assert once[0] == 0.0


def test_continue_rates(spark):
    got = {r.type: r.keep for r in threat.continue_rates(tiny_moves(spark)).collect()}
    assert got == {"Pass": 0.5, "Shot": 0.0}


def test_contributions_add_up(spark):
    rows = [(1, 1, i, k, v) for i, (k, v) in enumerate([("Pass", 0.1), ("Pass", 0.4), ("Carry", 0.3), ("Shot", 0.6)])]
    df = spark.createDataFrame(rows, "match_id long, possession long, index long, type string, score double")
    got = {r["index"]: (r.rise, r.contribution) for r in context.with_contribution(df, block_rows=2).collect()}
    assert got == {0: (0.3, 0.3), 1: (-0.1, -0.1), 2: (0.3, 0.3), 3: (0.0, 0.4)}
    assert sum(rise for rise, _ in got.values()) == pytest.approx(0.6 - 0.1)


def test_sliding_context_does_not_depend_on_blocks(spark, sf_dir):
    base = moves(spark, sf_dir)
    pick = lambda b: sorted(
        map(tuple, context.sliding_keys(base, b).select("match_id", "index", "context", "context_size").collect())
    )
    assert pick(1_000_000) == pick(20)


def test_context_rates_back_off(spark):
    pack = lambda *tokens: sum(t << 8 * i for i, t in enumerate(tokens))
    rows = [(pack(1, 2, 3), 1, True), (pack(1, 2, 4), 0, True), (pack(1, 2, 5), 0, False), (pack(9), 1, False)]
    df = spark.createDataFrame(rows, "context int, label int, seen boolean")
    got = {r.context: (r.level, r.score) for r in context.rates(df, F.col("seen"), alpha=2.0).collect()}
    assert got[pack(1, 2, 3)] == (3, pytest.approx((1 + 2 * 0.5) / 3))
    assert got[pack(1, 2, 5)] == (2, pytest.approx((1 + 2 * 0.5) / 4))
    assert got[pack(9)] == (0, 0.5)


def test_contexts_read_as_text(spark):
    rows = [("Pass", 0.0, 0.0), ("Carry", 119.0, 79.0), ("Shot", None, None)]
    df = spark.createDataFrame(rows, "type string, x double, y double")
    tokens = [r[0] for r in df.select(context.token(F.col("type"), F.col("x"), F.col("y"))).collect()]
    packed = tokens[0] | tokens[1] << 8 | tokens[2] << 16
    one = spark.createDataFrame([(packed,), (tokens[1],)], "c int")
    assert [r[0] for r in one.select(context.context_text(F.col("c"))).collect()] == ["Pass:0|Carry:23|Shot:-", "Carry:23"]
    assert one.select(context.context_text(F.col("c"), True)).first()[0] == "Shot:-|Carry:23|Pass:0"


def test_own_scorer(spark, sf_dir):
    rows = seq.from_events(moves(spark, sf_dir))
    out = context.score_possessions(rows, F.lit(True), lambda df: df.withColumn("score", F.lit(0.5)))
    assert out.where("score = 0.5 and label is not null").count() == rows.count()


def test_sensitivity_is_measured_from_one_baseline(spark, sf_dir):
    events = moves(spark, sf_dir)
    table = sensitivity.summary(sensitivity.eligible(seq.normalize(seq.from_events(events))), events)
    rows = table.collect()
    assert len(rows) == 42
    gaps = {round(r.mean_xT - r.delta_vs_baseline, 12) for r in rows}
    assert len(gaps) == 1


def test_synthetic_event_stops_at_the_end_line(spark, sf_dir):
    rows = sensitivity.counterfactuals(
        sensitivity.eligible(seq.normalize(seq.from_events(moves(spark, sf_dir))))
    )
    assert rows.where("added.end_x > 1 or added.end_x < added.x or added.end_y <> added.y").count() == 0


def test_best_run_per_phase(spark):
    runs = spark.createDataFrame(
        [("a", "r1", 0.5), ("a", "r2", 0.7), ("b", "r3", None), ("b", "r4", 0.6)],
        "phase string, run_name string, roc_auc double",
    )
    assert {r.run_name for r in experiments.best_per_phase(runs).collect()} == {"r2", "r4"}
    delta = {r.run_name: r.roc_auc_delta for r in experiments.delta_to(runs, "r1", ["roc_auc"]).collect()}
    assert delta["r2"] == pytest.approx(0.2) and delta["r3"] is None


def test_no_run_is_lost_without_or_with_two_baselines(spark):
    runs = spark.createDataFrame(
        [("a", "r1", 0.5), ("b", "r1", 0.6), ("b", "r2", 0.7)], "phase string, run_name string, roc_auc double"
    )
    absent = experiments.delta_to(runs, "r9", ["roc_auc"]).collect()
    assert len(absent) == 3 and {r.roc_auc_delta for r in absent} == {None}
    doubled = experiments.delta_to(runs, "r1", ["roc_auc"]).collect()
    assert len(doubled) == 3 and {round(r.roc_auc_delta, 6) for r in doubled} == {-0.1, 0.0, 0.1}


def test_rows_without_score_or_label_take_no_part(spark):
    data = [(0.2, 0), (0.9, 1), (0.4, 1), (0.7, 0)]
    gaps = [(None, 1), (0.5, None), (None, None)]
    schema = "score double, label int"
    whole, holes = spark.createDataFrame(data, schema), spark.createDataFrame(data + gaps, schema)
    assert metrics.record(holes).first() == metrics.record(whole).first()
    assert holes.select(edge_bin(F.col("score"), F.lit(0.0), F.lit(1.0), 4)).where("score is null").count() == 2
    for method in ("beta", "quadratic", "platt", "isotonic"):
        one = {r.score: r.calibrated for r in calibrate.calibrate(whole, whole, method).collect()}
        two = {r.score: r.calibrated for r in calibrate.calibrate(holes, holes, method).where("label is not null").collect()}
        assert two.pop(None) is None
        assert two == pytest.approx(one)


def test_mixture_does_not_depend_on_partitions(spark, sf_dir):
    from buildup.operators import models
    from buildup.session import stage

    rows = stage(seq.explode(seq.normalize(seq.from_events(moves(spark, sf_dir)))), "positions")
    fits = [
        [(r.type, r.component, round(r.weight, 6), [round(v, 6) for v in r.covariance]) for r in parts.collect()]
        for parts in (models.position_mixture(rows.repartition(n), [*seq.KEYS, "pos"]) for n in (3, 7))
    ]
    assert fits[0] == fits[1]
    assert [len([f for f in fits[0] if f[0] == kind]) for kind in ("Pass", "Carry")] == [5, 3]
