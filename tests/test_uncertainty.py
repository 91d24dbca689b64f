import json

import pytest
from pyspark.sql import functions as F

from buildup.operators import experiments, metrics
from buildup.sources import json_files


def test_draws_are_poisson_and_by_key(spark):
    rows = spark.range(4000).withColumn("key", F.col("id") % 2000)
    for parts in (1, 7):
        out = experiments.with_draws(rows.repartition(parts), ["key"], 6).groupBy("replicate", "key").agg(
            F.min("draws").alias("low"), F.max("draws").alias("high"), F.count("*").alias("n")
        )
        found = out.collect()
        assert all(r["low"] == r["high"] and r["n"] == 2 for r in found)
        assert {r["replicate"] for r in found} == set(range(1, 7))
        for b in range(1, 7):
            own = [r["low"] for r in found if r["replicate"] == b]
            assert sum(own) / 2000 == pytest.approx(1.0, abs=0.08)
            assert len(own) / 2000 == pytest.approx(0.632, abs=0.04)
        sums = sorted((r["replicate"], r["key"], r["low"]) for r in found)
        assert parts == 1 or sums == before
        before = sums


def test_replicates_equal_metrics_of_drawn_rows(spark):
    data = [(i, i % 40, (i * 37 % 100) / 100, int(i * 53 % 100 < 30 + i * 37 % 100 / 2)) for i in range(400)]
    rows = spark.createDataFrame(data, "id int, user int, score double, label int").withColumn("run", F.lit("a"))
    found = experiments.bootstrap(rows, ["user"], ["run"], ["roc_auc", "brier_score"], replicates=3)
    assert found.count() == 4
    for r in found.collect():
        own = rows
        if r["replicate"]:
            drawn = experiments.with_draws(rows, ["user"], 3).where(F.col("replicate") == r["replicate"])
            own = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), "draws")))
        assert r["brier_score"] == pytest.approx(metrics.summary(own).first()["brier_score"], abs=1e-9)
        assert r["roc_auc"] == pytest.approx(metrics.roc_auc(own).first()["roc_auc"], abs=1e-9)


def test_intervals_and_deltas(spark):
    rows = [(r, "a", 0.5 + r / 100) for r in range(11)] + [(r, "b", 0.4 + r / 50) for r in range(11)]
    frame = spark.createDataFrame(rows, "replicate int, run string, m double")
    both = frame.join(experiments.delta_replicates(frame, "run", "a", ["m"]), ["run", "replicate"])
    out = {(r["run"], r["metric"]): r for r in experiments.intervals(both, ["run"], ["m", "m_delta"], (0.0, 1.0)).collect()}
    assert out["a", "m"]["value"] == 0.5 and out["a", "m"]["low"] == 0.51 and out["a", "m"]["high"] == 0.6
    assert out["b", "m_delta"]["value"] == pytest.approx(-0.1) and out["b", "m_delta"]["replicates"] == 10
    assert out["a", "m_delta"]["low"] == out["a", "m_delta"]["high"] == 0


def test_broken_files_are_listed(spark, tmp_path):
    event = lambda i: {"id": str(i), "index": i, "type": {"id": 1, "name": "Pass"}, "location": [1.0, 2.0]}
    good = {n: json.dumps([event(i) for i in range(n)]) for n in (1, 2, 3)}
    texts = {f"{n}.json": t for n, t in good.items()}
    texts |= {"4.json": good[3][:-9], "6.json": "no json at all", "7.json": json.dumps(event(1)), "8.json": "[]"}
    texts |= {"readme.json": good[1], "9.json": json.dumps([event(1), {"index": 2}]), "10.json": json.dumps(good[1])}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found, rejected = json_files.parse_event_texts(json_files.read_texts(spark, str(tmp_path)))
    counts = {r["match_id"]: r["count"] for r in found.groupBy("match_id").count().collect()}
    assert counts == {1: 1, 2: 2, 3: 3, 7: 1}
    reasons = {r["file"].rsplit("/", 1)[-1]: (r["reason"], r["length"]) for r in rejected.collect()}
    assert reasons == {
        "4.json": ("broken", len(texts["4.json"])),
        "6.json": ("broken", 14),
        "readme.json": ("no match id", len(good[1])),
        "9.json": ("event without id", len(texts["9.json"])),
        "10.json": ("broken", len(texts["10.json"])),
    }
    assert found.columns == json_files.read_event_files(spark, str(tmp_path / "1.json")).columns


def test_draws_of_four_replicates_share_a_row(spark):
    data = [(u % 40, u % 7 / 10, u % 2) for u in range(400)]
    rows = spark.createDataFrame(data, "user int, score double, label int").withColumn("run", F.lit("a"))
    # 6 is not a multiple of four
    found = experiments.bootstrap(rows, ["user"], ["run"], ["brier_score"], 6).collect()
    assert sorted(r["replicate"] for r in found) == list(range(7))
    drawn = experiments.with_draws(rows, ["user"], 6)
    for r in drawn.groupBy("replicate").agg((F.sum(F.col("draws") * (F.col("score") - F.col("label")) ** 2) / F.sum("draws")).alias("v")).collect():
        assert r["v"] == pytest.approx(next(f["brier_score"] for f in found if f["replicate"] == r["replicate"]), abs=1e-9)
    # levels are compared in compiled code, not one array function call a draw
    assert "lambda" not in drawn._jdf.queryExecution().optimizedPlan().toString()
