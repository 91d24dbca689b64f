import bisect
import random

import pytest
from pyspark.sql import functions as F

from buildup import ordered
from buildup.operators import calibrate, isotonic

ROW = "score double, weight double, total double"


def brute(rows):
    """Value of every score: the largest over all starts of the least mean over all ends."""
    rows = sorted(rows)
    out = []
    for i in range(len(rows)):
        best = -1e18
        for a in range(i + 1):
            w = t = 0.0
            least = 1e18
            for b in range(a, len(rows)):
                w, t = w + rows[b][1], t + rows[b][2]
                if b >= i:
                    least = min(least, t / w)
            best = max(best, least)
        out.append((rows[i][0], best))
    return out


def at(values, s):
    """Linear between fitted scores, flat beyond."""
    scores = [v[0] for v in values]
    i = bisect.bisect_right(scores, s)
    if i == 0 or i == len(scores) or scores[i - 1] == s:
        return values[max(0, i - 1)][1]
    (s0, v0), (s1, v1) = values[i - 1 : i + 1]
    return v0 + (v1 - v0) * (s - s0) / (s1 - s0)


def drawn(n, seed, shape):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        weight = draw.randint(1, 9)
        rate = {"rising": i / n, "falling": 1 - i / n, "waves": (i % 17) / 17, "drop": i / n * (i < n - 1)}[shape]
        total = sum(draw.random() < rate for _ in range(weight))
        out.append((i / n, float(weight), float(total)))
    if shape == "drop":
        out[-1] = (out[-1][0], 1e6, 0.0)
    return out


@pytest.mark.parametrize("shape", ["rising", "falling", "waves", "drop"])
@pytest.mark.parametrize("range_rows,edge", [(10**6, 1000), (9, 2), (20, 3)])
def test_equals_brute_force(spark, shape, range_rows, edge):
    data = drawn(75, 3, shape)
    steps = isotonic.fit(spark.createDataFrame(data, ROW).repartition(4), range_rows, edge)
    expected = brute(data)
    rows = sorted(tuple(r) for r in steps.collect())
    assert all(a[2] < b[2] and a[1] < b[0] for a, b in zip(rows, rows[1:]))
    for score, value in expected:
        (own,) = [r for r in rows if r[0] <= score <= r[1]]
        assert own[2] == pytest.approx(value, abs=1e-12)
    points = [i / 200 - 0.1 for i in range(240)] + [r[0] for r in data]
    frame = spark.createDataFrame([(p,) for p in sorted(set(points))] + [(None,)], "score double").repartition(3)
    found = isotonic.with_value(frame, steps, "score", "v", range_rows=max(range_rows, 40)).collect()
    assert len(found) == len(set(points)) + 1
    for r in found:
        assert (r["v"] is None) if r["score"] is None else r["v"] == pytest.approx(at(expected, r["score"]), abs=1e-12)


def test_a_million_falling_scores(spark):
    """Every range is one pool, and all of them end in one."""
    n = 1_000_000
    rows = spark.range(n).select(
        (F.col("id") / n).alias("score"), F.lit(1.0).alias("weight"), (1 - F.col("id") / n).alias("total")
    )
    (pool,) = isotonic.fit(rows, range_rows=100_000, edge_pools=2).collect()
    assert (pool["first"], pool["last"]) == (0.0, (n - 1) / n)
    assert pool["value"] == pytest.approx(0.5 + 0.5 / n)


def test_one_low_score_swallows_all(spark):
    n = 20_000
    rows = spark.range(n).select(
        F.col("id").cast("double").alias("score"),
        F.when(F.col("id") == n - 1, 1e12).otherwise(1.0).alias("weight"),
        F.when(F.col("id") == n - 1, 0.0).otherwise(F.col("id") / n).alias("total"),
    )
    found = isotonic.fit(rows, range_rows=6_000, edge_pools=100).collect()
    assert max(found, key=lambda r: r["last"])["value"] < 1e-6
    assert sum(r["last"] - r["first"] + 1 for r in found) == n


def test_empty_and_equal(spark):
    none = spark.createDataFrame([], ROW)
    assert isotonic.fit(none).count() == 0
    points = spark.createDataFrame([(0.5,)], "score double")
    assert isotonic.with_value(points, isotonic.fit(none), "score", "v").first()["v"] is None
    flat = isotonic.fit(spark.createDataFrame([(0.1, 2.0, 1.0), (0.2, 4.0, 2.0)], ROW))
    assert [tuple(r) for r in flat.collect()] == [(0.1, 0.2, 0.5)]


def test_calibrate_keeps_rows_and_nulls(spark):
    fit_on = spark.createDataFrame([(0.1, 0), (0.1, 1), (0.3, 0), (0.9, 1), (None, 1)], "score double, label int")
    apply_to = spark.createDataFrame([(0.1, "a"), (0.1, "b"), (0.6, "c"), (2.0, "d"), (None, "e")], "score double, id string")
    out = calibrate.calibrate(fit_on, apply_to, "isotonic")
    found = {r["id"]: r["calibrated"] for r in out.collect()}
    assert found == {"a": pytest.approx(1 / 3), "b": pytest.approx(1 / 3), "c": pytest.approx(2 / 3), "d": 1.0, "e": None}


def test_neighbours_do_not_depend_on_blocks(spark):
    steps = spark.createDataFrame([(float(i * i), i) for i in range(12)], "at double, item int")
    rows = spark.createDataFrame([(float(v), v) for v in range(-3, 130)] + [(None, 0)], "value double, id int")
    for block in (10, 1000):
        out = ordered.neighbours(rows.repartition(5), steps, "value", "at", "item", block)
        for r in out.collect():
            v = r["value"]
            before = None if v is None else max((i for i in range(12) if i * i <= v), default=None)
            after = None if v is None else min((i for i in range(12) if i * i > v), default=None)
            assert (r["_before"], r["_after"]) == (before, after)
