import numpy as np
import pytest
from pyspark.sql import functions as F

from buildup.operators import threat
from buildup.plans.movement import moves


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    from buildup.session import stage

    return stage(moves(spark, sf_dir), "moves")


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("iterations", [1, 2, 7])
def test_sparse_form_equals_array_form(events, monkeypatch, few, iterations):
    if not few:
        monkeypatch.setattr(threat, "MOST_BROADCAST", 0)
    whole = {r["zone"]: r["threat"] for r in threat.zone_threat(events, iterations).collect()}
    sparse = {r["zone"]: r["threat"] for r in threat.sparse_threat(events, 12, 12, iterations).collect()}
    assert sparse == pytest.approx({z: whole[z] for z in sparse}, abs=1e-12)
    assert all(v == 0 for z, v in whole.items() if z not in sparse)


def test_settled_values_solve_the_equation(events):
    """The smallest solution of v = d + T v."""
    direct, pairs = threat.sparse_model(threat.with_zones(events, 30, 20))
    n = 600
    chances, goals = np.zeros((n, n)), np.zeros(n)
    for r in pairs.collect():
        chances[r["zone"], r["end_zone"]] = r["p"]
    for r in direct.collect():
        goals[r["zone"]] = r["direct"]
    exact = np.zeros(n)
    for _ in range(5_000):
        exact = goals + chances @ exact
    found = threat.sparse_threat(events, 30, 20).collect()
    assert {r["zone"]: r["threat"] for r in found} == pytest.approx({r["zone"]: exact[r["zone"]] for r in found}, abs=1e-7)


def test_fails_when_it_does_not_settle(events):
    with pytest.raises(RuntimeError):
        threat.sparse_threat(events, 12, 12, max_iterations=2)


def test_empty(events):
    assert threat.sparse_threat(events.where("false"), 120, 80).count() == 0


def test_with_threat_joins_by_zone(spark, events):
    model = threat.fit(events)
    rows = spark.createDataFrame([(0, 5), (1, None), (2, 143), (3, 5)], "id int, zone int")
    out = threat.with_threat(rows, model, F.col("zone"))
    assert out.columns == ["id", "zone", "score"]
    values = model.first()["threat"]
    assert {r["id"]: r["score"] for r in out.collect()} == {0: values[5], 1: None, 2: values[143], 3: values[5]}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
