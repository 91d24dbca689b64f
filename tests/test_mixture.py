import math
import random

import pytest

from buildup.operators import mixture

ROW = "id int, context int, x double, y double, end_x double, end_y double"


def drawn(n, seed=1):
    """Two groups of positions; context 3 has mostly the first, context 4 mostly the second."""
    draw, out = random.Random(seed), []
    for i in range(n):
        context = draw.choice((3, 4))
        first = draw.random() < (0.9 if context == 3 else 0.2)
        mean = (0.2, 0.3, 0.4, 0.5) if first else (0.7, 0.8, 0.6, 0.2)
        spread = (0.04, 0.04, 0.1, 0.05)
        out.append((i, context, *[draw.gauss(m, s) for m, s in zip(mean, spread)]))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(drawn(3000), ROW).cache()


def density(model, row):
    """Log density of one row, written out."""
    weights = model.weights.get(row[1], model.overall)
    parts = []
    for w, part in zip(weights, model.components):
        terms = [
            -0.5 * ((v - m) / d) ** 2 - math.log(d) - 0.5 * math.log(2 * math.pi)
            for v, m, d in zip(row[2:], part.mean, part.deviation)
        ]
        parts.append(w * math.exp(sum(terms)))
    return math.log(sum(parts))


def test_fit_finds_the_groups(rows):
    model = mixture.fit(rows, 2)
    first, second = sorted(range(2), key=lambda i: model.components[i].mean[0])
    for i, mean, spread in ((first, (0.2, 0.3, 0.4, 0.5), (0.04, 0.04, 0.1, 0.05)), (second, (0.7, 0.8, 0.6, 0.2), None)):
        assert model.components[i].mean == pytest.approx(mean, abs=0.01)
        assert spread is None or model.components[i].deviation == pytest.approx(spread, abs=0.006)
    assert model.weights[3][first] == pytest.approx(0.9, abs=0.03)
    assert model.weights[4][first] == pytest.approx(0.2, abs=0.03)


def test_likelihood_never_falls(rows):
    for k in (1, 3, 5):
        trace = mixture.fit(rows, k).trace
        assert all(b >= a - 1e-12 for a, b in zip(trace, trace[1:]))
        assert trace[-1] - trace[-2] < mixture.TOLERANCE


def test_does_not_depend_on_partitions(rows):
    one, many = mixture.fit(rows.coalesce(1), 3), mixture.fit(rows.repartition(13), 3)
    assert len(one.trace) == len(many.trace)
    for a, b in zip(one.components, many.components):
        assert a.mean == pytest.approx(b.mean, abs=1e-7) and a.deviation == pytest.approx(b.deviation, abs=1e-7)


def test_log_density_and_unseen_contexts(spark):
    data = drawn(200) + [(1000, 9, 0.5, 0.5, 0.5, 0.5), (1001, 0, 0.1, 0.9, 5.0, -3.0)]
    frame = spark.createDataFrame(data, ROW)
    parts = (mixture.Component((0.2, 0.3, 0.4, 0.5), (0.1,) * 4), mixture.Component((0.7, 0.8, 0.6, 0.2), (0.1, 0.1, 0.2, 0.3)))
    model = mixture.Mixture(parts, {3: (0.9, 0.1), 4: (0.0, 1.0)}, (0.5, 0.5))
    found = {r["id"]: r["log_density"] for r in mixture.with_log_density(frame, model).collect()}
    assert found == pytest.approx({r[0]: density(model, r) for r in data}, rel=1e-9)


def test_deviations_keep_their_bounds(spark):
    same = spark.createDataFrame([(i, 3, 0.5, 0.5, 0.5, 0.5) for i in range(20)], ROW)
    wide = spark.createDataFrame([(i, 3, i % 2, 1 - i % 2, 3.0 * (i % 2), -3.0 * (i % 2)) for i in range(20)], "id int, context int, x int, y int, end_x double, end_y double")
    low, high = mixture.START_BOUNDS, mixture.END_BOUNDS
    assert mixture.fit(same, 1).components[0].deviation == (low[0], low[0], high[0], high[0])
    assert mixture.fit(wide, 1).components[0].deviation == (low[1], low[1], high[1], high[1])


def test_fails_when_it_does_not_settle(rows):
    with pytest.raises(RuntimeError):
        mixture.fit(rows, 3, max_steps=2)
