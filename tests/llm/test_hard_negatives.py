import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from buildup.llm import hard_negatives
from tests.llm.conftest import CLASH, bag

SCHEMA = "vec_id bigint, label bigint, v array<bigint>"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(data, positives=5, negatives=10, low=30, high=90):
    data = [r for r in data if None not in r and None not in r[2]]
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for i, anchor in enumerate(data):
        if anchor[0] % 4:
            continue
        others = [(-score(anchor, r), r[0], r[1] == anchor[1]) for j, r in enumerate(data) if j != i]
        for p, positive_id, _ in sorted(r for r in others if r[2])[:positives]:
            inside = sorted(r[:2] for r in others if not r[2] and -low * p <= -100 * r[0] <= -high * p)
            for rank, (s, i_) in enumerate(inside[:negatives], 1):
                out.append((anchor[0], positive_id, rank, i_, -p, -s))
    return sorted(out, key=repr)


def mined(df, **kw):
    found = hard_negatives.mine(df, F.col("vec_id") % 4 == 0, "vec_id", F.col("label"), F.col("v"), **kw)
    return bag(found, *COLUMNS)


def table(n, dim, seed=1, spread=40, labels=3):
    draw = random.Random(seed)
    return [(i, draw.randrange(labels), [draw.randint(-spread, spread) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("side", [1, 4, 30])
def test_equals_brute_force(spark, side):
    """Few seed rows, small tasks and small groups of anchors, and many equal scores."""
    data = table(300, 6, spread=3) + [(i, 1, [3, 3, 3, 3, 3, 3]) for i in range(300, 400)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    df = df.select("*", *[F.lit("x").alias(c) for c in CLASH if c != "vec_id"])
    assert mined(df, side=side, seed_rows=20, part_rows=50, group_rows=30) == brute(data)


def test_awkward_rows(spark):
    data = table(60, 5, seed=2) + [
        (None, 1, [1, 2, 3, 4, 5]),
        (1000, None, [1, 2, 3, 4, 5]),
        (1004, 1, None),
        (1008, 1, [1, None, 3, 4, 5]),
        (1012, 1, [0, 0, 0, 0, 0]),
        (1016, 1, []),
        (1020, 2, [40, 40]),
        (1024, 9, [1, 1, 1, 1, 1]),
        (1028, 1, [2**40, -(2**38), 7, 2**33, 1]),
        (1029, 1, [2**20, 2**19, 2**18, 5, 3]),
        (1030, 2, [2**20, 2**19, 2**17, 5, 3]),
    ]
    assert mined(spark.createDataFrame(data, SCHEMA)) == brute(data)


def test_repeated_ids(spark):
    data = table(40, 4, seed=3) + [(8, 0, [9, 9, 9, 9]), (8, 2, [30, -7, 5, 1])]
    assert mined(spark.createDataFrame(data, SCHEMA).repartition(3)) == brute(data)


def test_one_dimension_and_few_rows(spark):
    for data in ([(4, 1, [7])], table(2, 1), table(9, 1, labels=2)):
        assert mined(spark.createDataFrame(data, SCHEMA)) == brute(data)


def test_empty_and_no_anchor(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, 1, [1, 2]), (2, 1, [3, 4])], SCHEMA)) == []


def test_walk_goes_down_over_all_cells():
    draw = np.random.default_rng(4)
    first, second = draw.integers(-9, 9, 7).astype(float), draw.integers(-9, 9, 5).astype(float)
    found = list(hard_negatives.walk(first, second))
    assert sorted((i, j) for _, i, j in found) == [(i, j) for i in range(7) for j in range(5)]
    bounds = [b for b, *_ in found]
    assert bounds == sorted(bounds, reverse=True)
    assert all(b == first[i] + second[j] for b, i, j in found)


def test_bounds_hold_and_prune():
    """On clustered rows the certified cells are a small part of all."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16)) * 200
    rows = np.floor(centres[draw.integers(0, 12, 3000)] + draw.normal(size=(3000, 16)) * 8)
    index = hard_negatives.Index(rows[:1000], 12)
    first, second = (hard_negatives.nearest(h, b) for h, b in zip(index.halves(rows), index.books))
    for i, (own, distance) in enumerate((first, second)):
        np.maximum.at(index.radii[i], own, distance)
    np.add.at(index.rows, (first[0], second[0]), 1)
    for anchor in rows[:20]:
        (f, s), (fl, sl) = index.bounds(anchor)
        score = rows @ anchor
        assert (score <= f[first[0]] + s[second[0]]).all() and (score >= fl[first[0]] + sl[second[0]]).all()
        top = np.sort(score)[-5]
        cells = list(hard_negatives.visits(index, anchor, np.inf, None))
        cells += list(hard_negatives.visits(index, anchor, np.inf, float(top)))
        assert len(cells) == len(set(cells))
        read = sum(index.rows[c] for c in cells)
        assert read < 0.8 * len(rows)
        inside = set(cells)
        assert all((a, b) in inside for a, b in zip(first[0][score >= top], second[0][score >= top]))
