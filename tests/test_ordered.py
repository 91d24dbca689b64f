"""Block-wise ordered operations against plain loops, with one group holding most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from buildup import ordered
from buildup.session import stage
from buildup.sources import standin


def make_rows(seed=3, n=400):
    """(key, order, clock, value): key 0 has a third of the rows and more; some values are null."""
    rng = random.Random(seed)
    clock = 0
    rows = []
    for order in rng.sample(range(5 * n), n):
        key = 0 if rng.random() < 0.5 else rng.randrange(1, 30)
        rows.append((key, order))
    rows.sort(key=lambda r: r[1])
    out = []
    for key, order in rows:
        clock += rng.choice([1, 1, 2, 9, 40])
        out.append((key, order, clock, None if rng.random() < 0.1 else rng.randrange(100)))
    return out


ROWS = make_rows()
SCHEMA = "key long, ord long, clock long, value long"


def by_key():
    groups = defaultdict(list)
    for row in ROWS:
        groups[row[0]].append(row)
    return groups


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.mark.parametrize("block", [1, 7, 100, 10_000])
def test_sessionize(df, block):
    out = ordered.sessionize(df, "key", "ord", "clock", 30, "session", block_rows=block)
    got = {(r.key, r.ord): r.session for r in out.collect()}
    want = {}
    for key, rows in by_key().items():
        number, last = 1, None
        for _, order, clock, _ in rows:
            if last is not None and clock - last > 30:
                number += 1
            last = clock
            want[key, order] = number
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_position_and_running_sum(df, block, descending):
    out = ordered.position(df, ["key"], "ord", "at", descending, block_rows=block)
    out = ordered.running_sum(
        out, ["key"], "ord", F.coalesce("value", F.lit(0)), "total", descending, block_rows=block
    )
    got = {(r.key, r.ord): (r.at, r.total) for r in out.collect()}
    want = {}
    for key, rows in by_key().items():
        total = 0
        for i, (_, order, _, value) in enumerate(reversed(rows) if descending else rows):
            total += value or 0
            want[key, order] = (i + 1, total)
    assert got == want


@pytest.mark.parametrize("block", [1, 3, 7, 10_000])
@pytest.mark.parametrize("count", [1, 2, 3])
@pytest.mark.parametrize("following", [False, True])
def test_lags(df, block, count, following):
    names = [f"near{i}" for i in range(count)]
    out = ordered.lags(df, ["key"], "ord", F.col("value"), names, following, block_rows=block)
    got = {(r.key, r.ord): [r[n] for n in names] for r in out.collect()}
    want = {}
    for key, rows in by_key().items():
        rows = list(reversed(rows)) if following else rows
        for i, row in enumerate(rows):
            before = [r[3] for r in reversed(rows[max(0, i - count) : i])]
            want[key, row[1]] = before + [None] * (count - len(before))
    assert got == want


def test_previous_and_following(df):
    out = ordered.previous(df, ["key"], "ord", F.col("value"), "p", block_rows=5)
    out = ordered.following(out, ["key"], "ord", F.col("value"), "f", block_rows=5)
    got = {(r.key, r.ord): (r.p, r.f) for r in out.collect()}
    for key, rows in by_key().items():
        values = [r[3] for r in rows]
        for i, row in enumerate(rows):
            before = values[i - 1] if i else None
            after = values[i + 1] if i + 1 < len(values) else None
            assert got[key, row[1]] == (before, after)


@pytest.mark.parametrize("buckets", [1, 2, 9])
def test_running_totals(spark, df, buckets):
    counts = stage(
        df.where("value is not null").groupBy("key", F.col("value").cast("double").alias("v")).agg(
            F.count("*").alias("n")
        ),
        "test",
    )
    out = ordered.running_totals(counts, "v", ["n"], ["key"], buckets)
    got = {(r.key, r.v): r.cum_n for r in out.collect()}
    for key, rows in by_key().items():
        values = [r[3] for r in rows if r[3] is not None]
        for v in set(values):
            assert got[key, float(v)] == sum(1 for w in values if w <= v)


def test_exact_quantiles_equal_percentile(df):
    got = ordered.exact_quantiles(df, "value", {"q10": 0.1, "q50": 0.5, "q99": 0.99}, ["key"])
    want = df.groupBy("key").agg(
        *[F.percentile("value", q).alias(n) for n, q in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99))]
    )
    got = {r.key: (r.q10, r.q50, r.q99) for r in got.collect()}
    for r in want.collect():
        assert got[r.key] == pytest.approx((r.q10, r.q50, r.q99))


def test_event_view_does_not_depend_on_blocks(spark, sf_dir):
    pick = lambda block: sorted(
        standin.event_view(spark, sf_dir, block_rows=block).select("index", "possession", "type").collect()
    )
    assert pick(1_000_000) == pick(50)


def test_sparse_order_values_leave_one_block_a_key(spark):
    """Summary rows are as many as keys where no key is large, however far apart the values are."""
    rows = spark.range(2000).selectExpr("id % 50 as key", "id * 1000003 as ord", "1L as value")
    blocks = ordered._with_block(rows, ["key"], "ord", 100).select("key", "_block").distinct()
    assert blocks.count() == 50
    cut = ordered._with_block(rows, ["key"], "ord", 10).groupBy("key", "_block").count()
    assert cut.count() <= 250 and cut.agg({"count": "max"}).first()[0] <= 11


@pytest.mark.parametrize("block_rows", [3, 100, 1000])
def test_blocks_are_even_whatever_the_values(spark, block_rows):
    """Dense values with one far away, values that grow by squares, and small groups beside them."""
    dense = spark.range(5_000).select(F.lit("dense").alias("k"), (F.col("id") + F.when(F.col("id") == 4_999, 10**15).otherwise(0)).alias("at"))
    squares = spark.range(5_000).select(F.lit("squares").alias("k"), (F.col("id") * F.col("id") * F.col("id")).alias("at"))
    small = spark.range(600).select((F.col("id") % 300).cast("string").alias("k"), F.col("id").alias("at"))
    rows = dense.union(squares).union(small).repartition(5)
    out = ordered._with_block(rows, ["k"], "at", block_rows)
    sizes = out.groupBy("k", "_block").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    found = sizes.orderBy("k", "_block").collect()
    assert sum(r["n"] for r in found) == 10_600
    for k in ("dense", "squares"):
        own = [r for r in found if r["k"] == k]
        assert max(r["n"] for r in own) <= max(2.2 * block_rows, block_rows + 3)
        assert len(own) >= 5_000 / block_rows / 1.5
        assert all(a["high"] < b["low"] for a, b in zip(own, own[1:]))
    assert all(r["_block"] == 0 for r in found if r["k"] not in ("dense", "squares"))
