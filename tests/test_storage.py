import random

import pytest
from pyspark.sql import functions as F

from buildup.operators import sketches
from buildup.plans import storage
from buildup.plans.movement import all_events
from buildup.sources import readers, sinks


def scanned(df) -> int:
    """Rows that the file scan put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


@pytest.fixture
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lookups_skip_row_groups(spark, tmp_path, plain_plans):
    rows = spark.range(200_000).select(
        (2 * F.floor(F.col("id") / 50)).cast("bigint").alias("match_id"),
        (F.col("id") % 5).alias("possession"),
        F.col("id").alias("index"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    )
    path = str(tmp_path / "sorted")
    sinks.write_for_lookup(rows.repartition(6, "index"), path, ["match_id", "possession"], "index", 1 << 18)
    table = spark.read.parquet(path)
    assert scanned(table) == 200_000
    one = table.where("match_id = 4000 and possession = 3")
    assert one.count() == 10
    assert scanned(one) <= 40_000
    # within the range of the statistics, but an odd id does not occur
    assert scanned(table.where("match_id = 4001")) == 0


def test_lookup_of_the_event_table(spark, sf_dir, plain_plans):
    path = storage.lookup_table(spark, sf_dir, 1 << 14)
    table = readers.read_events(spark, path)
    wanted = table.where("match_id = 8 and possession = 1")
    whole = all_events(spark, sf_dir).where("match_id = 8 and possession = 1")
    assert wanted.select(whole.columns).exceptAll(whole).isEmpty() and wanted.count() == whole.count() > 0
    assert scanned(wanted) < scanned(table) / 2


def test_merged_sketches_keep_their_rank_error(spark):
    draw = random.Random(2)
    data = [(m, int(draw.paretovariate(1.1) * 3)) for m in range(200) for _ in range(draw.randint(1, 400))]
    rows = spark.createDataFrame(data, "match_id bigint, n_events int").repartition(5)
    stored = sketches.length_sketches(rows)
    sets = spark.range(200).select(F.col("id").alias("match_id"), F.explode(F.array(F.lit("all"), (F.col("id") % 2).cast("string"))).alias("name"))
    points = [0.01, 0.1, 0.5, 0.9, 0.99]
    found = sketches.merged_quantiles(stored, sets, ["name"], points).collect()
    assert len(found) == 15
    for r in found:
        own = [v for m, v in data if r["name"] in ("all", str(m % 2))]
        assert r["n"] == len(own)
        low, high = sum(v < r["length"] for v in own) / len(own), sum(v <= r["length"] for v in own) / len(own)
        assert low - 0.01 <= r["point"] <= high + 0.01


def test_bitmaps_count_distinct_values_exactly(spark):
    draw = random.Random(3)
    data = [(m, f"p{draw.randrange(3000)}" if draw.random() < 0.95 else None) for m in range(40) for _ in range(300)]
    rows = spark.createDataFrame(data, "match_id bigint, player string").repartition(7)
    coded = rows.join(sketches.codes(rows, "player"), "player", "left")
    sets = spark.range(40).select(F.col("id").alias("match_id"), (F.col("id") % 3).alias("s"))
    found = {r["s"]: r["n"] for r in sketches.distinct_codes(sketches.bitmaps(coded, F.col("code")), sets, ["s"]).collect()}
    assert found == {s: len({p for m, p in data if m % 3 == s and p is not None}) for s in range(3)}
    assert sketches.bitmaps(coded.where("false"), F.col("code")).count() == 0


def test_stored_bitmaps_are_short_and_never_broadcast(spark):
    codes = [0, 7, 8, 32766, 32767, 70_000]
    rows = spark.createDataFrame([(m, c) for m in range(3) for c in codes[: 2 * m + 2]] + [(None, 5), (1, None)], "match_id bigint, code bigint")
    stored = sketches.bitmaps(rows, F.col("code"))
    sizes = {(r["match_id"], r["bucket"]): len(r["bitmap"]) for r in stored.where("match_id is not null").collect()}
    assert sizes[0, 1] == 1 and sizes[1, 1] == 4096 and sizes[2, 3] < 4096
    sets = spark.range(3).select(F.col("id").alias("match_id"), F.explode(F.array(F.lit("all"), F.col("id").cast("string"))).alias("s"))
    merged = sketches.distinct_codes(stored, sets, ["s"])
    assert {r["s"]: r["n"] for r in merged.collect()} == {"all": 6, "0": 2, "1": 4, "2": 6}
    each = sketches.distinct_codes(stored, sets, ["s", "match_id"])
    assert sorted(tuple(r) for r in each.collect()) == sorted((s, m, 2 * m + 2) for m in range(3) for s in ("all", str(m)))
    for found in (merged, each):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
