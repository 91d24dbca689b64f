import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from buildup.operators import events as ev
from buildup.operators import sequences as seq
from buildup.plans.movement import all_events
from buildup.sources import publish, sinks

BY = ["variant", "split"]
PARTS = [(v, s) for v in ("a", "b 2") for s in ("train", "val", "empty")]


@pytest.fixture
def builder(spark):
    """Rows of every part but the empty ones, whatever is asked for, and the log of what was."""
    log = []

    def build(parts):
        log.append(list(parts))
        rows = spark.range(40).withColumn("variant", F.when(F.col("id") % 2 == 0, "a").otherwise("b 2"))
        return rows.withColumn("split", F.when(F.col("id") % 5 == 0, "val").otherwise("train"))

    return build, log


def files(path):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(path, "data").rglob("*.parquet")}


def rows(spark, path):
    return sorted(tuple(r) for r in publish.read(spark, path, "id bigint, variant string, split string").collect())


def test_only_missing_parts_are_built(spark, builder, tmp_path):
    build, log = builder
    path = str(tmp_path / "set")
    assert publish.publish(spark, path, BY, PARTS, build) == PARTS
    assert publish.publish(spark, path, BY, PARTS, build) == [] and len(log) == 1
    before, whole = files(path), rows(spark, path)
    assert len(whole) == 40
    publish.drop(spark, path, BY, ("b 2", "val"))
    assert len(rows(spark, path)) == 36
    assert publish.publish(spark, path, BY, PARTS, build) == [("b 2", "val")] and log[1:] == [[("b 2", "val")]]
    assert rows(spark, path) == whole
    kept = {p: t for p, t in before.items() if os.path.exists(p)}
    assert len(kept) == len([p for p in before if not ("variant=b" in p and "split=val" in p)])
    assert all(files(path)[p] == t for p, t in kept.items())
    last = {(r.variant, r.split): (r.rows, r.builds) for r in publish.latest(publish.manifest(spark, path, BY), BY).collect()}
    assert last == {("a", "train"): (16, 1), ("a", "val"): (4, 1), ("b 2", "train"): (16, 1), ("b 2", "val"): (4, 2),
                    ("a", "empty"): (0, 1), ("b 2", "empty"): (0, 1)}


def test_half_written_parts_are_not_taken_as_done(spark, builder, tmp_path):
    build, _ = builder
    path = str(tmp_path / "set")
    # a job that died: files without an entry
    build([]).where("variant = 'a'").limit(3).write.partitionBy(*BY).parquet(f"{path}/data")
    assert publish.publish(spark, path, BY, PARTS[:2], build) == PARTS[:2]
    assert len(rows(spark, path)) == 20
    # a file that was cut, and a file too many
    (one,) = [p for p in files(path) if "split=val" in p][:1]
    Path(one).write_bytes(Path(one).read_bytes()[:-7])
    assert publish.missing(spark, path, BY, PARTS[:2]) == [("a", "val")]
    build([]).select("id").limit(1).write.mode("append").parquet(publish.part_path(path, BY, ("a", "train")))
    assert publish.publish(spark, path, BY, PARTS[:2], build) == PARTS[:2][::-1] or publish.missing(spark, path, BY, PARTS[:2]) == []
    assert len(rows(spark, path)) == 20


def test_a_part_that_becomes_empty_loses_its_files(spark, builder, tmp_path):
    build, _ = builder
    path = str(tmp_path / "set")
    publish.publish(spark, path, BY, PARTS[:1], build)
    build([]).select("id").limit(1).write.mode("append").parquet(publish.part_path(path, BY, PARTS[0]))
    publish.publish(spark, path, BY, PARTS[:1], lambda parts: build(parts).where("false"))
    assert not files(path) and publish.missing(spark, path, BY, PARTS[:1]) == []


def test_bucketed_events_need_no_exchange(spark, sf_dir, tmp_path):
    events = sinks.bucketed(all_events(spark, sf_dir), str(tmp_path / "by-possession"), seq.KEYS, "index", buckets=4)
    out = seq.explode(seq.from_events(ev.movement_events(events)).select(*seq.KEYS, "events"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan and "Bucketed: true" in plan
    plain = seq.explode(seq.from_events(ev.movement_events(all_events(spark, sf_dir))).select(*seq.KEYS, "events"))
    assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
    assert out.exceptAll(plain).isEmpty() and plain.exceptAll(out).isEmpty()
