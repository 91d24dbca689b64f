"""Readers, writers and plan shapes."""

import json

import pytest
from pyspark.sql import functions as F

from buildup import session
from buildup.functions.labels import VOCAB
from buildup.operators import sequences as seq
from buildup.operators import splits
from buildup.plans.movement import moves
from buildup.sources import json_files, readers, schemas, sinks, standin


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv(spark, tmp_path):
    assert readers.read_csv(spark, str(tmp_path / "none.csv"), schemas.PREDICTION, missing_ok=True) is None
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "none.csv"), schemas.PREDICTION)
    text = 'phase,run_name,description,carry_threshold,context_length\nP1,r1,"a, b",2,14\nP5,r2,c,,\n'
    (tmp_path / "runs.csv").write_text(text)
    rows = readers.read_csv(spark, str(tmp_path / "runs.csv"), schemas.EXPERIMENT.__class__(schemas.EXPERIMENT.fields[:5]))
    got = rows.orderBy("run_name").collect()
    assert got[0].description == "a, b" and got[0].carry_threshold == 2.0
    assert got[1].carry_threshold is None and got[1].context_length is None


def test_vocab(spark, tmp_path):
    sinks.write_vocab(spark, VOCAB, str(tmp_path / "vocab"))
    assert {r.token: r.id for r in readers.read_vocab(spark, str(tmp_path / "vocab")).collect()} == VOCAB


def test_variant_names_do_not_collide():
    names = {sinks.variant_name("threshold", t) for t in (2, 2.5, 3)} | {sinks.variant_name("adaptive")}
    assert len(names) == 4


def test_json_download(spark, tmp_path):
    named = lambda n: {"id": 1, "name": n}
    (tmp_path / "matches" / "11").mkdir(parents=True)
    (tmp_path / "events").mkdir()
    (tmp_path / "competitions.json").write_text(json.dumps([
        {"competition_id": 11, "season_id": 27, "country_name": "Spain", "season_name": "2015/2016"},
        {"competition_id": 12, "season_id": 27, "country_name": "Italy", "season_name": "2015/2016"},
    ]))
    match = lambda i, c: {"match_id": i, "competition": {"competition_id": c}, "season": {"season_id": 27}}
    (tmp_path / "matches" / "11" / "27.json").write_text(json.dumps([match(1, 11), match(2, 12), match(3, 11)]))
    events = [
        {"id": "a", "index": 1, "possession": 1, "type": named("Pass"), "team": named("H"),
         "possession_team": named("H"), "location": [1.0, 2.0], "pass": {"end_location": [3.0, 4.0]}},
        {"id": "b", "index": 2, "possession": 1, "type": named("Shot"), "team": named("H"),
         "possession_team": named("H"), "location": [110.0, 40.0],
         "shot": {"end_location": [120.0, 40.0, 1.0], "outcome": named("Goal"), "type": named("Open Play")}},
    ]
    for match_id in (1, 2):
        (tmp_path / "events" / f"{match_id}.json").write_text(json.dumps(events))
    (tmp_path / "events" / "3.json").write_text("[{broken")
    rows = json_files.collect(spark, str(tmp_path), ["Spain"], "2015/2016").orderBy("index").collect()
    assert [(r.match_id, r.type, r.league) for r in rows] == [(1, "Pass", "Spain"), (1, "Shot", "Spain")]
    assert rows[0].pass_end_location == [3.0, 4.0] and rows[1].shot_outcome == "Goal"


def test_event_writer(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Pass", "Spain", "2015/2016", 5)], "match_id long, type string, league string, season string, extra int")
    sinks.write_events(rows, str(tmp_path / "e"), essential=True)
    back = spark.read.parquet(str(tmp_path / "e"))
    assert "extra" not in back.columns and back.first().season == "2015_2016"


def test_existing_table_is_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_once(spark.range(3).toDF("n"), path)
    sinks.write_once(spark.range(9).toDF("n"), path)
    assert spark.read.parquet(path).count() == 3


class Session:
    """Stands for a session with a master and one setting."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("C", (), {"master": master, "getConf": lambda _: self.conf})()


def test_shared_dir_follows_the_session():
    assert session.shared_dir(Session("yarn", "hdfs://shared/x/")) == "hdfs://shared/x"
    assert session.shared_dir(Session("local[2]")).startswith("/")
    with pytest.raises(ValueError):
        session.shared_dir(Session("yarn"))


def test_truncation_is_limited_before_the_shuffle(spark, sf_dir):
    plan = plan_of(seq.truncate_last(moves(spark, sf_dir)))
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1
    assert "PushedFilters: [In(type" in plan
    adaptive = plan_of(seq.truncate_adaptive(moves(spark, sf_dir)))
    assert adaptive.count("WindowGroupLimit") == 2 and adaptive.count("Exchange") == 1


def test_sequences_need_one_shuffle_and_no_python(spark, sf_dir):
    plan = plan_of(seq.normalize(seq.from_events(moves(spark, sf_dir))))
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Cartesian" not in plan


def test_variants_limit_rows_before_the_shuffle(spark, sf_dir):
    rows = splits.variant_possessions(moves(spark, sf_dir), [1, 2], [2, 8])
    plan = plan_of(rows)
    assert plan.count("Exchange") == 2 and plan.count("WindowGroupLimit") == 2


def test_scan_reads_only_what_is_used(spark, sf_dir):
    plan = plan_of(standin.events(spark, sf_dir).groupBy("type").agg(F.count("*")))
    assert "ReadSchema: struct<type:string>" in plan


def test_round_trips_keep_the_data_of_earlier_calls(spark):
    from __spark_entry__ import queries

    catalogue = queries()
    for name in ("csv_roundtrip", "ingest_write_roundtrip", "vocab_lookup", "split_write_roundtrip"):
        small = catalogue[name](spark, "/root/testdata/sf0.001")
        large = catalogue[name](spark, "/root/testdata/sf0.01")
        total = lambda df: df.agg({"possessions" if "possessions" in df.columns else "n": "sum"}).first()[0]
        assert 0 < total(small) < total(large)


def test_clean_removes_the_staged_tables(spark, monkeypatch, tmp_path):
    from buildup import session

    monkeypatch.setattr(session, "shared_dir", lambda spark: f"file://{tmp_path}")
    session.stage(spark.range(3), "numbers")
    assert list(tmp_path.glob("*/numbers-*"))
    session.clean(spark)
    assert not list(tmp_path.iterdir())
