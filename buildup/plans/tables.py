"""Queries on sources, sinks and table shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildup import ordered, session
from buildup.functions import labels
from buildup.operators import events as ev
from buildup.operators import features, profile, splits
from buildup.operators import sequences as seq
from buildup.plans import views
from buildup.plans.evaluation import scored
from buildup.plans.movement import all_events, big, moves, sequences
from buildup.plans.registry import query
from buildup.sources import readers, schemas, sinks, standin

KEYS = seq.KEYS


_VOCAB_SQL = " ".join(f"WHEN '{k}' THEN {v}" for k, v in labels.VOCAB.items())


@query("vocab_lookup", f"""{views.SEQ}
SELECT CASE type {_VOCAB_SQL} END::BIGINT AS id, type AS token, count(*) AS n FROM tok GROUP BY type""")
def vocab_lookup(spark, sf_dir):
    """Token counts by id, the ids read from a written vocabulary and mapped back to names."""
    path = session.new_table_path(spark, "vocab")
    sinks.write_vocab(spark, labels.VOCAB, path)
    vocab = readers.read_vocab(spark, path)
    counts = seq.explode(sequences(spark, sf_dir)).groupBy(F.col("type").alias("token")).agg(
        F.count("*").alias("n")
    )
    rows = counts.join(F.broadcast(vocab), "token")
    return rows.select(*big("id"), labels.type_name(F.col("id")).alias("token"), "n")


@query("season_label", """SELECT o_orderkey, concat(year(o_orderdate), '_', year(o_orderdate) + 1) AS season
FROM orders""")
def season_label(spark, sf_dir):
    year = F.year("o_orderdate")
    season = F.concat_ws("/", year.cast("string"), (year + 1).cast("string"))
    rows = standin.table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", labels.season_label(season).alias("season"))


_INGEST = """WITH comp AS (SELECT n_nationkey::BIGINT AS competition_id, (n_regionkey % 2)::BIGINT AS season_id,
    n_name AS country_name, concat('201', n_regionkey % 2 + 5, '/201', n_regionkey % 2 + 6) AS season_name FROM nation),
matches AS (SELECT c_custkey AS match_id, c_nationkey::BIGINT AS competition_id,
    (n_regionkey % 2)::BIGINT AS season_id FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def ingest_tables(spark, sf_dir):
    nation = standin.table(spark, sf_dir, "nation")
    season = (F.col("n_regionkey") % 2).cast("bigint")
    competitions = nation.select(
        F.col("n_nationkey").cast("bigint").alias("competition_id"),
        season.alias("season_id"),
        F.col("n_name").alias("country_name"),
        F.format_string("201%d/201%d", season + 5, season + 6).alias("season_name"),
    )
    matches = standin.table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    matches = matches.select(
        F.col("c_custkey").alias("match_id"),
        F.col("c_nationkey").cast("bigint").alias("competition_id"),
        season.alias("season_id"),
    )
    events = standin.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("match_id"), F.col("o_orderkey").alias("index"),
        F.col("o_orderpriority").alias("type"),
    )
    return competitions, matches, events


@query("ingest_join", f"""{_INGEST}
SELECT o_custkey AS match_id, o_orderkey AS index, o_orderpriority AS type, country_name AS league,
  season_name AS season FROM orders JOIN matches ON match_id = o_custkey JOIN comp USING (competition_id, season_id)
WHERE season_name = '2016/2017' AND country_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 2, 3, 17, 24))""")
def ingest_join(spark, sf_dir):
    competitions, matches, events = ingest_tables(spark, sf_dir)
    nations = standin.table(spark, sf_dir, "nation").where(F.col("n_nationkey").isin(1, 2, 3, 17, 24))
    countries = [r[0] for r in nations.select("n_name").collect()]  # five rows
    return readers.collect_events(competitions, matches, events, countries, "2016/2017")


@query("ingest_write_roundtrip", f"""{_INGEST}
SELECT country_name AS league, replace(season_name, '/', '_') AS season, count(*) AS n,
  CAST(sum(o_orderkey) AS BIGINT) AS checksum FROM orders JOIN matches ON match_id = o_custkey
JOIN comp USING (competition_id, season_id) GROUP BY 1, 2""")
def ingest_write_roundtrip(spark, sf_dir):
    """Events written by league and season, read back through the partition columns."""
    competitions, matches, events = ingest_tables(spark, sf_dir)
    picked = matches.join(competitions, ["competition_id", "season_id"]).select(
        "match_id", F.col("country_name").alias("league"), F.col("season_name").alias("season")
    )
    path = session.new_table_path(spark, "ingest")
    sinks.write_events(events.join(picked, "match_id"), path)
    rows = spark.read.schema(
        "match_id bigint, index bigint, type string, league string, season string"
    ).parquet(path)
    return rows.groupBy("league", "season").agg(
        F.count("*").alias("n"), F.sum("index").alias("checksum")
    )


@query("union_by_name", """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment,
  NULL::BIGINT AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier""")
def union_by_name(spark, sf_dir):
    customers = standin.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as key", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment"
    )
    suppliers = standin.table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_nationkey as bigint) as nation", "s_acctbal as balance", "s_name as name", "s_suppkey as key"
    )
    return readers.combine([customers, suppliers])


@query("event_scan", f"""{views.EV}
SELECT type, count(*) AS n, count(x) AS located FROM ev GROUP BY type""")
def event_scan(spark, sf_dir):
    """A written event table, read again with two of its columns."""
    path = session.new_table_path(spark, "event-table")
    all_events(spark, sf_dir).write.parquet(path)
    rows = readers.read_events(spark, path, ["type", "location"])
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.count("location").alias("located"))


@query("essential_columns", f"""{views.EV}
SELECT index, type, x, y, possession, possession_team, minute, second, team, player, match_id, pass_x, pass_y,
  carry_x, carry_y, shot_outcome FROM ev""")
def essential_columns(spark, sf_dir):
    return ev.with_coordinates(readers.select_existing(all_events(spark, sf_dir), readers.ESSENTIAL_COLUMNS))


@query("drop_all_null_columns", f"""{views.EV}
SELECT match_id, possession, index, type, team, possession_team, x, y, pass_x, pass_y, carry_x, carry_y,
  shot_outcome, shot_type, player, minute, second FROM ev""")
def drop_all_null_columns(spark, sf_dir):
    return ev.with_coordinates(features.drop_all_null_columns(all_events(spark, sf_dir)))


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_FILLED = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS non_null FROM orders" for c in _ORDER_COLUMNS)


@query("schema_columns", f"""SELECT column_name, CASE column_type WHEN 'VARCHAR' THEN 'string'
    WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS column_type, non_null
FROM (DESCRIBE orders) JOIN ({_FILLED}) USING (column_name) WHERE contains(lower(column_name), 'order')""")
def schema_columns(spark, sf_dir):
    """Column names and types that contain a text, with their filled rows."""
    orders = standin.table(spark, sf_dir, "orders")
    filled = profile.null_profile(orders).select("column_name", "non_null")
    return readers.schema_columns(orders, contains="ORDER").join(F.broadcast(filled), "column_name")


@query("dim_map_lookup", f"""{views.MV}, d AS (
  SELECT *, row_number() OVER (PARTITION BY match_id, possession ORDER BY index) AS rn FROM mv)
SELECT match_id, possession, index, player AS full_name, s_name AS player
FROM d LEFT JOIN (SELECT concat('P', s_suppkey) AS p, s_name FROM supplier) s ON p = player
WHERE rn > 1""")
def dim_map_lookup(spark, sf_dir):
    """Players renamed through a dictionary; the first event of each possession is left out."""
    names = standin.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("P"), F.col("s_suppkey")).alias("full_name"), F.col("s_name").alias("short_name")
    )
    rows = features.map_names(moves(spark, sf_dir), "player", "full_name", names)
    rows = ordered.position(rows, KEYS, "index", "rn").where("rn > 1")
    return rows.select(*KEYS, "index", "full_name", "player")


@query("csv_roundtrip", f"""{views.SCORED}
SELECT score AS "xT", label, count(*) AS n FROM scored GROUP BY ALL""")
def csv_roundtrip(spark, sf_dir):
    """Predictions written as CSV and read back with their schema."""
    path = session.new_table_path(spark, "predictions")
    sinks.write_csv(scored(spark, sf_dir).select(F.col("score").alias("xT"), "label"), path)
    rows = readers.read_csv(spark, path, schemas.PREDICTION)
    return rows.groupBy("xT", "label").agg(F.count("*").alias("n"))


@query("split_write_roundtrip", f"""{views.SEQ}, parts AS (SELECT *, {views.SPLIT_OF} AS split FROM poss)
SELECT 'nofilter_ctx14' AS variant, split, count(*) AS possessions,
  CAST(sum(sequence_length) AS BIGINT) AS tokens, CAST(sum(goal) AS BIGINT) AS goals FROM parts GROUP BY split""")
def split_write_roundtrip(spark, sf_dir):
    """Sequence table written by variant and split, read back with partition pruning."""
    rows = splits.with_split(seq.normalize(sequences(spark, sf_dir)))
    rows = rows.withColumn("variant", F.lit(sinks.variant_name("nofilter")))
    path = session.new_table_path(spark, "splits")
    sinks.write_splits(rows, path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("variant", "split").agg(
        F.count("*").alias("possessions"),
        F.sum(F.size("events")).cast("bigint").alias("tokens"),
        F.sum("goal").cast("bigint").alias("goals"),
    )
