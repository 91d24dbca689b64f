"""Nested JSON downloads: one competition list, match lists, one event file per match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildup.session import stage
from buildup.sources import readers, schemas

# Field layout of an event object; nested names are flattened with an underscore.
_NAMED = "struct<id:bigint,name:string>"
_EVENT = f"""
    id string, `index` bigint, period bigint, timestamp string, minute bigint, second bigint,
    possession bigint, type {_NAMED}, team {_NAMED}, possession_team {_NAMED}, player {_NAMED},
    location array<double>, pass struct<end_location:array<double>>,
    carry struct<end_location:array<double>>,
    shot struct<end_location:array<double>,outcome:{_NAMED},type:{_NAMED},body_part:{_NAMED},
        freeze_frame:array<struct<teammate:boolean,location:array<double>,position:{_NAMED}>>>
"""
_MATCH = (
    "match_id bigint, competition struct<competition_id:bigint>, season struct<season_id:bigint>"
)


def read_competitions(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_json(spark, path, schemas.COMPETITION).where("competition_id is not null")


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    rows = readers.read_json(spark, path, _MATCH).where("match_id is not null")
    return rows.select("match_id", "competition.competition_id", "season.season_id")


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """Flat event table; the match id is the file name. An unreadable file has no rows here."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json", 1)
    rows = readers.read_json(spark, path, _EVENT).withColumn("match_id", name.try_cast("bigint"))
    return _flat(rows.where("id is not null and match_id is not null"))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(
        "id", "match_id", "possession", "index",
        F.col("type.name").alias("type"),
        F.col("team.name").alias("team"),
        F.col("possession_team.name").alias("possession_team"),
        "location",
        F.col("pass.end_location").alias("pass_end_location"),
        F.col("carry.end_location").alias("carry_end_location"),
        F.col("shot.end_location").alias("shot_end_location"),
        F.col("shot.outcome.name").alias("shot_outcome"),
        F.col("shot.type.name").alias("shot_type"),
        F.col("shot.body_part.name").alias("shot_body_part"),
        F.col("player.id").alias("player_id"),
        F.col("player.name").alias("player"),
        F.col("shot.freeze_frame").alias("shot_freeze_frame"),
        "timestamp", "period", "minute", "second",
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)``: every file below ``path`` as one text."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), "value")


def parse_event_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat events of the texts that can be read, and the rejected files.

    ``texts`` has ``file`` and ``value``, a JSON array of events or one event. A rejected file comes with the
    ``reason``, its length and how it begins; a file is read whole or not at all. An empty array has no events and
    is no failure. Events without an id, which the array reader would pass over, reject their file too.
    """
    schema = f"array<struct<{_EVENT.strip()}>>"
    name = F.regexp_extract(F.col("file"), r"(?:^|/)(\d+)\.json$", 1)
    whole = F.when(F.ltrim(F.col("value")).startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    parsed = texts.select(
        "file",
        "value",
        name.try_cast("bigint").alias("match_id"),
        F.from_json(whole, schema).alias("events"),
    )
    reason = (
        F.when(F.col("match_id").isNull(), "no match id")
        .when(F.col("events").isNull() | F.exists("events", lambda e: e.isNull()), "broken")
        .when(F.exists("events", lambda e: e["id"].isNull()), "event without id")
    )
    judged = stage(parsed.withColumn("reason", reason), "event-files")
    rejected = judged.where("reason is not null").select(
        "file", "reason", F.length("value").cast("bigint").alias("length"), F.left("value", F.lit(80)).alias("head")
    )
    rows = judged.where("reason is null").select("match_id", F.explode("events").alias("e")).select("match_id", "e.*")
    return _flat(rows), rejected


def collect(
    spark: SparkSession, root: str, countries: Sequence[str], season: str
) -> DataFrame:
    """Events of the wanted countries and season from a download folder."""
    return readers.collect_events(
        read_competitions(spark, f"{root}/competitions.json"),
        read_matches(spark, f"{root}/matches/*/*.json"),
        read_event_files(spark, f"{root}/events/*.json"),
        countries,
        season,
    )
