"""Readers for event, dimension and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildup.sources import schemas

# Columns of the essential event output.
ESSENTIAL_COLUMNS = [
    "id", "index", "type", "location", "possession", "possession_team", "period", "minute",
    "second", "team", "player", "match_id", "timestamp", "pass_end_location",
    "carry_end_location", "shot_outcome",
]


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The wanted columns that the table has, in the wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def read_events(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Parquet event table; only ``columns`` are read from the files."""
    df = spark.read.schema(schemas.EVENT).parquet(path)
    return df.select(*columns) if columns else df


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False
) -> DataFrame | None:
    """CSV table with a header; ``None`` for a missing path when ``missing_ok``."""
    try:
        return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    except AnalysisException as error:
        if missing_ok and "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Token table (``token``, ``id``) from a JSON object of token to id."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,int>")
    return text.select(F.explode(entries).alias("token", "id"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON files of one object or array each; a broken file becomes null rows, not a failed job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def collect_events(
    competitions: DataFrame,
    matches: DataFrame,
    events: DataFrame,
    countries: Sequence[str],
    season: str,
) -> DataFrame:
    """Events of the matches of the wanted countries and season, with ``league`` and ``season``.

    Competitions of one season stay small enough that Catalyst broadcasts them;
    matches without readable events simply have no rows in the result.
    """
    wanted = competitions.where(F.col("country_name").isin(*countries) & (F.col("season_name") == season))
    picked = matches.join(wanted, ["competition_id", "season_id"]).select(
        "match_id", F.col("country_name").alias("league"), F.col("season_name").alias("season")
    )
    return events.join(picked, "match_id")


def combine(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables; a column missing from one becomes null there."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def schema_columns(df: DataFrame, contains: str = "") -> DataFrame:
    """Sorted column names and types, optionally only names that contain a text."""
    rows = sorted(
        (f.name, f.dataType.simpleString())
        for f in df.schema.fields
        if contains.lower() in f.name.lower()
    )
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string")
