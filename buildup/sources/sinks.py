"""Writers. Every one keeps the rows on the executors."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from buildup.functions.labels import season_label
from buildup.sources.readers import ESSENTIAL_COLUMNS, select_existing


def variant_name(mode: str, threshold: float | None = None, context: int = 14) -> str:
    """Name of a dataset variant; fractional thresholds keep distinct names."""
    head = f"t{threshold:g}" if mode == "threshold" else mode
    return f"{head}_ctx{context}"


def write_splits(sequences: DataFrame, path: str, overwrite: bool = True, append: bool = False) -> None:
    """One Parquet folder per ``variant`` and ``split``.

    With ``overwrite=False`` an existing table is kept, with ``append`` it is added to.
    """
    mode = "append" if append else "overwrite" if overwrite else "ignore"
    sequences.write.mode(mode).partitionBy("variant", "split").parquet(path)


def write_events(events: DataFrame, path: str, essential: bool = False) -> None:
    """Event table by league and season, in full or with the essential columns only."""
    by = ["league", "season"]
    out = select_existing(events, [*ESSENTIAL_COLUMNS, *by]) if essential else events
    out = out.withColumn("season", season_label(out["season"]))
    out.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_vocab(spark: SparkSession, vocab: dict[str, int], path: str) -> None:
    """The vocabulary as one JSON object."""
    text = json.dumps(vocab)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_once(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Write unless the target exists already."""
    df.write.mode("ignore").partitionBy(*by).parquet(path)


def bucketed(df: DataFrame, path: str, by: Sequence[str], order: str, buckets: int | None = None) -> DataFrame:
    """``df`` written at ``path`` in buckets of ``by``, each sorted, and read back.

    Grouping, windows and joins by ``by`` then need no exchange. The default number of buckets is that of the shuffle
    partitions. The table is known to the session under the name of its folder.
    """
    spark = df.sparkSession
    name = re.sub(r"\W", "_", path.rstrip("/").rsplit("/", 1)[-1])
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one task a bucket, so that a bucket is one sorted file
    rows = df.repartition(buckets, *by)
    rows.write.bucketBy(buckets, *by).sortBy(*by, order).option("path", path).saveAsTable(name)
    return spark.table(name)


def write_for_lookup(df: DataFrame, path: str, by: Sequence[str], order: str, group_bytes: int = 16 << 20) -> None:
    """``df`` sorted by ``by`` across all files, with Bloom filters on these columns and small row groups.

    A reader that filters on them skips files and row groups by their statistics, and by the filters where a value lies
    between the least and the greatest but does not occur.
    """
    writer = df.repartitionByRange(*by).sortWithinPartitions(*by, order).write.option("parquet.block.size", group_bytes)
    for column in by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)
