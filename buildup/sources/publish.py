"""Publishing a dataset in parts, resumable after any break.

The dataset is one Parquet table partitioned by the columns that name a part. A manifest beside it gets a row for a
part after its files are complete: their number and bytes, the rows and which attempt wrote them. A part counts as done only
while its folder still has what the manifest says. Publishing again builds what is not done, replaces
exactly those partitions (dynamic overwrite), and leaves the others as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA, MANIFEST = "data", "manifest"
_FIGURES = "files bigint, bytes bigint, rows bigint, attempt bigint"

Part = tuple[str, ...]


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def part_path(path: str, by: Sequence[str], part: Part) -> str:
    """Folder of a part; values are plain names."""
    return "/".join([f"{path}/{DATA}", *[f"{c}={quote(v, safe=' .-_')}" for c, v in zip(by, part)]])


def present(spark: SparkSession, path: str, by: Sequence[str], part: Part) -> tuple[int, int]:
    """Number and bytes of the files of a part, from the file system alone."""
    place, system = _files(spark, part_path(path, by, part))
    if not system.exists(place):
        return 0, 0
    found = system.getContentSummary(place)
    return found.getFileCount(), found.getLength()


def drop(spark: SparkSession, path: str, by: Sequence[str], part: Part) -> None:
    """Remove the files of a part; it then counts as missing."""
    place, system = _files(spark, part_path(path, by, part))
    if system.exists(place):
        system.delete(place, True)


def manifest(spark: SparkSession, path: str, by: Sequence[str]) -> DataFrame:
    """Every entry ever made."""
    schema = ", ".join(f"{c} string" for c in by) + ", " + _FIGURES
    place, system = _files(spark, f"{path}/{MANIFEST}")
    if not system.exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{MANIFEST}")


def latest(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """The last entry of each part."""
    last = F.max_by(F.struct("files", "bytes", "rows", "attempt"), "attempt").alias("e")
    return entries.groupBy(*by).agg(last, F.count("*").alias("builds")).select(*by, "e.*", "builds")


def missing(spark: SparkSession, path: str, by: Sequence[str], wanted: Iterable[Part]) -> list[Part]:
    """The wanted parts that are not done. Both lists are as long as a dataset has parts."""
    entries = latest(manifest(spark, path, by), by).collect()
    done = {tuple(r[c] for c in by): (r["files"], r["bytes"]) for r in entries}
    return [p for p in wanted if p not in done or done[p] != present(spark, path, by, p)]


def publish(
    spark: SparkSession,
    path: str,
    by: Sequence[str],
    wanted: Sequence[Part],
    build: Callable[[list[Part]], DataFrame],
) -> list[Part]:
    """Build and write the parts that are not done; returns them.

    ``build`` gets the missing parts and returns their rows with the columns ``by``. Rows of other parts are left out, so
    a finished part is never touched. Parts without rows are recorded as empty.
    """
    todo = missing(spark, path, by, wanted)
    if not todo:
        return []
    attempt = 1 + (manifest(spark, path, by).agg(F.max("attempt")).first()[0] or 0)
    names = spark.createDataFrame(todo, ", ".join(f"{c} string" for c in by))
    rows = build(todo).join(F.broadcast(names), list(by), "left_semi")
    # a part that ends up empty is not replaced by the write
    for part in todo:
        drop(spark, path, by, part)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(f"{path}/{DATA}")
    back = spark.read.schema(rows.schema).parquet(f"{path}/{DATA}").join(F.broadcast(names), list(by), "left_semi")
    counts = {tuple(r[c] for c in by): r["count"] for r in back.groupBy(*by).count().collect()}
    entries = [(*p, *present(spark, path, by, p), counts.get(p, 0), attempt) for p in todo]
    schema = ", ".join(f"{c} string" for c in by) + ", " + _FIGURES
    spark.createDataFrame(entries, schema).coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return todo


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The published rows."""
    return spark.read.schema(schema).parquet(f"{path}/{DATA}")
