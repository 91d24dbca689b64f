"""What the jobs of this subpackage share: session settings, shipping of the code, worker caches."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import buildup
from buildup.session import configure

# Whole texts travel in Arrow batches; a batch stays small even where texts are long.
BATCH_ROWS = 512

_shipped: set[str] = set()
_worker_caches: list[dict] = []


def worker_cache() -> dict:
    """A cache of a Python worker; ``make_room`` keeps one of them filled at a time."""
    _worker_caches.append({})
    return _worker_caches[-1]


def make_room(own: dict) -> None:
    """Empty the caches of other operators, which ran earlier in the same worker."""
    for cache in _worker_caches:
        if cache is not own:
            cache.clear()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for text jobs, and the package for Python workers that do not have it."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(buildup.__file__).resolve().parent
        target = Path(tempfile.mkdtemp()) / "buildup.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(str(target))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: Column) -> Column:
    """64-bit hash of a text that tells null from empty."""
    return F.xxhash64(text.isNull(), text)


def whole_rows(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that helper columns cannot clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])
