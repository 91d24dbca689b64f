"""Summaries stored per match that merge for any set of matches, without reading events again.

Distinct counts are exact: a bitmap of the integer codes that occur, in buckets. Length percentiles come from
quantile sketches (KLL), whose rank error does not depend on how many are merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildup.session import stage

MATCH = "match_id"
SKETCH_K = 400  # rank error of a quantile below one per cent


def codes(events: DataFrame, column: str) -> DataFrame:
    """Staged dictionary ``(column, code)`` of the values of a text column; codes are dense but for gaps between tasks."""
    values = events.select(column).where(F.col(column).isNotNull()).distinct()
    return stage(values.withColumn("code", F.monotonically_increasing_id()), "codes")


def bitmaps(rows: DataFrame, code: Column) -> DataFrame:
    """``(match_id, bucket, bitmap)`` of the codes of every match; a bitmap ends after its last set byte."""
    # codes start at 1 in a bitmap's buckets
    own = rows.select(MATCH, (code + 1).alias("_c")).where("_c is not null")
    own = own.select(MATCH, F.bitmap_bucket_number("_c").alias("bucket"), F.bitmap_bit_position("_c").alias("_bit"))
    # each bitmap is built whole in one place: only codes are shuffled, not buffers of a bitmap's full length
    own = own.distinct().repartition(MATCH, "bucket")
    built = own.groupBy(MATCH, "bucket").agg(F.bitmap_construct_agg("_bit").alias("bitmap"), F.max("_bit").alias("_last"))
    cut = F.expr("substring(bitmap, 1, cast(_last div 8 + 1 as int))")
    return built.select(MATCH, "bucket", cut.alias("bitmap"))


def distinct_codes(stored: DataFrame, sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact number of codes in every set; ``sets`` has ``by`` and the ``match_id`` of each member."""
    # stored bitmaps grow with the matches, and by far when they are unpacked: the same join at every size
    members = stored.hint("merge").join(sets, MATCH)
    if MATCH in by:
        # as many sets as matches: their bitmaps meet before they are merged at full length
        members = members.repartition(*by, "bucket")
    merged = members.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def length_sketches(lengths: DataFrame, column: str = "n_events", k: int = SKETCH_K) -> DataFrame:
    """``(match_id, sketch)`` of the possession lengths of every match."""
    return lengths.groupBy(MATCH).agg(F.kll_sketch_agg_bigint(F.col(column).cast("bigint"), F.lit(k)).alias("sketch"))


def merged_quantiles(stored: DataFrame, sets: DataFrame, by: Sequence[str], points: Sequence[float]) -> DataFrame:
    """``by``, ``n`` and the length at each of ``points`` (``point``, ``length``) of every set."""
    merged = stored.join(sets, MATCH).groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    each = [
        F.struct(F.lit(p).alias("point"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias("length"))
        for p in points
    ]
    rows = merged.select(*by, F.kll_sketch_get_n_bigint("sketch").alias("n"), F.explode(F.array(*each)).alias("q"))
    return rows.select(*by, "n", "q.*")
