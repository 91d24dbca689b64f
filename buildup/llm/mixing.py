"""Mixing sources to target weights by hash thresholds.

Every document has a hash of its id. A source gives the documents below a threshold of its own; a
source that gives more than itself gives everything once and the documents below the
threshold twice. A threshold is found without sorting: sizes are summed by source and leading hash bits,
the bucket in which the budget runs out is refined by the next bits, and so on until one hash
value is left. Only rows of boundary buckets are read again. Thresholds of a growing budget are
nested, so a larger mix contains a smaller one.

The document at the boundary is taken if that brings the source closer to its target. Documents with
one hash (repeated ids) are taken together.

Defined cases: a null text has size 0; the null source is a source of its own and comes last; a source
of size 0 has target 0; repeated rows count each; an empty table gives an empty mix. The hash of a null
id is that of the empty string.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildup.llm.common import prepare, whole_rows
from buildup.session import stage

HASH_BITS = 60
LEVEL_BITS = 12


def n_words(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII white-space ones; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of an id as text."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Add ``target`` to one row per source ``(source, source_size)``.

    The budget is ``share`` of all sizes. Sources in order (nulls last) weigh ``weights``, repeating. No target
    exceeds ``most`` times its source; what is cut off is shared out again by weight, until none
    exceeds it. That ends where each source has the smaller of its limit and its weight times a
    common level, so the level is read off the sources sorted by limit over weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_i"))
    rows = sizes.withColumn("_i", (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = rows.select("source", "source_size", weight.alias("_w"), (F.col("source_size") * most).alias("_cap"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum(F.col("source_size")).over(everything) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weights_left = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    # the level that fills all sources before this one: it rises up to the last full source, then falls
    rows = rows.withColumn("_level", left / weights_left).withColumn("_common", F.max("_level").over(everything))
    target = F.least(F.col("_cap"), F.col("_w") * F.col("_common"))
    return rows.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Add ``threshold`` to ``budgets(source, budget)``: a document is below it if it is within the budget.

    ``rows`` are ``(source, size, h)``. A null budget stands for everything.
    """
    zero = F.lit(0).cast("bigint")
    bound = budgets.select("source", "budget", zero.alias("prefix"), zero.alias("below"))
    known = HASH_BITS  # low bits that the prefix leaves open
    while known > 0:
        bits = min(LEVEL_BITS, known)
        known -= bits
        here = rows.join(bound.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        sums = (
            here.where(F.col("budget").isNotNull() & (F.shiftright("h", known + bits) == F.col("prefix")))
            .groupBy("_s", F.shiftright("h", known).alias("bucket"))
            .agg(F.sum("size").alias("size"))
        )
        run = Window.partitionBy("_s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("size").over(run))
        over = F.col("below") + F.col("upto") > F.col("budget")
        cut = (
            bound.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
            .groupBy("source", "budget", "prefix", "below")
            .agg(F.min(F.when(over, F.struct("bucket", "upto", "size"))).alias("at"))
        )
        # a budget that nothing exceeds ends behind the last bucket
        bound = stage(
            cut.select(
                "source",
                "budget",
                F.coalesce("at.bucket", F.shiftleft(F.col("prefix") + 1, bits)).alias("prefix"),
                (F.col("below") + F.coalesce(F.col("at.upto") - F.col("at.size"), zero)).alias("below"),
                F.col("at.size").alias("last"),
            ),
            "thresholds",
        )
    # the documents with the boundary hash itself are in if that comes closer to the budget
    closer = F.coalesce(F.col("below") + F.col("last") / 2 <= F.col("budget"), F.lit(False))
    return bound.select(
        "source", F.when(F.col("budget").isNotNull(), F.col("prefix") + closer.cast("int")).alias("threshold")
    )


def sizes(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        n_words(F.col(f"`{text}`")).alias("size"),
        id_hash(F.col(f"`{id_col}`")).alias("h"),
    )


def mix(
    df: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, times)``: how often each row is in the mix, 0 to ``most``.

    ``most`` is a whole number of times.
    """
    prepare(df.sparkSession)
    rows = stage(sizes(df, id_col, text, source), "sizes")
    plan = decide(rows, weights, share, most)
    joined = rows.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    return joined.select("doc_id", "source", "size", "source_size", "target", _times().alias("times"))


def _times() -> Column:
    return F.col("whole") + F.coalesce((F.col("h") < F.col("threshold")).cast("int"), F.lit(0))


def decide(rows: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``(source, source_size, target, whole, threshold)``: each document ``whole`` times, below the threshold once more."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = stage(targets(by_source, weights, share, most), "targets")
    whole = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    aims = aims.withColumn("whole", whole.cast("int"))
    budgets = aims.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    budgets = budgets.withColumn("budget", F.when(F.col("budget") > 0, F.col("budget")))
    found = thresholds(rows, budgets).withColumnRenamed("source", "_s")
    return stage(aims.join(found, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "plan")


def apply_mix(
    df: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them; columns are unchanged."""
    prepare(df.sparkSession)
    rows = stage(sizes(df), "sizes")
    plan = decide(rows, weights, share, most).select(F.col("source").alias("_s"), "whole", "threshold")
    docs = df.select(whole_rows(df).alias("_row")).withColumn("h", id_hash(F.col("_row.doc_id")))
    taken = docs.join(plan, F.col("_row.source").eqNullSafe(F.col("_s"))).withColumn("_n", _times())
    return taken.where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), "_n"))).select("_row.*")
