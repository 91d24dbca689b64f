"""Ordered operations that stay safe when one group holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(order)`` sends a whole group to one
task. The functions here cut groups of more than ``block_rows`` rows into blocks
of consecutive ``order`` values, work inside (group, block), and carry only a
small summary row per block across the cut. ``order`` must be an integer that is
unique in a group. Blocks are cut at sampled values, so that a block holds
about ``block_rows`` rows however the values are spread; the result does not
depend on it.

All other groups are one block and have no summary to carry: the side table is
then empty at run time and AQE drops the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildup.session import stage

BLOCK_ROWS = 1_000_000
SAMPLED = 32


def _with_block(df: DataFrame, keys: Sequence[str], order: str, block_rows: int) -> DataFrame:
    """Add ``_block``, 0 throughout unless the group is large.

    A large group is cut at order values taken from a sample of its rows, ``SAMPLED`` a block, so blocks hold about
    ``block_rows`` rows however the values are spread. The sample is drawn by the hash of the value: every use of the
    blocks sees the same ones. There is at most one large group, and about one cut, for every ``block_rows`` rows, which
    bounds what is broadcast; joined otherwise, a large group would meet in one task.
    """
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows).select(*keys)
    every = min(SAMPLED, block_rows)
    picked = df.where(F.pmod(F.xxhash64(order, *keys), F.lit(block_rows)) < every).select(*keys, F.col(order).alias("_at"))
    sample = picked.join(F.broadcast(large), list(keys)).groupBy(*keys).agg(F.sort_array(F.collect_list("_at")).alias("_s"))
    cuts = sample.select(*keys, F.expr(f"filter(_s, (x, i) -> i % {every} = {every - 1})").alias("_cuts"))
    block = F.expr(f"coalesce(size(filter(_cuts, c -> c < `{order}`)), 0)").cast("bigint")
    return df.join(F.broadcast(cuts), list(keys), "left").select(*df.columns, block.alias("_block"))


def _direction(column: str, descending: bool) -> Column:
    return F.col(column).desc() if descending else F.col(column).asc()


def sessionize(
    df: DataFrame,
    key: str,
    order: str,
    clock: str,
    gap: int,
    name: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number the sessions of each ``key``: a step of ``clock`` above ``gap`` starts a new one."""
    inside = Window.partitionBy(key, "_block").orderBy(order)
    step = F.col(clock) - F.lag(clock).over(inside)
    rows = (
        _with_block(df, [key], order, block_rows)
        .withColumn("_cut", F.when(step > gap, 1).otherwise(0))
        .withColumn("_inside", F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    over_blocks = Window.partitionBy(key).orderBy("_block")
    step_between = F.col("_first") - F.lag("_last").over(over_blocks)
    upto = over_blocks.rowsBetween(Window.unboundedPreceding, 0)
    offsets = (
        rows.groupBy(key, "_block")
        .agg(
            F.min_by(clock, order).alias("_first"),
            F.max_by(clock, order).alias("_last"),
            F.sum("_cut").alias("_cuts"),
        )
        .withColumn("_starts", F.when(step_between > gap, 1).otherwise(0))
        .withColumn("_offset", F.sum(F.col("_starts") + F.col("_cuts")).over(upto) - F.col("_cuts"))
        .where("_offset > 0")
        .select(key, "_block", "_offset")
    )
    number = F.lit(1) + F.col("_inside") + F.coalesce("_offset", F.lit(0))
    return (
        rows.join(offsets, [key, "_block"], "left")
        .withColumn(name, number.cast("bigint"))
        .drop("_block", "_cut", "_inside", "_offset")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    descending: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the group's rows up to and including this one."""
    keys = list(keys)
    rows = _with_block(df, keys, order, block_rows).withColumn("_value", value)
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(_direction(order, descending))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier_blocks = (
        Window.partitionBy(*keys)
        .orderBy(_direction("_block", descending))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        rows.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_offset", F.sum("_total").over(earlier_blocks))
        .where("_offset is not null")
        .select(*keys, "_block", "_offset")
    )
    return (
        rows.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, [*keys, "_block"], "left")
        .withColumn(name, F.col("_inside") + F.coalesce("_offset", F.lit(0)))
        .drop("_block", "_value", "_inside", "_offset")
    )


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    descending: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row in its group."""
    one = F.lit(1).cast("bigint")
    return running_sum(df, keys, order, one, name, descending, block_rows)


def _edges(
    blocks: DataFrame, keys: Sequence[str], order: str, item: Column, size: int, following: bool = False
) -> DataFrame:
    """``_before`` of each block that has earlier ones: the last ``size`` items of each of the ``size`` blocks before it."""
    cut = [*keys, "_block"]
    from_end = Window.partitionBy(*cut).orderBy(_direction("_order", not following))
    ends = (
        blocks.select(*cut, F.col(order).alias("_order"), item.alias("_item"))
        .withColumn("_rank", F.row_number().over(from_end))
        .where(F.col("_rank") <= size)
        .groupBy(*cut)
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "_item")), asc=False).alias("_end"))
    )
    earlier_blocks = Window.partitionBy(*keys).orderBy(_direction("_block", following)).rowsBetween(-size, -1)
    return (
        ends.withColumn("_before", F.flatten(F.collect_list("_end").over(earlier_blocks)))
        .where(F.size("_before") > 0)
        .select(*cut, F.expr("transform(_before, e -> e._item)").alias("_before"))
    )


def trailing(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, size: int, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``name``: the values of the group's last ``size`` rows up to and including this one, in order."""
    keys = list(keys)
    cut, item = [*keys, "_block"], F.struct(value.alias("value"))
    blocks = _with_block(df, keys, order, block_rows)
    inside = Window.partitionBy(*cut).orderBy(order).rowsBetween(1 - size, 0)
    rows = blocks.withColumn("_inside", F.collect_list(item).over(inside))
    rows = rows.join(_edges(blocks, keys, order, item, size), cut, "left")
    # only the first rows of a block look back across its border
    both = F.when(F.size("_inside") < size, F.concat(F.coalesce("_before", F.slice("_inside", 1, 0)), "_inside"))
    last = F.expr(f"slice(_both, -least({size}, size(_both)), {size})")
    out = rows.withColumn("_both", F.coalesce(both, F.col("_inside")))
    out = out.withColumn(name, F.transform(last, lambda e: e["value"]))
    return out.drop("_block", "_inside", "_before", "_both")


def lags(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    names: Sequence[str],
    following: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add one column per name: the value one, two, ... rows earlier in the group, or later with ``following``.

    Null where the group has no such row.
    """
    keys, steps = list(keys), range(1, len(names) + 1)
    cut = [*keys, "_block"]
    item = F.struct(value.alias("value"))
    inside = Window.partitionBy(*cut).orderBy(_direction(order, following))
    blocks = _with_block(df, keys, order, block_rows)
    rows = blocks.withColumn("_item", item)
    rows = rows.withColumns({f"_lag{i}": F.lag("_item", i).over(inside) for i in steps})
    edges = _edges(blocks, keys, order, item, len(names), following)
    # a row with n earlier rows in its block finds the next ones at the end of the blocks before
    found = " + ".join(f"int(_lag{i} is not null)" for i in steps)
    pick = lambda i: f"coalesce(_lag{i}, get(_before, size(_before) + ({found}) - {i})).value"
    return (
        rows.join(edges, cut, "left")
        .withColumns({name: F.expr(pick(i)) for i, name in zip(steps, names)})
        .drop("_block", "_item", "_before", *[f"_lag{i}" for i in steps])
    )


def previous(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, **kw) -> DataFrame:
    """``lag(value)`` in the group."""
    return lags(df, keys, order, value, [name], **kw)


def following(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, **kw) -> DataFrame:
    """``lead(value)`` in the group."""
    return lags(df, keys, order, value, [name], following=True, **kw)


def running_totals(
    df: DataFrame, value: str, totals: Sequence[str], by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Cumulative sums along a sorted numeric column of a table with one row per (``by``, ``value``).

    Adds ``cum_<t>`` for each ``t``: its sum over the rows of the group with a
    value up to this one. The value range is cut into buckets of about equal
    row count, so no task sorts the whole column. The cut points are fixed on
    the driver first: both uses of a bucket then agree even if a task is rerun.
    ``df`` is read three times: pass a staged table.
    """
    by = list(by)
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.stat.approxQuantile(value, [i / n for i in range(1, n)], min(0.01, 0.5 / n)) if n > 1 else []
    splits = [float("-inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    rows = Bucketizer(splits=splits, inputCol=value, outputCol="_bucket").transform(df)
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    )
    # at most one row per (group, bucket)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*by, "_bucket")
        .agg(*[F.sum(t).alias(f"_sum_{t}") for t in totals])
        .select(*by, "_bucket", *[F.sum(f"_sum_{t}").over(earlier).alias(f"_off_{t}") for t in totals])
    )
    out = rows.withColumns({f"_in_{t}": F.sum(t).over(inside) for t in totals})
    out = out.join(offsets, [*by, "_bucket"], "left")
    for t in totals:
        out = out.withColumn(f"cum_{t}", F.col(f"_in_{t}") + F.coalesce(f"_off_{t}", F.lit(0)))
    return out.drop("_bucket", *[f"_in_{t}" for t in totals], *[f"_off_{t}" for t in totals])


def exact_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated quantiles, one column per entry of ``quantiles``.

    Equal to ``percentile`` but without its one-task map of all values: rows
    are reduced to value counts, and the counts are summed in sorted buckets.
    """
    by = list(by)
    number = F.col(value).cast("double").alias(value)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, number).agg(F.count("*").alias("n"))
    counts = stage(counts, "values")
    running = running_totals(counts, value, ["n"], by)
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("_size"))
    running = running.join(sizes, by, "left") if by else running.crossJoin(F.broadcast(sizes))
    picks = []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("_size") - 1)
        picks += [
            F.min(F.when(F.col("cum_n") > F.floor(at), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("cum_n") > F.ceil(at), F.col(value))).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_part_{name}"),
        ]
    out = running.groupBy(*by).agg(*picks)
    return out.select(
        *by,
        *[
            (F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_part_{k}")).alias(k)
            for k in quantiles
        ],
    )


def neighbours(
    rows: DataFrame, steps: DataFrame, value: str, at: str, item: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``_before`` and ``_after``: ``item`` of the last step with ``at`` up to ``value``, and of the first one above.

    Steps have distinct ``at``. Both tables are cut into the same ranges of values, so no task sorts
    everything; a range passes on its first and last step only. Null values have no neighbours.
    """
    kind = steps.schema[item].dataType
    points = rows.select(
        F.col(value).cast("double").alias("_at"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(kind).alias("_item")
    )
    marks = steps.select(F.col(at).alias("_at"), F.lit(None).cast(points.schema["_row"].dataType).alias("_row"), F.col(item).alias("_item"))
    both = stage(points.where("_at is not null").unionByName(marks), "ranges")
    n = max(1, -(-both.count() // block_rows))
    if n > 1:
        cuts = both.stat.approxQuantile("_at", [i / n for i in range(1, n)], min(0.01, 0.5 / n))
        splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
        both = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket").transform(both)
    else:
        both = both.withColumn("_bucket", F.lit(0.0))
    # a step comes before the points of its own value
    inside = Window.partitionBy("_bucket").orderBy("_at", F.col("_item").isNull())
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    behind = inside.rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumns(
        {"_in_before": F.last("_item", True).over(upto), "_in_after": F.first("_item", True).over(behind)}
    )
    # one row per range
    ends = both.groupBy("_bucket").agg(
        F.min_by("_item", F.when(F.col("_item").isNotNull(), F.col("_at"))).alias("_low"),
        F.max_by("_item", F.when(F.col("_item").isNotNull(), F.col("_at"))).alias("_high"),
    )
    order = Window.orderBy("_bucket")
    ends = ends.select(
        "_bucket",
        F.last("_high", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_out_before"),
        F.first("_low", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_out_after"),
    )
    found = found.where("_row is not null").join(F.broadcast(ends), "_bucket").select(
        "_row.*",
        F.coalesce("_in_before", "_out_before").alias("_before"),
        F.coalesce("_in_after", "_out_after").alias("_after"),
    )
    none = [F.lit(None).cast(kind).alias(c) for c in ("_before", "_after")]
    return found.unionByName(rows.where(F.col(value).isNull()).select("*", *none))
