"""Isotonic regression by pooling adjacent violators in score ranges.

The distinct scores are cut into ranges of consecutive values. Every range is pooled by one pass with a stack on an
executor. Neighbouring ranges are then merged pair by pair, level by level: only the last pools of the left and the
first of the right side travel, are pooled by the same stack, and more are fetched while the pool that spans
the border reaches the edge of what came. The result is a table of pools; it is looked up by score range, linearly between
pools and flat beyond the ends. Pools never pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildup import ordered
from buildup.session import stage

RANGE_ROWS = 1_000_000
EDGE_POOLS = 1_000  # pools that a merge fetches from each side; a limit that Spark applies before the shuffle

_POOL = "first double, last double, weight double, total double"


def pooled(rows: Iterable[tuple], stack: list[tuple] | None = None) -> list[tuple]:
    """Pools ``(first, last, weight, total)`` of entries in order, whose means then rise strictly.

    Goes on with ``stack`` if it is given.
    """
    stack = [] if stack is None else stack
    for first, last, weight, total in rows:
        while stack and stack[-1][3] * weight >= total * stack[-1][2]:
            begin, _, w, t = stack.pop()
            first, weight, total = begin, weight + w, total + t
        stack.append((first, last, weight, total))
    return stack


def _table(pools: list[tuple], **fixed: int) -> pa.RecordBatch:
    columns = list(zip(*pools)) or [()] * 4
    data = {n: pa.array(c, pa.float64()) for n, c in zip(("first", "last", "weight", "total"), columns)}
    data |= {n: pa.array([v] * len(pools), pa.int64()) for n, v in fixed.items()}
    return pa.RecordBatch.from_pydict(data)


def _pool_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pools of one sorted range."""
    stack: list[tuple] = []
    for batch in batches:
        score, weight, total = (batch.column(i).to_pylist() for i in range(3))
        pooled(zip(score, score, weight, total), stack)
    yield _table(stack, node=TaskContext.get().partitionId())


def _merge_side(edge: int):
    def run(found: pa.Table) -> pa.Table:
        """New pools over the border of two nodes, and whether they reach the edge of what was fetched."""
        rows = sorted(found.to_pylist(), key=lambda r: r["first"])
        pair = rows[0]["node"] // 2
        merged = pooled([(r["first"], r["last"], r["weight"], r["total"]) for r in rows])
        old = {(r["first"], r["last"]) for r in rows}
        new = [p for p in merged if p[:2] not in old]
        # a side of fewer pools was fetched whole
        sides = [sum(r["node"] % 2 == side for r in rows) == edge for side in (0, 1)]
        reach = lambda p: (sides[0] and p[0] == rows[0]["first"]) or (sides[1] and p[1] == rows[-1]["last"])
        out = _table(new, pair=pair)
        return pa.Table.from_batches([out.append_column("open", pa.array([reach(p) for p in new], pa.bool_()))])

    return run


def _merge_level(pools: DataFrame, edge: int, most: int) -> DataFrame:
    """Nodes 2 i and 2 i + 1 become node i; a merge takes up to ``most`` pools of a side at once."""
    while True:
        left = F.col("node") % 2 == 0
        near = F.when(left, -F.col("last")).otherwise(F.col("first"))
        by_edge = Window.partitionBy("node").orderBy("_near")
        edges = pools.withColumn("_near", near).withColumn("_rank", F.row_number().over(by_edge))
        edges = edges.where(F.col("_rank") <= edge).drop("_near", "_rank")
        merged = edges.groupBy(F.expr("node div 2").alias("pair")).applyInArrow(
            _merge_side(edge), _POOL + ", pair bigint, open boolean"
        )
        # at most one pool for every two ranges
        merged = stage(merged, "merged")
        if not merged.isEmpty():
            cover = merged.select("pair", F.col("first").alias("_from"), F.col("last").alias("_to"))
            inside = (F.expr("node div 2") == F.col("pair")) & (F.col("first") >= F.col("_from")) & (F.col("last") <= F.col("_to"))
            rest = pools.join(F.broadcast(cover), inside, "left_anti")
            own = merged.select("first", "last", "weight", "total", (2 * F.col("pair")).alias("node"))
            pools = stage(rest.unionByName(own), "pools")
        if merged.where("open").isEmpty():
            return pools.withColumn("node", F.expr("node div 2"))
        edge = max(edge, min(8 * edge, most))


def fit(
    scores: DataFrame, range_rows: int = RANGE_ROWS, edge_pools: int = EDGE_POOLS
) -> DataFrame:
    """Staged pools ``(first, last, value)`` of a table with one row ``(score, weight, total)`` per distinct score.

    ``total`` is the weighted sum of the labels. Any ``range_rows`` and ``edge_pools`` (at least 2) give the same.
    """
    rows = stage(scores.select("score", "weight", "total").where("weight > 0"), "scores")
    ranges = max(1, -(-rows.count() // range_rows))
    dealt = rows.repartitionByRange(ranges, "score") if ranges > 1 else rows.coalesce(1)
    pools = dealt.sortWithinPartitions("score").mapInArrow(_pool_ranges, _POOL + ", node bigint")
    pools = stage(pools, "pools")
    nodes = ranges
    while nodes > 1:
        pools, nodes = _merge_level(pools, edge_pools, range_rows), -(-nodes // 2)
    return stage(pools.select("first", "last", (F.col("total") / F.col("weight")).alias("value")), "steps")


def with_value(rows: DataFrame, steps: DataFrame, score: str, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the fitted value of ``score`` to rows with distinct scores; null scores stay null."""
    pool = F.struct("first", "last", "value")
    found = ordered.neighbours(rows, steps.select("first", pool.alias("_step")), score, "first", "_step", range_rows)
    s, before, after = F.col(score).cast("double"), F.col("_before"), F.col("_after")
    share = (s - before["last"]) / (after["first"] - before["last"])
    between = before["value"] + (after["value"] - before["value"]) * share
    value: Column = (
        F.when(s.isNull(), None)
        .when(before.isNull(), after["value"])
        .when((s <= before["last"]) | after.isNull(), before["value"])
        .otherwise(between)
    )
    return found.withColumn(name, value).drop("_before", "_after")
