"""Merkle manifest of a dataset: a leaf per row, a tree per part, a tree over the parts, and a proof for every row.

The rows of a part are ranked in order. The rank is cut into a block number and ``DIGITS`` binary digits, one column
each. The digits are grouped away one after the other, the last first: a group holds the one or two nodes that differ in
that digit, becomes their parent, and nests them in its struct. All these aggregations run on one
partitioning by (part, block). A block is then one row that nests up to ``2 ** digits`` leaves. The blocks of a part are
ranked rows themselves and are rolled up the same way until each part is one node, and so are the
parts up to the root. Going down again, a block meets the proof of its own node in an aggregation, and a nested
``transform`` with an ``explode`` emits its members with their longer proofs. Proofs need no join.

A parent's hash is that of its children's hashes in hexadecimal, one after the other; a last node without a partner becomes
the hash of its own, unless it is the only node left, which is the root of its tree.

Defined cases: a null value is written ``-`` and any other with its length in bytes, so null differs from empty; rows
of a null part are a part of their own, which comes first; rows without an order value come first in their part, and rows
of equal order values follow each other by their leaf; equal rows are leaves of their own; an empty table has no
rows and no root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildup.llm.common import prepare, whole_rows
from buildup.session import stage

DIGITS = 10
_STEP = "array<struct<sibling:string,on_left:boolean>>"


def leaf_hash(values: Sequence[Column]) -> Column:
    """Hash of the values, each with its length in bytes before it, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    written = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*written), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def up(own: Column, step: Column) -> Column:
        sibling = step["sibling"]
        pair = F.when(step["on_left"], F.concat(sibling, own)).otherwise(F.concat(own, sibling))
        return F.sha2(F.coalesce(pair, own), 256)

    return F.aggregate(proof, leaf, up)


def proof_hash(proof: Column) -> Column:
    """Hash of all siblings of a proof, one after the other."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: step["sibling"]), ""), 256)


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``rank`` (from 0) of a row in its ``part`` by ``order``, and the part's ``total``.

    All rows are sorted once by (part, order); a part is spread over as many tasks as its rows need. Places come from
    the written result of the sort, and only counts per part and task are added up.
    """
    # equal rows have nothing else that could spread them over tasks
    spread = rows.withColumn("_spread", F.monotonically_increasing_id())
    by = ["part", *order, "_spread"]
    placed = spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_spread")
    placed = stage(placed.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("_task", F.shiftright("_at", 33))
    counts = placed.groupBy("part", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    in_part = Window.partitionBy("part")
    earlier = in_part.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("part").alias("_part"),
        F.col("_task").alias("_of"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(in_part).alias("total"),
    )
    met = placed.join(counts, F.col("part").eqNullSafe(F.col("_part")) & (F.col("_task") == F.col("_of")))
    return met.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_part", "_of", "_shift")


def roll_up(nodes: DataFrame, digits: int) -> DataFrame:
    """``(part, total, block, node)`` from ``(part, rank, total, node)``; a node is a struct with its hash ``h``."""
    names = [f"d{i}" for i in range(digits)]
    rows = nodes.select(
        "part",
        "total",
        F.shiftright("rank", digits).alias("block"),
        *[F.shiftright("rank", i).bitwiseAND(F.lit(1)).cast("tinyint").alias(d) for i, d in enumerate(names)],
        "node",
    ).repartition("part", "block")
    for i, digit in enumerate(names):
        members = F.sort_array(F.collect_list(F.struct(digit, "node")))
        rows = rows.groupBy("part", "total", "block", *names[i + 1 :]).agg(members.alias("_m"))
        rows = rows.withColumn("_k", F.expr("transform(_m, m -> m.node)"))
        joined = F.sha2(F.array_join(F.expr("transform(_k, k -> k.h)"), ""), 256)
        # a tree of up to 2 ** i leaves has one node on this level already
        own = F.when(F.col("total") > (1 << i), joined).otherwise(F.expr("_k[0].h"))
        rows = rows.withColumn("node", F.struct(own.alias("h"), F.col("_k").alias("kids"))).drop("_m", "_k")
    return rows


def _members(node: Column, total: Column, proof: Column, level: int) -> Column:
    """All leaves below a node with their proofs, as an array."""
    if level == 0:
        return F.array(F.struct(node.alias("leaf"), proof.alias("proof")))
    kids = node["kids"]

    def down(kid: Column, i: Column) -> Column:
        step = F.struct(F.get(kids, 1 - i)["h"].alias("sibling"), (i == 1).alias("on_left"))
        steps = F.when(total > (1 << (level - 1)), F.array(step)).otherwise(F.array().cast(_STEP))
        return _members(kid, total, F.concat(steps, proof), level - 1)

    return F.flatten(F.transform(kids, down))


def climb(nodes: DataFrame, digits: int) -> list[DataFrame]:
    """Blocks of ever higher tiers, up to the tier where a part is one block."""
    tiers, rows = [], nodes
    while True:
        tiers.append(stage(roll_up(rows, digits), "blocks"))
        most = tiers[-1].agg(F.max("total")).first()[0] or 0
        if most <= 1 << digits:
            return tiers
        body = F.struct(F.col("node.h").alias("h"), F.struct("block").alias("body"))
        blocks = F.shiftright(F.col("total") + ((1 << digits) - 1), digits)
        rows = tiers[-1].select("part", F.col("block").alias("rank"), blocks.alias("total"), body.alias("node"))


def descend(tiers: list[DataFrame], above: DataFrame, digits: int) -> DataFrame:
    """``(part, leaf, proof, roots)`` of every leaf; ``above`` has ``proof`` and ``roots`` of each part's own node."""
    found = above.select("part", F.lit(0).cast("bigint").alias("block"), "proof", "roots")
    for tier in reversed(tiers):
        missing = {c: F.lit(None).cast(found.schema[c].dataType) for c in ("proof", "roots")}
        both = tier.withColumns(missing).unionByName(found, allowMissingColumns=True)
        once = [F.first(c, ignorenulls=True).alias(c) for c in ("total", "node", "proof", "roots")]
        met = both.groupBy("part", "block").agg(*once)
        members = F.explode(_members(F.col("node"), F.col("total"), F.col("proof"), digits))
        out = met.select("part", "roots", members.alias("m")).select("part", "roots", "m.leaf", "m.proof")
        found = out
        if tier is not tiers[0]:
            found = out.select("part", F.col("leaf.body.block").alias("block"), "proof", "roots")
    return out


def manifest(
    df: DataFrame,
    part: str,
    order: str,
    fields: Sequence[str],
    changed: dict[str, Column] | None = None,
    digits: int = DIGITS,
) -> DataFrame:
    """``(row, leaf, changed_leaf, subroot, root, proof)`` of every row of ``df``.

    ``row`` holds ``part`` and ``order``. A leaf covers ``fields``; ``changed_leaf`` is the leaf that the row
    would have with the columns ``changed`` in their place. A proof lists the siblings (null where there is none) from
    the leaf up, and on which side they are. A block holds ``2 ** digits`` nodes.
    """
    prepare(df.sparkSession)
    rows = df.select(whole_rows(df).alias("_row"), *[c.alias(f"_new_{n}") for n, c in (changed or {}).items()])
    own = [F.col("_row")[f] for f in fields]
    new = [F.col(f"_new_{f}") if f in (changed or {}) else F.col("_row")[f] for f in fields]
    leaves = rows.select(
        F.col("_row")[part].alias("part"),
        F.col("_row")[order].alias("at"),
        leaf_hash(own).alias("h"),
        leaf_hash(new).alias("changed"),
    )
    # texts are read once
    leaves = stage(leaves.withColumn("changed", F.when(F.col("changed") != F.col("h"), F.col("changed"))), "leaves")
    body = F.struct("h", F.struct("at", "changed").alias("body")).alias("node")
    tiers = climb(ranked(leaves, ["at", "h"]).select("part", "rank", "total", body), digits)
    # the roots of the parts are leaves of the tree above them
    roots = tiers[-1].select(F.lit(0).alias("part"), F.col("part").alias("of"), F.col("node.h").alias("h"))
    body = F.struct("h", F.struct("of").alias("body")).alias("node")
    upper = climb(ranked(roots, ["of"]).select("part", "rank", "total", body), digits)
    top = upper[-1].select(
        "part", F.array().cast(_STEP).alias("proof"), F.struct(F.col("node.h").alias("root")).alias("roots")
    )
    parts = descend(upper, top, digits).select(
        F.col("leaf.body.of").alias("part"),
        "proof",
        F.struct(F.col("leaf.h").alias("subroot"), "roots.root").alias("roots"),
    )
    return descend(tiers, parts, digits).select(
        F.struct(F.col("part").alias(part), F.col("leaf.body.at").alias(order)).alias("row"),
        F.col("leaf.h").alias("leaf"),
        F.coalesce("leaf.body.changed", "leaf.h").alias("changed_leaf"),
        "roots.subroot",
        "roots.root",
        "proof",
    )
