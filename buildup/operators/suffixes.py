"""Goal rate by the latest events of a possession, in a tree of contexts of any length.

A node of depth j is a sequence of j tokens (event type and coarse cell) that some event looks back on. The tree is
grown level by level: a context can only be frequent if the shorter one that it ends with is, so a level looks only
at the rows whose node of the level before was kept. The rate of a node leans on that of its parent: with n training
rows and g goals, ``(g + alpha * parent) / (n + alpha)``; the root has the overall rate. An event takes the
rate of its deepest kept node.

Rows are reduced to distinct histories first. A history is text, two hexadecimal digits a token, the latest first, so a
node is a prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildup import ordered
from buildup.operators import context
from buildup.session import stage

KEYS = context.KEYS
ALPHA = context.ALPHA
MIN_ROWS = 5


def with_history(moves: DataFrame, longest: int, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Add ``history``: up to ``longest`` latest tokens of the possession, the current event's first."""
    word = context.token(F.col("type"), F.col("x"), F.col("y"))
    rows = ordered.trailing(moves, KEYS, "index", word, longest, "_words", block_rows)
    digits = F.transform(F.reverse("_words"), lambda t: F.lpad(F.hex(t.cast("bigint")), 2, "0"))
    return rows.withColumn("history", F.array_join(digits, "")).drop("_words")


def histories(rows: DataFrame, training: Column) -> DataFrame:
    """Training rows ``n`` and goals ``g`` of every distinct history; ``rows`` has a 0/1 ``label``."""
    learnt = F.when(training, F.col("label")).otherwise(0)
    return rows.groupBy("history").agg(F.count_if(training).alias("n"), F.sum(learnt).cast("bigint").alias("g"))


def grow(
    counts: DataFrame, lengths: Sequence[int], alpha: float = ALPHA, min_rows: int = MIN_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Scores of the histories in ``counts``, and the kept nodes.

    Scores have ``history``, its ``depth`` and ``score_<length>`` for each of ``lengths``, the longest context
    that the score may use. Nodes have ``depth``, ``node``, ``n`` and ``g``.
    """
    rows = stage(counts, "histories")
    base = rows.agg(F.try_divide(F.sum("g"), F.sum("n")).alias("p"))
    alive = rows.crossJoin(F.broadcast(base)).withColumns(
        {"depth": F.lit(0), **{f"score_{c}": F.lit(None).cast("double") for c in lengths}}
    )
    done, levels = [], []
    for j in range(1, max(lengths) + 1):
        reaching = F.length("history") >= 2 * j
        alive = alive.withColumn("node", F.when(reaching, F.substring("history", 1, 2 * j)))
        nodes = alive.where("node is not null").groupBy("node").agg(F.sum("n").alias("_n"), F.sum("g").alias("_g"))
        nodes = stage(nodes.where(F.col("_n") >= min_rows), "nodes")
        n = nodes.count()
        if not n:
            break
        levels.append(nodes.select(F.lit(j).alias("depth"), "node", F.col("_n").alias("n"), F.col("_g").alias("g")))
        met = alive.join(F.broadcast(nodes) if n <= context.MOST_BROADCAST else nodes, "node", "left")
        kept = F.col("_n").isNotNull()
        rate = (F.col("_g") + F.lit(alpha) * F.col("p")) / (F.col("_n") + F.lit(alpha))
        met = met.withColumns({"p": F.when(kept, rate).otherwise(F.col("p")), "_kept": kept})
        met = met.withColumn("depth", F.when(kept, F.lit(j)).otherwise(F.col("depth")))
        if j in lengths:
            met = met.withColumn(f"score_{j}", F.when(kept, F.col("p")))
        met = stage(met.drop("node", "_n", "_g"), "level")
        done.append(met.where("not _kept").drop("_kept"))
        alive = met.where("_kept").drop("_kept")
    out = alive.drop("node")
    for part in done:
        out = out.unionByName(part)
    # lengths beyond the deepest node give what that node gives
    scores = out.select("history", "depth", *[F.coalesce(f"score_{c}", "p").alias(f"score_{c}") for c in lengths])
    kept = rows.sparkSession.createDataFrame([], "depth int, node string, n bigint, g bigint")
    for level in levels:
        kept = kept.unionByName(level)
    return stage(scores, "scores"), kept


def log_losses(rows: DataFrame, scores: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """``(context, n, log_loss, rank)`` of rows with ``history`` and ``label``, the best context first."""
    counts = rows.groupBy("history").agg(F.count("*").alias("n"), F.sum("label").alias("g"))
    names = F.array(*[F.struct(F.lit(c).alias("context"), F.col(f"score_{c}").alias("p")) for c in lengths])
    long = counts.join(scores, "history").select("n", "g", F.explode(names).alias("e"))
    loss = -F.col("g") * F.ln("e.p") - (F.col("n") - F.col("g")) * F.ln(1 - F.col("e.p"))
    # a label that a rate of 0 or 1 excludes has no finite loss; one that it implies has none
    loss = F.when(F.col("g") == 0, -F.col("n") * F.ln(1 - F.col("e.p"))).when(
        F.col("g") == F.col("n"), -F.col("n") * F.ln("e.p")
    ).otherwise(loss)
    out = long.groupBy("e.context").agg(F.sum("n").alias("n"), (F.sum(loss) / F.sum("n")).alias("log_loss"))
    # contexts that no row tells apart are equal, whatever the order of their sums
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.round("log_loss", 9), "context")))


def score(
    moves: DataFrame,
    outcomes: DataFrame,
    training: Column,
    lengths: Sequence[int],
    block_rows: int = ordered.BLOCK_ROWS,
    **growth,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events with their scores, the staged rows behind them, and the nodes.

    ``outcomes`` has one row per possession with its 0/1 ``label`` and whatever ``training`` looks at.
    """
    keyed = stage(with_history(moves, max(lengths), block_rows).join(outcomes, KEYS), "with-history")
    scores, nodes = grow(histories(keyed, training), lengths, **growth)
    few = scores.count() <= context.MOST_BROADCAST
    return keyed.join(F.broadcast(scores) if few else scores, "history"), scores, nodes
