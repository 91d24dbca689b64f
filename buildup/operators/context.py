"""Goal rate by recent context, with back-off to shorter contexts.

A context is up to three tokens of event type and cell, packed into one integer: eight bits a token, the
token that the longest back-off keeps in the lowest. Shorter contexts are its low bits. Rows are
reduced to one per distinct context first: the back-off joins then run on contexts, where no key
repeats, and a context that holds a large part of the data costs as much as any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildup import ordered
from buildup.functions import labels, pitch
from buildup.session import stage

KEYS = ["match_id", "possession"]
SIZE = 3
ALPHA = 20.0
BINS_X, BINS_Y = 6, 4
BITS, CELLS = 8, 32  # of a token; cells of a type, and one for no place
MOST_BROADCAST = 1_000_000  # contexts, of about 20 bytes


def token(event_type: Column, x: Column, y: Column) -> Column:
    """Number of a type of the vocabulary and a cell of a coarse grid, 1 to 255."""
    cell = F.coalesce(pitch.cell(x, y, BINS_X, BINS_Y) + 1, F.lit(0))
    return (labels.type_id(event_type) * CELLS + cell + 1).cast("int")


def _packed(tokens: Sequence[Column]) -> Column:
    """Context of the given tokens, the one to keep longest first; missing ones are 0."""
    parts = [F.shiftleft(F.coalesce(t, F.lit(0)), BITS * i) for i, t in enumerate(tokens)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])


def shortened(context: Column, tokens: int) -> Column:
    return context.bitwiseAND(F.lit((1 << BITS * tokens) - 1))


def context_text(context: Column, latest_last: bool = False) -> Column:
    """The tokens of a context as ``type:cell``, joined by ``|`` in the order of the events."""
    places = [BITS * i for i in range(SIZE)]
    numbers = F.array(*[shortened(F.shiftright(context, i), 1) for i in (reversed(places) if latest_last else places)])

    def name(t: Column) -> Column:
        cell = (t - 1) % CELLS
        number = F.when(cell == 0, "-").otherwise((cell - 1).cast("string"))
        return F.concat_ws(":", labels.type_name(F.floor((t - 1) / CELLS).cast("int")), number)

    return F.array_join(F.transform(F.filter(numbers, lambda t: t > 0), name), "|")


def start_keys(sequences: DataFrame) -> DataFrame:
    """``context`` of the first events of each sequence."""
    inputs = F.slice("events", 1, F.least(F.lit(SIZE), F.size("events") - 1))
    words = F.transform(inputs, lambda e: token(e["type"], e["x"], e["y"]))
    rows = sequences.withColumn("_words", words)
    return rows.withColumn("context", _packed([F.get("_words", F.lit(i)) for i in range(SIZE)])).drop("_words")


def sliding_keys(moves: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """``context`` of the up to three latest events of the possession, the current one included."""
    rows = moves.withColumn("_word", token(F.col("type"), F.col("x"), F.col("y")))
    rows = ordered.lags(rows, KEYS, "index", F.col("_word"), ["_p1", "_p2"], block_rows=block_rows)
    return rows.withColumns(
        {
            "context": _packed([F.col("_word"), F.col("_p1"), F.col("_p2")]),
            "context_size": F.expr("1 + int(_p1 is not null) + int(_p2 is not null)"),
        }
    ).drop("_word", "_p1", "_p2")


def rates(keyed: DataFrame, training: Column, alpha: float = ALPHA) -> DataFrame:
    """``score`` per distinct context, learnt from the rows where ``training`` holds.

    ``keyed`` has ``context`` and a 0/1 ``label``. The longest context seen in
    training decides; its rate is smoothed by the overall rate with ``alpha``
    pseudo-rows. The counts per context are staged: every level is a sum over them.
    """
    contexts = keyed.groupBy("context").agg(
        F.count_if(training).alias("n3"),
        F.sum(F.when(training, F.col("label")).otherwise(0)).alias("g3"),
    )
    shorter = {f"k{i}": shortened(F.col("context"), i) for i in (2, 1)}
    contexts = stage(contexts, "context-counts").withColumns(shorter)
    totals = lambda by, i: contexts.groupBy(*by).agg(
        F.sum("n3").alias(f"n{i}"), F.sum("g3").alias(f"g{i}")
    )
    base = totals([], 0).select(F.try_divide("g0", "n0").alias("base"))
    joined = (
        contexts.join(totals(["k2"], 2), "k2").join(totals(["k1"], 1), "k1").crossJoin(F.broadcast(base))
    )

    def smooth(i: int) -> Column:
        rate = (F.col(f"g{i}") + F.lit(alpha) * F.col("base")) / (F.col(f"n{i}") + F.lit(alpha))
        return F.when(F.col(f"n{i}") > 0, rate)

    level = F.when(F.col("n3") > 0, 3).when(F.col("n2") > 0, 2).when(F.col("n1") > 0, 1).otherwise(0)
    return joined.select(
        "context", level.alias("level"), F.coalesce(smooth(3), smooth(2), smooth(1), "base").alias("score")
    )


def with_rates(keyed: DataFrame, training: Column) -> DataFrame:
    """Join each row of a staged table with the score of its context.

    Rows share few contexts, some of them very many, so the scores are broadcast if they are as few as the
    vocabulary makes likely; their number is counted before.
    """
    scores = stage(rates(keyed, training), "context-rates")
    few = scores.count() <= MOST_BROADCAST
    return keyed.join(F.broadcast(scores) if few else scores, "context")


def score_possessions(
    sequences: DataFrame, training: Column, scorer: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``score`` and ``label`` per possession from its start context.

    ``scorer`` may replace the context table by any function that adds a
    ``score`` column, e.g. a model applied with ``mapInPandas``.
    """
    labelled = sequences.withColumn("label", F.when(F.col("goal") == 1, 1).otherwise(0))
    if scorer is not None:
        return scorer(labelled)
    # the sequences are built once: the table of contexts and the final join read the keyed rows
    keyed = stage(start_keys(labelled).drop("events"), "keyed")
    return with_rates(keyed, training)


def score_actions(
    moves: DataFrame,
    outcomes: DataFrame,
    training: Column,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    block_rows: int = ordered.BLOCK_ROWS,
) -> DataFrame:
    """``score`` of every event from its sliding context.

    ``outcomes`` has one row per possession with its 0/1 ``label`` and whatever
    ``training`` looks at.
    """
    keyed = sliding_keys(moves, block_rows).join(outcomes, KEYS)
    if scorer is not None:
        return scorer(keyed)
    keyed = stage(keyed, "contexts")  # read by the table of contexts and by the final join
    return with_rates(keyed, training)


def with_contribution(
    scored: DataFrame, score: str = "score", digits: int = 3, block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Rise of the score to the next event, 0 for the last; a shot counts from its own value to 1."""
    rows = ordered.following(scored, KEYS, "index", F.col(score), "_next", block_rows=block_rows)
    rise = F.coalesce(F.round(F.col("_next") - F.col(score), digits), F.lit(0.0))
    own = F.when(F.col("type") == "Shot", F.round(1 - F.col(score), digits)).otherwise(rise)
    return rows.withColumns({"rise": rise, "contribution": own}).drop("_next")


def contribution_summary(contributions: DataFrame) -> DataFrame:
    """Sum, mean, extremes and their events per possession."""
    c = F.col("contribution")
    return contributions.groupBy(*KEYS).agg(
        F.sum(c).alias("total"),
        F.avg(c).alias("mean"),
        F.max(c).alias("largest"),
        F.min(c).alias("smallest"),
        F.max_by("index", F.struct(c, -F.col("index"))).alias("largest_at"),
        F.min_by("index", F.struct(c, "index")).alias("smallest_at"),
    )


def attach_scores(
    moves: DataFrame, scores: DataFrame, types: Sequence[str], block_rows: int = ordered.BLOCK_ROWS
) -> DataFrame:
    """Give the i-th event of ``types`` of each possession the score with ``token_idx`` i - 1.

    Other events keep their place with a null score.
    """
    counted = F.when(F.col("type").isin(*types), 1).otherwise(0).cast("bigint")
    rows = ordered.running_sum(moves, KEYS, "index", counted, "_at", block_rows=block_rows)
    at = F.when(F.col("type").isin(*types), F.col("_at") - 1)
    return rows.withColumn("token_idx", at).drop("_at").join(scores, [*KEYS, "token_idx"], "left")
