"""Token tables: causal pairs, ids, positions, masks, padding, Fourier features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildup import ordered
from buildup.functions import labels, pitch
from buildup.functions.labels import VOCAB

# Angular frequencies of the position features.
FREQUENCIES = [1, 2, 4, 8, 16, 32, 64, 128]
AXES = ["x", "y", "end_x", "end_y"]


def causal_pairs(sequences: DataFrame) -> DataFrame:
    """Each element with the type of the one after it."""
    inputs = F.slice("events", 1, F.size("events") - 1)
    targets = F.slice("events", 2, F.size("events") - 1)
    pairs = F.zip_with(
        inputs, targets, lambda a, b: F.struct(a["type"].alias("input_type"), b["type"].alias("target_type"))
    )
    keep = [c for c in sequences.columns if c != "events"]
    rows = sequences.select(*keep, F.posexplode(pairs).alias("pos", "pair"))
    return rows.select(*keep, "pos", "pair.*")


def grid_text(sequences: DataFrame, step: int = 5) -> DataFrame:
    """Sequence as text: START, one grid token per event, the terminal."""

    def corner(value):
        return (F.floor(value / step) * step).cast("string")

    def token(e):
        located = F.concat_ws("_", e["type"], F.lit("LOC"), corner(e["x"]), corner(e["y"]))
        return F.when(e["type"].isin("Pass", "Carry"), located).otherwise(e["type"])

    words = F.concat(F.array(F.lit("START")), F.transform("events", token))
    return sequences.withColumn("tokens", F.array_join(words, " ")).drop("events")


def token_table(sequences: DataFrame, max_len: int, vocab: dict[str, int] = VOCAB) -> DataFrame:
    """Fixed-length training arrays: ids, positions and masks of inputs and targets.

    Shorter sequences are padded; longer ones keep their full length.
    """
    n = F.size("events") - 1
    pad = F.greatest(F.lit(max_len) - n, F.lit(0))
    parts = {"input": F.slice("events", 1, n), "target": F.slice("events", 2, n)}
    pad_ids = {"input": vocab["<pad>"], "target": labels.IGNORED_TARGET}

    def position(e):
        return F.array(*[F.coalesce(e[a], F.lit(0.0)).cast("float") for a in AXES])

    nowhere = F.array(*[F.lit(0.0).cast("float") for _ in AXES])
    columns = []
    for side, events in parts.items():
        ids = F.transform(events, lambda e: labels.type_id(e["type"], vocab))
        columns += [
            F.concat(ids, F.array_repeat(F.lit(pad_ids[side]), pad)).alias(f"{side}_types"),
            F.concat(F.transform(events, position), F.array_repeat(nowhere, pad)).alias(f"{side}_positions"),
            F.concat(
                F.transform(events, lambda e: e["x"].isNotNull()), F.array_repeat(F.lit(False), pad)
            ).alias(f"{side}_start_mask"),
            F.concat(
                F.transform(events, lambda e: e["end_x"].isNotNull()), F.array_repeat(F.lit(False), pad)
            ).alias(f"{side}_end_mask"),
        ]
    return sequences.select("match_id", "possession", *columns)


def real_length(types_column: str, vocab: dict[str, int] = VOCAB):
    """Number of tokens that are not padding."""
    return F.size(F.filter(F.col(types_column), lambda t: t != vocab["<pad>"]))


def explode_tokens(table: DataFrame) -> DataFrame:
    """One row per array slot of a token table."""
    names = [c for c in table.columns if c not in ("match_id", "possession")]
    zipped = F.posexplode(F.arrays_zip(*names)).alias("pos", "t")
    return table.select("match_id", "possession", zipped).select("match_id", "possession", "pos", "t.*")


def start_context(sequences: DataFrame, size: int = 3) -> DataFrame:
    """The first ``size`` events, or all input events when there are fewer; never the terminal."""
    first = F.slice("events", 1, F.least(F.lit(size), F.size("events") - 1))
    return sequences.withColumn("context", first)


def fourier(positions, frequencies=tuple(FREQUENCIES)):
    """Sine and cosine of every coordinate at every frequency, in the order coordinate, frequency, function."""
    rates = F.array(*[F.lit(float(f)) for f in frequencies])
    per_axis = F.transform(
        positions,
        lambda p: F.flatten(F.transform(rates, lambda r: F.array(F.sin(p * r), F.cos(p * r)))),
    )
    return F.flatten(per_axis)


def scoring_tokens(moves: DataFrame) -> DataFrame:
    """Passes and shots as scoring input: ordinal, type id and unrounded unit coordinates.

    A shot carries no end point here.
    """
    rows = moves.where(F.col("type").isin(*labels.PASS_ONLY_TYPES))
    rows = ordered.position(rows, ["match_id", "possession"], "index", "_at")
    end = lambda c, size: F.when(F.col("type") == "Pass", pitch.normalized(F.col(c), size, None))
    return rows.withColumns(
        {
            "token_idx": F.col("_at") - 1,
            "type_id": labels.type_id(F.col("type"), labels.PASS_ONLY_VOCAB),
            "x": pitch.normalized(F.col("x"), pitch.LENGTH, None),
            "y": pitch.normalized(F.col("y"), pitch.WIDTH, None),
            "end_x": end("end_x", pitch.LENGTH),
            "end_y": end("end_y", pitch.WIDTH),
        }
    ).drop("_at")


def feature_rows(sequences: DataFrame) -> DataFrame:
    """One row per input token: type, next type and the 4-value position with zeros for missing parts."""
    n = F.size("events") - 1

    def row(a, b):
        position = F.array(*[F.coalesce(a[c], F.lit(0.0)) for c in AXES])
        return F.struct(
            a["type"].alias("input_type"), b["type"].alias("target_type"), position.alias("position")
        )

    pairs = F.zip_with(F.slice("events", 1, n), F.slice("events", 2, n), row)
    rows = sequences.select("match_id", "possession", F.posexplode(pairs).alias("pos", "r"))
    return rows.select("match_id", "possession", "pos", "r.*")
