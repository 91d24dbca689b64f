"""Explicit schemas; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

_point = T.ArrayType(T.DoubleType())

EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("match_id", T.LongType()),
        T.StructField("possession", T.LongType()),
        T.StructField("index", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("team", T.StringType()),
        T.StructField("possession_team", T.StringType()),
        T.StructField("location", _point),
        T.StructField("pass_end_location", _point),
        T.StructField("carry_end_location", _point),
        T.StructField("shot_end_location", _point),
        T.StructField("shot_outcome", T.StringType()),
        T.StructField("shot_type", T.StringType()),
        T.StructField("player", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("period", T.LongType()),
        T.StructField("minute", T.LongType()),
        T.StructField("second", T.LongType()),
    ]
)

COMPETITION = T.StructType(
    [
        T.StructField("competition_id", T.LongType()),
        T.StructField("season_id", T.LongType()),
        T.StructField("country_name", T.StringType()),
        T.StructField("season_name", T.StringType()),
    ]
)

MATCH = T.StructType(
    [
        T.StructField("match_id", T.LongType()),
        T.StructField("competition_id", T.LongType()),
        T.StructField("season_id", T.LongType()),
    ]
)

FREEZE_FRAME = T.ArrayType(
    T.StructType(
        [
            T.StructField("teammate", T.BooleanType()),
            T.StructField("location", _point),
            T.StructField("position", T.StructType([T.StructField("name", T.StringType())])),
        ]
    )
)

SCORED_POSSESSION = T.StructType(
    [
        T.StructField("match_id", T.LongType()),
        T.StructField("possession", T.LongType()),
        T.StructField("team", T.StringType()),
        T.StructField("possession_team", T.StringType()),
        T.StructField("index", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("shot_outcome", T.StringType()),
        T.StructField("player", T.StringType()),
        T.StructField("minute", T.LongType()),
        T.StructField("second", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("x_end", T.DoubleType()),
        T.StructField("y_end", T.DoubleType()),
    ]
)

PREDICTION = T.StructType(
    [T.StructField("xT", T.DoubleType()), T.StructField("label", T.IntegerType())]
)

SENSITIVITY = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("distance_sb", T.DoubleType()),
        T.StructField("mean_xT", T.DoubleType()),
        T.StructField("std_xT", T.DoubleType()),
        T.StructField("delta_vs_baseline", T.DoubleType()),
    ]
)

EXPERIMENT = T.StructType(
    [
        T.StructField("phase", T.StringType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("carry_threshold", T.DoubleType()),
        T.StructField("context_length", T.IntegerType()),
        T.StructField("max_seq_len", T.IntegerType()),
        T.StructField("eval_max_seq_len", T.IntegerType()),
        T.StructField("num_layers", T.IntegerType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("single_mdn", T.BooleanType()),
        T.StructField("n_rollouts", T.IntegerType()),
        T.StructField("roc_auc", T.DoubleType()),
        T.StructField("brier_score", T.DoubleType()),
        T.StructField("separation", T.DoubleType()),
        T.StructField("mean_xT_goals", T.DoubleType()),
        T.StructField("mean_xT_no_goals", T.DoubleType()),
        T.StructField("val_loss", T.DoubleType()),
        T.StructField("train_loss", T.DoubleType()),
    ]
)
