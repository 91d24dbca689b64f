"""Queries on splits, variants and score quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildup.functions import labels
from buildup.operators import metrics, splits, zones
from buildup.operators import events as ev
from buildup.operators import sequences as seq
from buildup.plans import views
from buildup.plans.exploration import lengths, _LENGTHS
from buildup.plans.movement import all_events, big, moves
from buildup.plans.registry import SQL, query
from buildup.session import new_table_path
from buildup.sources import sinks, standin

KEYS = seq.KEYS


def goals(spark, sf_dir):
    return seq.possession_goals(seq.truncate_last(moves(spark, sf_dir)))


def rounded(df, *names, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


# ---- zones

_LOCATED = f"""{views.EV}, located AS (
  SELECT *, least(greatest(CAST(floor(x * 12 / 120.0::DOUBLE) AS BIGINT), 0), 11) AS x_bin,
    least(greatest(CAST(floor(y * 12 / 80.0::DOUBLE) AS BIGINT), 0), 11) AS y_bin
  FROM ev WHERE type IN ('Pass', 'Carry', 'Shot') AND x IS NOT NULL),
shot_poss AS (SELECT DISTINCT match_id, possession, 1 AS has_shot FROM located WHERE type = 'Shot')"""

_THROUGH = f"""{_LOCATED}, through AS (
  SELECT x_bin, y_bin, count(*) AS total, CAST(sum(coalesce(has_shot, 0)) AS BIGINT) AS with_shot
  FROM (SELECT DISTINCT x_bin, y_bin, match_id, possession FROM located) d
  LEFT JOIN shot_poss USING (match_id, possession) GROUP BY x_bin, y_bin)"""


def _cells(df):
    return df.select(
        *big("x_bin", "y_bin"), *[c for c in df.columns if c not in ("x_bin", "y_bin")]
    )


@query("zone_event_counts", f"""{views.EV}
SELECT least(greatest(CAST(floor(x * 25 / 120.0::DOUBLE) AS BIGINT), 0), 24) AS x_bin,
  least(greatest(CAST(floor(y * 25 / 80.0::DOUBLE) AS BIGINT), 0), 24) AS y_bin, count(*) AS n
FROM ev WHERE type IN ('Pass', 'Carry', 'Shot') AND x IS NOT NULL GROUP BY 1, 2""")
def zone_event_counts(spark, sf_dir):
    return _cells(zones.event_counts(ev.with_coordinates(all_events(spark, sf_dir))))


@query("zone_shot_rate", f"""{_THROUGH}
SELECT *, round(with_shot * 100.0::DOUBLE / total, 6) AS rate FROM through""")
def zone_shot_rate(spark, sf_dir):
    rows = zones.shot_rate_through(ev.with_coordinates(all_events(spark, sf_dir)))
    return rounded(_cells(rows), "rate")


@query("zone_start_shot_rate", f"""{_LOCATED}, first_one AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, possession ORDER BY index) AS rn
                 FROM located) t WHERE rn = 1)
SELECT x_bin, y_bin, count(*) AS total, CAST(sum(coalesce(has_shot, 0)) AS BIGINT) AS with_shot,
  round(sum(coalesce(has_shot, 0)) * 100.0::DOUBLE / count(*), 6) AS rate
FROM first_one LEFT JOIN shot_poss USING (match_id, possession) GROUP BY x_bin, y_bin""")
def zone_start_shot_rate(spark, sf_dir):
    rows = zones.shot_rate_start(ev.with_coordinates(all_events(spark, sf_dir)))
    return rounded(_cells(rows), "rate")


@query("zone_shot_rate_dense", f"""{_THROUGH}
SELECT a.range AS x_bin, b.range AS y_bin, total, with_shot,
  round(with_shot * 100.0::DOUBLE / total, 6) AS rate
FROM range(12) a CROSS JOIN range(12) b LEFT JOIN through ON x_bin = a.range AND y_bin = b.range""")
def zone_shot_rate_dense(spark, sf_dir):
    rates = zones.shot_rate_through(ev.with_coordinates(all_events(spark, sf_dir)))
    return rounded(_cells(zones.dense(rates)), "rate")


# ---- splits

@query("hash_split", f"{views.SEQ} SELECT match_id, possession, {views.SPLIT_OF} AS split FROM poss")
def hash_split(spark, sf_dir):
    return splits.with_split(goals(spark, sf_dir)).select(*KEYS, "split")


_BALANCED = f"""{views.SEQ}, train AS (
  SELECT *, {views.digits(1)} / 4294967296.0::DOUBLE AS u FROM poss WHERE {views.digits(0)} % 100 < 80),
part AS (SELECT least(1.0, (count(*) FILTER (goal = 1) / 0.05::DOUBLE - count(*) FILTER (goal = 1))
                / nullif(count(*) FILTER (goal = 0), 0)) AS fraction FROM train),
balanced AS (SELECT train.* FROM train, part WHERE goal = 1 OR (goal = 0 AND u < fraction))"""


@query("balanced_train", f"{_BALANCED} SELECT match_id, possession, goal FROM balanced")
def balanced_train(spark, sf_dir):
    rows = splits.with_split(goals(spark, sf_dir)).where("split = 'train'")
    return splits.balance(rows).select(*KEYS, *big("goal"))


@query("split_goal_balance", f"""{views.SEQ}, parts AS (SELECT goal, {views.SPLIT_OF} AS split FROM poss)
SELECT split, goal, count(*) AS n,
  round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY split), 2) AS pct
FROM parts GROUP BY split, goal""")
def split_goal_balance(spark, sf_dir):
    rows = splits.goal_balance(splits.with_split(goals(spark, sf_dir)))
    return rows.select("split", *big("goal"), "n", "pct")


@query("fixed_sample", f"""{views.SEQ}
SELECT match_id, possession, goal FROM poss ORDER BY {views.digits(2)}, match_id, possession LIMIT 1000""")
def fixed_sample(spark, sf_dir):
    return splits.fixed_sample(goals(spark, sf_dir), 1000).select(*KEYS, *big("goal"))


# Thresholds and contexts of the sweep.
THRESHOLDS = [1, 2, 3, 5, 8]
CONTEXTS = [2, 5, 8, 10, 14, 18, 23]

VARIANTS = f"""{views.MV}, copies AS (
  SELECT mv.*, t.threshold, row_number() OVER (
      PARTITION BY threshold, match_id, possession ORDER BY index DESC) AS event_rank
  FROM mv, (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold) t
  WHERE type <> 'Carry' OR carry_dist >= threshold),
vtrunc AS (
  SELECT copies.*, c.context FROM copies, (SELECT unnest({CONTEXTS})::BIGINT AS context) c
  WHERE event_rank <= context),
vposs AS (
  SELECT threshold, context, match_id, possession, count(*) + 1 AS sequence_length,
    CAST(sum(CASE WHEN shot_outcome = 'Goal' THEN 1 ELSE 0 END) AS BIGINT) AS goal
  FROM vtrunc GROUP BY ALL)"""


@query("sequence_variants", f"""{VARIANTS}
SELECT threshold, context, count(*) AS possessions, count(*) FILTER (goal = 1) AS goals,
  count(*) FILTER (goal > 1) AS several_goals, round(avg(sequence_length), 6) AS mean_length
FROM vposs GROUP BY threshold, context""")
def sequence_variants(spark, sf_dir):
    rows = splits.variant_possessions(moves(spark, sf_dir), THRESHOLDS, CONTEXTS)
    return rows.groupBy("threshold", *big("context")).agg(
        F.count("*").alias("possessions"),
        F.count_if(F.col("goal") == 1).alias("goals"),
        F.count_if(F.col("goal") > 1).alias("several_goals"),
        F.round(F.avg("sequence_length"), 6).alias("mean_length"),
    )


@query("train_eval_contexts", f"""{VARIANTS}
SELECT a.context, a.goal AS goal_short, b.goal AS goal_full, count(*) AS n,
  CAST(sum(b.sequence_length - a.sequence_length) AS BIGINT) AS extra_events
FROM vposs a JOIN vposs b USING (threshold, match_id, possession)
WHERE threshold = 2 AND b.context = 14 GROUP BY 1, 2, 3""")
def train_eval_contexts(spark, sf_dir):
    """Each possession at every context it could be trained on, against the context it is evaluated on."""
    rows = splits.variant_possessions(moves(spark, sf_dir), [2], CONTEXTS)
    short = F.struct("context", "goal", "sequence_length")
    both = rows.groupBy(*KEYS).agg(
        F.max(F.when(F.col("context") == 14, F.col("goal"))).alias("goal_full"),
        F.max(F.when(F.col("context") == 14, F.col("sequence_length"))).alias("length_full"),
        F.collect_list(short).alias("short"),  # one entry a context
    )
    pairs = both.select("goal_full", "length_full", F.explode("short").alias("s"))
    return pairs.groupBy(
        F.col("s.context").cast("bigint").alias("context"),
        F.col("s.goal").cast("bigint").alias("goal_short"),
        F.col("goal_full").cast("bigint").alias("goal_full"),
    ).agg(
        F.count("*").alias("n"),
        F.sum(F.col("length_full") - F.col("s.sequence_length")).cast("bigint").alias("extra_events"),
    )


@query("context_grid", f"""{_LENGTHS}
SELECT context FROM (
  SELECT DISTINCT unnest(quantile_disc(n_events, {[p / 100 for p in range(5, 100, 5)]})) AS context
  FROM len) t WHERE context >= 3""")
def context_grid(spark, sf_dir):
    return splits.context_grid(lengths(spark, sf_dir))


# ---- score quality

def scored(spark, sf_dir):
    return standin.scored(spark, sf_dir)


_AUC = f"""{views.SCORED}, ranks AS (
  SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r
  FROM scored)"""
_AUC_EXPR = """(sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
  / (sum(label)::DOUBLE * (count(*) - sum(label)))"""


@query("roc_auc", f"{_AUC} SELECT round({_AUC_EXPR}, 6) AS roc_auc FROM ranks")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(scored(spark, sf_dir)), "roc_auc")


@query("roc_curve", f"""{views.SCORED}, cuts AS (SELECT DISTINCT score AS threshold FROM scored)
SELECT threshold, round(count(*) FILTER (label = 1 AND score >= threshold) * 1.0::DOUBLE
    / count(*) FILTER (label = 1), 6) AS tpr,
  round(count(*) FILTER (label = 0 AND score >= threshold) * 1.0::DOUBLE
    / count(*) FILTER (label = 0), 6) AS fpr FROM cuts, scored GROUP BY threshold
UNION ALL SELECT 'Infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""")
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(scored(spark, sf_dir)), "tpr", "fpr")


@query("brier", f"{views.SCORED} SELECT round(avg((score - label) * (score - label)), 6) AS brier_score FROM scored")
def brier(spark, sf_dir):
    return rounded(metrics.summary(scored(spark, sf_dir)).select("brier_score"), "brier_score")


_P = "greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, score))"


@query("log_loss", f"""{views.SCORED}
SELECT round(avg(CASE WHEN label = 1 THEN -ln({_P}) ELSE -ln(1 - {_P}) END), 6) AS log_loss FROM scored""")
def log_loss(spark, sf_dir):
    return rounded(metrics.summary(scored(spark, sf_dir)).select("log_loss"), "log_loss")


@query("separation", f"""{views.SCORED}, m AS (
  SELECT avg(score) FILTER (label = 1) AS a, avg(score) FILTER (label = 0) AS b FROM scored)
SELECT round(a, 6) AS mean_goals, round(b, 6) AS mean_no_goals, round(a - b, 6) AS separation,
  round((a - b) / a, 6) AS relative_drop FROM m""")
def separation(spark, sf_dir):
    rows = metrics.summary(scored(spark, sf_dir))
    drop = metrics.relative_drop(F.col("mean_goals"), F.col("mean_no_goals"))
    rows = rows.select("mean_goals", "mean_no_goals", "separation", drop.alias("relative_drop"))
    return rounded(rows, *rows.columns)


@query("xg_ratio", f"{views.SCORED} SELECT round(sum(score) / sum(label), 6) AS xg_ratio FROM scored")
def xg_ratio(spark, sf_dir):
    return rounded(metrics.summary(scored(spark, sf_dir)).select("xg_ratio"), "xg_ratio")


def with_gaps(spark, sf_dir):
    """The scored table with missing scores."""
    return scored(spark, sf_dir).withColumn("score", F.expr("if(event_id % 17 = 0, null, score)"))


BINS_SQL = """bins AS (SELECT range AS bin, range * 0.1::DOUBLE AS low,
  CASE WHEN range = 9 THEN 1.0::DOUBLE ELSE (range + 1) * 0.1::DOUBLE END AS high FROM range(10))"""


@query("ece", f"""{views.SCORED}, {BINS_SQL}, r AS (
  SELECT bin, count(*) AS n, avg(score) AS c, avg(label) AS a
  FROM scored JOIN bins ON score >= low AND score < high GROUP BY bin)
SELECT round(sum(abs(c - a) * n) / (SELECT count(*) FROM scored), 6) AS ece FROM r""")
def ece(spark, sf_dir):
    return rounded(metrics.ece(scored(spark, sf_dir)), "ece")


@query("reliability_fixed", f"""{views.SCORED}, {BINS_SQL}
SELECT bin, count(*) AS n, round(avg(score), 6) AS confidence, round(avg(label), 6) AS accuracy
FROM scored JOIN bins ON score >= low AND score < high GROUP BY bin""")
def reliability_fixed(spark, sf_dir):
    return rounded(metrics.reliability(scored(spark, sf_dir)), "confidence", "accuracy")


@query("reliability_range", f"""{views.SCORED}, lim AS (SELECT min(score) AS lo, max(score) AS hi FROM scored),
edges AS (SELECT range AS bin, lo + range * ((hi - lo) / 10) AS low,
  CASE WHEN range = 9 THEN 2.0 ELSE lo + (range + 1) * ((hi - lo) / 10) END AS high FROM lim, range(10))
SELECT bin, count(*) AS n, round(avg(score), 6) AS confidence, round(avg(label), 6) AS accuracy
FROM scored JOIN edges ON score >= low AND score < high GROUP BY bin""")
def reliability_range(spark, sf_dir):
    return rounded(metrics.reliability_range(scored(spark, sf_dir)), "confidence", "accuracy")


_GAPS = views.SCORED.replace("FROM events)", "FROM events WHERE event_id % 17 <> 0)")


@query("log_loss_gaps", f"""{_GAPS} SELECT count(*) AS n, round(avg((score - label) * (score - label)), 6) AS brier_score,
  round(avg(CASE WHEN label = 1 THEN -ln({_P}) ELSE -ln(1 - {_P}) END), 6) AS log_loss,
  round(sum(score) / sum(label), 6) AS xg_ratio FROM scored""")
def log_loss_gaps(spark, sf_dir):
    rows = metrics.summary(with_gaps(spark, sf_dir))
    return rounded(rows.select("n", "brier_score", "log_loss", "xg_ratio"), "brier_score", "log_loss", "xg_ratio")


@query("ece_gaps", f"""{_GAPS}, {BINS_SQL}, r AS (
  SELECT bin, count(*) AS n, avg(score) AS c, avg(label) AS a
  FROM scored JOIN bins ON score >= low AND score < high GROUP BY bin)
SELECT round(sum(abs(c - a) * n) / (SELECT count(*) FROM scored), 6) AS ece FROM r""")
def ece_gaps(spark, sf_dir):
    return rounded(metrics.ece(with_gaps(spark, sf_dir)), "ece")


@query("reliability_range_gaps", SQL["reliability_range"].replace(views.SCORED, _GAPS))
def reliability_range_gaps(spark, sf_dir):
    return rounded(metrics.reliability_range(with_gaps(spark, sf_dir)), "confidence", "accuracy")


# ---- the dataset: every variant, balanced for training and natural otherwise

# Truncation length of each variant.
DATASETS = {"t2": 14, "adaptive": 14, "nofilter": 14, "passonly": 12}
_AXES = ("x", "y", "end_x", "end_y")


def _dataset_sql(variant: str, n: int) -> str:
    source = {
        "t2": "SELECT * FROM mv WHERE type <> 'Carry' OR carry_dist >= 2",
        "adaptive": "SELECT * FROM mv",
        "nofilter": "SELECT * FROM mv",
        "passonly": "SELECT * FROM mv WHERE type IN ('Pass', 'Shot')",
    }[variant]
    order = "index DESC"
    if variant == "adaptive":
        order = "CASE WHEN type = 'Carry' THEN 2 ELSE 1 END, CASE WHEN type = 'Carry' THEN carry_dist END DESC NULLS LAST, index DESC"
    checksum = " + ".join(f"coalesce(sum(round({c} / {'120.0' if 'x' in c else '80.0'}, 5)), 0)" for c in _AXES)
    return f"""{variant}_cut AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, possession ORDER BY {order}) AS keep
    FROM ({source}) s) t WHERE keep <= {n}),
{variant}_poss AS (
  SELECT match_id, possession, count(*) + 1 AS tokens, {checksum} AS checksum,
    sum(CASE WHEN shot_outcome = 'Goal' THEN 1 ELSE 0 END) AS goal, {views.SPLIT_OF} AS split
  FROM {variant}_cut GROUP BY match_id, possession),
{variant}_kept AS (
  SELECT p.* FROM {variant}_poss p, (
    SELECT least(1.0, (count(*) FILTER (goal = 1) / 0.05::DOUBLE - count(*) FILTER (goal = 1))
      / count(*) FILTER (goal = 0)) AS fraction FROM {variant}_poss WHERE split = 'train') f
  WHERE split <> 'train' OR goal = 1 OR (goal = 0 AND {views.digits(1)} / 4294967296.0::DOUBLE < fraction))"""


def _dataset_part(variant: str, n: int) -> str:
    name = variant + f"_ctx{n}"
    return f"""SELECT '{name}' AS variant, split, count(*) AS possessions, CAST(sum(tokens) AS BIGINT) AS tokens,
  CAST(sum(goal) AS BIGINT) AS goals, round(sum(checksum), 3) AS checksum FROM {variant}_kept GROUP BY split"""


@query(
    "dataset_build",
    f"{views.MV}, "
    + ", ".join(_dataset_sql(v, n) for v, n in DATASETS.items())
    + " "
    + " UNION ALL ".join(_dataset_part(v, n) for v, n in DATASETS.items()),
)
def dataset_build(spark, sf_dir):
    """Every dataset variant, written by variant and split, read back and summed up."""
    events = standin.events(spark, sf_dir)
    path = new_table_path(spark, "dataset")
    for variant, n in DATASETS.items():
        rows = splits.dataset(splits.variant_events(events, variant), n, variant)
        sinks.write_splits(rows.withColumn("variant", F.lit(sinks.variant_name(variant, context=n))), path, append=True)
    back = spark.read.schema(rows.schema.add("variant", "string")).parquet(path)
    value = lambda c: F.aggregate("events", F.lit(0.0), lambda a, e: a + F.coalesce(e[c], F.lit(0.0)))
    checksum = sum((value(c) for c in _AXES[1:]), value(_AXES[0]))
    return back.groupBy("variant", "split").agg(
        F.count("*").alias("possessions"),
        F.sum("sequence_length").cast("bigint").alias("tokens"),
        F.sum("goal").cast("bigint").alias("goals"),
        F.round(F.sum(checksum), 3).alias("checksum"),
    )
