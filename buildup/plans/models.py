"""Queries on token tables, calibration, runs and Spark ML models."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildup.functions import labels, pitch
from buildup.operators import calibrate, context, experiments, metrics, models, splits, threat, tokens
from buildup.operators import sequences as seq
from buildup.plans import views
from buildup.plans.evaluation import BINS_SQL, CONTEXTS, rounded, scored, with_gaps
from buildup.plans.movement import big, moves, sequences
from buildup.plans.registry import query
from buildup.plans.threat import ACTIONS, THREAT, scored_actions
from buildup.session import stage

KEYS = seq.KEYS
MAX_LEN = 16


def normalized(spark, sf_dir):
    return seq.normalize(sequences(spark, sf_dir))


def type_case(column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in labels.VOCAB.items()) + " END::BIGINT"


# ---- tokens

@query("token_ids", f"""{views.NORM}
SELECT match_id, possession, string_agg({type_case('type')}::VARCHAR, ' ' ORDER BY pos) AS ids
FROM norm GROUP BY match_id, possession""")
def token_ids(spark, sf_dir):
    ids = F.transform("events", lambda e: labels.type_id(e["type"]).cast("string"))
    return sequences(spark, sf_dir).select(*KEYS, F.array_join(ids, " ").alias("ids"))


_SLOTS = f"""{views.NORM}, slots AS (
  SELECT match_id, possession, sequence_length, range AS pos FROM poss, range({MAX_LEN})),
feat AS (
  SELECT s.match_id, s.possession, s.pos,
    CASE WHEN s.pos < sequence_length - 1 THEN {type_case('a.type')} ELSE 4 END AS input_type,
    CASE WHEN s.pos < sequence_length - 1 THEN {type_case('b.type')} ELSE -100 END AS target_type,
    CASE WHEN s.pos < sequence_length - 1 THEN coalesce(a.x, 0) ELSE 0 END AS x,
    CASE WHEN s.pos < sequence_length - 1 THEN coalesce(a.y, 0) ELSE 0 END AS y,
    CASE WHEN s.pos < sequence_length - 1 THEN coalesce(a.end_x, 0) ELSE 0 END AS end_x,
    CASE WHEN s.pos < sequence_length - 1 THEN coalesce(a.end_y, 0) ELSE 0 END AS end_y,
    (s.pos < sequence_length - 1 AND a.x IS NOT NULL)::INT::BIGINT AS input_start,
    (s.pos < sequence_length - 1 AND a.end_x IS NOT NULL)::INT::BIGINT AS input_end,
    (s.pos < sequence_length - 1 AND b.x IS NOT NULL)::INT::BIGINT AS target_start,
    (s.pos < sequence_length - 1 AND b.end_x IS NOT NULL)::INT::BIGINT AS target_end
  FROM slots s LEFT JOIN norm a ON a.match_id = s.match_id AND a.possession = s.possession AND a.pos = s.pos
  LEFT JOIN norm b ON b.match_id = s.match_id AND b.possession = s.possession AND b.pos = s.pos + 1)"""


@query("token_features", f"""{_SLOTS}
SELECT match_id, possession, pos, input_type, target_type, round(x, 5) AS x, round(y, 5) AS y,
  round(end_x, 5) AS end_x, round(end_y, 5) AS end_y, input_start, input_end, target_start, target_end FROM feat""")
def token_features(spark, sf_dir):
    table = tokens.explode_tokens(tokens.token_table(normalized(spark, sf_dir), MAX_LEN))
    # the arrays hold floats of values with 5 decimals
    at = lambda i, name: F.get("input_positions", F.lit(i)).cast("decimal(12,5)").cast("double").alias(name)
    return table.select(
        *KEYS, *big("pos"),
        F.col("input_types").cast("bigint").alias("input_type"),
        F.col("target_types").cast("bigint").alias("target_type"),
        *[at(i, name) for i, name in enumerate(tokens.AXES)],
        *[
            F.col(f"{side}_{part}_mask").cast("int").cast("bigint").alias(f"{side}_{part}")
            for side in ("input", "target") for part in ("start", "end")
        ],
    )


_FOURIER = " + ".join(
    f"[round(sin({a} * {f}), 6), round(cos({a} * {f}), 6)]" for a in tokens.AXES for f in tokens.FREQUENCIES
).replace(" + ", ", ")


@query("fourier_features", f"""{views.NORM}, inputs AS (
  SELECT match_id, possession, pos, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(end_x, 0) AS end_x,
    coalesce(end_y, 0) AS end_y FROM norm WHERE type NOT IN ('GOAL', 'NO_GOAL')),
f AS (SELECT match_id, possession, pos, flatten([{_FOURIER}]) AS v FROM inputs)
SELECT match_id, possession, pos, i AS feature, v[i + 1] AS value FROM f, (SELECT range AS i FROM range(64)) r""")
def fourier_features(spark, sf_dir):
    rows = tokens.feature_rows(normalized(spark, sf_dir))
    values = rows.select(*KEYS, *big("pos"), F.posexplode(tokens.fourier(F.col("position"))).alias("i", "v"))
    return values.select(*KEYS, "pos", F.col("i").cast("bigint").alias("feature"), F.round("v", 6).alias("value"))


WEIGHTS = {"Pass": 1.0, "Shot": 2.0, "GOAL": 10.0, "NO_GOAL": 1.5, "<pad>": 1.0, "Carry": 1.0}
_WEIGHT_CASE = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " ELSE 1.0 END::DOUBLE"


@query("class_weights", f"""{views.SEQ}
SELECT {type_case('type')} AS id, type, count(*) AS n, {_WEIGHT_CASE.format(c='type')} AS weight,
  round(count(*) * {_WEIGHT_CASE.format(c='type')}, 6) AS weighted FROM tok WHERE pos > 0 GROUP BY type""")
def class_weights(spark, sf_dir):
    targets = seq.explode(sequences(spark, sf_dir)).where("pos > 0").groupBy("type").agg(F.count("*").alias("n"))
    weight = F.coalesce(F.try_element_at(labels.literal_map(WEIGHTS), F.col("type")), F.lit(1.0))
    return targets.select(
        labels.type_id(F.col("type")).cast("bigint").alias("id"), "type", "n", weight.alias("weight"),
        F.round(F.col("n") * weight, 6).alias("weighted"),
    )


_PREDICT = f"""{views.SEQ}, pairs AS (
  SELECT a.type AS input_type, b.type AS truth, {views.SPLIT_OF.replace('match_id', 'a.match_id').replace('possession', 'a.possession')} AS split
  FROM tok a JOIN tok b ON a.match_id = b.match_id AND a.possession = b.possession AND b.pos = a.pos + 1),
trans AS (
  SELECT input_type, truth AS target_type, count(*) AS n,
    count(*) / sum(count(*)) OVER (PARTITION BY input_type) AS p
  FROM pairs WHERE split = 'train' GROUP BY 1, 2),
best AS (SELECT input_type, first(target_type ORDER BY n DESC, target_type) AS predicted FROM trans GROUP BY 1),
pred AS (
  SELECT pairs.*, predicted, p, {_WEIGHT_CASE.format(c='truth')} AS weight
  FROM pairs JOIN best USING (input_type) JOIN trans ON trans.input_type = pairs.input_type AND target_type = truth
  WHERE split <> 'train')"""


def transition_predictions(spark, sf_dir):
    """Next-type predictions of the transition table learnt on the training split, on the other splits."""
    pairs = tokens.causal_pairs(splits.with_split(sequences(spark, sf_dir)))
    table = threat.type_transitions(pairs.where("split = 'train'"))
    most = F.min(F.struct((-F.col("n")).alias("order"), "target_type"))["target_type"]
    best = table.groupBy("input_type").agg(most.alias("predicted"))
    weight = F.coalesce(F.try_element_at(labels.literal_map(WEIGHTS), F.col("truth")), F.lit(1.0))
    held = pairs.where("split <> 'train'").withColumnRenamed("target_type", "truth")
    chances = table.select("input_type", F.col("target_type").alias("truth"), "p")
    return (
        held.join(best, "input_type")
        .join(chances, ["input_type", "truth"])
        .withColumn("weight", weight)
    )


@query("accuracy_by_type", f"""{_PREDICT}
SELECT truth, count(*) AS n, round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pred GROUP BY truth""")
def accuracy_by_type(spark, sf_dir):
    return rounded(metrics.accuracy_by_type(transition_predictions(spark, sf_dir)), "accuracy")


@query("weighted_log_loss", f"{_PREDICT} SELECT round(sum(weight * -ln(p)) / sum(weight), 6) AS loss FROM pred")
def weighted_log_loss(spark, sf_dir):
    return rounded(metrics.weighted_cross_entropy(transition_predictions(spark, sf_dir)), "loss")


# ---- calibration

# Newton steps of the penalised logistic fit on ``fitted`` (s, n, k)
_PLATT = """platt(i, a, b) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab),
         b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT i, a, b, a + sum((n * p - k) * s) AS ga, sum(n * p - k) AS gb,
          1 + sum(n * p * (1 - p) * s * s) AS haa, sum(n * p * (1 - p) * s) AS hab, sum(n * p * (1 - p)) AS hbb
        FROM (SELECT i, a, b, n, k, s, 1 / (1 + exp(-(a * s + b))) AS p FROM platt, fitted WHERE i < 25) q
        GROUP BY i, a, b) g)"""



def _newton(name: str, first: str, second: str) -> str:
    """Newton steps of the logistic fit of two features and an intercept on ``fitted``."""
    return f"""{name}(i, a, b, c) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1,
    a - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det,
    b - (h11 * (g2 * h33 - g3 * h23) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det,
    c - (h11 * (h22 * g3 - h23 * g2) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det
  FROM (SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS det
    FROM (SELECT i, a, b, c, sum(r * f1) AS g1, sum(r * f2) AS g2, sum(r) AS g3, sum(w * f1 * f1) AS h11,
        sum(w * f1 * f2) AS h12, sum(w * f1) AS h13, sum(w * f2 * f2) AS h22, sum(w * f2) AS h23, sum(w) AS h33
      FROM (SELECT *, n * p - k AS r, n * p * (1 - p) AS w FROM (
          SELECT i, a, b, c, n, k, f1, f2, 1 / (1 + exp(-(a * f1 + b * f2 + c))) AS p
          FROM {name}, (SELECT n, k, {first} AS f1, {second} AS f2 FROM fitted) f WHERE i < 40) q0) q
      GROUP BY i, a, b, c) g) d)"""


def _newton_one(name: str, feature: str) -> str:
    """The same for one feature."""
    return f"""{name}(i, a, c) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, a - (hcc * ga - hac * gc) / (haa * hcc - hac * hac), c - (haa * gc - hac * ga) / (haa * hcc - hac * hac)
  FROM (SELECT i, a, c, sum((n * p - k) * f) AS ga, sum(n * p - k) AS gc, sum(n * p * (1 - p) * f * f) AS haa,
      sum(n * p * (1 - p) * f) AS hac, sum(n * p * (1 - p)) AS hcc
    FROM (SELECT i, a, c, n, k, {feature} AS f, 1 / (1 + exp(-(a * {feature} + c))) AS p
      FROM {name}, fitted WHERE i < 40) q GROUP BY i, a, c) g)"""


# the fit is convex with two lower bounds: the best of the four choices of active bounds that keeps them
_BETA = """choices AS (
  SELECT a, b, c FROM free WHERE i = 40 UNION ALL SELECT a, 0.0::DOUBLE, c FROM only_u WHERE i = 40
  UNION ALL SELECT 0.0::DOUBLE, a, c FROM only_v WHERE i = 40
  UNION ALL SELECT 0.0::DOUBLE, 0.0::DOUBLE, ln(sum(k) / (sum(n) - sum(k))) FROM fitted),
likely AS (SELECT a, b, c, sum(k * z - n * greatest(z, 0) - n * ln(1 + exp(-abs(z)))) AS loglik
  FROM (SELECT a, b, c, n, k, a * u + b * v + c AS z FROM choices, fitted WHERE a >= 0 AND b >= 0) q GROUP BY a, b, c),
beta_fit AS (SELECT a, b, c FROM likely ORDER BY loglik DESC LIMIT 1)"""

_HALF = "('0x' || substr(md5(concat(user_id, '-42')), 1, 8))::BIGINT % 100 < 50"
_CAL = f"""WITH RECURSIVE {views.SCORED[5:]}, side AS (SELECT *, {_HALF} AS fit FROM scored),
fitted AS (SELECT score AS s, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS k,
    ln(greatest(1e-7, least(1 - 1e-7, score)) / (1 - greatest(1e-7, least(1 - 1e-7, score)))) AS l,
    ln(greatest(1e-7, least(1 - 1e-7, score))) AS u, -ln(1 - greatest(1e-7, least(1 - 1e-7, score))) AS v
  FROM side WHERE fit GROUP BY score),
applied AS (SELECT score AS s, label,
    ln(greatest(1e-7, least(1 - 1e-7, score)) / (1 - greatest(1e-7, least(1 - 1e-7, score)))) AS l,
    ln(greatest(1e-7, least(1 - 1e-7, score))) AS u, -ln(1 - greatest(1e-7, least(1 - 1e-7, score))) AS v
  FROM side WHERE NOT fit),
{_PLATT},
{_newton('quad', 'l', 'l * l')},
{_newton('free', 'u', 'v')},
{_newton_one('only_u', 'u')},
{_newton_one('only_v', 'v')},
{_BETA},
cum AS (SELECT *, sum(n) OVER o AS cn, sum(k) OVER o AS ck, row_number() OVER o AS r FROM fitted
        WINDOW o AS (ORDER BY s)),
span AS (SELECT j.r AS lo, h.r AS hi, (h.ck - j.ck + j.k) / (h.cn - j.cn + j.n) AS m
         FROM cum j JOIN cum h ON h.r >= j.r),
iso AS (SELECT c.s, max(worst) AS v FROM cum c JOIN (
    SELECT lo, i.r, min(m) AS worst FROM span JOIN cum i ON i.r BETWEEN lo AND hi GROUP BY lo, i.r) t ON t.r = c.r
  GROUP BY c.s),
iso_end AS (SELECT min(s) AS first_s, max(s) AS last_s, min(v) AS first_v, max(v) AS last_v FROM iso),
iso_at AS (
  SELECT DISTINCT a.s, coalesce(e.v, CASE WHEN a.s < first_s THEN first_v WHEN a.s > last_s THEN last_v
      ELSE p.v + (q.v - p.v) * (a.s - p.s) / (q.s - p.s) END) AS v
  FROM (SELECT DISTINCT s FROM applied) a CROSS JOIN iso_end LEFT JOIN iso e ON e.s = a.s
  LEFT JOIN iso p ON p.s = (SELECT max(s) FROM iso WHERE s < a.s)
  LEFT JOIN iso q ON q.s = (SELECT min(s) FROM iso WHERE s > a.s)),
curves AS (
  SELECT x.s, label, 1 / (1 + exp(-(pl.a * x.s + pl.b))) AS platt, iso_at.v AS isotonic,
    1 / (1 + exp(-(qu.a * x.l + qu.b * x.l * x.l + qu.c))) AS quadratic,
    1 / (1 + exp(-(be.a * x.u + be.b * x.v + be.c))) AS beta
  FROM applied x JOIN iso_at ON iso_at.s = x.s, platt pl, quad qu, beta_fit be WHERE pl.i = 25 AND qu.i = 40)"""


def halves(spark, sf_dir):
    """Scored rows to fit on and to apply to, split by user."""
    rows = scored(spark, sf_dir).withColumn("fit", splits.key_hash(keys=["user_id"]) % 100 < 50)
    return rows.where("fit"), rows.where("not fit")


def calibrated_scores(spark, sf_dir, method):
    fit_on, apply_to = halves(spark, sf_dir)
    out = calibrate.calibrate(fit_on, apply_to, method)
    return out.groupBy("score", F.round("calibrated", 4).alias("calibrated")).agg(F.count("*").alias("n"))


def _curve_sql(method: str) -> str:
    return f"{_CAL} SELECT s AS score, round({method}, 4) AS calibrated, count(*) AS n FROM curves GROUP BY ALL"


@query("calibrate_platt", _curve_sql("platt"))
def calibrate_platt(spark, sf_dir):
    return calibrated_scores(spark, sf_dir, "platt")


@query("calibrate_isotonic", _curve_sql("isotonic"))
def calibrate_isotonic(spark, sf_dir):
    return calibrated_scores(spark, sf_dir, "isotonic")


@query("calibrate_quadratic_logit", _curve_sql("quadratic"))
def calibrate_quadratic_logit(spark, sf_dir):
    return calibrated_scores(spark, sf_dir, "quadratic")


# a twentieth of the scores is missing: those rows are as if they were not there
GAP = 17


@query("calibrate_quadratic_gaps", _curve_sql("quadratic").replace("FROM events)", f"FROM events WHERE event_id % {GAP} <> 0)"))
def calibrate_quadratic_gaps(spark, sf_dir):
    rows = with_gaps(spark, sf_dir).withColumn("fit", splits.key_hash(keys=["user_id"]) % 100 < 50)
    out = calibrate.calibrate(rows.where("fit"), rows.where("not fit"), "quadratic").where("score is not null")
    return out.groupBy("score", F.round("calibrated", 4).alias("calibrated")).agg(F.count("*").alias("n"))


@query("calibrate_beta", _curve_sql("beta"))
def calibrate_beta(spark, sf_dir):
    return calibrated_scores(spark, sf_dir, "beta")


_LONG = f"""{_CAL}, long AS (
  SELECT 'raw' AS method, s AS score, label FROM curves UNION ALL SELECT 'platt', platt, label FROM curves
  UNION ALL SELECT 'isotonic', isotonic, label FROM curves
  UNION ALL SELECT 'beta', beta, label FROM curves
  UNION ALL SELECT 'quadratic', quadratic, label FROM curves)"""
METHODS = ["platt", "isotonic", "beta", "quadratic"]


@query("metrics_by_method", f"""{_LONG}, {BINS_SQL}, ranked AS (
  SELECT *, rank() OVER (PARTITION BY method ORDER BY score)
    + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0::DOUBLE AS r FROM long),
base AS (SELECT method, count(*) AS n, avg((score - label) * (score - label)) AS brier,
    (sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
      / (sum(label)::DOUBLE * (count(*) - sum(label))) AS auc FROM ranked GROUP BY method),
cells AS (SELECT method, bin, count(*) AS m, abs(avg(score) - avg(label)) AS gap
  FROM long JOIN bins ON score >= low AND score < high GROUP BY method, bin),
total AS (SELECT method, sum(m * gap) AS gaps FROM cells GROUP BY method)
SELECT method, n, round(brier, 4) AS brier_score, round(auc, 4) AS roc_auc, round(gaps / n, 4) AS ece
FROM base JOIN total USING (method)""")
def metrics_by_method(spark, sf_dir):
    rows = metrics.record(calibrate.by_method(*halves(spark, sf_dir), METHODS), ["method"], weight="weight")
    return rows.select("method", "n", "brier_score", "roc_auc", "ece")


@query("calibration_ranges", f"""{_LONG}
SELECT method, round(min(score), 4) AS min, round(max(score), 4) AS max, round(avg(score), 4) AS mean
FROM long GROUP BY method""")
def calibration_ranges(spark, sf_dir):
    rows = metrics.score_ranges(calibrate.by_method(*halves(spark, sf_dir), METHODS), ["method"], "weight")
    return rounded(rows, "min", "max", "mean", digits=4)


_ROW_LOSS = "CASE WHEN label = 1 THEN -ln(greatest(1e-7, least(1 - 1e-7, {p}))) ELSE -ln(1 - greatest(1e-7, least(1 - 1e-7, {p}))) END"


@query("evaluation_record", f"""{_CAL}, ranks AS (
  SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM curves)
SELECT round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
    / (sum(label)::DOUBLE * (count(*) - sum(label))), 4) AS roc_auc,
  round(avg((s - label) * (s - label)), 4) AS brier_raw,
  round(avg((quadratic - label) * (quadratic - label)), 4) AS brier_calibrated,
  round(avg({_ROW_LOSS.format(p='s')}), 4) AS log_loss_raw,
  round(avg({_ROW_LOSS.format(p='quadratic')}), 4) AS log_loss_calibrated,
  round(sum(s) / sum(label), 4) AS ratio_raw, round(sum(quadratic) / sum(label), 4) AS ratio_calibrated FROM ranks""")
def evaluation_record(spark, sf_dir):
    fit_on, apply_to = halves(spark, sf_dir)
    # all metrics are sums over distinct scores and labels
    rows = stage(calibrate.calibrate(fit_on, metrics.reduce(apply_to), "quadratic"), "reduced")
    raw = metrics.summary(rows, weight="weight")
    fixed = metrics.summary(rows, score="calibrated", weight="weight")
    pick = lambda df, tail: df.select(
        F.col("brier_score").alias(f"brier_{tail}"), F.col("log_loss").alias(f"log_loss_{tail}"),
        F.col("xg_ratio").alias(f"ratio_{tail}"),
    )
    out = metrics.roc_auc(rows, weight="weight").crossJoin(pick(raw, "raw")).crossJoin(pick(fixed, "calibrated"))
    return rounded(out, *out.columns, digits=4)


@query("action_contributions", f"""{ACTIONS.replace('WITH raw', 'WITH RECURSIVE raw')},
fitted AS (SELECT score AS s, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS k FROM rated
  WHERE {views.digits(0)} % 100 BETWEEN 80 AND 89 GROUP BY score),
{_PLATT},
cal AS (SELECT rated.*, 1 / (1 + exp(-(pl.a * score + pl.b))) AS c FROM rated, platt pl WHERE pl.i = 25),
nexts AS (SELECT *, lead(c) OVER (PARTITION BY match_id, possession ORDER BY index) - c AS up FROM cal)
SELECT match_id, possession, index, type, round(score, 6) AS score, round(c, 6) AS calibrated,
  CASE WHEN type = 'Shot' THEN round(1 - c, 3) ELSE coalesce(round(up, 3), 0) END AS contribution FROM nexts""")
def action_contributions(spark, sf_dir):
    """Context score of every action, calibrated on the validation split, and its contribution."""
    rows = stage(scored_actions(spark, sf_dir), "actions")
    fixed = calibrate.calibrate(rows.where("split = 'val'"), rows, "platt")
    out = context.with_contribution(fixed, "calibrated")
    out = out.select(*KEYS, "index", "type", "score", "calibrated", "contribution")
    return rounded(out, "score", "calibrated")


# ---- runs

# Thresholds of the runs. Their contexts are those of the variants.
RUN_THRESHOLDS = [1, 2, 3, 5, 8]
RUN_CONTEXTS = CONTEXTS

_RUNS = f"""{THREAT}, copies AS (
  SELECT mv.*, t.threshold, row_number() OVER (
      PARTITION BY threshold, match_id, possession ORDER BY index DESC) AS event_rank
  FROM mv, (SELECT unnest({RUN_THRESHOLDS})::DOUBLE AS threshold) t
  WHERE type <> 'Carry' OR carry_dist >= threshold),
cut AS (
  SELECT copies.*, c.context, row_number() OVER (
      PARTITION BY threshold, context, match_id, possession ORDER BY index) AS seq_no
  FROM copies, (SELECT unnest({RUN_CONTEXTS})::BIGINT AS context) c
  WHERE event_rank <= context AND (context = 14 OR threshold = 2)),
picked AS (
  SELECT threshold, context, match_id, possession, {views.SPLIT_OF} AS split,
    (sum(CASE WHEN shot_outcome = 'Goal' THEN 1 ELSE 0 END) = 1)::INT AS label,
    max_by({views.cell('coalesce(end_x, x)', 'coalesce(end_y, y)')}, seq_no) FILTER (seq_no <= 3) AS zone
  FROM cut GROUP BY ALL),
bases AS (SELECT threshold, context, avg(label) AS base FROM picked WHERE split = 'train' GROUP BY ALL),
zrates AS (SELECT threshold, context, zone, (sum(label) + 20 * max(base)) / (count(*) + 20) AS rate
  FROM picked JOIN bases USING (threshold, context) WHERE split = 'train' GROUP BY ALL),
runscored AS (
  SELECT b.threshold, b.context, coalesce(rate, base) AS score, label
  FROM bases b JOIN picked v ON v.threshold = b.threshold AND v.context = 14 AND v.split = 'val'
  LEFT JOIN zrates z ON z.threshold = b.threshold AND z.context = b.context AND z.zone = v.zone),
phased AS (
  SELECT 'threshold' AS phase, * FROM runscored WHERE context = 14 UNION ALL
  SELECT 'context', * FROM runscored WHERE threshold = 2),
ranked AS (SELECT *, rank() OVER (PARTITION BY phase, threshold, context ORDER BY score)
    + (count(*) OVER (PARTITION BY phase, threshold, context, score) - 1) / 2.0::DOUBLE AS r FROM phased),
runs AS (
  SELECT phase, concat('t', CAST(threshold AS BIGINT), '_ctx', context) AS run_name, count(*) AS n,
    round((sum(CASE WHEN label = 1 THEN r ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
      / nullif(sum(label)::DOUBLE * (count(*) - sum(label)), 0), 4) AS roc_auc,
    round(avg((score - label) * (score - label)), 4) AS brier_score,
    round(avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0), 4) AS separation
  FROM ranked GROUP BY phase, threshold, context)"""


def run_cells(spark, sf_dir):
    """Possessions per (threshold, context, split, zone, label); the zone is where the start context ends.

    One aggregation per threshold and possession finds the zone at each rank; the start context of a
    shorter truncation ends at another rank of the same row.
    """
    longest = max(RUN_CONTEXTS)
    rows = splits.threshold_ranks(moves(spark, sf_dir), RUN_THRESHOLDS, longest)
    end = pitch.cell(F.coalesce("end_x", "x"), F.coalesce("end_y", "y"), threat.BINS_X, threat.BINS_Y)
    goal = labels.goal_flag(F.col("shot_outcome"))
    rank = F.col("event_rank")
    wide = rows.groupBy("threshold", *KEYS).agg(
        F.count("*").alias("_n"),
        *[F.sum(F.when(rank <= c, goal)).alias(f"_g{c}") for c in RUN_CONTEXTS],
        *[F.max(F.when(rank == r, end)).alias(f"_z{r}") for r in range(1, longest + 1)],
    )
    zones = F.array(*[F.col(f"_z{r}") for r in range(1, longest + 1)])
    entry = lambda c: F.struct(
        F.lit(c).alias("context"),
        F.element_at(zones, F.greatest(F.least("_n", F.lit(c)) - 2, F.lit(1)).cast("int")).alias("zone"),
        F.when(F.col(f"_g{c}") == 1, 1).otherwise(0).alias("label"),
    )
    long = splits.with_split(wide).select(
        F.col("threshold").cast("int").alias("threshold"), "split", F.explode(F.array(*[entry(c) for c in RUN_CONTEXTS])).alias("e")
    )
    cells = long.where("(e.context = 14 or threshold = 2) and split <> 'test'")
    return cells.groupBy("threshold", "split", "e.context", "e.zone", "e.label").agg(F.count("*").alias("weight"))


def run_table(spark, sf_dir):
    """One row per dataset variant and phase: zone rates learnt on its training split, on the same validation set.

    Every context is evaluated on the possessions of the longest one.
    """
    cells = stage(run_cells(spark, sf_dir), "cells")
    train = cells.where("split = 'train'")
    run = ["threshold", "context"]
    base = train.groupBy(*run).agg((F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("base"))
    rates = (
        train.join(base, run)
        .groupBy(*run, "zone")
        .agg(
            (
                (F.sum(F.col("label") * F.col("weight")) + context.ALPHA * F.max("base"))
                / (F.sum("weight") + context.ALPHA)
            ).alias("rate")
        )
    )
    held = cells.where("split = 'val' and context = 14").select("threshold", "zone", "label", "weight")
    scores = held.join(base, "threshold").join(rates, [*run, "zone"], "left")
    scores = scores.select(*run, F.coalesce("rate", "base").alias("score"), "label", "weight")
    record = metrics.record(scores, run, weight="weight")
    phases = F.array_compact(
        F.array(F.when(F.col("context") == 14, "threshold"), F.when(F.col("threshold") == 2, "context"))
    )
    name = F.concat(F.lit("t"), F.col("threshold"), F.lit("_ctx"), F.col("context"))
    return record.select(
        F.explode(phases).alias("phase"), name.alias("run_name"), "n", "roc_auc", "brier_score", "separation"
    )


@query("experiment_runs", f"""{_RUNS}
SELECT runs.*, round(roc_auc - (SELECT max(roc_auc) FROM runs WHERE run_name = 't2_ctx14'), 4) AS roc_auc_delta
FROM runs""")
def experimentrun_table(spark, sf_dir):
    return rounded(experiments.delta_to(run_table(spark, sf_dir), "t2_ctx14", ["roc_auc"]), "roc_auc_delta", digits=4)


@query("best_run_per_phase", f"""{_RUNS}
SELECT phase, run_name, n, roc_auc, brier_score, separation FROM (
  SELECT *, row_number() OVER (PARTITION BY phase ORDER BY roc_auc DESC, run_name) AS rn FROM runs) t WHERE rn = 1""")
def best_run_per_phase(spark, sf_dir):
    return experiments.best_per_phase(run_table(spark, sf_dir))


# ---- Spark ML models

_MIXED = [f"{a}" for a in tokens.AXES]


def mixture(spark, sf_dir):
    rows = stage(seq.explode(normalized(spark, sf_dir)), "positions")
    return models.position_mixture(rows, [*KEYS, "pos"])


@query("position_mixture")
def position_mixture(spark, sf_dir):
    """Weight, mean and covariance of every component."""
    return mixture(spark, sf_dir)


@query("position_mixture_moments", f"""{views.NORM}
SELECT type, count(*) AS n, 1.0::DOUBLE AS weights, {', '.join(f'round(avg({a}), 4) AS mean_{a}' for a in _MIXED)}
FROM norm WHERE type IN ('Pass', 'Carry') AND {' AND '.join(f'{a} IS NOT NULL' for a in _MIXED)} GROUP BY type""")
def position_mixture_moments(spark, sf_dir):
    """After any step of the fit the weights sum to 1, and the weighted means to the mean of the data."""
    parts = mixture(spark, sf_dir)
    return parts.groupBy("type").agg(
        F.max("n").alias("n"),
        F.round(F.sum("weight"), 6).alias("weights"),
        *[F.round(F.sum(F.col("weight") * F.col(f"mean_{a}")), 4).alias(f"mean_{a}") for a in _MIXED],
    )


@query("next_type_model", f"""{views.SEQ}, pairs AS (
  SELECT b.type AS truth, {views.SPLIT_OF.replace('match_id', 'a.match_id').replace('possession', 'a.possession')} AS split
  FROM tok a JOIN tok b ON a.match_id = b.match_id AND a.possession = b.possession AND b.pos = a.pos + 1)
SELECT truth, count(*) AS n, round(sum({_WEIGHT_CASE.format(c='truth')}), 3) AS weighted, 1.0::DOUBLE AS mass_share
FROM pairs WHERE split = 'train' GROUP BY truth""")
def next_type_model(spark, sf_dir):
    """Training rows by next type, and the share of their weight that the model's probabilities sum up to.

    The intercepts carry no penalty, so at the optimum that share is 1 for every type.
    """
    rows = stage(splits.with_split(models.next_type_rows(normalized(spark, sf_dir), WEIGHTS)), "next-type")
    train = rows.where("split = 'train'")
    counts = train.groupBy(F.col("target_type").alias("truth")).agg(
        F.count("*").alias("n"), F.sum("weight").alias("weighted")
    )
    mass = models.class_mass(models.next_type_model(train), train)
    return counts.join(mass, "truth").select(
        "truth", "n", F.round("weighted", 3).alias("weighted"), F.round(F.col("mass") / F.col("weighted"), 3).alias("mass_share")
    )


@query("next_type_loss")
def next_type_loss(spark, sf_dir):
    """Mean loss of each type on the rows that were not learnt from, with the iterations of the fit."""
    rows = stage(splits.with_split(models.next_type_rows(normalized(spark, sf_dir), WEIGHTS)), "next-type")
    model = models.next_type_model(rows.where("split = 'train'"))
    held = models.predict_next(model, rows.where("split <> 'train'"))
    losses = held.groupBy("truth").agg(F.avg(-F.ln("p")).alias("loss"))
    steps = F.lit(model.summary.totalIterations)
    return metrics.accuracy_by_type(held).join(losses, "truth").withColumns({"iterations": steps, "converged": F.lit(True)})
