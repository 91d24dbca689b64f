"""Queries on the spread of metrics and on files that cannot be read."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildup.operators import experiments
from buildup.plans import views
from buildup.plans.evaluation import rounded, scored
from buildup.plans.movement import all_events
from buildup.plans.registry import query
from buildup.sources import json_files

REPLICATES = 20
METRICS = ["roc_auc", "brier_score"]

_U = " UNION ALL ".join(
    f"""SELECT user_id, {r + 1} AS replicate,
    ('0x' || substr(md5(concat(user_id, '-{42 + r // 4}')), {1 + 8 * (r % 4)}, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM users"""
    for r in range(REPLICATES)
)
_DRAWN = " + ".join(f"(u >= {level!r}::DOUBLE)::BIGINT" for level in experiments.poisson_levels())
_BOOT = f"""{views.SCORED}, users AS (SELECT DISTINCT user_id FROM scored),
draws AS (SELECT user_id, 0 AS replicate, 1::BIGINT AS w FROM users
  UNION ALL SELECT user_id, replicate, {_DRAWN} AS w FROM ({_U}) d),
runs AS (SELECT 'raw' AS run_name, user_id, score, label FROM scored
  UNION ALL SELECT 'coarse', user_id, floor(score * 5) / 5, label FROM scored),
cells AS (SELECT run_name, replicate, score, sum(w) AS n, sum(w * label) AS k,
    sum(w * (score - label) * (score - label)) AS gaps
  FROM runs JOIN draws USING (user_id) GROUP BY run_name, replicate, score HAVING sum(w) > 0),
below AS (SELECT *, coalesce(sum(n - k) OVER (PARTITION BY run_name, replicate ORDER BY score
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM cells),
found AS (
  SELECT run_name, replicate, sum(gaps) / sum(n) AS brier_score,
    sum(k * (lower + (n - k) / 2.0::DOUBLE)) / (sum(k)::DOUBLE * (sum(n) - sum(k))) AS roc_auc
  FROM below GROUP BY run_name, replicate),
wide AS (
  SELECT f.run_name, f.replicate, f.roc_auc, f.brier_score, f.roc_auc - b.roc_auc AS roc_auc_delta,
    f.brier_score - b.brier_score AS brier_score_delta
  FROM found f JOIN found b ON b.run_name = 'raw' AND b.replicate = f.replicate),
long AS (UNPIVOT wide ON roc_auc, brier_score, roc_auc_delta, brier_score_delta INTO NAME metric VALUE v)"""


@query("metric_intervals", f"""{_BOOT}
SELECT run_name, metric, round(max(v) FILTER (replicate = 0), 5) AS value,
  round(quantile_cont(v, 0.025) FILTER (replicate > 0), 5) AS low,
  round(quantile_cont(v, 0.975) FILTER (replicate > 0), 5) AS high,
  count(*) FILTER (replicate > 0) AS replicates FROM long GROUP BY run_name, metric""")
def metric_intervals(spark, sf_dir):
    """AUC, Brier score and their change to the raw scores, with intervals; users are drawn as a whole."""
    rows = scored(spark, sf_dir)
    runs = F.array(
        F.struct(F.lit("raw").alias("run_name"), F.col("score")),
        F.struct(F.lit("coarse").alias("run_name"), (F.floor(F.col("score") * 5) / 5).alias("score")),
    )
    rows = rows.select("user_id", "label", F.explode(runs).alias("r")).select("user_id", "label", "r.*")
    drawn = experiments.bootstrap(rows, ["user_id"], ["run_name"], METRICS, REPLICATES)
    deltas = experiments.delta_replicates(drawn, "run_name", "raw", METRICS)
    both = drawn.join(deltas, ["run_name", "replicate"])
    out = experiments.intervals(both, ["run_name"], [*METRICS, *[f"{m}_delta" for m in METRICS]])
    return rounded(out, "value", "low", "high", digits=5)


# every so many files is cut short, and as many have a name without a number
CUT, NAMELESS = 11, 13

_FILES = f"""{views.EV}, files AS (
  SELECT match_id * 100000 + possession AS match_id, index, type, x FROM ev)"""


def event_texts(spark, sf_dir):
    """One JSON text per possession, as a download of one file per match would be; some of them broken."""
    point = lambda c: F.when(F.col(c).isNotNull(), F.col(c))
    event = F.struct(
        F.col("index").cast("string").alias("id"),
        "index",
        "possession",
        F.struct(F.lit(1).alias("id"), F.col("type").alias("name")).alias("type"),
        point("location").alias("location"),
    )
    number = F.col("match_id") * 100000 + F.col("possession")
    texts = all_events(spark, sf_dir).groupBy(number.alias("number")).agg(F.to_json(F.collect_list(event)).alias("value"))
    name = F.concat(F.when(F.col("number") % NAMELESS == 5, "copy_of_").otherwise(""), F.col("number"), F.lit(".json"))
    cut = F.when(F.col("number") % CUT == 0, F.expr("left(value, length(value) - 2)")).otherwise(F.col("value"))
    return texts.select(F.concat(F.lit("events/"), name).alias("file"), cut.alias("value"))


@query("ingest_quarantine", f"""{_FILES}
SELECT 'read' AS state, count(*) AS n, count(DISTINCT match_id) AS files, count(x) AS located FROM files
WHERE match_id % {CUT} <> 0 AND match_id % {NAMELESS} <> 5
UNION ALL SELECT 'broken', count(DISTINCT match_id), count(DISTINCT match_id), 0 FROM files
  WHERE match_id % {CUT} = 0 AND match_id % {NAMELESS} <> 5
UNION ALL SELECT 'no match id', count(DISTINCT match_id), count(DISTINCT match_id), 0 FROM files
  WHERE match_id % {NAMELESS} = 5""")
def ingest_quarantine(spark, sf_dir):
    """Events of the files that can be read, and the rejected files by reason."""
    found, rejected = json_files.parse_event_texts(event_texts(spark, sf_dir))
    read = found.agg(
        F.lit("read").alias("state"), F.count("*").alias("n"), F.count_distinct("match_id").alias("files"),
        F.count("location").alias("located"),
    )
    zero = F.lit(0).cast("bigint")
    other = rejected.groupBy(F.col("reason").alias("state")).agg(
        F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.max(zero).alias("located")
    )
    return read.unionByName(other)
