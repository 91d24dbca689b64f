"""Queries on contexts of any length."""

from __future__ import annotations

from pyspark.sql import functions as F

from buildup.operators import sequences as seq
from buildup.operators import splits, suffixes
from buildup.plans import views
from buildup.plans.evaluation import CONTEXTS, rounded
from buildup.plans.movement import big, moves
from buildup.plans.registry import query

KEYS = seq.KEYS
LONGEST = max(CONTEXTS)

_WORD = f"concat(type, ':', {views.cell('x', 'y', 6, 4)})"
_TREE = f"""{views.SEQ.replace('WITH', 'WITH RECURSIVE', 1)}, h AS (
  SELECT match_id, possession, index, type, list({_WORD}) OVER (
    PARTITION BY match_id, possession ORDER BY index ROWS BETWEEN {LONGEST - 1} PRECEDING AND CURRENT ROW) AS words FROM mv),
keyed AS MATERIALIZED (
  SELECT h.*, CASE WHEN goal = 1 THEN 1 ELSE 0 END AS label, {views.SPLIT_OF} AS split
  FROM h JOIN poss USING (match_id, possession)),
levels AS MATERIALIZED (
  SELECT match_id, possession, index, label, split, j, array_to_string(words[-j:], '|') AS node
  FROM keyed, (SELECT unnest(range(1, {LONGEST + 1})) AS j) r WHERE j <= len(words)),
nodes AS MATERIALIZED (
  SELECT j, node, count(*) FILTER (split = 'train') AS n, coalesce(sum(label) FILTER (split = 'train'), 0) AS g
  FROM levels GROUP BY j, node HAVING count(*) FILTER (split = 'train') >= {suffixes.MIN_ROWS}),
steps AS MATERIALIZED (SELECT match_id, possession, index, j, n, g FROM levels JOIN nodes USING (j, node)),
path AS (
  SELECT match_id, possession, index, 0::BIGINT AS j, (SELECT avg(label) FROM keyed WHERE split = 'train') AS p FROM keyed
  UNION ALL
  SELECT s.match_id, s.possession, s.index, s.j,
    (s.g + {suffixes.ALPHA}::DOUBLE * p) / (s.n + {suffixes.ALPHA}::DOUBLE)
  FROM path JOIN steps s ON s.match_id = path.match_id AND s.possession = path.possession
    AND s.index = path.index AND s.j = path.j + 1)"""


def outcomes(events):
    found = seq.possession_goals(seq.truncate_last(events))
    return splits.with_split(found.select(*KEYS, F.when(F.col("goal") == 1, 1).otherwise(0).alias("label")))


def tree(spark, sf_dir):
    events = moves(spark, sf_dir)
    return suffixes.score(events, outcomes(events), F.col("split") == "train", CONTEXTS)


@query("suffix_scores", f"""{_TREE}
SELECT match_id, possession, index, max(j) AS depth,
  {', '.join(f'round(arg_max(p, j) FILTER (j <= {c}), 6) AS score_{c}' for c in CONTEXTS)}
FROM path GROUP BY match_id, possession, index""")
def suffix_scores(spark, sf_dir):
    """Every event with its score from contexts up to each length."""
    rows, _, _ = tree(spark, sf_dir)
    names = [f"score_{c}" for c in CONTEXTS]
    return rounded(rows.select(*KEYS, "index", *big("depth"), *names), *names)


@query("suffix_nodes", f"""{_TREE}
SELECT j AS depth, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS n, CAST(sum(g) AS BIGINT) AS goals,
  CAST(max(n) AS BIGINT) AS largest FROM nodes GROUP BY j""")
def suffix_nodes(spark, sf_dir):
    _, _, nodes = tree(spark, sf_dir)
    return nodes.groupBy(*big("depth")).agg(
        F.count("*").alias("nodes"), F.sum("n").alias("n"), F.sum("g").alias("goals"), F.max("n").alias("largest")
    )


@query("suffix_runs", f"""{_TREE}, scores AS (
  SELECT match_id, possession, index, {', '.join(f'arg_max(p, j) FILTER (j <= {c}) AS s{c}' for c in CONTEXTS)}
  FROM path GROUP BY match_id, possession, index),
held AS (
  SELECT label, unnest([{', '.join(f'{{context: {c}, p: s{c}}}' for c in CONTEXTS)}], recursive := true)
  FROM scores JOIN keyed USING (match_id, possession, index) WHERE split = 'val'),
losses AS (
  SELECT context, count(*) AS n, avg(CASE WHEN label = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS log_loss
  FROM held GROUP BY context)
SELECT context::BIGINT AS context, n, round(log_loss, 6) AS log_loss,
  row_number() OVER (ORDER BY round(log_loss, 9), context) AS rank FROM losses""")
def suffix_runs(spark, sf_dir):
    """The context lengths by their log loss on the validation split."""
    rows, scores, _ = tree(spark, sf_dir)
    runs = suffixes.log_losses(rows.where("split = 'val'").select("history", "label"), scores, CONTEXTS)
    return rounded(runs.select(*big("context", "n", "rank"), "log_loss"), "log_loss")
