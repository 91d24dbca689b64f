import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from buildup import ordered
from buildup.operators import suffixes

LENGTHS = [1, 2, 4, 9]


def drawn(n, seed, longest, tokens="ab"):
    """Histories of repeated phrases, so that long contexts are frequent."""
    draw, out = random.Random(seed), []
    for _ in range(n):
        text = "".join(draw.choice(tokens) if draw.random() < 0.2 else "ab"[i % 2] for i in range(draw.randint(1, longest)))
        for i in range(1, len(text) + 1):
            history = "".join(f"{ord(c):02X}" for c in reversed(text[max(0, i - longest) : i]))
            out.append((history, int(draw.random() < 0.3 + 0.1 * text.count("aa")), draw.random() < 0.7))
    return out


def brute(data, alpha, min_rows):
    n, g = defaultdict(int), defaultdict(int)
    for history, label, training in data:
        if training:
            for j in range(len(history) // 2 + 1):
                n[history[: 2 * j]] += 1
                g[history[: 2 * j]] += label
    out = {}
    for history in {r[0] for r in data}:
        p, rates = g[""] / n[""], {0: g[""] / n[""]}
        for j in range(1, len(history) // 2 + 1):
            node = history[: 2 * j]
            if j > max(LENGTHS) or n[node] < min_rows:
                break
            p = rates[j] = (g[node] + alpha * p) / (n[node] + alpha)
        scores = [rates[max(d for d in rates if d <= c)] for c in LENGTHS]
        out[history] = (max(rates), *scores)
    kept = {k for k in n if 0 < len(k) // 2 <= max(LENGTHS) and n[k] >= min_rows}
    return out, {(len(k) // 2, k, n[k], g[k]) for k in kept}


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("min_rows", [1, 4])
def test_equals_brute_force(spark, monkeypatch, broadcast, min_rows):
    if not broadcast:
        monkeypatch.setattr(suffixes.context, "MOST_BROADCAST", 0)
    data = drawn(60, 7, 12)
    rows = spark.createDataFrame(data, "history string, label int, training boolean").repartition(3)
    scores, nodes = suffixes.grow(suffixes.histories(rows, F.col("training")), LENGTHS, alpha=3.0, min_rows=min_rows)
    expected, kept = brute(data, 3.0, min_rows)
    found = {r["history"]: tuple(r)[1:] for r in scores.collect()}
    assert found.keys() == expected.keys()
    for history, own in expected.items():
        assert found[history] == pytest.approx(own, abs=1e-12)
    assert {tuple(r) for r in nodes.collect()} == kept
    losses = suffixes.log_losses(rows.where("not training").select("history", "label"), scores, LENGTHS)
    held = [r for r in data if not r[2]]
    for r in losses.collect():
        p = [expected[h][1 + LENGTHS.index(r["context"])] for h, _, _ in held]
        own = sum(-math.log(x if y else 1 - x) for x, (_, y, _) in zip(p, held)) / len(held)
        assert r["n"] == len(held) and r["log_loss"] == pytest.approx(own)
    assert sorted(r["rank"] for r in losses.collect()) == [1, 2, 3, 4]


def test_empty_and_without_training(spark):
    schema = "history string, label int, training boolean"
    for data in ([], [("61", 1, False), ("6162", 0, False)]):
        rows = spark.createDataFrame(data, schema)
        scores, nodes = suffixes.grow(suffixes.histories(rows, F.col("training")), LENGTHS)
        assert scores.count() == len({r[0] for r in data}) and nodes.count() == 0


def test_trailing_in_blocks(spark):
    data = [(k, i * (1 if k else 7) + (10**9 if i == 59 else 0), i) for k in range(2) for i in range(60)]
    rows = spark.createDataFrame(data, "k int, at bigint, v int").repartition(4)
    for block_rows in (3, 11, 1000):
        for size in (1, 5, 23):
            out = ordered.trailing(rows, ["k"], "at", F.col("v"), size, "last", block_rows)
            assert out.columns == ["k", "at", "v", "last"]
            for r in out.collect():
                assert r["last"] == list(range(max(0, r["v"] - size + 1), r["v"] + 1))
