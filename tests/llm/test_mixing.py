import hashlib
from fractions import Fraction

import pytest

from buildup.llm import mixing
from tests.llm.conftest import rows


def fair(sizes, weights, share, most):
    """Targets by sharing out again and again, in exact arithmetic."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = Fraction(share) * sum(sizes.values()), set(names), dict.fromkeys(names, Fraction(0))
    while open_ and left:
        total = sum(weight[s] for s in open_)
        add = {s: left * weight[s] / total for s in open_}
        left = Fraction(0)
        for s in list(open_):
            target[s] += add[s]
            if target[s] >= Fraction(most) * sizes[s]:
                left += target[s] - Fraction(most) * sizes[s]
                target[s] = Fraction(most) * sizes[s]
                open_.discard(s)
    return target


def test_targets(spark):
    for sizes in (
        {"a": 100, "b": 1, "c": 50, "d": 0, None: 7},
        {"a": 1, "b": 1, "c": 1000},
        {"x": 0, "y": 0},
        {"ä": 5, "z": 9, "A": 70, "é": 11, "b": 3, "c": 2, "d": 900},
    ):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        found = {r["source"]: r["target"] for r in mixing.targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        expected = fair(sizes, (5, 2, 1), "1.5", 2)
        assert found == pytest.approx({k: float(v) for k, v in expected.items()}, rel=1e-12)


def n_words(text):
    return len((text or "").encode().split())


@pytest.fixture(scope="module")
def mixed(clashing):
    return mixing.mix(clashing).collect()


def test_awkward_rows(mixed):
    data = rows()
    sizes = {}
    for row in data:
        sizes[row[3]] = sizes.get(row[3], 0) + n_words(row[1])
    target = fair(sizes, (5, 2, 1), "1.5", 2)
    found = mixed
    assert sorted((r["doc_id"], r["size"]) for r in found if r["doc_id"] is not None) == sorted(
        (r[0], n_words(r[1])) for r in data if r[0] is not None
    )
    taken = {}
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["times"] <= 2
        taken[r["source"]] = taken.get(r["source"], 0) + r["times"] * r["size"]
    largest = {s: max(n_words(r[1]) for r in data if r[3] == s) for s in sizes}
    for source, words in taken.items():
        # repeated rows and the documents at the boundary come or go together
        assert abs(words - target[source]) <= 3 * largest[source]


def test_rows_repeat_as_often_as_they_are_taken(mixed, clashing):
    times = {}
    for r in mixed:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + r["times"]
    got = {}
    out = mixing.apply_mix(clashing)
    assert out.columns == clashing.columns
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: n for k, n in times.items() if n}


def test_larger_budgets_are_nested(docs):
    taken = [
        {r["doc_id"] for r in mixing.mix(docs, share=share).collect() if r["times"]} for share in (0.3, 0.8)
    ]
    assert taken[0] < taken[1]


def test_hash(spark):
    df = spark.createDataFrame([(5,), (None,)], "doc_id bigint")
    found = {r[0]: r[1] for r in df.select("doc_id", mixing.id_hash(df["doc_id"])).collect()}
    assert found == {5: int(hashlib.md5(b"5").hexdigest()[:15], 16), None: int(hashlib.md5(b"").hexdigest()[:15], 16)}


def test_empty(empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.apply_mix(empty).count() == 0
