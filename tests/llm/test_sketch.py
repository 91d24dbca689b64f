import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from buildup.llm import sketch
from tests.llm.conftest import rows

WORDS = [f"w{i}" for i in range(4000)]


def test_estimates():
    a, b = " ".join(WORDS[:3000]), " ".join(WORDS[1000:])
    x, y = sketch.sketch(a), sketch.sketch(b)
    assert sketch.likeness(x, y) == pytest.approx(2000 / 4000, abs=0.08)
    assert sketch.containment(x, y) == pytest.approx(2000 / 3000, abs=0.08)
    part = sketch.sketch(" ".join(WORDS[500:700]))
    assert sketch.containment(part, x) == 1.0


def test_kept_hashes_are_a_fixed_share():
    found = sketch.sketch(" ".join(WORDS))
    assert found.shingles == 3996
    assert len(found.kept) == pytest.approx(3996 / sketch.SHARE, rel=0.15)
    assert (found.kept < 2**64 // sketch.SHARE).all()


def test_sketches_merge():
    a, b = " ".join(WORDS[:900]), " ".join(WORDS[400:2000])
    both = sketch.merge(sketch.sketch(a), sketch.sketch(b))
    assert np.array_equal(both, sketch.sketch(" ".join(WORDS[:2000])).kept)


def test_small_texts():
    one, same, other, none = (sketch.sketch(t) for t in ("one word", "ONE  word", "two words", None))
    assert str(one) == str(same) and sketch.likeness(one, same) == 1
    assert sketch.likeness(one, other) == 0 and sketch.likeness(none, sketch.sketch(" ")) == 1


def brute(data):
    """The digest of every edited text, in the order of ids; rows with one id are ordered by their text's hash."""
    texts = [t or "" for _, t in data]
    out = []
    for i, (doc_id, _) in enumerate(data):
        text, after = texts[i], texts[(i + 1) % len(data)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=repr)


def ordered(df):
    """Ids and texts in the operator's order."""
    from buildup.llm.common import text_hash

    key = [F.col("doc_id").isNull(), "doc_id", text_hash(F.col("text"))]
    return [(r["doc_id"], r["text"]) for r in df.orderBy(*key).select("doc_id", "text").collect()]


def found(df):
    return sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in sketch.compare_edits(df).collect()], key=repr)


def test_awkward_rows(clashing):
    expected = brute(ordered(clashing))
    assert len(expected) == len(rows())
    got = sketch.compare_edits(clashing).collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], key=repr) == expected
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_equal_neighbours_are_alike(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c d e f g h")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in sketch.compare_edits(df).collect()}
    assert got[1]["near_next"] == 1 and got[1]["fingerprint"] == got[2]["fingerprint"]


def test_one_row_and_none(spark, empty):
    assert sketch.compare_edits(empty).count() == 0
    one = spark.createDataFrame([(None, "abc")], "doc_id bigint, text string")
    assert found(one) == [(None, 3, hashlib.sha256(b"aba").hexdigest())]


def test_query_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = entry_module.queries()["op5_document_fingerprints"](spark, sf_dir).collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], key=repr) == brute(ordered(table))


def exact(a, b, words=5):
    """True share of the shingles of either text that both have."""
    sets = []
    for text in (a, b):
        found = text.lower().encode().split()
        sets.append({tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_query_likeness_against_exact_sets(spark, sf_dir):
    data = ordered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = {r["doc_id"]: r for r in entry_module.queries()["op5_document_fingerprints"](spark, sf_dir).collect()}
    off, short = [], []
    for i, (doc_id, text) in enumerate(data):
        text, after = text or "", data[(i + 1) % len(data)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        for name, other in (("near_edited", edited), ("near_next", after)):
            true = exact(text, other)
            off.append(abs(got[doc_id][name] - true))
            if len(text.split()) < 100:
                short.append(off[-1])
            assert got[doc_id][name] > 0 or true < 0.2
    assert short and sum(short) / len(short) < 0.03 and sum(off) / len(off) < 0.02
    assert sum(x > 0.2 for x in off) <= 0.005 * len(off)


def test_likeness_of_short_texts():
    found = []
    for n in range(8, 60):
        a, b = WORDS[60 * n : 60 * n + n], WORDS[60 * n + n // 4 : 60 * n + n]
        a, b = " ".join(a), " ".join(b)
        found.append(abs(sketch.likeness(sketch.sketch(a), sketch.sketch(b)) - exact(a, b)))
    assert sum(found) / len(found) < 0.12


def test_large_ids_beside_null_ones(spark):
    ids = [9007199254740993, None, 9007199254740995, -9007199254740997, 9223372036854775807]
    rows = spark.createDataFrame([(i, f"some words of text {n}") for n, i in enumerate(ids)], "doc_id bigint, text string")
    found = sketch.compare_edits(rows.coalesce(1))
    assert found.schema["doc_id"].dataType.simpleString() == "bigint"
    assert sorted([r["doc_id"] for r in found.collect()], key=repr) == sorted(ids, key=repr)
