"""The stages, one after another, against plain Python over the same rows."""

from collections import Counter

import pytest

import corpus_pipeline
from buildup.llm import bpe, langid, mixing
from buildup.llm.queries import vocabulary
from buildup.session import stage
from tests.llm.conftest import bag, rows
from tests.llm.test_line_chunks import brute
from tests.llm.test_simhash import fingerprint, linked, roots

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark, clashing):
    """What each stage returned for all that its predecessor kept."""
    out, current = {}, clashing
    for name, step in corpus_pipeline.STAGES:
        current = stage(step(spark, current, ""), name)
        out[name] = current
    return out


def test_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "bpe"
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def test_all_but_the_last_return_documents(steps, clashing):
    for name in list(STAGES)[:-1]:
        assert steps[name].columns == clashing.columns


def test_language_stage(steps):
    kept = Counter(r["doc_id"] for r in steps["language_id"].collect())
    letters = Counter(r[0] for r in rows() if langid._WORD.search(r[1] or ""))
    assert kept == letters


def test_line_stage(steps):
    before = [tuple(r) for r in steps["language_id"].select("doc_id", "text").collect()]
    assert bag(steps["line_dedup"], "doc_id", "text") == brute(before)


def test_simhash_stage(steps):
    before = [tuple(r) for r in steps["line_dedup"].select("doc_id", "text").collect()]
    root = roots(len(before), linked([fingerprint(r[1]) for r in before], 4))
    least = {}
    for r, row in zip(root, before):
        key = (row[0] is None, row[0])
        least[r] = min(least.get(r, key), key)
    kept = [(r["doc_id"] is None, r["doc_id"]) for r in steps["simhash_near_dedup"].collect()]
    assert sorted(kept) == sorted(least.values())


def test_mix_stage(steps):
    before = steps["simhash_near_dedup"]
    times = {r["doc_id"]: r["times"] for r in mixing.mix(before).collect()}
    got = Counter(r["doc_id"] for r in steps["mix_sources"].collect())
    assert got == {k: n for k, n in times.items() if n}


def test_encode_stage(steps):
    encoder = bpe.Encoder(bpe.load(vocabulary("word_bpe_49k.json")))
    expected = sorted([(r["doc_id"], encoder.encode([r["text"]])[0]) for r in steps["mix_sources"].collect()], key=repr)
    got = sorted([(r["doc_id"], bytes(r["ids"])) for r in steps["bpe"].collect()], key=repr)
    assert got == expected


def test_stages_take_empty_tables(spark, empty):
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, empty, "").count() == 0
