import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from buildup.llm import langid
from buildup.llm.queries import vocabulary

PIECES = ["▁", "▁a", "▁ab", "a", "ab", "aba", "b", "ba", "c"]


def cuts(text):
    """Every way to cut a text into pieces."""
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        if text[:n] in PIECES:
            for rest in cuts(text[n:]):
                yield [PIECES.index(text[:n]), *rest]


def table(seed=0):
    p = np.random.default_rng(seed).random((len(PIECES) + 1, 2))
    return p / p.sum(axis=0)


def test_forward_sums_all_segmentations():
    words, p = ["abab", "a", "cab", "bbaabac", "axb"], table()
    lattice = langid.Lattice(PIECES)
    match = lattice.match(words)
    alpha = langid.forward(match, p[match[2]], int(match[6][-1]) + 1)[match[6]]
    for word, got in zip(words[:4], alpha):
        for column in range(2):
            total = sum(math.prod(p[i, column] for i in way) for way in cuts("▁" + word))
            assert got[column] == pytest.approx(total, rel=1e-12)
    unknown = len(PIECES)
    expected = [
        sum(math.prod(p[i, c] for i in way) for way in cuts("▁a")) * p[unknown, c] * p[PIECES.index("b"), c]
        for c in range(2)
    ]
    assert alpha[4] == pytest.approx(expected, rel=1e-12)


def test_expected_uses_are_posterior_means():
    words, counts, p = ["abab", "ba"], np.array([3, 5]), table(1)
    uses = langid.expected_uses(langid.Lattice(PIECES), words, counts, np.array([0, 1]), p) / langid.FIXED_POINT
    expected = np.zeros((2, len(p)))
    for language, (word, n) in enumerate(zip(words, counts)):
        ways = list(cuts("▁" + word))
        weight = np.array([math.prod(p[i, language] for i in way) for way in ways])
        for way, share in zip(ways, weight / weight.sum()):
            for i in way:
                expected[language, i] += n * share
    assert uses.reshape(2, -1) == pytest.approx(expected, abs=1e-4)


def test_cache_and_batches_do_not_matter():
    p = table(2)
    texts = ["ab ba", None, "", "ab " * 50, "aba" * 40, "a-b c", "ab ba"]
    whole, letters = langid.Scorer(PIECES, p).score(texts)
    scorer = langid.Scorer(PIECES, p)
    single = np.concatenate([scorer.score([t])[0] for t in texts])
    assert np.allclose(whole, single, rtol=1e-12)
    assert letters.tolist() == [4, 0, 0, 100, 120, 3, 4]


@pytest.fixture(scope="module")
def model(docs):
    return langid.train(docs, vocabulary("piece_bpe_32k.model"), rounds=2)


def test_awkward_rows(docs, clashing, empty, model):
    found = {}
    for r in langid.identify(docs, model).collect():
        found[r["doc_id"]] = r["lang_pred"], r["score"]
    assert found[100] == found[101] == found[102] == found[103] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in found.values())
    assert sum(found[i][0] == ("en", "de", "fr")[i % 3] for i in range(40)) >= 38
    assert langid.identify(empty, model).count() == 0
    kept = langid.keep_identified(clashing, model)
    assert kept.columns == clashing.columns
    gone = {100, 101, 102, 103}
    assert gone.isdisjoint(r["doc_id"] for r in kept.collect())
    assert kept.count() == docs.count() - len(gone) - 1  # and the row that is all null


def test_nothing_to_learn_from(docs, empty):
    model = langid.train(empty, vocabulary("piece_bpe_32k.model"))
    assert {tuple(r)[1:] for r in langid.identify(docs, model).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    """On rows of a third table that training never saw."""
    sf_dir = "/root/testdata/sf0.01"
    found = entry_module.queries()["op1_language_id"](spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    right = found.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] > 0.97


def test_held_out_is_the_remainder(spark):
    import zlib

    ids = [*range(50), None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    for doc_id, out in df.select("doc_id", langid.held_out(F.col("doc_id"))).collect():
        assert out == (doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 == 2)


def test_words_longer_than_the_limit_are_whole():
    parts = langid._WORD.findall("a" * 100)
    assert "".join(parts) == "a" * 100
    assert list(itertools.chain(map(len, parts))) == [32, 32, 32, 4]


def test_words_pass_the_lattice_in_bounded_numbers(monkeypatch):
    texts = ["ab abc b c abba", None, "", "ca bc abc aa", "acb"]
    pieces = ["a", "ab", "abc", "b", "c", "▁", "▁a"]
    p = np.random.default_rng(1).dirichlet(np.ones(len(pieces) + 1), 2).T
    whole = langid.Scorer(pieces, p).score(texts)
    monkeypatch.setattr(langid, "WORDS_AT_ONCE", 2)
    scorer, passed = langid.Scorer(pieces, p), []
    learn = scorer._learn
    monkeypatch.setattr(scorer, "_learn", lambda words: passed.append(len(words)) or learn(words))
    parts = scorer.score(texts)
    assert max(passed) <= 2 and all((a == b).all() for a, b in zip(whole, parts))
