import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
from buildup.llm import token_counts
from tests.llm.conftest import bag, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = (
    "a s t ' 're 'll 've 's 'd r e v l ll 1 42 ! -- é ß 中 \U0001f600 aaaa ==== ABC ٣ ¼ <|endoftext|> <|endof 　 \x85 \xa0".split(" ")
    + [" ", "  ", "\n", "\t", "'", " '"]
)


@pytest.fixture(scope="module")
def reader():
    return token_counts.Reader(token_counts.load(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_equals_library_on_awkward_texts(reader, library):
    draw = random.Random(5)
    texts = ["".join(draw.choices(PARTS, k=draw.randint(0, 40))) for _ in range(4000)]
    assert reader.counts(texts) == expected(library, texts)


def test_equals_library_on_long_words(reader, library):
    draw = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = ["a" * 100_000, "ab" * 30_000, " " * 9_000 + "x", "\n" * 90_000, "=-" * 3_000, "中文" * 9_000]
    texts += ["".join(draw.choices(letters, k=50_000)), "".join(draw.choices("abc", k=50_000)), "aaa" * 9_999 + "'s"]
    assert reader.counts(texts) == expected(library, texts)


def test_windows_and_resets_do_not_matter(reader, library, monkeypatch):
    draw = random.Random(7)
    texts = ["".join(draw.choices(PARTS, k=3_000)) for _ in range(6)] + ["x" * 700, "", None]
    monkeypatch.setattr(token_counts, "WINDOW", 97)
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    assert reader.counts(texts) == expected(library, texts)


def test_classes_equal_library_on_every_code_point(reader, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a'{chr(c)}1{chr(c)} " for c in points[i : i + 4000]) for i in range(0, len(points), 4000)]
    assert reader.counts(texts) == expected(library, texts)


def test_scan_composes_maps():
    draw = np.random.default_rng(1)
    for n in (1, 2, 7, 33):
        maps = draw.integers(0, 5, (n, 5))
        found, own = token_counts.scan(maps), np.arange(5)
        for i in range(n):
            own = maps[i][own]
            assert (found[i] == own).all()


def test_word_starts_do_not_depend_on_chunks(reader, monkeypatch):
    draw = random.Random(8)
    text = "".join(draw.choices(PARTS, k=500)) + token_counts.MARK
    classes = reader.compiled.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    whole = token_counts.word_starts(classes)
    for size in (1, 3, 1000):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert (token_counts.word_starts(classes) == whole).all()


def test_awkward_rows(clashing, library):
    found = token_counts.count_tokens(clashing, PATH, limit=30)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = expected(library, [r[1] for r in rows()])
    assert bag(found, *found.columns) == sorted(
        [(r[0], len((r[1] or "").encode()), k, k > 30) for r, k in zip(rows(), n)], key=repr
    )


def test_empty(empty):
    assert token_counts.count_tokens(empty, PATH).count() == 0


def test_query_equals_library(spark, sf_dir, library):
    data = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    n = expected(library, [r["text"] for r in data])
    found = entry_module.queries()["op11_token_counts"](spark, sf_dir)
    assert bag(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(
        [(r["doc_id"], len((r["text"] or "").encode()), k, k > 1024) for r, k in zip(data, n)], key=repr
    )
