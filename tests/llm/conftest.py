"""Small tables with every awkward case."""

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names that the operators use inside
CLASH = (
    "fp fingerprint component_id root size h _row _text _id _null _hash ids decoded bucket guest vec_id key "
    "lang_pred score cuts start lines times target _p _n _s shard row"
).split()

PROSE = {
    "en": "the cat sat on the mat and then the dog went out of the house with the old man",
    "de": "der hund und die katze sind nicht in dem haus und der mann geht auf die gasse",
    "fr": "le chat est dans la maison et les enfants vont avec une amie sur le grand pont",
}


def rows():
    out = []
    for i in range(40):
        lang = ("en", "de", "fr")[i % 3]
        words = PROSE[lang].split()
        turned = words[i % 7 :] + words[: i % 5]
        text = "\n".join([" ".join(turned), " ".join(reversed(words)), "shared head", "shared tail", f"line {i}"])
        out.append((i, text, lang, f"s{i % 4}", len(text)))
    out += [
        (None, None, None, None, None),
        (None, "no id", "en", "s1", 5),
        (100, None, "en", None, None),
        (101, "", "de", "s2", 0),
        (102, " \t\n\n ", "fr", "s2", 5),
        (103, "1234 -- 5678", None, "s3", 12),
        (104, "word " * 60_000, "en", "s0", 300_000),
        (105, "a" * 100_000, "en", "s0", 100_000),
        (106, out[3][1], "en", "s0", out[3][4]),
        (107, out[3][1], "en", "s0", out[3][4]),
        (3, *out[3][1:]),
        (3, *out[3][1:]),
        (108, "Ünïcödé ñandú \U0001f600\U0001f600 straße", "de", "s9", 10),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOC).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark):
    """The same rows with extra columns that have the operators' inner names."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows(), DOC).repartition(2)
    return frame.select("*", *[F.lit("x").alias(name) for name in CLASH])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


def bag(df, *columns):
    """Rows as a sorted list of plain values."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
