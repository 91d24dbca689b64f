"""Language identification by unigram piece models with the segmentation summed out.

Each language has a probability for every piece of one fixed public vocabulary. The likelihood of a
word is the sum over all ways to cut it into pieces, found by a forward pass; that of a text is
the product over its words. The probabilities are fitted by expectation maximisation: a backward pass
gives the expected uses of each piece in the words of a language.

A word is ``▁`` and up to 32 letters of a run (longer runs are read as several words); text is
normalised (NFC) and lower-cased, everything but letters is passed over. Whole texts are scored.

Defined cases: null or letterless text is ``und`` with score 0, and so is every text where there was
no labelled row to learn from; letters outside the vocabulary weigh alike for all languages;
of equally likely languages the first by code point is taken. Rows are independent, so repeated rows
and empty tables need no care.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildup.llm.common import make_room, prepare, worker_cache
from buildup.llm.lattice import Pieces, by_step
from buildup.session import stage

MARK = "▁"
LONGEST = 32  # keeps forward probabilities within double precision
CACHE_WORDS = 100_000
CACHED_LENGTH = 48
WORDS_AT_ONCE = 8_192  # passed through the lattice together; bounds a worker's memory
FIXED_POINT = 2**20  # expected counts are summed as integers, in any order

_WORD = regex.compile(r"\p{L}{1,%d}" % LONGEST)
_WORD_OR_BREAK = regex.compile(r"\p{L}{1,%d}|\n" % LONGEST)


def normal(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()


def vocabulary(path: str) -> list[str]:
    """The letter pieces of a sentencepiece model, lower-cased, and each of their letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i).lower() for i in range(model.get_piece_size())]
    whole = {p for p in pieces if regex.fullmatch(f"{MARK}?\\p{{L}}+", p)}
    return sorted(whole | set("".join(whole)) | {MARK})


class Lattice:
    """Matches of the vocabulary in words; unknown letters share the last piece."""

    def __init__(self, pieces: list[str]):
        letters = sorted(set("".join(pieces)))
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.mark = int(self.code[ord(MARK)])
        self.unknown = len(pieces)
        sequences = {i: [int(self.code[ord(c)]) for c in p] for i, p in enumerate(pieces)}
        self.trie = Pieces(sequences | {self.unknown: [0]}, len(letters) + 1)

    def match(self, words: list[str]):
        """Occurrences ordered by offset, as slots: a word of n codes has n + 1 of them."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        last = np.cumsum(sizes)
        first = last - sizes
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes = np.full(int(last[-1]), self.mark, np.int64)
        inside = np.ones(len(codes), bool)
        inside[first] = False
        codes[inside] = self.code[letters]
        word = np.repeat(np.arange(len(words)), sizes)
        start, end, piece = self.trie.match(codes, np.repeat(last, sizes))
        order, begins = by_step(start, np.arange(len(codes)) - first[word])
        start, end, piece = start[order], end[order], piece[order]
        of = word[start]
        steps = [slice(a, b) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
        rows = np.arange(len(words))
        return start + of, end + of, piece, of, steps, first + rows, last + rows


def forward(match, weight: np.ndarray, slots: int) -> np.ndarray:
    """Sum over all ways to reach each slot; ``weight`` is that of each occurrence, one column a language."""
    start, end, _, _, steps, first, _ = match
    alpha = np.zeros((slots, *weight.shape[1:]))
    alpha[first] = 1
    for step in steps:
        alpha[end[step]] += alpha[start[step]] * weight[step]
    return alpha


def expected_uses(lattice: Lattice, words: list[str], counts, language, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece by language, in fixed point; ``language`` is that of each word."""
    match = lattice.match(words)
    start, end, piece, of, steps, first, last = match
    slots = int(last[-1]) + 1
    weight = p[piece, language[of]]
    alpha = forward(match, weight, slots)
    beta = np.zeros(slots)
    beta[last] = 1
    for step in reversed(steps):
        np.add.at(beta, start[step], weight[step] * beta[end[step]])
    share = alpha[start] * weight * beta[end] / alpha[last][of]
    uses = np.rint(share * counts[of] * FIXED_POINT)
    return np.bincount(language[of] * len(p) + piece, uses, p.shape[1] * len(p))


class Scorer:
    """Log-likelihoods of texts under each language, with a bounded cache of words."""

    def __init__(self, pieces: list[str], p: np.ndarray):
        self.lattice = Lattice(pieces)
        self.p = p
        self.rows: dict[str, int] = {}
        self.values = np.empty((0, p.shape[1] + 1))

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """Log-likelihoods and number of letters of each chunk between white space."""
        out = np.zeros((len(chunks), self.p.shape[1] + 1))
        parts = _WORD_OR_BREAK.findall("\n".join(chunks))
        chunk = np.cumsum(np.fromiter((w == "\n" for w in parts), bool, len(parts)))
        words = [w for w in parts if w != "\n"]
        if words:
            of = chunk[np.fromiter((w != "\n" for w in parts), bool, len(parts))]
            match = self.lattice.match(words)
            alpha = forward(match, self.p[match[2]], int(match[6][-1]) + 1)
            np.add.at(out[:, :-1], of, np.log(alpha[match[6]]))
            np.add.at(out[:, -1], of, [len(w) for w in words])
        return out

    def score(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (text x language) and number of letters of each text."""
        split = [normal(text).split() if text else [] for text in texts]
        if len(self.rows) > CACHE_WORDS:
            self.rows, self.values = {}, self.values[:0]
        rows = self.rows
        new = sorted(set(chain.from_iterable(split)).difference(rows))
        size = len(rows)
        if size + len(new) > len(self.values):
            grown = np.empty((2 * (size + len(new)), self.values.shape[1]))
            grown[:size] = self.values[:size]
            self.values = grown
        if new:
            for i in range(0, len(new), WORDS_AT_ONCE):
                some = new[i : i + WORDS_AT_ONCE]
                self.values[size + i : size + i + len(some)] = self._learn(some)
            rows.update(zip(new, range(size, size + len(new))))
        out = np.zeros((len(split), self.values.shape[1]))
        for i, words in enumerate(split):
            if words:
                at = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
                out[i] = self.values[at].sum(axis=0)
        if any(len(word) > CACHED_LENGTH for word in new):
            self.rows, self.values = {}, self.values[:0]
        return out[:, :-1], out[:, -1]


_scorers: dict[str, Scorer] = worker_cache()


class LanguageModel:
    """Fitted probabilities; ``predict`` gives a struct column ``(lang, score)``."""

    def __init__(self, spark: SparkSession, languages: list[str], pieces: list[str], p: np.ndarray):
        self.languages = languages
        self.p = p
        # languages x vocabulary: bounded by the fixed vocabulary and the label set
        self.shared = spark.sparkContext.broadcast((languages, pieces, p))
        self.name = uuid.uuid4().hex

    def predict(self, text: Column) -> Column:
        shared, name = self.shared, self.name

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            languages, pieces, p = shared.value
            if name not in _scorers and languages:
                make_room(_scorers)
                _scorers.clear()
                _scorers[name] = Scorer(pieces, p)
            for batch in batches:
                lang, score = np.full(len(batch), "und", object), np.zeros(len(batch))
                if languages:
                    logs, letters = _scorers[name].score(batch.tolist())
                    best = logs.argmax(axis=1)
                    top = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    seen = letters > 0
                    lang[seen] = np.array(languages, object)[best[seen]]
                    score[seen] = top[seen]
                yield pd.DataFrame({"lang": lang, "score": score})

        return F.pandas_udf(run, "lang string, score double")(text)


def train(
    labelled: DataFrame,
    vocabulary_path: str,
    sample_rows: int = 2000,
    rounds: int = 4,
    smoothing: float = 0.05,
    text: str = "text",
    lang: str = "lang",
    id_col: str = "doc_id",
) -> LanguageModel:
    """Fit the piece probabilities of each label on about ``sample_rows`` rows a language.

    The rows are chosen by a hash of their id, so the sample does not depend on partitioning. Rows
    without a label or text teach nothing. Expectation maximisation runs over the distinct words
    of the sample; only vocabulary-sized tables come to the driver.
    """
    spark = prepare(labelled.sparkSession)
    rows = labelled.select(
        F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{id_col}`")).alias("h")
    ).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    pieces = vocabulary(vocabulary_path)
    p = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    if not languages:
        return LanguageModel(spark, languages, pieces, p)
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_rows / n))])
    sample = rows.where(F.pmod("h", F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter()
            for language, text in zip(batch["lang"], batch["text"]):
                for word, n in Counter(_WORD.findall(normal(text))).items():
                    found[language, word] += n
            yield pd.DataFrame([(k, w, n) for (k, w), n in found.items()], columns=["lang", "word", "n"])

    words = sample.mapInPandas(count, "lang string, word string, n bigint")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stage(words.repartition(spark.sparkContext.defaultParallelism), "words")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((languages, pieces, p))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            languages, pieces, p = shared.value
            lattice, index = Lattice(pieces), {k: i for i, k in enumerate(languages)}
            total = np.zeros(p.size)
            for batch in batches:
                language = batch["lang"].map(index).to_numpy(np.int64)
                words, n = batch["word"].tolist(), batch["n"].to_numpy()
                for i in range(0, len(words), WORDS_AT_ONCE):
                    some = slice(i, i + WORDS_AT_ONCE)
                    total += expected_uses(lattice, words[some], n[some], language[some], p)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"cell": at, "uses": total[at].astype(np.int64)})

        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
        uses = words.mapInPandas(expect, "cell bigint, uses bigint").groupBy("cell").agg(F.sum("uses").alias("uses"))
        table = uses.toPandas()
        prepare(spark)
        counts = np.zeros(p.size)
        counts[table["cell"].to_numpy(np.int64)] = table["uses"].to_numpy() / FIXED_POINT
        counts = counts.reshape(len(languages), len(pieces) + 1).T + smoothing
        p = counts / counts.sum(axis=0)
        shared.unpersist()
    return LanguageModel(spark, languages, pieces, p)


def identify(
    df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row; score is the share of the best language."""
    found = df.select(F.col(f"`{id_col}`").alias("doc_id"), model.predict(F.col(f"`{text}`")).alias("_p"))
    return found.select("doc_id", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def keep_identified(df: DataFrame, model: LanguageModel, least: float = 0.3) -> DataFrame:
    """The rows whose text has a language with at least the share ``least``; columns are unchanged."""
    found = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"))
    found = found.withColumn("_p", model.predict(F.col("_row.text")))
    return found.where((F.col("_p.lang") != "und") & (F.col("_p.score") >= least)).select("_row.*")
