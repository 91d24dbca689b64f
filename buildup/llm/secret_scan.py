"""Secrets in text: fixed patterns, and character Markov models for strings that no pattern names.

The patterns find assignments, access keys and hexadecimal strings. The samples they label, random strings inside
them and ordinary identifiers outside, train two first-order character models. Every other long run of
key characters is scored with both; a run whose mean log-likelihood ratio per character reaches
``LEAST`` is a secret of kind ``random``.

Defined cases: null text counts as empty; without labelled samples the models are uniform and add nothing;
rows are independent, so repeated rows and empty tables need no care. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buildup.llm.common import prepare

KINDS = ("assign", "access", "hex", "random")
LEAST = 2.0  # nats a character
DISTINCT = 8  # a run of fewer different characters is a rule or a filler, not random
BACKOFF = 100.0  # weight of what is fallen back on, in samples
RUN = 16  # shortest run that the models score
ORDINARY = 6  # shortest run that is an identifier sample

_ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("passw", "secret", "token", "api")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(256, len(ALPHABET), np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
SIZE = len(ALPHABET)
_RUNS = re.compile(b"[%s]{%d,}" % (re.escape(ALPHABET.encode()), RUN))
_TOKENS = re.compile(b"[%s]{%d,}" % (re.escape(ALPHABET.encode()), ORDINARY))


def one_byte(text: str) -> bytes:
    """The text with one byte a code point; what is not Latin-1 becomes a question mark."""
    return text.encode("latin-1", "replace")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, start of the secret itself)`` of the patterns, by start, then kind."""
    found = []
    lower = text.lower()
    if any(word in lower for word in _WORDS):
        found += [
            (m.start(), 0, m.end(), m.start(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6
        ]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found)


def _apart(runs: list[tuple[int, int]], base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    return [(a, b) for a, b in runs if not any(s < b and a < e for s, _, e, _ in base)]


def pair_counts(texts) -> np.ndarray:
    """Counts of character pairs in (ordinary, random) samples; a start symbol opens each sample."""
    counts = np.zeros((2, (SIZE + 1) * (SIZE + 1)), np.int64)
    for text in texts:
        if not text:
            continue
        raw = one_byte(text)
        base = base_spans(text)
        labelled = {(m, e): 1 for _, _, e, m in base}
        labelled |= {s: 0 for s in _apart([m.span() for m in _TOKENS.finditer(raw)], base)}
        for (a, b), label in labelled.items():
            codes = _CODE[np.frombuffer(raw[a:b], np.uint8)]
            codes = codes[codes < SIZE]
            before = np.concatenate(([SIZE], codes[:-1]))
            np.add.at(counts[label], before * (SIZE + 1) + codes, 1)
    return counts


def pair_ratio(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio, random over ordinary, of each character after each other.

    After characters without samples, ordinary text falls back on its single characters, and
    random strings on all characters alike.
    """
    ordinary, random = counts.reshape(2, SIZE + 1, SIZE + 1)[:, :, :SIZE].astype(float)
    single = ordinary.sum(axis=0) + 0.5
    prior = BACKOFF * np.stack([single / single.sum(), np.full(SIZE, 1 / SIZE)])
    follow = lambda pairs, prior: np.log((pairs + prior) / (pairs.sum(axis=1, keepdims=True) + BACKOFF))
    return follow(random, prior[1]) - follow(ordinary, prior[0])


class SecretModel:
    """Log-likelihood ratio of each character pair; ``scan`` gives a struct column of counts and spans."""

    def __init__(self, spark: SparkSession, counts: np.ndarray):
        self.ratio = pair_ratio(counts)
        self.shared = spark.sparkContext.broadcast(self.ratio)  # fixed size

    def scan(self, text: Column, least: float = LEAST) -> Column:
        shared = self.shared

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([scan_text(t or "", shared.value, least) for t in batch], columns=_COLUMNS)

        return F.pandas_udf(run, "n_assign bigint, n_access bigint, n_hex bigint, base string, spans string")(text)


_COLUMNS = ["n_assign", "n_access", "n_hex", "base", "spans"]


def random_runs(raw: bytes, base, ratio: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Runs apart from the base spans that the models call random."""
    found = []
    for a, b in _apart([m.span() for m in _RUNS.finditer(raw)], base):
        codes = _CODE[np.frombuffer(raw[a:b], np.uint8)]
        if len(set(raw[a:b])) < DISTINCT:
            continue
        if ratio[np.concatenate(([SIZE], codes[:-1])), codes].mean() >= least:
            found.append((a, b))
    return found


def _joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_text(text: str, ratio: np.ndarray, least: float = LEAST) -> tuple:
    base = base_spans(text)
    spans = [(s, k, e) for s, k, e, _ in base]
    added = [(a, 3, b) for a, b in random_runs(one_byte(text), base, ratio, least)]
    kinds = [k for _, k, _ in spans]
    counts = [kinds.count(i) for i in range(3)]
    return (*counts, _joined(spans), _joined(sorted(spans + added)))


def train(
    df: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text: str = "text"
) -> SecretModel:
    """Fit the models on the samples that the patterns label in about ``sample_rows`` rows.

    The rows are chosen by a hash of their id, so the sample does not depend on partitioning.
    """
    spark = prepare(df.sparkSession)
    n = df.count()
    rate = min(1.0, sample_rows / max(1, n))
    rows = df.where(F.pmod(F.xxhash64(f"`{id_col}`"), F.lit(1_000_000)) < rate * 1_000_000)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, (SIZE + 1) * (SIZE + 1)), np.int64)
        for batch in batches:
            total += pair_counts(batch["text"])
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total.ravel()[at]})

    cells = rows.select(F.col(f"`{text}`").alias("text")).mapInPandas(count, "cell bigint, n bigint")
    counts = np.zeros((2, (SIZE + 1) * (SIZE + 1)), np.int64)
    for row in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most two models
        counts.ravel()[row["cell"]] = row["n"]
    return SecretModel(spark, counts)


def find_secrets(
    df: DataFrame, model: SecretModel, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base, spans)`` of every row; spans are ``kind:start:end``."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), model.scan(F.col(f"`{text}`")).alias("_s"))
    return rows.select("doc_id", *[F.col(f"_s.{c}").alias(c) for c in _COLUMNS])
