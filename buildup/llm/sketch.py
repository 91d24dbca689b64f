"""Threshold-scaled document sketches.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range. Unlike a fixed number of
minima it grows with the document, so sketches of very unequal documents can be compared,
and the sketch of several documents together is the union of theirs.

A fingerprint is ``<distinct shingles>.<digest of all of them>.<kept hashes, base64>``. Likeness is the share of the
kept hashes of two sketches that both have; where neither kept any, it is 1 for equal digests and 0
otherwise.

Defined cases: null text counts as empty and has no shingles; fewer words than a shingle make one shingle; equal
texts have equal fingerprints; an empty table gives an empty result. Null ids come last in the order of
documents, equal ids are ordered by their text's hash; a lone document is its own next one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildup.llm.common import prepare, text_hash

WORDS = 5
SHARE = 2  # one hash in so many is kept


class Sketch:
    """Kept hashes of one text, ascending, with the number and digest of all its distinct shingles."""

    def __init__(self, kept: np.ndarray, shingles: int, digest: int):
        self.kept, self.shingles, self.digest = kept, shingles, digest

    def __str__(self) -> str:
        kept = base64.b64encode(self.kept.astype(">u8").tobytes()).decode()
        return f"{self.shingles}.{self.digest:016x}.{kept}"


def sketch(text: str | None, words: int = WORDS, share: int = SHARE) -> Sketch:
    found = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not found:
        return Sketch(np.empty(0, np.uint64), 0, 0)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh3_64_intdigest
    every = np.array([hashed(line[s:e]) for s, e in zip(starts.tolist(), (ends - 1).tolist())], np.uint64)
    every = np.unique(every)
    kept = every[: np.searchsorted(every, np.uint64(2**64 // share))]
    return Sketch(kept, len(every), xxhash.xxh3_64_intdigest(every.tobytes()))


def merge(a: Sketch, b: Sketch) -> np.ndarray:
    """Kept hashes of both documents together."""
    return np.union1d(a.kept, b.kept)


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated share of the shingles of either that both have."""
    if not len(a.kept) and not len(b.kept):
        return float(a.digest == b.digest)
    both = len(np.intersect1d(a.kept, b.kept, assume_unique=True))
    return both / (len(a.kept) + len(b.kept) - both)


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    if not len(a.kept):
        return likeness(a, b)
    return len(np.intersect1d(a.kept, b.kept, assume_unique=True)) / len(a.kept)


def fingerprints(df: DataFrame, words: int = WORDS, share: int = SHARE, text: str = "text") -> DataFrame:
    """Add ``fingerprint`` of ``text``."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([str(sketch(t, words, share)) for t in batch], dtype=object)

    return df.withColumn("fingerprint", F.pandas_udf(run, T.StringType())(F.col(f"`{text}`")))


def in_sequence(df: DataFrame, per_partition: int = 4) -> DataFrame:
    """``(bucket, guest, no_id, doc_id, text_hash, text)``: rows dealt to buckets of consecutive ids, and sorted.

    Each bucket ends with a guest, the first row of the next bucket, so that every row is followed by its
    successor in one task; the last is followed by the very first. Only cut points and one id a
    bucket come to the driver. Buckets are many more than tasks, which evens tasks out.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = per_partition * partitions
    ids = df.select(F.col("doc_id").cast("double").alias("_x"))
    cuts = ids.stat.approxQuantile("_x", [i / n for i in range(1, n)], 0.25 / n)
    splits = [float("-inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="_x", outputCol="_bucket", handleInvalid="keep")
    rows = df.withColumn("_x", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan"))))
    rows = bucketizer.transform(rows).select(
        F.col("_bucket").cast("int").alias("bucket"),
        F.col("doc_id").isNull().alias("no_id"),
        "doc_id",
        text_hash(F.col("text")).alias("text_hash"),
        "text",
    )
    found = rows.groupBy("bucket").agg(F.min("doc_id").alias("least")).orderBy("bucket").collect()
    if not found:
        return rows.withColumn("guest", F.lit(False))
    before = {r["bucket"]: found[i - 1]["bucket"] for i, r in enumerate(found)}
    first = rows.where(F.col("doc_id").isin([r["least"] for r in found if r["least"] is not None]) | F.col("no_id"))
    first = first.groupBy("bucket").agg(F.min(F.struct("no_id", "doc_id", "text_hash", "text")).alias("f"))
    # an id that opens a bucket is the least one there
    moved = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("bucket")]
    guests = first.select(moved.alias("bucket"), "f.*", F.lit(True).alias("guest"))
    everything = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    return everything.repartition(n, "bucket").sortWithinPartitions(
        "bucket", "guest", "no_id", "doc_id", "text_hash"
    )


_PAIR = (
    "doc_id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, contained_in_edited double, contained_in_next double"
)


def compare_edits(
    df: DataFrame, words: int = WORDS, share: int = SHARE, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Fingerprints of every text, of the text edited with the next one, and their likeness.

    The edited text has its last half (rounded down, in code points) replaced by as much of the beginning of the
    next document.
    """
    prepare(df.sparkSession)
    rows = in_sequence(df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")))

    def row(doc_id, text: str, own: Sketch, following: str, after: Sketch) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        made = sketch(edited, words, share)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        near = likeness(own, made), likeness(own, after), containment(own, made), containment(own, after)
        return (doc_id, len(text), digest, str(own), str(made), *near)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            out = []
            for bucket, guest, doc_id, text in zip(batch["bucket"], batch["guest"], batch["doc_id"], batch["text"]):
                text = text or ""
                here = sketch(text, words, share)
                if last is not None and last[0] == bucket:
                    out.append(row(*last[1:], text, here))
                last = None if guest else (bucket, doc_id, text, here)
            columns = [c.split()[0] for c in _PAIR.split(", ")]
            yield pd.DataFrame(out, columns=columns)

    # ids go through pandas as text: beside a null it would turn integers into doubles
    found = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, _PAIR)
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))
