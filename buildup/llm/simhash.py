"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``d`` bits apart meet in a variant that is at most half of ``d`` away
from each. Every distinct fingerprint emits all variants of that ball; fingerprints that emit the
same variant are linked.

The ball is emitted in two steps, so that the shuffle carries tens of rows a fingerprint instead of
thousands: a row for each way to spend flips on ``p`` chosen bits goes to the block these bits name, and
the task that holds the block emits the variants that spend the remaining flips on the other
bits. A variant lies in exactly one block, so all who emit it meet there. ``p`` grows with the
number of fingerprints, which keeps blocks alike at every size; blocks that are much fuller
than that are dealt to several tasks by a hash of the variant.

Defined cases: null text counts as empty, an empty text has fingerprint zero and is linked like any
other; equal rows give equal rows; an empty table gives an empty result; null ids are allowed
and never name a component unless all ids of it are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buildup.llm.common import prepare, text_hash, whole_rows
from buildup.llm.components import components
from buildup.session import stage

BITS = 64
BLOCK = 1024  # fingerprints whose own bits name a block, on average
CHUNK = 1 << 23  # variants held at once
SHINGLES = 400_000  # hashes summed at once


def _hashes(text: str | None, words: int) -> list[int]:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], 42) for s, e in zip(starts.tolist(), (ends - 1).tolist())]


def _majority(hashes: list[int], sizes: list[int]) -> np.ndarray:
    """One fingerprint for each run of ``sizes`` hashes; all sizes are positive."""
    values = np.array(hashes, dtype=np.uint64)
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    counts = np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)
    set_bits = counts * 2 > np.array(sizes)[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(texts, words: int) -> np.ndarray:
    """64-bit majority fingerprints of word shingles, as signed integers."""
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[int] = []
    rows: list[int] = []
    sizes: list[int] = []

    def settle():
        if rows:
            out[rows] = _majority(hashes, sizes)
            hashes.clear(), rows.clear(), sizes.clear()

    for i, text in enumerate(texts):
        if own := _hashes(text, words):
            hashes += own
            rows.append(i)
            sizes.append(len(own))
            if len(hashes) > SHINGLES:
                settle()
    settle()
    return out.view(np.int64)


def with_fingerprint(df: DataFrame, words: int = 4, text: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint of ``text`` as a long."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(fingerprints(batch.tolist(), words))

    return df.withColumn(name, F.pandas_udf(run, T.LongType())(F.col(f"`{text}`")))


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


@lru_cache(maxsize=64)
def masks(bits: tuple[int, ...], flips: int) -> np.ndarray:
    """Every way to flip at most ``flips`` of ``bits``."""
    made = [sum(1 << b for b in chosen) for n in range(flips + 1) for chosen in combinations(bits, n)]
    return np.array(made, dtype=np.uint64)


def _local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


PARITY = np.random.default_rng(64).integers(0, 2**64, 24, dtype=np.uint64)


def syndromes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash to ``size`` = 2**e cells that is linear in the bits: flips move a value by their own hash."""
    out = np.zeros(len(values), np.int64)
    for k in range(size.bit_length() - 1):
        out |= (np.bitwise_count(values & PARITY[k]).astype(np.int64) & 1) << k
    return out


def _variants(base: np.ndarray, flips: np.ndarray, cell: int, cells: int) -> tuple[np.ndarray, ...]:
    """Of all ``base`` x ``flips``, those in one cell: value, index of the base, number of flips.

    As the hash is linear, the flips that lead from a base to the cell are known beforehand; no
    variant is made for another cell.
    """
    used = np.bitwise_count(flips).astype(np.int64)
    if cells == 1:
        return (
            (base[:, None] ^ flips[None, :]).ravel(),
            np.repeat(np.arange(len(base)), len(flips)),
            np.tile(used, len(base)),
        )
    at, by = syndromes(base, cells), syndromes(flips, cells)
    order = np.argsort(by, kind="stable")
    values, owners, counts = [], [], []
    for here in np.unique(at):
        first, last = np.searchsorted(by[order], [here ^ cell, (here ^ cell) + 1])
        own, some = np.flatnonzero(at == here), order[first:last]
        values.append((base[own][:, None] ^ flips[some][None, :]).ravel())
        owners.append(np.repeat(own, len(some)))
        counts.append(np.tile(used[some], len(own)))
    return np.concatenate(values), np.concatenate(owners), np.concatenate(counts)


def block_links(
    fps: np.ndarray, block: int, bits: tuple[int, ...], distance: int, part: int = 0, parts: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints that emit a common variant inside one block.

    ``bits`` name blocks; ``part`` of ``parts`` (a power of two) takes a share of the variants. Of all
    that emit a variant, one at most ``distance // 2`` away is linked to each other one; for an even
    distance these are all linked pairwise anyway, for an odd one a pair that the star leaves out
    meets in another variant. The links are then thinned to a spanning forest.
    """
    fps = np.unique(fps)
    reach, inner = (distance + 1) // 2, distance // 2
    key = masks(bits, len(bits))[-1] if bits else np.uint64(0)
    base = (fps & ~key) | np.uint64(block)  # the variant that keeps every other bit
    spent = np.bitwise_count((fps ^ np.uint64(block)) & key).astype(np.int64)
    others = tuple(i for i in range(BITS) if i not in bits)
    groups = [(np.flatnonzero(spent == reach - left), masks(others, left)) for left in range(reach + 1)]
    total = sum(len(who) * len(flips) for who, flips in groups)
    cells = parts
    while cells * CHUNK < total and cells < 2 ** len(PARITY):
        cells *= 2
    left_a, left_b = [], []
    for cell in range(part, cells, parts):
        values, owner, outer = [], [], []
        for who, flips in groups:
            if len(who):
                made, own, used = _variants(base[who], flips, cell, cells)
                values.append(made), owner.append(who[own]), outer.append(used + spent[who[own]] > inner)
        if not values:
            continue
        values = np.concatenate(values)
        ordered = np.sort(values)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(again):
            continue
        spot = np.minimum(np.searchsorted(again, values), len(again) - 1)
        met = np.flatnonzero(again[spot] == values)
        group, owner, outer = spot[met], np.concatenate(owner)[met], np.concatenate(outer)[met]
        order = np.lexsort((owner, outer, group))
        group, owner, outer = group[order], owner[order], outer[order]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        head = np.flatnonzero(first)[np.cumsum(first) - 1]  # the nearest owner of the same variant
        star = ~first & ~outer[head]
        a, b = owner[head][star], owner[star]
        good = np.bitwise_count(fps[a] ^ fps[b]) <= distance
        a, b = a[good], b[good]
        root = _local_roots(a, b, len(fps))
        child = np.flatnonzero(root != np.arange(len(fps)))
        left_a.append(root[child]), left_b.append(child)
    if not left_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    root = _local_roots(np.concatenate(left_a), np.concatenate(left_b), len(fps))
    child = np.flatnonzero(root != np.arange(len(fps)))
    return fps[root[child]], fps[child]


def fingerprint_links(fps: DataFrame, distance: int, block_size: int = BLOCK) -> DataFrame:
    """``(a, b)``, a < b, linking the distinct long ``fp`` values at most ``distance`` bits apart.

    Not every pair is listed: the links join the same fingerprints into the same components
    as all pairs would. A block with more than four times ``block_size`` own fingerprints is shared
    by several tasks. ``fps`` is read twice: pass a staged table.
    """
    spark = fps.sparkSession
    n, *ones = fps.agg(
        F.count("*"), *[F.sum(F.expr(f"shiftright(fp, {i}) & 1")) for i in range(BITS)]
    ).first()
    schema = "a bigint, b bigint"
    if n < 2:
        return spark.createDataFrame([], schema)
    reach = (distance + 1) // 2
    p = min(BITS // 2, max(0, round(np.log2(n / block_size))))
    # the bits that divide this set of fingerprints most evenly
    bits = tuple(sorted(range(BITS), key=lambda i: (abs(2 * ones[i] - n), i))[:p])
    key = _signed(sum(1 << b for b in bits))
    ways = [_signed(int(m)) for m in masks(bits, min(reach, p))]
    dealt = fps.select("fp", F.explode(F.array(*[F.lit(w) for w in ways])).alias("way")).select(
        "fp", F.expr(f"(fp ^ way) & {key}L").alias("block"), F.lit(1).alias("parts"), F.lit(0).alias("part")
    )
    own = fps.groupBy(F.expr(f"fp & {key}L").alias("block")).agg(F.count("*").alias("own"))
    full = stage(own.where(F.col("own") > 4 * block_size), "full")
    if not full.isEmpty():
        shares = F.pow(2, F.ceil(F.log2(F.col("own") / block_size))).cast("int").alias("shares")
        dealt = (
            dealt.drop("parts", "part")
            .join(full.select("block", shares), "block", "left")
            .withColumn("parts", F.coalesce("shares", F.lit(1)))
            .select("fp", "block", "parts", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
        )

    def expand(group: pa.Table) -> pa.Table:
        fp = group["fp"].to_numpy().view(np.uint64)
        block = int(group["block"][0].as_py()) % 2**64
        part, parts = group["part"][0].as_py(), group["parts"][0].as_py()
        a, b = block_links(fp, block, bits, distance, part, parts)
        x, y = a.view(np.int64), b.view(np.int64)
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return dealt.groupBy("block", "part").applyInArrow(expand, schema).distinct()


def near_duplicates(
    df: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)`` of each row.

    ``component_id`` is the smallest id among all rows whose fingerprints are joined by links
    of at most ``distance`` bits; ``root`` names the component itself.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = with_fingerprint(rows.withColumn("text_hash", text_hash(F.col("text"))), words)
    rows = stage(rows.select("doc_id", "text_hash", "fp"), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct, distance))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stage(named.join(least, "root").select("fp", "root", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(df: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """The rows of ``df`` that stay when one document of each near-duplicate group is kept.

    The one with the smallest ``doc_id`` stays (null ids last), of equal ids the one with
    the smallest text hash, and of equal rows one.
    """
    found = stage(near_duplicates(df, words, distance), "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    kept = found.groupBy("root").agg(F.min(rank).alias("k")).select("k.doc_id", "k.text_hash")
    key = ["_id", "_null", "_hash"]
    rows = df.select(whole_rows(df).alias("_row")).select("_row", *_row_key("_row.doc_id", text_hash(F.col("_row.text"))))
    kept = kept.select(*_row_key("doc_id", F.col("text_hash")))
    # equal rows are all that a kept key can repeat; both steps share one shuffle on it
    return rows.join(kept, key, "left_semi").dropDuplicates(key).select("_row.*")


def _row_key(doc_id: str, hashed) -> list:
    """Join columns without nulls that stand for a row's id and text."""
    return [
        F.coalesce(F.col(doc_id), F.lit(0)).alias("_id"),
        F.col(doc_id).isNull().alias("_null"),
        hashed.alias("_hash"),
    ]
