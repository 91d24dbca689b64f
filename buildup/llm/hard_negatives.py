"""Hard negatives by an inverted multi-index.

A vector is cut into two halves, each half has a codebook, and the pair of nearest centroids is the vector's cell. Per
half, the score of an anchor against all rows of a centroid is at most its score against the centroid plus the
length of its half times the centroid's radius, which is taken over all rows; the sum over both halves bounds a cell.
A multi-sequence heap walks the cells of an anchor in falling order of that sum without forming all of them.

An anchor is searched twice, for its positives and then for the negatives in the score windows that the positives
set. Each search visits the first cells up to ``seed_rows`` rows, which gives a score that the last row of
each result list must reach, and then goes on with the heap until the bound falls below it: from there on no cell can
change a list, so the lists are certified. Cells whose lower bound is above all windows are passed over. The results do
not depend on the codebooks, which only decide how much is read.

Rows and the anchors that visit them meet by the first centroid, whose rows are dealt to tasks of about
``part_rows``; more than ``group_rows`` anchors are dealt to groups. Products are exact: in doubles while these hold them,
else in Python's integers.

Defined cases: rows with a null id, label or vector, with a null or non-finite component or with one beyond 64 bits take no
part; a shorter vector counts as if it were filled up with zeros; equal scores are ordered by id, rows of equal
ids in no stated order, and each counts; scores beyond 64 bits count as the last of these; rows that share an anchor's id are searched each on its own; an anchor
without positives, and a positive without a negative in its window, have no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildup.llm.common import prepare
from buildup.session import stage

SAMPLE = 10_000  # rows that the codebooks are fitted on, about
CELL_ROWS = 64  # rows of a cell, on average
SIDE = 256  # most centroids of a half
SEED_ROWS = 2_000
PART_ROWS = 32_768
GROUP_ROWS = 16_384
EXACT = 2.0**53


def codebook(half: np.ndarray, size: int, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids of the rows of ``half`` (k-means)."""
    rng = np.random.default_rng(seed)
    centres = half[rng.choice(len(half), size, replace=False)]
    for _ in range(rounds):
        own = nearest(half, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, half)
        n = np.bincount(own, minlength=size)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the distance to it."""
    own = np.empty(len(half), np.int64)
    for low in range(0, len(half), 4096):
        part = half[low : low + 4096]
        own[low : low + 4096] = ((centres**2).sum(axis=1) - 2 * part @ centres.T).argmin(axis=1)
    return own, np.sqrt(((half - centres[own]) ** 2).sum(axis=1))


class Index:
    """Codebooks, radii and the number of rows of every cell."""

    def __init__(self, sample: np.ndarray, side: int, seed_rows: int = SEED_ROWS, part_rows: int = PART_ROWS):
        self.seed_rows, self.part_rows = seed_rows, part_rows
        self.cut, self.dim = sample.shape[1] // 2, sample.shape[1]
        side = min(side, len(sample))
        self.books = [codebook(half, side) for half in self.halves(sample)]
        self.radii = [np.full(side, -np.inf), np.full(side, -np.inf)]
        self.rows = np.zeros((side, side), np.int64)

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, : self.cut], vectors[:, self.cut :]

    def parts(self) -> np.ndarray:
        """Number of tasks that the rows of each first centroid are dealt to."""
        return np.maximum(1, -(-self.rows.sum(axis=1) // self.part_rows))

    def bounds(self, anchor: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Highest and lowest half scores of each centroid; widened by what doubles may round off."""
        high, low = [], []
        for half, book, radius in zip(self.halves(anchor[None]), self.books, self.radii):
            length = np.sqrt((half[0] ** 2).sum())
            middle = book @ half[0]
            reach = length * np.maximum(radius, 0)
            slack = 1e-9 * (np.abs(middle) + reach + length * np.sqrt((book**2).sum(axis=1))) + 1e-6
            high.append(np.where(radius >= 0, middle + reach + slack, -np.inf))
            low.append(middle - reach - slack)
        return high, low


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """``(sum, i, j)`` for all pairs in falling order of ``first[i] + second[j]`` (multi-sequence heap)."""
    rows, columns = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    f, s = first[rows].tolist(), second[columns].tolist()
    heap = [(-(f[0] + s[0]), 0, 0)]
    while heap:
        less, a, b = heapq.heappop(heap)
        yield -less, int(rows[a]), int(columns[b])
        if b + 1 < len(s):
            heapq.heappush(heap, (-(f[a] + s[b + 1]), a, b + 1))
        # a row of the grid is entered from the one above, in its first column
        if b == 0 and a + 1 < len(f):
            heapq.heappush(heap, (-(f[a + 1] + s[0]), a + 1, 0))


def visits(index: Index, anchor: np.ndarray, most: float, reached: float | None) -> Iterator[tuple[int, int]]:
    """Cells to visit: the first up to ``seed_rows`` rows, or those behind them whose bound is at least ``reached``.

    Cells with all scores above ``most`` are passed over.
    """
    (f, s), (fl, sl) = index.bounds(anchor)
    seen = 0
    for bound, i, j in walk(f, s):
        if bound == -np.inf or (seen >= index.seed_rows and (reached is None or bound < reached)):
            return
        n = int(index.rows[i, j])
        if n and fl[i] + sl[j] <= most:
            if (seen < index.seed_rows) == (reached is None):
                yield i, j
            seen += n


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), dim), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    largest = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    if a.shape[1] * largest[0] * largest[1] < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by id."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


_ANCHOR = "key bigint, id bigint, label bigint, vector array<bigint>"
_LISTS = ", pos_ids array<bigint>, pos_scores array<bigint>, reached bigint"


def _schedule(anchors: DataFrame, shared, groups: int, low: int, high: int) -> DataFrame:
    """One row per anchor and task that it visits, with the cells as second centroids.

    ``reached`` is null for a first visit. Windows follow from ``pos_scores``, which is null for positives.
    """
    names = anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        parts = index.parts()
        for batch in batches:
            vectors = matrix(pa.chunked_array([batch.column(names.index("vector"))]), index.dim)
            scores = batch.column(names.index("pos_scores")).to_pylist()
            reached = batch.column(names.index("reached")).to_pylist()
            out: list[tuple[int, int, int, list[int]]] = []
            for r, vector in enumerate(vectors):
                most = np.inf if scores[r] is None else max((high * p // 100 for p in scores[r]), default=-np.inf)
                by_first: dict[int, list[int]] = {}
                for i, j in visits(index, vector.astype(np.float64), most, reached[r]):
                    by_first.setdefault(i, []).append(j)
                out += [(r, i, p, js) for i, js in by_first.items() for p in range(parts[i])]
                if len(out) > 4096 or (out and r + 1 == len(vectors)):
                    row, *found = zip(*out)
                    columns = [batch.column(i).take(pa.array(row, pa.int64())) for i in range(len(names))]
                    kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()))
                    columns += [pa.array(c, k) for c, k in zip(found, kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=[*names, "c1", "part", "cells"])
                    out = []

    schema = _ANCHOR + _LISTS + ", c1 int, part int, cells array<int>"
    found = anchors.mapInArrow(run, schema)
    return found.withColumn("grp", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))


def _meet(rows: DataFrame, visiting: DataFrame, groups: int, dim: int, k: int, window: tuple[int, int]) -> DataFrame:
    """Best rows of each task: positives of an anchor (``slot`` -1), or negatives of its ``slot``-th positive."""
    low, high = window
    dealt = rows.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(here: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if here.num_rows and asking.num_rows:
            cell = here["c2"].to_numpy()
            order = np.argsort(cell, kind="stable")
            cell, ids = cell[order], here["id"].to_numpy()[order]
            keys, labels = here["key"].to_numpy()[order], here["label"].to_numpy()[order]
            vectors = matrix(here["vector"], dim)[order]
            present, begin = np.unique(cell, return_index=True)
            spans = dict(zip(present.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(cell)])))
            step = max(1, 4_000_000 // len(cell))
            for lo in range(0, asking.num_rows, step):
                out += meet_some(asking.slice(lo, step), ids, keys, labels, vectors, spans)
        columns = list(zip(*out)) or [()] * 5
        names = ("key", "slot", "id", "other", "score")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})

    def meet_some(asking: pa.Table, ids, keys, labels, vectors, spans) -> list[tuple]:
        points = matrix(asking["vector"], dim)
        score = np.zeros((len(points), len(ids)), np.int64)
        met = np.zeros((len(points), len(ids)), bool)
        visitors: dict[int, list[int]] = {}
        for r, cells in enumerate(asking["cells"].to_pylist()):
            for c in cells:
                visitors.setdefault(c, []).append(r)
        for c, who in visitors.items():
            if c in spans:
                a, b = spans[c]
                score[who, a:b] = products(points[who], vectors[a:b])
                met[who, a:b] = True
        out = []
        asked = zip(*[asking[c].to_pylist() for c in ("key", "label", "pos_scores")])
        for r, (key, label, windows) in enumerate(asked):
            if windows is None:
                at = np.flatnonzero(met[r] & (labels == label) & (keys != key))
                at = at[_best(score[r, at], ids[at], k)]
                out += [(key, -1, *t) for t in zip(ids[at].tolist(), keys[at].tolist(), score[r, at].tolist())]
                continue
            others = np.flatnonzero(met[r] & (labels != label))
            own = score[r, others]
            for slot, p in enumerate(windows):
                at = others[(own >= -(-low * p // 100)) & (own <= high * p // 100)]
                at = at[_best(score[r, at], ids[at], k)]
                out += [(key, slot, *t) for t in zip(ids[at].tolist(), keys[at].tolist(), score[r, at].tolist())]
        return out

    by = ["c1", "part", "grp"]
    met = dealt.groupBy(*by).cogroup(visiting.groupBy(*by))
    return met.applyInArrow(run, "key bigint, slot int, id bigint, other bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _fit(rows: DataFrame, n: int, dim: int, side: int | None, seed_rows: int, part_rows: int) -> Index:
    """Codebooks from a sample of about ``SAMPLE`` rows."""
    share = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1_000_000)) < 1e6 * min(1.0, SAMPLE / n)
    picked = [r["vector"] for r in rows.where(share).select("vector").collect()]
    picked = picked or [r["vector"] for r in rows.select("vector").limit(1).collect()]
    sample = np.zeros((len(picked), dim))
    for r, vector in enumerate(picked):
        sample[r, : len(vector)] = vector
    side = side or min(SIDE, max(1, round((n / CELL_ROWS) ** 0.5)))
    return Index(sample, side, seed_rows, part_rows)


def _place(rows: DataFrame, index: Index) -> DataFrame:
    """Staged rows with their cell and task; fills in the index's radii and counts, which its size bounds."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            halves = index.halves(matrix(table["vector"], index.dim).astype(np.float64))
            for name, half, book in zip("12", halves, index.books):
                own, distance = nearest(half, book)
                table = table.append_column("c" + name, pa.array(own, pa.int32()))
                table = table.append_column("d" + name, pa.array(distance, pa.float64()))
            yield from table.combine_chunks().to_batches()

    schema = _ANCHOR + ", asks boolean, c1 int, d1 double, c2 int, d2 double"
    placed = stage(rows.select("key", "id", "label", "vector", "asks").mapInArrow(run, schema), "cells")
    for i, name in enumerate("12"):
        for r in placed.groupBy("c" + name).agg(F.max("d" + name).alias("d")).collect():
            index.radii[i][r["c" + name]] = r["d"]
    for r in placed.groupBy("c1", "c2").count().collect():
        index.rows[r["c1"], r["c2"]] = r["count"]
    return placed


def mine(
    df: DataFrame,
    is_anchor: Column,
    id_col: str,
    label: Column,
    vector: Column,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    side: int | None = None,
    seed_rows: int = SEED_ROWS,
    part_rows: int = PART_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    The positives of an anchor are the rows of its label with the highest inner products of the integer ``vector``.
    The negatives of a positive are the highest rows of other labels whose score is at least ``window[0]`` and at
    most ``window[1]`` per cent of the positive's. The other parameters change what is read at once, not the result.
    """
    spark = prepare(df.sparkSession)
    rows = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        label.cast("bigint").alias("label"),
        vector.cast("array<bigint>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).where("id is not null and label is not null and vector is not null")
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull()))
    rows = stage(rows.withColumn("key", F.monotonically_increasing_id()), "vectors")
    n, dim, asking = rows.agg(F.count("*"), F.max(F.size("vector")), F.count_if("asks")).first()
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not asking:
        return spark.createDataFrame([], schema)
    index = _fit(rows, n, max(1, dim), side, seed_rows, part_rows)
    placed = _place(rows, index)
    shared = spark.sparkContext.broadcast(index)
    parts = F.array(*[F.lit(int(p)) for p in index.parts()])
    dealt = placed.select(
        "key", "id", "label", "vector", "c1", "c2",
        F.pmod(F.xxhash64("key"), F.get(parts, F.col("c1"))).cast("int").alias("part"),
    )
    groups = -(-asking // group_rows)

    def search(anchors: DataFrame, k: int) -> DataFrame:
        """Staged lists of each anchor and slot, certified."""
        go = lambda some: _meet(dealt, _schedule(some, shared, groups, *window), groups, index.dim, k, window)
        first = stage(_ranked(go(anchors), k), "seeds")
        # what the last row of each list has to reach; a list that is not full takes whatever its window allows
        lists = first.groupBy("key", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        full = lists.where(F.col("n") >= k).groupBy("key").agg(F.count("*").alias("full"), F.min("least").alias("least"))
        lowest = F.lit(-(2**63))
        least = F.array_min("pos_scores").cast("double") * (window[0] / 100)
        floor = F.coalesce(F.floor(least - F.abs(least) * 1e-9 - 1).cast("bigint"), lowest)
        wanted = F.coalesce(F.size("pos_scores"), F.lit(1))
        met = anchors.join(full.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
        done = F.coalesce(F.col("full"), F.lit(0)) >= wanted
        reached = F.when(done, F.greatest("least", floor)).otherwise(floor)
        rest = met.withColumn("reached", reached).select(*anchors.columns)
        return stage(_ranked(first.drop("rank").unionByName(go(rest)), k), "certified")

    none = [F.lit(None).cast("array<bigint>").alias(c) for c in ("pos_ids", "pos_scores")]
    blank = F.lit(None).cast("bigint").alias("reached")
    anchors = stage(placed.where("asks").select("key", "id", "label", "vector"), "anchors")
    best = search(anchors.select("*", *none, blank), positives)
    lists = best.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("l"))
    lists = lists.select("_key", F.col("l.id").alias("pos_ids"), F.col("l.score").alias("pos_scores"))
    asked = anchors.join(lists, F.col("key") == F.col("_key")).drop("_key").withColumn("reached", blank)
    asked = stage(asked, "windows")
    found = search(asked, negatives)
    names = asked.select(F.col("key").alias("_key"), F.col("id").alias("anchor_id"), "pos_ids", "pos_scores")
    return found.join(names, F.col("key") == F.col("_key")).select(
        "anchor_id",
        F.get("pos_ids", F.col("slot")).alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.get("pos_scores", F.col("slot")).alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
