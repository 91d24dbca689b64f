"""Nearest neighbours by multi-index hashing.

Vectors get binary codes from learned rotations: principal directions turned so that the signs lose least
(iterative quantisation), several rotations side by side if more bits than dimensions are asked for. The
rotations and the search radius are fitted on a bounded sample; every row is indexed.

The index is cut into blocks of rows by a hash of the id. In a block the code is split into 16-bit substrings, each
with its own bucket table. Two codes at most ``r`` bits apart agree in some substring up to ``r // m`` bits, so
probing all buckets that close to the query's substring, in all ``m`` tables, finds every code within
the radius. These are ranked by their distance to the original vectors. Queries with fewer than ``k`` codes
in the radius are searched again without a limit.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, and neither do those
of another than the most common length; equal distances are ordered by id; rows with the query's own id are no
candidates for it, repeated rows of other ids count each; query rows that share an id ask once, with the smallest
of their vectors in the order of arrays; fewer than ``k`` candidates are all returned; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildup.llm.common import prepare
from buildup.session import stage

BITS = 128
SUB = 16
BLOCK = 65_536  # most rows of an index block, on average
QUERY_BLOCK = 65_536
SAMPLE = 10_000  # rows that the rotations and the radius are fitted on
COVERED = 0.985  # share of the sample's neighbours within the radius


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Coder:
    """Signs of rotated, centred vectors, packed to 16-bit words."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = 30, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        _, _, axes = np.linalg.svd(centred.T @ centred)
        axes = axes[: min(bits, len(axes))].T
        low = centred @ axes
        turns = []
        while sum(t.shape[1] for t in turns) < bits:
            turn = np.linalg.qr(rng.normal(size=(low.shape[1],) * 2))[0]
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
                turn = (u @ v).T
            turns.append(axes @ turn)
        self.turn = np.concatenate(turns, axis=1)[:, :bits]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors - self.mean) @ self.turn > 0
        return np.packbits(signs, axis=1).view(np.uint16)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def fit_radius(coder: Coder, sample: np.ndarray, k: int, rows: int, queries: int = 300) -> int:
    """Bits that cover nearly all of the neighbours to be found among ``rows`` rows.

    A sample is thinner than the table, so only its nearest ``k * sample / rows`` neighbours are alike.
    """
    rank = min(max(1, -(-k * len(sample) // rows)), len(sample) - 1)
    codes, found = coder.codes(sample), []
    for i in range(min(queries, len(sample))):
        d = np.sqrt(((sample - sample[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        near = np.argpartition(d, rank - 1)[:rank]
        found.append(hamming(codes[near], codes[i]))
    return int(np.quantile(np.concatenate(found), COVERED, method="higher"))


class Block:
    """Bucket tables of one block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            values, starts = np.unique(column[order], return_index=True)
            self.tables.append((order, values, starts, np.append(starts[1:], len(column))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is at most ``radius`` bits away."""
        reach = radius // len(self.tables)
        seen = np.zeros(len(self.codes), bool)
        for part, (order, values, starts, ends) in zip(code, self.tables):
            close = np.bitwise_count(values ^ part) <= reach
            first, sizes = starts[close], (ends - starts)[close]
            skip = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
            seen[order[skip + np.arange(len(skip))]] = True
        rows = np.flatnonzero(seen)
        return rows[hamming(self.codes[rows], code) <= radius]


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    flat = table["vector"].combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _search(
    rows: DataFrame, queries: DataFrame, blocks: int, groups: int, coder, dim: int, radius: int, k: int
) -> DataFrame:
    """The nearest ``k`` of each block for each query, within ``radius`` bits."""
    shared = rows.sparkSession.sparkContext.broadcast(coder)  # dimensions x bits
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    index = rows.select("vec_id", "vector", deal("vec_id", blocks).alias("block"))
    index = index.withColumn("part", F.explode(F.expr(f"sequence(0, {groups - 1})")))
    asked = queries.select(F.col("vec_id").alias("query_id"), "vector", deal("vec_id", groups).alias("part"))
    asked = asked.withColumn("block", F.explode(F.expr(f"sequence(0, {blocks - 1})")))

    def run(here: pa.Table, asking: pa.Table) -> pa.Table:
        out = ([], [], [])
        if here.num_rows and asking.num_rows:
            coder = shared.value
            ids, vectors = here["vec_id"].to_numpy(), _matrix(here, dim)
            block, points = Block(coder.codes(vectors)), _matrix(asking, dim)
            for query, point, code in zip(asking["query_id"].to_numpy(), points, coder.codes(points)):
                near = block.within(code, radius)
                near = near[ids[near] != query]
                score = np.sqrt(((vectors[near] - point) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], score))[:k]
                out[0].append(np.full(len(best), query, np.int64))
                out[1].append(ids[near][best])
                out[2].append(score[best])
        empty = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float64)]
        columns = [np.concatenate([e, *c]) for e, c in zip(empty, out)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    found = index.groupBy("block", "part").cogroup(asked.groupBy("block", "part"))
    return found.applyInArrow(run, "query_id bigint, vec_id bigint, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector: str = "embedding",
    bits: int = BITS,
    block_rows: int = BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for every row with ``is_query``."""
    spark = prepare(df.sparkSession)
    rows = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("vec_id"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("vector").alias("dim")).count()
    common = lengths.orderBy(F.col("count").desc(), "dim").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    dim, n = common["dim"], common["count"]
    rows = stage(rows.where(F.size("vector") == dim), "vectors")
    share = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1_000_000)) < 1e6 * min(1.0, SAMPLE / n)
    sample = np.array([r["vector"] for r in rows.where(share).select("vector").collect()]).reshape(-1, dim)
    if len(sample) < 2:
        sample = np.array([r["vector"] for r in rows.limit(SAMPLE).select("vector").collect()])
    coder = Coder(sample, bits)
    radius = fit_radius(coder, sample, k, n) if len(sample) > 1 else bits
    queries = rows.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n // block_rows), min(tasks, -(-n // 2048)))
    groups = max(1, -(-queries.count() // QUERY_BLOCK))
    found = stage(_best(_search(rows, queries, blocks, groups, coder, dim, radius, k), k), "found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = stage(queries.join(full, "vec_id", "left_anti").select("vec_id", "vector"), "short")
    if not short.isEmpty():
        more = _best(_search(rows, short, blocks, groups, coder, dim, bits, k), k)
        whole = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
        found = whole.unionByName(more)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
