"""Packing of token ids into rows of one length, by best fit decreasing.

Documents are dealt to shards by a hash, and each shard is packed by itself, so that the work grows with the
number of shards and a row holds documents of one shard. A document longer than a row fills whole rows
first; what remains is one piece. Pieces are placed from the longest to the shortest, each into the row with the
least room that still holds it; a segment tree over the room finds that row. Nothing is cut off: the
pieces of a document, put together by ``starts``, are the document.

A packed row is ``(shard, row, n_tokens, ids, positions, cu_seqlens, doc_ids, starts)``: ``ids`` is the row of the id
matrix, unused places hold ``pad``; ``positions`` counts from zero in each piece (zero in unused places);
``cu_seqlens`` are the cumulative piece lengths from 0 on; ``doc_ids`` and ``starts`` say what each piece is. Ids
and positions are little-endian unsigned integers of ``width`` and 4 bytes or, for rows that allow it, 2.

Defined cases: documents without ids take no place; null ids of documents are kept; repeated rows are packed as
often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildup.llm.common import prepare

LENGTH = 2048
SHARD_BYTES = 32 << 20  # of packed ids in a shard, on average


class Rooms:
    """Open rows by the room they have left; a segment tree finds the least room that is enough."""

    def __init__(self, length: int):
        self.size = 1 << (length + 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, change: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += change
            node >>= 1

    def put(self, row: int, room: int) -> None:
        if room:
            self.rows[room].append(row)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """An open row with the least room of at least ``need``, and that room."""
        node = need + self.size
        if not self.tree[node]:
            # up until a right neighbour has rows, then down to its leftmost one
            while node > 1 and (node & 1 or not self.tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(sizes, length: int) -> list[int]:
    """The row of each piece, for sizes of 1 to ``length`` in any order."""
    rooms, rows, count = Rooms(length), [0] * len(sizes), 0
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[piece])
        if found is None:
            found = count, length
            count += 1
        rows[piece] = found[0]
        rooms.put(found[0], found[1] - sizes[piece])
    return rows


def pack_shard(documents: list[np.ndarray], length: int) -> list[list[tuple[int, int, int]]]:
    """Rows of ``(document, start, end)`` pieces."""
    rows, rest = [], []
    for i, ids in enumerate(documents):
        whole = len(ids) // length * length
        rows += [[(i, at, at + length)] for at in range(0, whole, length)]
        if whole < len(ids):
            rest.append((i, whole, len(ids)))
    placed = best_fit([end - start for _, start, end in rest], length)
    packed: list[list[tuple[int, int, int]]] = [[] for _ in range(max(placed, default=-1) + 1)]
    for piece, row in zip(rest, placed):
        packed[row].append(piece)
    return rows + packed


_PACKED = (
    "shard int, row int, n_tokens int, ids binary, positions binary, "
    "cu_seqlens array<int>, doc_ids array<bigint>, starts array<bigint>"
)


def pack(
    df: DataFrame,
    length: int = LENGTH,
    width: int = 4,
    pad: int = 0,
    shard_bytes: int = SHARD_BYTES,
    total_bytes: int | None = None,
    id_col: str = "doc_id",
    ids: str = "ids",
) -> DataFrame:
    """Packed rows of documents with packed little-endian ids of ``width`` bytes.

    ``total_bytes`` is about the size of all ids; if it is not known, they are counted first.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{ids}`").alias("ids"))
    if total_bytes is None:
        total_bytes = rows.agg(F.sum(F.octet_length("ids").cast("bigint"))).first()[0] or 0
    shards = max(1, -(-total_bytes // shard_bytes))
    shard = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)).cast("int")
    kind, place = f"<u{width}", "<u2" if length <= 65_536 else "<u4"

    def run(group: pa.Table) -> pa.Table:
        # empty ids are left out here: a filter before the shuffle would make Spark compute the ids twice
        group = group.filter(pc.greater(pc.binary_length(group["ids"]), 0))
        keys, values = group["doc_id"].to_pylist(), group["ids"].to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0, values[i]))
        keys = [keys[i] for i in order]
        documents = [np.frombuffer(values[i], kind) for i in order]
        out = {name.split()[0]: [] for name in _PACKED.split(", ")}
        shard = group["shard"][0].as_py() if keys else None
        for number, pieces in enumerate(pack_shard(documents, length)):
            line, position = np.full(length, pad, kind), np.zeros(length, place)
            ends = np.cumsum([end - start for _, start, end in pieces])
            for (i, start, end), stop in zip(pieces, ends):
                line[stop - (end - start) : stop] = documents[i][start:end]
                position[stop - (end - start) : stop] = np.arange(end - start)
            out["shard"].append(shard)
            out["row"].append(number)
            out["n_tokens"].append(int(ends[-1]))
            out["ids"].append(line.tobytes())
            out["positions"].append(position.tobytes())
            out["cu_seqlens"].append([0, *ends.tolist()])
            out["doc_ids"].append([keys[i] for i, _, _ in pieces])
            out["starts"].append([start for _, start, _ in pieces])
        schema = pa.schema(
            [
                ("shard", pa.int32()),
                ("row", pa.int32()),
                ("n_tokens", pa.int32()),
                ("ids", pa.binary()),
                ("positions", pa.binary()),
                ("cu_seqlens", pa.list_(pa.int32())),
                ("doc_ids", pa.list_(pa.int64())),
                ("starts", pa.list_(pa.int64())),
            ]
        )
        return pa.table(out, schema=schema)

    return rows.withColumn("shard", shard).groupBy("shard").applyInArrow(run, _PACKED)


def write(packed: DataFrame, path: str) -> None:
    """Store packed rows; one file a task, rows of equal length in binary columns."""
    packed.write.option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    return spark.read.schema(_PACKED).parquet(path)


def unpack(packed: DataFrame, width: int = 4) -> DataFrame:
    """``(doc_id, ids)`` of every packed document whose id is not null and occurs once."""
    piece = F.expr("sequence(0, size(doc_ids) - 1)")
    parts = packed.select("ids", "cu_seqlens", "doc_ids", "starts", F.explode(piece).alias("i")).select(
        F.expr("doc_ids[i]").alias("doc_id"),
        F.expr("starts[i]").alias("start"),
        F.expr(f"substring(ids, cu_seqlens[i] * {width} + 1, (cu_seqlens[i + 1] - cu_seqlens[i]) * {width})").alias(
            "part"
        ),
    )
    whole = parts.where("doc_id is not null").groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts")
    )
    return whole.select("doc_id", F.expr("aggregate(parts, x'', (a, p) -> concat(a, p.part))").alias("ids"))
