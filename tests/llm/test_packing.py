import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from buildup.llm import packing
from buildup.session import new_table_path


def naive_rooms(sizes, length):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fit = [i for i, room in enumerate(rooms) if room >= size]
        if fit:
            best = min(fit, key=lambda i: rooms[i])
            rooms[best] -= size
        else:
            rooms.append(length - size)
    return sorted(rooms)


@pytest.mark.parametrize("length", [1, 7, 8, 64, 100])
def test_best_fit_decreasing(length):
    rng = random.Random(length)
    for _ in range(100):
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 60))]
        used = Counter()
        for row, size in zip(packing.best_fit(sizes, length), sizes):
            used[row] += size
        assert sorted(length - n for n in used.values()) == naive_rooms(sizes, length)


def documents():
    rng = random.Random(1)
    out = [(i, np.array([rng.randint(0, 60_000) for _ in range(rng.choice([0, 1, 5, 30, 32, 33, 64, 200]))])) for i in range(150)]
    return out + [(500, np.arange(5000)), (None, np.arange(7)), (None, np.arange(40)), (3, out[3][1]), (501, None)]


def frame(spark, width, data=None):
    data = documents() if data is None else data
    rows = [(i, None if a is None else bytearray(a.astype(f"<u{width}").tobytes()), 1, 2, 3) for i, a in data]
    return spark.createDataFrame(rows, "doc_id bigint, ids binary, shard int, row int, starts int").repartition(3)


@pytest.mark.parametrize("width,shard_bytes", [(2, 2000), (4, 1 << 25)])
def test_rows(spark, width, shard_bytes):
    packed = packing.pack(frame(spark, width), length=32, width=width, pad=9, shard_bytes=shard_bytes)
    path = new_table_path(spark, "packed")
    packing.write(packed, path)
    pieces = defaultdict(list)
    rows = packing.read(spark, path).collect()
    assert len({(r["shard"], r["row"]) for r in rows}) == len(rows)
    assert (len({r["shard"] for r in rows}) > 1) == (shard_bytes == 2000)
    for r in rows:
        line, places = np.frombuffer(r["ids"], f"<u{width}"), np.frombuffer(r["positions"], "<u2")
        assert len(line) == len(places) == 32 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        assert (line[r["n_tokens"] :] == 9).all() and not places[r["n_tokens"] :].any()
        for a, b, doc_id, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["starts"]):
            assert places[a:b].tolist() == list(range(b - a)) and b > a
            pieces[doc_id].append((start, line[a:b].tolist()))
    expected = Counter()
    for doc_id, ids in documents():
        for at in range(0, 0 if ids is None else len(ids), 32):
            expected[doc_id, at, tuple(ids[at : at + 32].tolist())] += 1
    assert Counter((d, s, tuple(i)) for d, own in pieces.items() for s, i in own) == expected


def test_round_trip(spark):
    once = {i: a for i, a in documents() if i not in (None, 3) and a is not None and len(a)}
    packed = packing.pack(frame(spark, 4), length=64)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.unpack(packed).where("doc_id <> 3").collect()}
    assert got == {i: a.tolist() for i, a in once.items()}


def test_empty(spark):
    assert packing.pack(frame(spark, 4).limit(0)).count() == 0
    assert packing.pack(frame(spark, 4, [(1, np.arange(0))])).count() == 0


def test_query_holds_every_token(spark, sf_dir):
    found = entry_module.queries()["op3_token_packing"](spark, sf_dir)
    tokens = entry_module.queries()["op6_bpe"](spark, sf_dir).where("n_tokens > 0").select("doc_id", "n_tokens")
    piece = F.explode(F.expr("sequence(0, size(doc_ids) - 1)"))
    pieces = found.select("doc_ids", "starts", "cu_seqlens", piece.alias("i")).selectExpr(
        "doc_ids[i] as doc_id", "starts[i] as start", "cu_seqlens[i + 1] - cu_seqlens[i] as n"
    )
    got = pieces.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max(F.col("start") + F.col("n")).alias("end"))
    assert {tuple(r) for r in got.select("doc_id", "n").collect()} == {tuple(r) for r in tokens.collect()}
    assert got.where("n <> end").count() == 0
