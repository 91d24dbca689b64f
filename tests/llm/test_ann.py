import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from buildup.llm import ann

VEC = "vec_id bigint, embedding array<float>, vector int, block int, query_id int"


def nearest(ids, vectors, queries, k=10):
    out = {}
    for i in queries:
        d = np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 2**16, (500, 4), dtype=np.uint16)
    codes[100:200] = codes[0] ^ (1 << rng.integers(0, 16, (100, 4))).astype(np.uint16)
    block = ann.Block(codes)
    for radius in (0, 3, 4, 11, 24, 30, 64):
        for i in (0, 150, 300):
            expected = np.flatnonzero(ann.hamming(codes, codes[i]) <= radius)
            assert np.array_equal(block.within(codes[i], radius), expected)


def test_codes_of_other_sizes():
    rng = np.random.default_rng(1)
    for dim in (2, 64, 200):
        coder = ann.Coder(rng.normal(size=(100, dim)), rounds=2)
        assert coder.codes(rng.normal(size=(5, dim))).shape == (5, ann.BITS // 16)


def awkward(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[50:120] = vectors[7]  # one common vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows[7] = (7, vectors[7].tolist())
    bad = [
        (1000, None), (1100, []), (1200, [0.0] * 8), (1300, [None] + [1.0] * 7), (1400, [float("nan")] + [1.0] * 7),
        (1500, [float("inf")] + [1.0] * 7), (1600, [1.0] * 3), (None, [1.0] * 8),
    ]
    repeated = [rows[0], rows[200]]
    data = [(*r, 1, 2, 3) for r in rows + bad + repeated]
    ids = np.array([r[0] for r in rows + repeated])
    return spark.createDataFrame(data, VEC).repartition(3), ids, np.array([r[1] for r in rows + repeated], float)


def test_awkward_rows(spark):
    df, ids, vectors = awkward(spark)
    got = result(ann.search(df, F.col("vec_id") % 100 == 0, k=10, block_rows=64))
    expected = nearest(ids, vectors, [0, 100, 200])
    assert got.keys() == expected.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in expected[q]}) for q in got)
    assert hits >= 0.9 * sum(map(len, expected.values()))
    for q, rows in got.items():
        scores = dict(nearest(ids, vectors, [q], len(ids))[q])
        assert all(s == pytest.approx(scores[v], abs=1e-12) for v, s in rows)
        assert rows == sorted(rows, key=lambda r: (r[1], r[0]))
    assert got[100] == expected[100]  # its ties are the smallest ids


def test_fewer_candidates_than_asked(spark):
    df, ids, vectors = awkward(spark)
    few = df.where("vec_id in (0, 1, 2, 1000)")
    got = result(ann.search(few, F.col("vec_id") == 0, k=10))
    assert [v for v, _ in got[0]] == [v for v, _ in nearest(ids[:3], vectors[:3], [0])[0]]


def test_empty(spark):
    df, _, _ = awkward(spark)
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_recall_of_the_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    got = result(entry_module.queries()["op10_nearest_neighbours"](spark, sf_dir))
    expected = nearest(ids, vectors, np.flatnonzero(ids % 100 == 0))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in rows}) for q, rows in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_queries_that_share_an_id_do_not_depend_on_partitions(spark):
    import random

    draw = random.Random(9)
    data = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    data += [(7, [draw.gauss(0, 1) for _ in range(8)]) for _ in range(4)]
    rows = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    own = min(v for i, v in data if i == 7)
    expected = sorted((sum((a - b) ** 2 for a, b in zip(v, own)) ** 0.5, i) for i, v in data if i != 7)[:5]
    for parts in (1, 2, 5, 11):
        out = ann.search(rows.repartition(parts), F.col("vec_id") == 7, k=5).orderBy("rank").collect()
        assert [r["vec_id"] for r in out] == [i for _, i in expected]
