import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from buildup.llm import merkle
from tests.llm.conftest import DOC, bag, rows

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def tree(leaves):
    """The root, and for every leaf its proof as (sibling, whether it is on the left)."""
    proofs, nodes, below = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        for i, members in enumerate(below):
            sibling = nodes[i ^ 1] if i ^ 1 < len(nodes) else None
            for m in members:
                proofs[m].append((sibling, i % 2 == 1))
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        below = [sum(below[i : i + 2], []) for i in range(0, len(below), 2)]
    return nodes[0], proofs


def brute(data):
    parts = defaultdict(list)
    for row in data:
        parts[row[2]].append(((row[0] is not None, row[0] or 0), leaf(row), row[0]))
    names = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {p: (sorted(parts[p]), *tree([m[1] for m in sorted(parts[p])])) for p in names}
    root, above = tree([trees[p][1] for p in names])
    out = []
    for p, proof in zip(names, above):
        members, subroot, proofs = trees[p]
        for (_, own, doc_id), inside in zip(members, proofs):
            out.append((doc_id, own, subroot, root, inside + proof))
    return sorted(out, key=repr)


def found(df, **kw):
    rows = merkle.manifest(df, "lang", "doc_id", FIELDS, **kw)
    rows = rows.select("row.doc_id", "leaf", "subroot", "root", "proof").collect()
    return sorted([(*r[:4], [(s[0], s[1]) for s in r[4]]) for r in rows], key=repr)


@pytest.mark.parametrize("digits", [1, 2, 10])
def test_equals_brute_force(clashing, digits):
    """With one or two digits a block, the trees have several tiers of blocks."""
    assert found(clashing, digits=digits) == brute(rows())


def test_many_parts(spark):
    data = [(i, f"t{i}", f"lang {i % 37}" if i % 37 else None, "s", 3) for i in range(150)] + [(7, "ä", "é", None, None)]
    assert found(spark.createDataFrame(data, DOC).repartition(5), digits=2) == brute(data)


def test_one_row_and_equal_rows(spark):
    one = [(1, "only", "en", "s", 4)]
    assert found(spark.createDataFrame(one, DOC)) == brute(one)
    same = one * 9 + [(None, "only", "en", "s", 4)] * 5
    assert found(spark.createDataFrame(same, DOC).repartition(4), digits=1) == brute(same)


def test_empty(empty):
    assert merkle.manifest(empty, "lang", "doc_id", FIELDS).count() == 0


def test_only_changed_rows_fail(spark, docs):
    longer = F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = merkle.manifest(docs, "lang", "doc_id", FIELDS, {"n_chars": longer}, digits=2)
    out = out.withColumn("right", merkle.fold(F.col("changed_leaf"), F.col("proof")) == F.col("root"))
    changed = {r[0] for r in rows() if r[0] is not None and r[0] % 5 == 0 and r[4] is not None}
    assert bag(out, "row.doc_id", "right") == sorted([(r[0], r[0] not in changed) for r in rows()], key=repr)
    assert out.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_a_hot_part_is_spread(spark):
    """Equal rows of one part get consecutive ranks although they lie in several tasks."""
    rows = spark.range(20_000).select(F.lit(None).cast("string").alias("part"), F.lit("x").alias("h"))
    out = merkle.ranked(rows.repartition(7), ["h"]).agg(
        F.min("rank"), F.max("rank"), F.count_distinct("rank"), F.min("total"), F.max("total")
    )
    assert tuple(out.first()) == (0, 19_999, 20_000, 20_000, 20_000)


def test_query_equals_sql_on_awkward_rows(spark, tmp_path):
    spark.createDataFrame(rows(), DOC).coalesce(1).write.parquet(f"{tmp_path}/in/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/in/documents.parquet/*.parquet')")
    expected = con.execute(entry_module.oracle_sql()["op13_merkle_manifest"])
    names = [d[0] for d in expected.description]
    own = entry_module.queries()["op13_merkle_manifest"](spark, f"{tmp_path}/in")
    assert bag(own, *names) == sorted(expected.fetchall(), key=repr)
