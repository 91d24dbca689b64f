"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildup.session import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    larger = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    return (
        larger.join(least.withColumnRenamed("a", "u"), "u")
        .select(F.col("m").alias("a"), F.col("v").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    rest = (
        links.join(least, "b")
        .where("a <> m")
        .select(F.col("m").alias("a"), F.col("a").alias("b"))
    )
    return rest.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``links(a, b)`` with a < b; root is the smallest node reachable.

    Each step groups by a node only with a minimum, and joins; no neighbour list
    is collected. The steps end when the table no longer changes, which is
    certain to happen, after about log(n) rounds. Each round is written to the
    shared folder.
    """
    spark = links.sparkSession
    links = stage(links.distinct(), "links")
    state = _state(links)
    while state[0]:
        stars = stage(_small_star(stage(_large_star(links), "links")), "links")
        after = _state(stars)
        links = stars
        if after == state:
            break
        state = after
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    ) if state[0] else spark.createDataFrame([], "node bigint, root bigint")


def _state(links: DataFrame) -> tuple:
    """Row count and order-free digest of a link table."""
    row = links.agg(
        F.count("*").alias("n"),
        F.sum((F.xxhash64("a", "b") / 2**24).cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]
