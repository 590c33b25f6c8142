"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.llm.common import checkpointed

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """``links``: columns a, b (long). Returns (node, component) for every node of a link; component is the smallest node
    that can be reached. Each round keeps at most as many links as there were; a node with very many links is one key of
    a join that adaptive execution can split, and of minima that are taken before the shuffle. The rounds are about the
    logarithm of the longest path. Links with a null end, and links of a node to itself, are left out; without links there are
    no rows; should the links not settle within ``MAX_ROUNDS`` rounds, enough for any path of 2^60 links, it is an error."""
    links = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        links = checkpointed(small.distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
