"""Greedy decisions along an order, taken in rounds on DataFrames in place of a walk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.runtime import checkpointed

MAX_ROUNDS = 10_000


def weaker_goes(pairs: DataFrame) -> DataFrame:
    """recording, node and by: the nodes that go, and the one that each lost to, when pairs (recording, i < j, snr_i, snr_j) are walked in the order of i
    and then j: a pair is passed over if i had gone before its first pair was reached, or if j has gone; else the weaker of the two
    goes (of equals j). A node that loses in its own turn goes on to meet its later partners, and is named by the last one.

    What a pair does depends on earlier pairs that have i or j as their second node, and on nothing else. So a round settles every pair
    whose i is the second of no open pair and is the first of j's open pairs; second nodes that lost take their open pairs with
    them. The open pairs are written each round and only shrink; there are as many rounds as the longest chain of pairs that
    wait for each other, and all recordings take theirs together."""
    key = ["recording", "i", "j"]
    open_pairs = pairs.select(*key, (F.col("snr_i") >= F.col("snr_j")).alias("first_stays")).distinct()
    settled = None
    for _ in range(MAX_ROUNDS):
        open_pairs = checkpointed(open_pairs)
        if open_pairs.isEmpty():
            break
        second = open_pairs.groupBy("recording", "j").agg(F.min("i").alias("first_i"))
        waits = second.select("recording", F.col("j").alias("i"), F.lit(True).alias("waits"))
        marked = open_pairs.join(second, ["recording", "j"]).join(waits, ["recording", "i"], "left")
        marked = checkpointed(marked.select(*key, "first_stays", (F.col("waits").isNull() & (F.col("i") == F.col("first_i"))).alias("ready")))
        done = marked.filter("ready").drop("ready")
        settled = done if settled is None else settled.unionByName(done)
        lost = done.filter("first_stays").select("recording", "j").distinct()
        open_pairs = marked.filter("not ready").drop("ready").join(lost, ["recording", "j"], "left_anti").join(lost.withColumnRenamed("j", "i"), ["recording", "i"], "left_anti")
    else:
        raise RuntimeError("greedy rounds did not end")
    if settled is None:
        return open_pairs.select("recording", F.col("i").alias("node"), F.col("j").alias("by"))
    loser = settled.select("recording", F.when(F.col("first_stays"), F.col("j")).otherwise(F.col("i")).alias("node"), F.when(F.col("first_stays"), F.col("i")).otherwise(F.col("j")).alias("by"))
    return loser.groupBy("recording", "node").agg(F.max("by").alias("by"))


def first_come(pairs: DataFrame) -> DataFrame:
    """recording, node and by: the nodes that go when nodes are taken in the order of their numbers and each that is kept removes its later
    neighbours. ``pairs``: recording, i < j."""
    return weaker_goes(pairs.select("recording", "i", "j", F.lit(0).alias("snr_i"), F.lit(0).alias("snr_j")))
