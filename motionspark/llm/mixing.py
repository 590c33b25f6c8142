"""Operator 3: mixing sources to target weights by Poisson replication.

A source of n documents and target weight w gets the rate ``w * target rows / n``. Each document draws a uniform number
from a hash of its id and the seed, and the inverse of the Poisson distribution with its source's rate turns it into a
number of copies; the copies are shuffled globally by another hash. The same seed gives the same corpus, whatever the
partitions. Only DataFrame functions are used. A rate above ``PART_RATE`` is split into equal parts of at most that, each
drawn from its own hash: a Poisson number is the sum of independent ones whose rates add up to its own. So no rate is
limited, and the probabilities of a source stay a short list.

The only table that is joined has one row a source with its cumulative probabilities. Its size is counted: up to
``BROADCAST_NUMBERS`` probabilities it is broadcast, so the documents of one source, even a third of all, stay where they
were read; beyond that it is joined by a shuffle that adaptive execution splits.

Edge cases: a null source is a source of its own; a source without a given weight gets none (no copies) if weights are
given, else all sources weigh the same; a weight for a source that the table lacks is left out, and the others share the
whole; a null doc_id hashes as an empty id; repeated rows draw alike; an empty table
gives no rows. Columns named source_rate, copies, copy or shuffle_key in the input are replaced; all others stay, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionspark.llm.common import fresh

#: Probabilities in the joined table up to which it is broadcast (8 bytes each); a larger one is joined by shuffle.
BROADCAST_NUMBERS = 1_000_000
#: Largest rate that is drawn at once; a larger one is drawn in parts.
PART_RATE = 1000.0
#: Copies of a row that are listed at once.
COPY_BLOCK = 1000
OWN = ("source_rate", "copies", "copy", "shuffle_key")


def uniform(*parts) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, target_rows: int | None, source_col: str) -> DataFrame:
    counts = docs.groupBy(F.col(source_col).alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.lit(1.0))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
        weighed = counts.withColumn("w", F.coalesce(given[F.col("mix_source").cast("string")].cast("double"), F.lit(0.0)))
    rows, all_weight = weighed.agg(F.sum("n"), F.sum("w")).first()  # one row
    if not rows or not all_weight:
        return weighed.limit(0).select("mix_source", F.lit(0.0).alias("source_rate"))
    rate = F.col("w") / F.lit(float(all_weight)) * F.lit(float(rows if target_rows is None else target_rows)) / F.col("n")
    return weighed.select("mix_source", F.round(rate, 9).alias("source_rate"))


def last_count(rate: Column) -> Column:
    """A count beyond which nothing is left of the distribution."""
    return F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until nothing is left, as an array rounded to 12 places."""
    steps = F.sequence(F.lit(0), last_count(rate))

    def step(acc, k):
        log_p = F.when(k == 0, -rate).otherwise(acc["log_p"] + F.ln(rate) - F.ln(F.greatest(k, F.lit(1)).cast("double")))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["cdf"], F.array(F.round(total, 12))).alias("cdf"))

    start = F.struct(F.lit(0.0).alias("log_p"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("cdf"))
    return F.aggregate(steps, start, step, lambda acc: acc["cdf"])


def draws(source: Column, seed: str, id_col: str) -> Column:
    """The copies of a row: one draw, or the sum of one draw a part with the part's number in its hash."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    more = F.transform(F.sequence(F.lit(1).cast("long"), source["parts"]), lambda i: uniform(F.lit(seed), key, i, F.lit("part")))
    us = F.when(source["parts"] == 1, F.array(uniform(F.lit(seed), key))).otherwise(more)
    return F.aggregate(us, F.lit(0), lambda acc, u: acc + F.size(F.filter(source["cdf"], lambda p: p <= u)))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", shuffle: bool = True) -> DataFrame:
    """``docs`` with each row repeated: source_rate, copies, copy (from 0) and shuffle_key are added. Rows of a partition
    follow the shuffle key, and partitions are dealt by it, so the files hold a random order of all copies."""
    docs = docs.drop(*OWN)
    table = rates(docs, weights, target_rows, source_col).filter("source_rate > 0")
    table = table.withColumn("parts", F.ceil(F.col("source_rate") / F.lit(PART_RATE)).cast("long"))
    part_rate = F.col("source_rate") / F.col("parts")
    numbers = table.agg(F.sum(last_count(part_rate) + 2)).first()[0] or 0
    name, drawing = fresh("mix_source", docs), fresh("mix_drawing", docs)
    table = table.select(F.col("mix_source").alias(name), F.struct("source_rate", "parts", cumulative(part_rate).alias("cdf")).alias(drawing))
    table = F.broadcast(table) if numbers <= BROADCAST_NUMBERS else table
    drawn = docs.join(table, F.col(source_col).eqNullSafe(F.col(name)))
    drawn = drawn.select(*docs.columns, F.col(drawing)["source_rate"].alias("source_rate"), draws(F.col(drawing), seed, id_col).alias("copies")).filter("copies > 0")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPY_BLOCK))))
    drawn = drawn.withColumn("copy", F.explode(F.sequence("copy", F.least(F.col("copy") + (COPY_BLOCK - 1), F.col("copies") - 1))))
    drawn = drawn.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), key, F.col("copy"), F.lit("order"))))
    return drawn.repartition("shuffle_key").sortWithinPartitions("shuffle_key") if shuffle else drawn
