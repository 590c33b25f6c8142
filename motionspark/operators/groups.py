"""Comparison of two groups: ranks, effect sizes, tests, corrections and resampling.

``long`` has metric, condition (two values), sample and value. Ranks and percentiles never put a whole metric in one task:
values are counted first, dealt into ordered slices of about as many different values each (bounds by approximate
percentiles, so an outlier moves none), and each slice gets the total before it. Resampling is dealt the same way: a
replicate first draws how many of its values come from each slice, and the slices draw them in tasks of their own.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionspark.functions import special
from motionspark.functions.stats import sample_std
from motionspark.runtime import checkpointed, dealt_out, ship_package

#: Slices of a key at least and at most, and different values that one is meant for.
SLICES, MOST_SLICES, SLICE_ROWS = 32, 4096, 100_000


def running_counts(counted: DataFrame, keys: list[str], order: str, columns: list[str], written: bool = False) -> DataFrame:
    """``counted`` with ``<column>_upto``: the sum of the column over all rows of the key up to the row's value. ``counted``
    has one row for each key and value; it is written once, unless it is ``written``, and the largest key's number of values sets the
    number of slices."""
    counted = counted if written else checkpointed(counted)
    most = counted.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    slices = min(MOST_SLICES, max(SLICES, -(-most // SLICE_ROWS)))
    cuts = [k / slices for k in range(1, slices)]
    bounds = counted.groupBy(*keys).agg(F.percentile_approx(order, cuts, max(1000, 10 * slices)).alias("_bounds"))
    stride = math.isqrt(slices)  # a value is compared with every so many bounds first, and then with those between two of them
    bounds = bounds.withColumn("_coarse", F.filter("_bounds", lambda b, i: (i + 1) % stride == 0))
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.col(order)))
    dealt = counted.join(bounds, keys).withColumn("_first", below("_coarse") * stride)
    dealt = dealt.withColumn("_slice", F.col("_first") + below(F.slice("_bounds", F.col("_first") + 1, F.lit(stride)))).drop("_bounds", "_coarse", "_first")
    totals = dealt.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_slice", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(totals, [*keys, "_slice"])
    return joined.select(*counted.columns, *[(F.sum(c).over(inside) + F.col(f"_b_{c}")).alias(f"{c}_upto") for c in columns])


def counted_values(long: DataFrame) -> DataFrame:
    """metric, condition, value and n: how often each known value comes. Written once, for what asks for several statistics."""
    return checkpointed(long.filter("value is not null").groupBy("metric", "condition", "value").agg(F.count("*").alias("n")))


def counted_moments(counted: DataFrame) -> DataFrame:
    """n, mean and variance of each metric and condition of ``counted_values``."""
    n, keys = F.col("n"), ["metric", "condition"]
    means = counted.groupBy(*keys).agg((F.sum(n * F.col("value")) / F.sum(n)).alias("mean"))
    gap = F.col("value") - F.col("mean")
    got = counted.join(F.broadcast(means), keys).groupBy(*keys, "mean").agg(F.sum("n").alias("n"), F.sum(n * gap * gap).alias("_ss"))
    return got.select(*keys, "n", "mean", F.when(n == 1, 0.0).otherwise(F.try_divide("_ss", n - 1)).alias("var"))


def percentiles(long: DataFrame, keys: list[str], wanted: dict[str, float], value: str = "value", times: str | None = None) -> DataFrame:
    """Percentiles at midpoint positions for each key, from counts of different values; a row stands for ``times`` values."""
    counted = checkpointed(long.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(times) if times else F.count("*")).alias("_n")))
    upto = running_counts(counted, keys, value, ["_n"], written=True)
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    both = upto.join(sizes, keys)
    place = lambda p: F.greatest(F.lit(1.0), F.least(F.col("_all").cast("double"), F.col("_all") * F.lit(p / 100) + 0.5))
    at = lambda r: F.min(F.when(F.col("_n_upto") >= r, F.col(value)))
    got = both.groupBy(*keys, "_all").agg(*[c for k, p in wanted.items() for c in (at(F.floor(place(p))).alias(f"_a_{k}"), at(F.least(F.floor(place(p)) + 1, F.col("_all"))).alias(f"_b_{k}"))])
    return got.select(*keys, *[(F.col(f"_a_{k}") + (place(p) - F.floor(place(p))) * (F.col(f"_b_{k}") - F.col(f"_a_{k}"))).alias(k) for k, p in wanted.items()])


def describe(long: DataFrame, counted: bool = False) -> DataFrame:
    """n, mean, median, sd, sem and iqr of each metric and condition; ``long`` may be ``counted`` values."""
    known = long.filter("value is not null")
    if counted:
        moments = counted_moments(long).withColumn("sd", F.sqrt("var")).drop("var")
    else:
        moments = known.groupBy("metric", "condition").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), sample_std(F.col("value")).alias("sd"))
    pct = percentiles(known, ["metric", "condition"], {"q1": 25, "median": 50, "q3": 75}, times="n" if counted else None)
    return moments.join(pct, ["metric", "condition"]).select("metric", "condition", "n", "mean", "median", "sd", (F.col("sd") / F.sqrt(F.col("n").cast("double"))).alias("sem"), (F.col("q3") - F.col("q1")).alias("iqr"))


def moments(long: DataFrame, first: str, second: str, counted: bool = False) -> DataFrame:
    """n1, m1, v1, n2, m2, v2 of each metric: count, mean and variance of the two conditions; ``long`` may be ``counted`` values."""
    if counted:
        of = lambda c, name: F.max(F.when(F.col("condition") == name, F.col(c)))
        n = lambda name: F.coalesce(of("n", name), F.lit(0))
        return counted_moments(long).groupBy("metric").agg(n(first).alias("n1"), of("mean", first).alias("m1"), of("var", first).alias("v1"), n(second).alias("n2"), of("mean", second).alias("m2"), of("var", second).alias("v2"))
    x = lambda c: F.when(F.col("condition") == c, F.col("value"))
    spread = lambda c: F.coalesce(F.var_samp(x(c)), F.when(F.count(x(c)) == 1, 0.0))
    return long.groupBy("metric").agg(F.count(x(first)).alias("n1"), F.avg(x(first)).alias("m1"), spread(first).alias("v1"), F.count(x(second)).alias("n2"), F.avg(x(second)).alias("m2"), spread(second).alias("v2"))


def welch_t(m: DataFrame) -> DataFrame:
    """t (second minus first), degrees of freedom and two-sided p; without spread p is 1."""
    ship_package(m.sparkSession)

    @F.pandas_udf("double")
    def p_of(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([1.0 if np.isnan(a) else special.t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")

    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = F.when(a + b > 0, (F.col("m2") - F.col("m1")) / F.sqrt(a + b))
    df = F.when(a + b > 0, (a + b) * (a + b) / (a * a / F.greatest(F.lit(1), F.col("n1") - 1) + b * b / F.greatest(F.lit(1), F.col("n2") - 1)))
    return m.select("metric", t.alias("t"), df.alias("df")).withColumn("p", p_of("t", "df"))


def hedges_g(m: DataFrame) -> DataFrame:
    """Bias-corrected standardised difference, and its label."""
    n = F.col("n1") + F.col("n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (n - 2))
    g = F.try_divide(F.col("m2") - F.col("m1"), pooled) * (1 - 3 / (4 * n - 9))
    return m.select("metric", g.alias("g"), effect_label(g).alias("effect"))


def effect_label(g: Column) -> Column:
    size = F.abs(g)
    return F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").when(size.isNotNull(), "large")


def cohens_d(m: DataFrame) -> DataFrame:
    """First minus second over the pooled spread; 0 without spread."""
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return m.select("metric", F.when(pooled > 0, (F.col("m1") - F.col("m2")) / pooled).otherwise(0.0).alias("cohens_d"))


def rank_sums(long: DataFrame, first: str, second: str, counted: bool = False) -> DataFrame:
    """n1, n2, U of the first condition and the tie term of each metric, from counts of different values; of small metrics
    also the sizes of their blocks of equal values in order (``blocks``). ``long`` may be ``counted`` values."""
    times = F.col("n") if counted else F.lit(1)
    x = lambda c: F.sum(F.when(F.col("condition") == c, times).otherwise(0)).cast("long")
    counted = checkpointed(long.filter(F.col("value").isNotNull()).groupBy("metric", "value").agg(x(first).alias("a"), x(second).alias("b")))
    upto = running_counts(counted, ["metric"], "value", ["b"], written=True)
    t = (F.col("a") + F.col("b")).cast("double")
    whole = upto.groupBy("metric").agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * (F.col("b_upto") - F.col("b") / 2.0)).alias("u"), F.sum(t * t * t - t).alias("ties"))
    small = whole.filter(F.col("n1") + F.col("n2") <= EXACT_VALUES).select("metric")
    blocks = counted.join(small, "metric", "left_semi").filter("a + b > 0").groupBy("metric").agg(F.transform(F.array_sort(F.collect_list(F.struct("value", (F.col("a") + F.col("b")).alias("n")))), lambda s: s["n"]).alias("blocks"))
    return whole.join(blocks, "metric", "left")


#: Values of both groups together up to which their blocks of ties are gathered, for an exact rank test.
EXACT_VALUES = 40


def exact_if_both_below(limit: int):
    """The exact test when both groups are smaller than ``limit``, as the two-condition stage asks for."""
    return lambda n1, n2: n1 < limit and n2 < limit


def exact_if_small(n1: float, n2: float) -> bool:
    """The exact test of a plain rank-sum call: the smaller group below 10 and both together below 20."""
    return min(n1, n2) < 10 and n1 + n2 < 20


def mann_whitney(ranks: DataFrame, exact=exact_if_both_below(20)) -> DataFrame:
    """U, z and two-sided p: where ``exact`` of the two sizes holds by the exact distribution, tied or not, else normal with tie
    and continuity corrections."""
    ship_package(ranks.sparkSession)

    @F.pandas_udf("double")
    def p_of(u: pd.Series, n1: pd.Series, n2: pd.Series, blocks: pd.Series, z: pd.Series) -> pd.Series:
        rows = zip(u, n1, n2, blocks, z, strict=True)
        return pd.Series([special.rank_sum_exact(a, int(n), [int(t) for t in b]) if b is not None and n and m and exact(n, m) else min(1.0, 2 * special.normal_cdf(-abs(s))) for a, n, m, b, s in rows], dtype="float64")

    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, gap = n1 + n2, F.col("u") - n1 * n2 / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / F.greatest(F.lit(1.0), n * (n - 1))))
    z = F.coalesce(F.try_divide(F.signum(gap) * F.greatest(F.lit(0.0), F.abs(gap) - 0.5), spread), F.lit(0.0))
    return ranks.select("metric", "n1", "n2", "u", "blocks", z.alias("z")).withColumn("p", p_of("u", "n1", "n2", "blocks", "z")).drop("blocks")


def cliffs_delta(ranks: DataFrame) -> DataFrame:
    """Delta = 2U/(n1 n2) - 1, the probability index and the label."""
    delta = 2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1
    size = F.abs(delta)
    label = F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")
    return ranks.select("metric", delta.alias("delta"), ((1 + delta) / 2).alias("probability"), label.alias("effect"))


def fdr_bh(tests: DataFrame, p: str = "p") -> DataFrame:
    """``q``: Benjamini-Hochberg. A missing p counts as 1 among the tests and stays missing. Tests are few."""
    filled = F.coalesce(F.col(p), F.lit(1.0))
    every = Window.partitionBy()
    m = F.count("*").over(every)
    ranked = tests.withColumn("_p", filled).withColumn("_q", F.col("_p") * m / F.row_number().over(Window.orderBy("_p", "metric")))
    least = F.min("_q").over(Window.orderBy(F.desc("_p"), F.desc("metric")).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("_p", "_q")


def bonferroni(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Corrected p, the corrected limit, and the stars of p itself where it is below that limit. Every listed test counts, also
    one that has no p for want of data."""
    m = F.count("*").over(Window.partitionBy())
    corrected = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * m))
    raw = F.col(p)
    stars = F.when(raw.isNull() | (raw >= alpha / m), "n.s.").when(raw < 0.001, "***").when(raw < 0.01, "**").when(raw < 0.05, "*").otherwise("n.s.")
    return tests.withColumns({"p_bonferroni": corrected, "alpha_bonferroni": alpha / m, "stars": stars})


def steady_sum(value: Column) -> Column:
    """The sum of known values, whatever the order that tasks add them in: whole 2^-20ths and what is left of them are added apart, both
    without rounding while the sum is below 2^33 and there are less than 2^22 values of 1 or more."""
    whole = F.rint(value * 2.0**20) / 2.0**20
    return F.sum(whole) + F.sum(F.when(F.abs(value) < 2.0**32, value - whole).otherwise(0.0))


def sample_means(long: DataFrame) -> DataFrame:
    """n and mean of each sample; samples of the same values have the same mean, to the last bit, so they tie in ranks."""
    n, value = F.count("*"), F.col("value").cast("double")
    return long.filter("value is not null").groupBy("metric", "condition", "sample").agg(n.alias("n"), (steady_sum(value) / n).alias("mean"))


#: Different values of a slice that one task draws from, slices of a block, replicates that are dealt together, and replicates whose
#: numbers are held at once for a slice.
SLICE_VALUES, BLOCK_SLICES, CHUNK, HELD = 1000, 256, 500, 50

#: Draws a different value from which counting the draws of each value is quicker than drawing one by one.
DRAWS_A_VALUE = 12


def stable_hash(*parts) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode())


def drawn_counts(rng, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """[replicates, parts]: how many of ``k`` draws with replacement fall to each part, which has ``n`` values."""
    total, shape = n.sum(), (len(k), len(n))
    if not total:
        return np.zeros(shape, np.int64)
    if max(total, k.mean()) > DRAWS_A_VALUE * len(n) or total > 2**16:
        return rng.multinomial(k, n / total)
    place = np.repeat(np.arange(len(n)), n)[rng.integers(0, total, k.sum(), dtype=np.uint16)]
    return np.bincount(place + np.repeat(np.arange(len(k)) * len(n), k), minlength=len(k) * len(n)).reshape(shape)


def shared_out(rng, k1: np.ndarray, k2: np.ndarray, a: np.ndarray, b: np.ndarray, shuffle_labels: bool) -> tuple[np.ndarray, np.ndarray]:
    """[replicates, parts]: how many of each replicate's ``k1`` and ``k2`` draws fall to each part, of which ``a`` and ``b`` values are
    of the two conditions."""
    if shuffle_labels:
        method = "count" if (a + b).sum() <= DRAWS_A_VALUE * len(a) else "marginals"
        c1 = np.array([rng.multivariate_hypergeometric(a + b, k, method=method) for k in k1])
        return c1, a + b - c1
    return drawn_counts(rng, k1, a), drawn_counts(rng, k2, b)


def slice_sums(rng, x: np.ndarray, a: np.ndarray, b: np.ndarray, k1: np.ndarray, k2: np.ndarray, shuffle_labels: bool, pairs: bool) -> np.ndarray:
    """[3, replicates]: the sums of both conditions' draws from the values ``x`` of a slice and, with ``pairs``, the pairs in which the
    first is greater, ties as halves. ``HELD`` replicates are drawn at a time, so their numbers stay in the processor's cache."""
    out = np.zeros((3, len(k1)))
    for i in range(0, len(k1), HELD):
        c1, c2 = (c.astype(float) for c in shared_out(rng, k1[i : i + HELD], k2[i : i + HELD], a, b, shuffle_labels))
        out[0, i : i + HELD], out[1, i : i + HELD] = c1 @ x, c2 @ x
        if pairs:
            out[2, i : i + HELD] = np.einsum("ij,ij->i", c1, np.cumsum(c2, axis=1) - c2 / 2)
    return out


def value_slices(means: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """metric, block, slice, x, xa and xb (its different values and how often each condition has them), a and b of each slice of
    ``SLICE_VALUES`` different values. A row stands for ``n`` values if ``means`` has that column."""
    n = F.col("n") if value != "mean" and "n" in means.columns else F.lit(1)
    of = lambda c: F.sum(F.when(F.col("condition") == c, n).otherwise(0)).cast("long")
    known = means.filter(F.col(value).isNotNull() & F.col("condition").isin(first, second))
    counted = known.groupBy("metric", F.col(value).cast("double").alias("value")).agg(of(first).alias("a"), of(second).alias("b")).withColumn("one", F.lit(1))
    placed = running_counts(counted, ["metric"], "value", ["one"]).withColumn("slice", F.floor((F.col("one_upto") - 1) / SLICE_VALUES).cast("int"))
    slices = placed.groupBy("metric", "slice").agg(F.array_sort(F.collect_list(F.struct("value", "a", "b"))).alias("items"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    of_items = lambda c: F.transform("items", lambda i: i[c])
    slices = slices.select("metric", "slice", of_items("value").alias("x"), of_items("a").alias("xa"), of_items("b").alias("xb"), "a", "b")
    return checkpointed(slices.withColumn("block", F.floor(F.col("slice") / BLOCK_SLICES).cast("int")))


def replicate_sums(means: DataFrame, first: str, second: str, replicates: int, seed: int, shuffle_labels: bool = False, value: str = "mean", times: DataFrame | None = None, pairs: bool = True, added: bool = False) -> DataFrame:
    """metric, replicate, slice and, of what a replicate drew there, w1 and s1 (number and sum for the first condition), w2
    and s2 (for the second) and u (pairs in which the first is greater, ties as halves). Values are drawn with
    replacement within their condition, or, with ``shuffle_labels``, the conditions are dealt anew. Each metric's values
    are counted and dealt into slices of ``SLICE_VALUES`` different ones, and slices into blocks of ``BLOCK_SLICES``; a replicate's
    draws are shared out among the blocks, those of a block among its slices, and those of a slice among its values, each
    in tasks of their own (multinomial or hypergeometric), which together is the same as drawing from all values. No task
    holds more than one block's numbers at a time. Replicates have their own seeds, whatever the partitions. With ``added`` a task
    adds its slices, and the result has metric, replicate, w1, s1, w2, s2 and u, which are still to be summed; u then counts all pairs
    with the first in the task's slices (0 without ``pairs``), for a slice is sent with the draws of the second that lie below it.

    ``times`` (metric, chunk, times: an array over the chunk's replicates) says how many times over a replicate draws as many
    values as the metric has, in place of once. Then the result is metric, chunk, slice, w and s of the first condition alone,
    as arrays over the ``CHUNK`` replicates of a chunk."""
    ship_package(means.sparkSession)
    slices, arrays = value_slices(means, first, second, value), times is not None
    parts = lambda name: F.array_sort(F.collect_list(F.struct(F.col(name).alias("part"), "a", "b"))).alias("parts")
    blocks = slices.groupBy("metric", "block").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    whole = blocks.groupBy("metric").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    if times is None:
        chunks = whole.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // CHUNK)))).withColumn("times", F.lit(None).cast("array<long>"))
    else:
        chunks = whole.join(times, "metric")

    def start(batches):
        for pdf in batches:
            n = [min(CHUNK, replicates - c * CHUNK) for c in pdf["chunk"]]
            t = [np.ones(k, np.int64) if x is None else np.array(x) for x, k in zip(pdf["times"], n, strict=True)]
            yield pd.DataFrame({"metric": pdf["metric"], "chunk": pdf["chunk"], "part": 0, "k1": [(x * a).tolist() for x, a in zip(t, pdf["a"], strict=True)], "k2": [(x * b).tolist() for x, b in zip(t, pdf["b"], strict=True)], "below": [[0] * k for k in n]})

    numbers = "metric string, chunk int, part int, k1 array<long>, k2 array<long>, below array<long>"
    held = chunks.select("metric", "chunk", "times", "a", "b").mapInPandas(start, numbers)

    def spread(level: int):
        def run(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    rng = np.random.default_rng((seed, level, stable_hash(r.metric), r.chunk, r.part))
                    a, b = (np.array([x[k] for x in r.parts], np.int64) for k in ("a", "b"))
                    c1, c2 = shared_out(rng, np.array(r.k1), np.array(r.k2), a, b, shuffle_labels)
                    below = np.array(r.below)[:, None] + np.cumsum(c2, axis=1) - c2
                    yield pd.DataFrame({"metric": r.metric, "chunk": r.chunk, "part": [x["part"] for x in r.parts], "k1": list(c1.T), "k2": list(c2.T), "below": list(below.T)})

        return run

    if (blocks.agg(F.max("block")).first()[0] or 0) > 0:
        of_metric = blocks.groupBy("metric").agg(parts("block"))
        held = dealt_out(held.join(of_metric, "metric"), "metric", "chunk").mapInPandas(spread(1), numbers)
    of_block = slices.groupBy("metric", F.col("block").alias("part")).agg(parts("slice"))
    held = dealt_out(held.join(of_block, ["metric", "part"]).select("metric", "chunk", "part", "k1", "k2", "below", "parts"), "metric", "chunk", "part").mapInPandas(spread(2), numbers)

    def drawn(r):
        rng = np.random.default_rng((seed, 3, stable_hash(r.metric), r.chunk, r.slice))
        k1, k2 = np.array(r.k1), np.array(r.k2)
        return k1, k2, *slice_sums(rng, np.array(r.x), np.array(r.xa), np.array(r.xb), k1, k2, shuffle_labels, pairs and not arrays)

    def draw(batches):
        for pdf in batches:
            total = {}
            for r in pdf.itertuples():
                k1, k2, s1, s2, u = drawn(r)
                if arrays:
                    yield pd.DataFrame({"metric": [r.metric], "chunk": [r.chunk], "slice": [r.slice], "w": [k1.astype(float).tolist()], "s": [s1.tolist()]})
                elif added:
                    held = total.setdefault((r.metric, r.chunk), np.zeros((5, len(k1))))
                    held += k1, s1, k2, s2, u + k1 * np.array(r.below) if pairs else u
                else:
                    yield pd.DataFrame({"metric": r.metric, "replicate": r.chunk * CHUNK + np.arange(len(k1)), "slice": r.slice, "w1": k1, "s1": s1, "w2": k2, "s2": s2, "u": u})
            for (metric, chunk), (w1, s1, w2, s2, u) in total.items():
                yield pd.DataFrame({"metric": metric, "replicate": chunk * CHUNK + np.arange(len(w1)), "w1": w1.astype(np.int64), "s1": s1, "w2": w2.astype(np.int64), "s2": s2, "u": u})

    both = dealt_out(slices.select("metric", "slice", "x", "xa", "xb").join(held.withColumnRenamed("part", "slice"), ["metric", "slice"]), "metric", "slice", "chunk")
    schema = "metric string, chunk int, slice int, w array<double>, s array<double>" if arrays else f"metric string, replicate int, {'' if added else 'slice int, '}w1 long, s1 double, w2 long, s2 double, u double"
    return both.select("metric", "slice", "chunk", "x", "xa", "xb", "k1", "k2", "below").mapInPandas(draw, schema)


def replicate_differences(sums: DataFrame) -> DataFrame:
    """metric, replicate and value: the mean of the second condition minus that of the first; rounded, for slices are
    added in no fixed order."""
    mean = lambda k: F.try_divide(F.sum(f"s{k}"), F.sum(f"w{k}"))
    return sums.groupBy("metric", "replicate").agg(F.round(mean(2) - mean(1), 9).alias("value"))


def bootstrap_mean_diff(means: DataFrame, first: str, second: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Percentile interval of the difference of means (second minus first) of resampled samples."""
    rows = replicate_differences(replicate_sums(means, first, second, replicates, seed, pairs=False, added=True))
    return percentiles(rows, ["metric"], {"ci_low": 2.5, "ci_high": 97.5})


def permutation_test(means: DataFrame, first: str, second: str, replicates: int = 10_000, seed: int = 42, plain: bool = False) -> DataFrame:
    """Two-sided p of the difference of means under shuffled labels: (count + 1) / (replicates + 1), or with ``plain`` the
    share of replicates at least as far from zero as the difference itself."""
    x = lambda c: F.avg(F.when(F.col("condition") == c, F.col("mean")))
    seen = means.groupBy("metric").agg((x(second) - x(first)).alias("seen"))
    rows = replicate_differences(replicate_sums(means, first, second, replicates, seed, shuffle_labels=True, pairs=False, added=True)).join(seen, "metric")
    hit = F.count_if(F.abs("value") >= F.abs("seen") - 1e-9)
    p = hit / F.count("*") if plain else (hit + 1) / (F.count("*") + 1)
    return rows.groupBy("metric").agg(F.when(F.first("seen").isNotNull(), p).alias("p_permutation"))


def delta_of(x: np.ndarray, y: np.ndarray) -> float:
    y = np.sort(y)
    return float((np.searchsorted(y, x, "left").sum() - (len(y) - np.searchsorted(y, x, "right")).sum()) / (len(x) * len(y)))


def bootstrap_effect(means: DataFrame, first: str, second: str, replicates: int = 2000, seed: int = 42, value: str = "mean") -> DataFrame:
    """Percentile interval of Cliff's delta of two resampled conditions, for the column ``value``: means of samples, or
    the values themselves, which may be counted (``n``)."""
    sums = replicate_sums(means, first, second, replicates, seed, value=value, added=True)
    delta = F.try_divide(2 * F.sum("u"), F.sum("w1").cast("double") * F.sum("w2")) - 1
    rows = sums.groupBy("metric", "replicate").agg(F.round(delta, 12).alias("value"))
    return percentiles(rows, ["metric"], {"effect_low": 2.5, "effect_high": 97.5})


def forest_table(long: DataFrame, first: str, second: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """Cliff's delta of each metric with its interval, both of the same values: the samples' means as ``<metric>`` and all
    values as ``all_<metric>``."""
    per = sample_means(long).select("metric", "condition", F.col("mean").alias("value"), F.lit(1).cast("long").alias("n"))
    counted = long.filter("value is not null").groupBy("metric", "condition", "value").agg(F.count("*").alias("n"))
    every = checkpointed(counted.withColumn("metric", F.concat(F.lit("all_"), "metric")).unionByName(per))
    delta = cliffs_delta(rank_sums(every, first, second, counted=True)).select("metric", "delta", "effect")
    return delta.join(bootstrap_effect(every, first, second, replicates, seed, value="value"), "metric")


def icc(long: DataFrame) -> DataFrame:
    """ICC(1) of samples within each metric and condition from the mean squares of one-way ANOVA, not below 0; NULL with
    fewer than two samples. Also the mean cluster size, the design effect and the effective number."""
    known = long.filter("value is not null")
    per = known.groupBy("metric", "condition", "sample").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    whole = per.groupBy("metric", "condition").agg(
        F.count("*").alias("k"), F.sum("n").alias("n_all"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("between"), F.sum("ss").alias("ss")
    )
    msb = (F.col("between") - F.col("n_all") * F.col("grand") * F.col("grand")) / (F.col("k") - 1)
    msw = F.try_divide(F.col("ss") - F.col("between"), F.col("n_all") - F.col("k"))
    size = F.col("n_all") / F.col("k")
    value = F.when(F.col("k") >= 2, F.greatest(F.lit(0.0), F.coalesce(F.try_divide(msb - msw, msb + (size - 1) * msw), F.lit(0.0))))
    got = whole.withColumns({"mean_cluster": size}).withColumn("icc", F.when(F.col("k") >= 2, value))
    effect = 1 + (F.col("mean_cluster") - 1) * F.col("icc")
    return got.select("metric", "condition", F.col("k").alias("n_samples"), F.col("n_all").alias("n_values"), "mean_cluster", "icc", effect.alias("design_effect"), (F.col("n_all") / effect).alias("effective_n"))


def normality(long: DataFrame, alpha: float = 0.05) -> DataFrame:
    """n, test, p, skewness, kurtosis and non_normal of each metric and condition: Lilliefors' test, or, where the values have no spread to
    test, the screen |skewness| > 1 or |kurtosis - 3| > 2; none below 4 values (``non_normal`` is NULL)."""
    long = checkpointed(long.filter("value is not null"))
    got = long.groupBy("metric", "condition").agg(F.count("*").alias("n"), F.skewness("value").alias("skewness"), (F.kurtosis("value") + 3).alias("kurtosis"))
    got = got.join(lilliefors(long, alpha).select("metric", "condition", "p", "rejected"), ["metric", "condition"], "left")
    test = F.when(F.col("p").isNotNull(), "Lilliefors").when(F.col("n") >= 4, "moments")
    screen = F.coalesce((F.abs("skewness") > 1) | (F.abs(F.col("kurtosis") - 3) > 2), F.lit(False))
    return got.select("metric", "condition", "n", test.alias("test"), "p", "skewness", "kurtosis", F.when(F.col("p").isNotNull(), F.col("rejected")).when(F.col("n") >= 4, screen).alias("non_normal"))


def lilliefors_p(d: Column, n: Column) -> Column:
    """p of Lilliefors' D by the fits of Dallal and Wilkinson (up to 0.1) and of Stephens (above it), within the range from 0.001 to 0.5
    that tables of its critical values have."""
    least = F.least(n, F.lit(100)).cast("double")
    scaled = F.when(n > 100, d * F.pow(n / F.lit(100.0), F.lit(0.49))).otherwise(d)
    m = least + 2.78019
    low = F.exp(-7.01256 * scaled * scaled * m + 2.99587 * scaled * F.sqrt(m) - 0.122119 + 0.974598 / F.sqrt(least) + 1.67997 / least)
    root = F.sqrt(n.cast("double"))
    k = (root - 0.01 + 0.85 / root) * d
    fit = lambda *c: sum((c[i] * F.pow(k, F.lit(float(i))) for i in range(1, len(c))), F.lit(c[0]))
    high = (
        F.when(k <= 0.302, 1.0).when(k <= 0.5, fit(2.76773, -19.828315, 80.709644, -138.55152, 81.218052)).when(k <= 0.9, fit(-4.901232, 40.662806, -97.490286, 94.029866, -32.355711))
        .when(k <= 1.31, fit(6.198765, -19.558097, 23.186922, -12.234627, 2.423045)).otherwise(0.0)
    )
    return F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.when(low > 0.1, high).otherwise(low)))


def lilliefors(long: DataFrame, alpha: float = 0.05) -> DataFrame:
    """n, D, p and whether normality is rejected (p <= alpha), of each metric and condition with at least 4 values that are not all
    the same."""
    ship_package(long.sparkSession)
    known = long.filter("value is not null")
    counted = known.groupBy("metric", "condition", "value").agg(F.count("*").alias("n"))
    whole = known.groupBy("metric", "condition").agg(F.count("*").alias("n_all"), F.avg("value").alias("m"), sample_std(F.col("value")).alias("s")).filter("n_all >= 4 and s > 0")
    upto = running_counts(counted, ["metric", "condition"], "value", ["n"]).join(whole, ["metric", "condition"])

    @F.pandas_udf("double")
    def cdf(z: pd.Series) -> pd.Series:
        return pd.Series(special.normal_cdfs(z.to_numpy(float)), dtype="float64")

    both = upto.withColumn("f", cdf((F.col("value") - F.col("m")) / F.col("s")))
    gap = F.greatest(F.col("n_upto") / F.col("n_all") - F.col("f"), F.col("f") - (F.col("n_upto") - F.col("n")) / F.col("n_all"))
    found = both.groupBy("metric", "condition", "n_all").agg(F.max(gap).alias("d")).withColumnRenamed("n_all", "n").withColumn("p", lilliefors_p(F.col("d"), F.col("n")))
    return found.withColumn("rejected", F.col("p") <= alpha)


def ecdf(long: DataFrame) -> DataFrame:
    """The empirical distribution function at each different value."""
    counted = long.filter("value is not null").groupBy("metric", "condition", "value").agg(F.count("*").alias("n"))
    whole = counted.groupBy("metric", "condition").agg(F.sum("n").alias("n_all"))
    upto = running_counts(counted, ["metric", "condition"], "value", ["n"])
    return upto.join(whole, ["metric", "condition"]).select("metric", "condition", "value", (F.col("n_upto") / F.col("n_all")).alias("ecdf"))


def box_stats(long: DataFrame) -> DataFrame:
    """Quartiles, the upper fence Q3 + 1.5 IQR and the number of values above it, from one count of the different values."""
    counted = counted_values(long)
    q = percentiles(counted, ["metric", "condition"], {"q1": 25, "median": 50, "q3": 75}, times="n").withColumn("fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    above = F.sum(F.when(F.col("value") > F.col("fence"), F.col("n")).otherwise(0)).cast("long")
    return counted.join(q, ["metric", "condition"]).groupBy("metric", "condition", "q1", "median", "q3", "fence").agg(above.alias("n_outliers"))


def places(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row, from 1, in the order of the columns ``order`` (nulls last). Rows are
    dealt by ranges and numbered inside them; only the sizes of the ranges meet in one place."""
    columns = [F.col(c).asc_nulls_last() for c in order]
    dealt = df.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*columns))
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, (inside + F.col("_start")).cast("int")).drop("_part", "_start")


def rank_samples(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Rank of each sample in each metric (ties by input order, missing values unranked), mean rank and overall rank. A
    sample is one recording; ``ordinal`` is the input order."""
    ranked = wide
    for m in metrics:
        ranked = places(ranked, [m, "ordinal"], f"{m}_rank").withColumn(f"{m}_rank", F.when(F.col(m).isNotNull(), F.col(f"{m}_rank")))
    known = [F.col(f"{m}_rank") for m in metrics]
    total = sum((F.coalesce(c, F.lit(0)) for c in known), F.lit(0))
    count = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in known), F.lit(0))
    ranked = ranked.withColumn("avg_rank", F.try_divide(total.cast("double"), count))
    return places(ranked, ["avg_rank", "ordinal"], "overall_rank")


def better_half(ranked: DataFrame, metrics: list[str], condition: str) -> DataFrame:
    """metric, condition, n and n_better_half: of the samples with a rank in each metric, how many of each condition are in the half with
    the lowest values (of an odd number the smaller half)."""
    long = ranked.select(F.col(condition).alias("condition"), *[F.col(f"{m}_rank").alias(m) for m in metrics]).unpivot(["condition"], metrics, "metric", "place")
    half = long.groupBy("metric").agg(F.floor(F.count("place") / 2).alias("half"))
    return long.join(half, "metric").groupBy("metric", "condition").agg(F.count("place").alias("n"), F.count_if(F.col("place") <= F.col("half")).alias("n_better_half"))


def power_estimate(m: DataFrame, z: float = 1.96) -> DataFrame:
    """Power of a two-sided test for the observed standardised difference, by the normal approximation with both tails;
    NULL without a difference."""
    ship_package(m.sparkSession)

    @F.pandas_udf("double")
    def power(d: pd.Series, n: pd.Series) -> pd.Series:
        shift = d * np.sqrt(n / 2)
        return pd.Series([None if not a else min(1.0, 1 - special.normal_cdf(z - s) + special.normal_cdf(-z - s)) for a, s in zip(d, shift, strict=True)], dtype="float64")

    harmonic = 2.0 * F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))
    return m.join(cohens_d(m), "metric").select("metric", harmonic.alias("harmonic_n"), power("cohens_d", harmonic).alias("power"))


#: Values up to which a sample is drawn from whole, beside the others of its block; draws at a time when they go one by one; draws that take
#: as long as a point of the distribution of their sum; and draws from which working out such a distribution pays.
SAMPLE_VALUES, DRAWN, DRAWS_A_POINT, MANY_DRAWS = 10_000, 2**16, 32, 2**17

#: Parts of one that values are tried to be whole numbers of.
SCALES = (1, 100, 10_000)

#: Deviations on each side of the mean that the cells of a sum lie within, their number, and the most frequencies that their chances are made of.
REACH, CELLS, FREQUENCIES = 20.0, 4096, 512


def reach_of_sum(gap: np.ndarray, spread: float) -> float:
    """Deviations ``spread`` on each side of its mean that a sum of draws, each with one of ``gap`` to its own mean, leaves with a chance below
    1e-15, by Bernstein's bound."""
    far = 12 * np.abs(gap).max() / spread
    return far + math.sqrt(far * far + 72)


def sum_chances(chances: np.ndarray, n: int) -> np.ndarray:
    """How likely each sum of ``n`` draws is, modulo ``len(chances)``, when ``chances`` are those of 0, 1, 2, ... in a draw: the n-th power of
    their Fourier transform. Rounding errors, below 1e-16, count as nothing."""
    square, power = np.fft.rfft(chances), 1.0
    for bit in bin(n)[:1:-1]:
        power = power * square if bit == "1" else power
        square = square * square
    got = np.fft.irfft(power, len(chances))
    return np.where(got > 1e-16, got, 0.0)


def cell_chances(gap: np.ndarray, often: np.ndarray, spread: float) -> np.ndarray | None:
    """How likely a sum of draws from ``gap`` (different values less their mean, and how often each is there; as many draws as values) is in each of
    ``CELLS`` from -``REACH`` to ``REACH`` times its deviation ``spread``, so that even draws in a cell give the sum's characteristic function, which is
    the values' own to the power of their number. None where that has not died away within ``FREQUENCIES``, or the sum may leave the cells."""
    if reach_of_sum(gap, spread) > REACH:
        return None
    n, turns = often.sum(), np.exp(-1j * np.pi / REACH / spread * gap)[None]
    while len(turns) < FREQUENCIES:
        turns = np.concatenate([turns, turns * turns[-1]])  # one frequency a row
        if len(turns) >= 64:
            wave = (turns @ (often / n)) ** n
            if np.abs(wave[-len(wave) // 8 :]).max() < 1e-16:
                k = np.arange(1, len(wave) + 1)
                got = np.fft.irfft(np.append(1.0, wave * np.where(k % 2, -1, 1) / np.sinc(k / CELLS)), CELLS)
                return np.where(got > 1e-16, got, 0.0)
    return None


def drawn_places(rng, chances: np.ndarray, times: int) -> np.ndarray:
    """``times`` places drawn by their ``chances``. Most are found by a table of where each 16,384th of the chances begins, the rest by search."""
    upto, parts = np.cumsum(chances), 2**14
    upto /= upto[-1]
    start = np.cumsum(np.bincount(np.ceil(upto * parts).astype(np.intp), minlength=parts + 2))
    u = rng.random(times)
    part = (u * parts).astype(np.intp)
    place = start[part]
    rest = np.flatnonzero(start[part + 1] != place)
    place[rest] = np.searchsorted(upto, u[rest], "right")
    return place


def sums_of_draws(rng, values: np.ndarray, times: int) -> np.ndarray:
    """``times`` sums, each of as many draws with replacement from ``values`` as these are.

    A sum has a distribution that follows from the values, and is drawn from it at once, which is the same as adding draws: where values are
    whole numbers of a step with few steps from the least to the greatest, by the chance of each sum, else by the chances of narrow cells, which
    give the sum's characteristic function to about 1e-12. Few draws, and those of far outliers, go one by one, or by counts if few values differ."""
    n = len(values)
    x, often = np.unique(values, return_counts=True)
    if len(x) == 1:
        return np.full(times, n * x[0])
    for scale in SCALES:
        whole = np.rint(x * scale)
        if np.abs(whole).max() < 2**31 and (whole / scale == x).all():
            steps = (whole - whole[0]).astype(np.int64)
            step = np.gcd.reduce(steps)
            steps //= step
            gap = steps - often @ steps / n
            spread = math.sqrt(often @ (gap * gap))
            most = min(int(steps[-1]) * n + 1, math.ceil(2 * reach_of_sum(gap, spread) * spread) + 2)
            size = 1 << (most - 1).bit_length()
            if size * DRAWS_A_POINT > times * n:
                break
            place = drawn_places(rng, sum_chances(np.bincount(steps % size, often / n, size), n), times)
            first = max(0, int(often @ steps) - size // 2)  # sums lie within ``size`` from there
            return (n * whole[0] + step * (first + (place - first) % size)) / scale
    if n > DRAWS_A_VALUE * len(x):
        return rng.multinomial(n, often / n, size=times) @ x
    if times * n > MANY_DRAWS and np.isfinite(x).all():
        mean = often @ x / n
        gap = x - mean
        spread = math.sqrt(often @ (gap * gap))
        chances = cell_chances(gap, often, spread)
        if chances is not None:
            place = drawn_places(rng, chances, times) + rng.random(times) - 0.5
            return n * mean + spread * (place * (2 * REACH / CELLS) - REACH)
    every = np.repeat(x, often)
    out, rows = np.empty(times), max(1, DRAWN // n)
    place, got = np.empty((min(rows, times), n), np.intp), np.empty((min(rows, times), n))
    for i in range(0, times, rows):
        m = min(rows, times - i)
        place[:m] = rng.integers(0, n, (m, n), dtype=np.uint16)
        every.take(place[:m], mode="clip", out=got[:m])
        got[:m].sum(axis=1, out=out[i : i + m])
    return out


def drawn_sums(rng, values: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The sum of ``k[i]`` times as many draws with replacement from ``values`` as these are, for each i."""
    out = np.zeros(len(k))
    some = np.flatnonzero(k)
    if len(some):
        sums = sums_of_draws(rng, values, int(k.sum()))
        out[some] = np.add.reduceat(sums, np.concatenate([[0], np.cumsum(k[some])[:-1]]))
    return out


def hierarchical_bootstrap(long: DataFrame, first: str, second: str, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Percentile intervals when samples are drawn again, and the values in each drawn sample: of each condition's mean over
    all drawn values (low1, high1, low2, high2) and of the difference of the two (ci_low, ci_high; second minus first).

    A replicate first draws how many times over each sample comes; then as many values as that many samples of its size have
    are drawn from the sample, so each time it comes it counts with values of its own. Samples are drawn in the same two
    steps, by blocks and then in each block. A block of samples of up to ``SAMPLE_VALUES`` values is drawn in one task, which
    leaves one sum a replicate: of each sample it draws the sums alone where it can (``sums_of_draws``). Larger samples spread over tasks by
    slices as in ``replicate_sums``, with their numbers in arrays of ``CHUNK`` replicates until they are summed."""
    ship_package(long.sparkSession)
    known = long.filter(F.col("value").isNotNull() & F.col("condition").isin(first, second))
    known = known.select("metric", "condition", F.xxhash64("metric", "condition", "sample").alias("key"), F.col("value").cast("double").alias("value"))
    samples = checkpointed(known.groupBy("metric", "condition", "key").agg(F.count("*").alias("n")).withColumn("one", F.lit(1)))
    numbered = running_counts(samples, ["metric", "condition"], "key", ["one"]).withColumns({"block": F.floor((F.col("one_upto") - 1) / SLICE_VALUES).cast("int"), "place": ((F.col("one_upto") - 1) % SLICE_VALUES).cast("int")})
    numbered = checkpointed(numbered.select("metric", "condition", "key", "n", "block", "place"))
    large = numbered.filter(F.col("n") > SAMPLE_VALUES)
    own = numbered.groupBy("metric", "condition", "block").agg(F.count("*").cast("int").alias("n"))
    sizes = own.groupBy("metric", "condition").agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("sizes"))
    sizes = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // CHUNK))))

    def numbers(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                rng = np.random.default_rng((seed, 4, stable_hash(r.metric, r.condition), r.chunk))
                n = np.array([x["n"] for x in r.sizes], np.int64)
                k = rng.multinomial(n.sum(), n / n.sum(), size=min(CHUNK, replicates - r.chunk * CHUNK))
                yield pd.DataFrame({"metric": r.metric, "condition": r.condition, "block": [x["block"] for x in r.sizes], "chunk": r.chunk, "size": n, "k": k.T.tolist()})

    dealt = sizes.repartition("metric", "condition", "chunk").select("metric", "condition", "chunk", "sizes").mapInPandas(numbers, "metric string, condition string, block int, chunk int, size int, k array<long>")

    def times(r) -> np.ndarray:
        """[replicates of the chunk, samples of the block]: how many times over each comes, the same wherever it is asked for."""
        rng = np.random.default_rng((seed, 5, stable_hash(r.metric, r.condition), r.chunk, r.block))
        k = np.array(r.k)
        place = rng.integers(0, r.size, k.sum(), dtype=np.uint16) + np.repeat(np.arange(len(k)) * r.size, k)
        return np.bincount(place, minlength=len(k) * r.size).reshape(len(k), r.size)

    def draw(values: pd.DataFrame, numbers: pd.DataFrame) -> pd.DataFrame:
        chunks = list(numbers.sort_values("chunk").itertuples())
        r = chunks[0]
        often = np.concatenate([times(c).T.astype(np.int32) for c in chunks], axis=1)  # a row a sample
        w, s = (np.zeros(often.shape[1]) for _ in range(2))
        rng = np.random.default_rng((seed, 6, stable_hash(r.metric, r.condition), r.block))
        for v in values.sort_values("place").itertuples():
            w += often[v.place] * len(v.values_)
            s += drawn_sums(rng, np.asarray(v.values_), often[v.place])
        return pd.DataFrame({"metric": r.metric, "condition": r.condition, "replicate": np.arange(len(w)), "w": w, "s": s})

    result = "metric string, condition string, replicate long, w double, s double"
    small = known.join(large.select("key"), "key", "left_anti") if large.first() else known
    small = small.groupBy("key").agg(F.collect_list("value").alias("values_"))
    small = small.join(numbered.drop("n"), "key").select("metric", "condition", "block", "place", "key", "values_")
    by = ["metric", "condition", "block"]
    parts = max(2 * long.sparkSession.sparkContext.defaultParallelism, min(own.count(), MOST_SLICES))  # so that long blocks leave no core waiting
    drawn = small.repartition(parts, *by).groupBy(*by).cogroup(dealt.repartition(parts, *by).groupBy(*by)).applyInPandas(draw, result)

    if large.first():
        held = large.groupBy(*by).agg(F.collect_list(F.struct("place", "key")).alias("keys"))

        def pick(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    often = times(r)
                    yield pd.DataFrame({"metric": [str(x["key"]) for x in r.keys], "chunk": r.chunk, "times": [often[:, x["place"]].tolist() for x in r.keys]})

        picked = dealt_out(held.join(dealt, by), *by, "chunk").select(*by, "chunk", "size", "keys", "k").mapInPandas(pick, "metric string, chunk int, times array<long>")
        values = known.join(large.select("key"), "key", "left_semi").select(F.col("key").cast("string").alias("metric"), F.lit("v").alias("condition"), "value")
        parts = replicate_sums(values, "v", "", replicates, seed, value="value", times=picked)
        parts = parts.select(F.col("metric").cast("long").alias("key"), "chunk", "w", "s").join(large.select("metric", "condition", "key"), "key")

        def add(batches):
            for pdf in batches:
                rows = []
                for (metric, condition, chunk), part in pdf.groupby(["metric", "condition", "chunk"]):
                    w, s = (np.array(part[c].tolist()).sum(0) for c in ("w", "s"))
                    rows.append(pd.DataFrame({"metric": metric, "condition": condition, "replicate": chunk * CHUNK + np.arange(len(w)), "w": w, "s": s}))
                yield pd.concat(rows)

        drawn = drawn.unionByName(parts.select("metric", "condition", "chunk", "w", "s").mapInPandas(add, result))
    total = lambda c, name: F.sum(F.when(F.col("condition") == name, F.col(c)))
    mean = lambda name: F.round(F.try_divide(total("s", name), total("w", name)), 9)
    rows = checkpointed(drawn.groupBy("metric", "replicate").agg(mean(first).alias("m1"), mean(second).alias("m2")).withColumn("gap", F.round(F.col("m2") - F.col("m1"), 9)))
    out = percentiles(rows, ["metric"], {"ci_low": 2.5, "ci_high": 97.5}, "gap")
    for k in (1, 2):
        out = out.join(percentiles(rows, ["metric"], {f"low{k}": 2.5, f"high{k}": 97.5}, f"m{k}"), "metric", "left")
    return out
