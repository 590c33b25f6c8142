"""Operator 12 against an eigendecomposition of the whole covariance, and its merge tree against one SVD."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionspark.llm import queries, whitening


def slow_whiten(vectors, k=8):
    """vec_id -> (n, deviation, [whitened up to the sign]), shares of the variance."""
    good = [(i, v) for i, v in vectors if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, d)
    deviations = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    return [i for i, _ in good], n, deviations, centred @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def compare(df, vectors, k=8):
    ids, n, deviations, white, shares = slow_whiten(vectors, k)
    rows = df.orderBy("vec_id", "deviation", "component").collect()
    k = white.shape[1]
    assert len(rows) == len(ids) * k and {r["n"] for r in rows} == {n}
    order = sorted(range(len(ids)), key=lambda i: (ids[i], deviations[i]))
    assert [r["vec_id"] for r in rows] == [ids[i] for i in order for _ in range(k)] and [r["component"] for r in rows] == list(range(1, k + 1)) * len(ids)
    assert [int(r["deviation"]) for r in rows] == [deviations[i] for i in order for _ in range(k)]
    got, want = np.array([r["whitened"] for r in rows]).reshape(-1, k), white[order]
    signs = np.sign((got * want).sum(0))
    assert np.abs(got * signs - want).max() < 1e-7
    assert np.allclose(np.array([r["explained"] for r in rows]).reshape(-1, k), shares, rtol=1e-9)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9


def test_whitening_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    compare(queries.op12_whitening(spark, sf), vectors)
    for parts, merge in ((1, 2), (7, 2), (40, 3)):
        models = whitening.fit(df.repartition(parts), merge=merge)
        assert list(models) == [64] and models[64].n == len(vectors)
    compare(whitening.whiten(df.repartition(23)), vectors)


def test_merging_keeps_the_whole_rank():
    rng = np.random.default_rng(1)
    x = rng.integers(90_000, 110_000, (500, 12)).astype(np.int64)
    x[:, 5] = 7
    whole = whitening.State.of(x)
    for cuts in ([1, 2, 3, 250], [499], [100, 200, 300, 400]):
        parts = [whitening.State.of(p) for p in np.split(x, cuts)]
        got = whitening.merged(parts)
        assert got.n == 500 and got.sums == whole.sums == x.sum(0).tolist()
        centred = x - x.mean(0)
        assert np.allclose(got.factor.T @ got.factor, centred.T @ centred, rtol=0, atol=1e-13 * (centred * centred).sum())
        assert np.allclose(np.linalg.svd(got.factor, compute_uv=False), np.linalg.svd(whole.factor, compute_uv=False), rtol=1e-12, atol=1e-8)


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(v) for v in rng.normal(size=3) * (3, 2, 1)]) for i in range(50)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 2.0]), (104, [1.0, float("inf"), 2.0])]
    df = spark.createDataFrame(good + bad + [(7, good[3][1])], "vec_id long, v array<double>").repartition(4).withColumn("component", F.lit("clash"))
    compare(whitening.whiten(df, column="v"), good + bad + [(7, good[3][1])])
    assert whitening.whiten(df.filter("vec_id >= 100"), column="v").count() == 0
    assert whitening.whiten(df.filter("vec_id < 0"), column="v").count() == 0
    # one row, and rows without any spread, have no component
    assert whitening.whiten(df.filter("vec_id = 5"), column="v").count() == 0
    flat = spark.createDataFrame([(i, [1.0, 2.0, float(i)]) for i in range(5)], "vec_id long, v array<double>")
    assert [r["component"] for r in whitening.whiten(flat, column="v").collect()] == [1] * 5


def test_lengths_are_tables_of_their_own(spark):
    rng = np.random.default_rng(3)
    two, four = ([(10 * d + i, [float(v) for v in rng.normal(size=d)]) for i in range(30)] for d in (2, 4))
    df = spark.createDataFrame([(i + 1000 * len(v), v) for i, v in two + four], "vec_id long, v array<double>").repartition(3)
    got = whitening.whiten(df, column="v")
    compare(got.filter("vec_id < 3000"), [(i + 2000, v) for i, v in two])
    compare(got.filter("vec_id > 3000"), [(i + 4000, v) for i, v in four])


@pytest.mark.parametrize("size", [1e3, 1e9, 1e14, 1e300])
def test_sums_of_any_size(spark, size):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(v) for v in rng.normal(size=4) * size]) for i in range(40)]
    rows = whitening.whiten(spark.createDataFrame(vectors, "vec_id long, v array<double>"), column="v").collect()
    limit = int(whitening.LIMIT)
    x = [[max(-limit, min(limit, math.floor(1024 * c))) + 100_000 for c in v] for _, v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = {i: sum((40 * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for i, r in enumerate(x)}
    assert rows and all(r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 10**38 else None) for r in rows)
