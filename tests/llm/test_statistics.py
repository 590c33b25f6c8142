"""Trained and drawn results against plain versions of their definitions."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionspark.llm import mixing, quality, sites
from motionspark.llm.common import fresh, lowest_hashes
from motionspark.llm.queries import MIXING_SQL


def test_lowest_hashes(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = [r[0] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(40).collect()]
    assert [r[0] for r in lowest_hashes(ids, "doc_id", 40).collect()] == want
    assert lowest_hashes(ids, "doc_id", 9000).count() == 5000 and lowest_hashes(ids.limit(0), "doc_id", 5).count() == 0
    assert fresh("a", spark.sql("select 1 as A, 2 as a_")) == "a__"


def slow_strength(groups):
    """``groups``: (n, k, prior)."""
    n = sum(g[0] for g in groups)
    between = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups)
    noise = sum(g[2] * (1 - g[2]) for g in groups)
    spread = sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n
    extra = (between - noise) / n
    return min(sites.MAX_STRENGTH, max(1.0, spread / extra - 1)) if extra > 1e-9 else sites.MAX_STRENGTH


def test_mixing_weights_of_absent_sources(spark):
    """A weight for a source that the table lacks goes, and the rest share the whole; a source without a weight gets no copy."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"))
    got = {r["source"]: r["source_rate"] for r in mixing.mix(docs, {"a": 0.3, "b": 0.1, "gone": 0.6}).select("source", "source_rate").distinct().collect()}
    assert got == {"a": 2.25, "b": 0.75}


def test_lowest_hashes_of_repeated_rows(spark):
    """Repeats neither crowd out other rows nor leave the sample empty."""
    df = spark.range(400_000).select((F.col("id") % 4).alias("doc_id"), F.lit(1.5).alias("x"))
    assert lowest_hashes(df, ["doc_id", "x"], 3).count() == 3 and {r["doc_id"] for r in lowest_hashes(df, ["doc_id", "x"], 100).collect()} == {0, 1, 2, 3}
    same = spark.range(1000).select(F.lit(7).alias("doc_id"), "id")
    assert lowest_hashes(same, ["doc_id", "id"], 20).count() == 20


def test_repeated_labelled_rows_change_no_verdict(spark):
    texts = ["good plain words in a row here", "### $$$ %%% ### $$$", "more plain words for all of us", "%%% &&& ||| %%% |||"]
    rows = [(i, t, f"h{i}", "p") for i, t in enumerate(texts)] + [(10 + i, t, f"h{i}", "p") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    judge = lambda d: {(r["doc_id"], r["kept"]) for r in sites.classify(d, labels, F.col("host"), F.col("path"), fit_rows=50).select("doc_id", "kept").distinct().collect()}
    often = docs.filter("doc_id >= 10").unionByName(docs.filter("doc_id < 10").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("k"))
    assert judge(docs) == judge(often) and {k for _, k in judge(docs)} == {True, False}


def test_site_bayes_against_brute_force(spark, docs, odd_docs, labels):
    more = odd_docs.select(*docs.columns).filter("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    table = docs.unionByName(more)
    rows = [(r["doc_id"], r["source"], r["lang"], r["text"]) for r in table.collect()]
    known = defaultdict(list)
    for r in labels.filter("quality is not null").collect():
        known[r["doc_id"]].append(r["quality"])
    x = np.array([sites.statistics(t) for *_, t in rows])
    y = [min(known[d]) if d in known else None for d, *_ in rows]
    fit = [i for i, v in enumerate(y) if v is not None]
    w, mean, spread = sites.fit_logistic(x[fit], np.array([y[i] for i in fit], float))
    odds = np.clip(w[0] + ((x - mean) / spread) @ w[1:], -30, 30)
    p = 1 / (1 + np.exp(-odds))
    own = [(sites.SOFT, sites.SOFT * q) if v is None else (1.0, float(v)) for v, q in zip(y, p, strict=True)]
    host, path = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
    for (_, h, g, _), (n, k) in zip(rows, own, strict=True):
        for group in (host[h], path[h, g]):
            group[0] += n
            group[1] += k
    rate = sum(k for _, k in host.values()) / sum(n for n, _ in host.values())
    hs = slow_strength([(n, k, rate) for n, k in host.values()])
    p_host = {h: (k + hs * rate) / (n + hs) for h, (n, k) in host.items()}
    ps = slow_strength([(n, k, p_host[h]) for (h, _), (n, k) in path.items()])
    p_path = {key: (k + ps * p_host[key[0]]) / (n + ps) for key, (n, k) in path.items()}
    want = []
    for (d, h, g, _), (n, k), o, q in zip(rows, own, odds, p, strict=True):
        prior = (max(0, host[h][1] - k) + hs * rate) / (max(0, host[h][0] - n) + hs)
        site = (max(0, path[h, g][1] - k) + ps * prior) / (max(0, path[h, g][0] - n) + ps)
        good = 1 / (1 + math.exp(-(o + math.log(site / (1 - site)) - math.log(rate / (1 - rate)))))
        want.append((d, h, g, q, p_host[h], p_path[h, g], good))
    got = [tuple(r) for r in sites.classify(table, labels, F.col("source"), F.col("lang")).collect()]
    assert len(got) == len(want)
    # rows with one id differ in their numbers, so they are paired in order
    for a, b in zip(sorted(got, key=lambda r: (r[0], r[6])), sorted(want, key=lambda r: (r[0], r[6])), strict=True):
        assert a[:3] == b[:3] and np.allclose(a[3:7], b[3:], atol=2e-5) and a[7] == (a[6] >= sites.KEEP)


def test_quality_against_brute_force(spark, docs, odd_docs, labels):
    for table in (docs, odd_docs):
        texts = [(r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text").collect()]
        good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
        target, corpus = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)

        def grams(text):
            raw = text.encode()
            return [((sum(b * pow(257, 2 - j, 1 << 32) for j, b in enumerate(raw[i : i + 3])) % (1 << 32)) * 2654435761 % (1 << 32)) >> 18 for i in range(len(raw) - 2)]

        for d, t in texts:
            for g in grams(t):
                corpus[g] += 1
                target[g] += d in good
        ratio = np.log(target / target.sum()) - np.log(corpus / corpus.sum()) if target.sum() > quality.BUCKETS else None
        want = []
        for d, t in texts:
            llr = None if ratio is None else float(np.mean([ratio[g] for g in grams(t)])) if len(t.encode()) >= 3 else 0.0
            want.append((str(d), len(t), llr))
        got = [(str(r["doc_id"]), r["llr"], r["base_failed"], r["kept"]) for r in quality.judge(table, labels).collect()]
        for (d, llr, failed, kept), (e, _, x) in zip(sorted(got, key=lambda r: (r[0], r[1] or 0)), sorted(want, key=lambda r: (r[0], r[2] or 0)), strict=True):
            assert d == e and (llr is None) == (x is None) and (x is None or abs(llr - x) < 1e-8)
            assert kept == (not failed and (llr is None or llr >= quality.THRESHOLD))


def test_mixing_keeps_any_column(spark):
    names = ("cdf", "mix_source", "Mix_Drawing", "parts", "n", "w", "log_p", "total", "k", "acc", "p")
    small = spark.createDataFrame([(i, "a" if i < 4 else None) for i in range(42)], "doc_id long, source string").withColumns({c: F.lit(c) for c in names})
    rows = mixing.mix(small, target_rows=400).collect()
    assert {tuple(r[c] for c in names) for r in rows} == {names} and {r["source"] for r in rows} == {"a", None}
    assert mixing.mix(small.withColumns({c: F.lit(1) for c in mixing.OWN})).columns == mixing.mix(small).columns


def test_mixing_reaches_its_weights_at_any_rate(spark):
    """One rare and 199 common rows at nine to one."""
    rows = spark.createDataFrame([(i, "rare" if i == 0 else "common") for i in range(200)], "doc_id long, source string")
    got = {r["source"]: r["count"] for r in mixing.mix(rows, {"rare": 0.9, "common": 0.1}, target_rows=100_000, shuffle=False).groupBy("source").count().collect()}
    assert abs(got["rare"] - 90_000) < 1500 and abs(got["common"] - 10_000) < 500


@pytest.mark.parametrize("sources", [3, 4])
def test_mixing_sql_beyond_one_part(spark, tmp_path, sources):
    import duckdb

    small = spark.createDataFrame([(i, f"s{min(i, sources - 1)}") for i in range(6000)], "doc_id long, source string")
    got = sorted(tuple(r[c] for c in ("doc_id", "source_rate", "copies", "copy", "shuffle_key")) for r in mixing.mix(small).collect())
    documents = small.toPandas()  # noqa: F841
    want = sorted(duckdb.sql(f"select doc_id, source_rate, copies, copy, shuffle_key from ({MIXING_SQL})").fetchall())
    assert got == want and max(r[1] for r in got) > mixing.PART_RATE


def test_lattice_recall_on_the_table(spark):
    """Links of the rows whose id is divisible by 50, against all rows, by brute force."""
    from motionspark.llm import lattice

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.array([v for _, v in good], np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = {i: int(n) for (i, _), n in zip(good, (unit @ unit.T >= 0.95).sum(1) - 1, strict=True)}
    got = {r["vec_id"]: r["n_links"] for r in lattice.near_vectors(table).collect()}
    assert all(got[i] <= links.get(i, 0) for i in got)
    asked = [i for i in links if i % 50 == 0]
    assert sum(got[i] for i in asked) >= 0.97 * sum(links[i] for i in asked) and sum(got.values()) >= 0.97 * sum(links.values())
