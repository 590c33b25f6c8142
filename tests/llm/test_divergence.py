"""Operator 13 against brute force in whole numbers of any size."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from motionspark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_audit(rows, min_docs=3, top=200):
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        docs[lang or ""].update(set(terms))
        groups[lang or "", source or ""].update(terms)
    out = []
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        own = {s: Counter({t: n for t, n in c.items() if t in kept}) for (k, s), c in groups.items() if k == lang}
        whole = sum(own.values(), Counter())

        def shares(counts, kept=kept):
            n = sum(counts.values()) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // n for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        gap = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in own[s] if p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def texts(df):
    return [tuple(r) for r in df.select("text", "lang", "source").collect()]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 20_000, "block_postings": 500, "block_sources": 3}])
def test_audit_against_brute_force(docs, options):
    got = divergence.audit(docs, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == slow_audit(texts(docs))


def test_audit_of_odd_rows(spark, odd_docs, no_docs):
    long = "".join("abcdefghij"[k * k % 10] for k in range(700))
    rows = texts(odd_docs) * 3 + [(f"{long} Über {long}x É {w}", lang, source) for w, lang, source in (("a", None, None), ("b", "en", "s9"), ("c", "en", "s1"), ("d", "en", ""), ("e", "xx", "s1"), ("f", "xx", "s2"))]
    rows += [(None, "empty", "s1"), ("", "empty", "s2"), ("1 2 3", "empty", None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, key string").repartition(4)
    for options in ({}, {"shard_bytes": 600, "block_postings": 7, "block_sources": 2}):
        got = sorted(map(tuple, divergence.audit(df, **options).collect()))
        assert got == slow_audit(rows)
    assert any(r[3] == long for r in got)  # a long term comes back as it is written
    assert {r[4] for r in got if r[0] == "empty"} == {0}
    assert divergence.audit(no_docs).count() == 0


def test_shares_beyond_long_products(spark):
    n = 30_000_000_000
    df = spark.createDataFrame([(n, 3 * n, 7)], "c long, n long, v long")
    assert df.select(divergence.share("c", "n", "v")).first()[0] == 1 + 10**9 * (n + 1) // (3 * n + 7)


def test_bytes_that_are_no_text(spark):
    df = spark.range(3).select(F.expr("cast(x'61FF62' as string)").alias("text"), F.lit("en").alias("lang"), F.col("id").cast("string").alias("source"))
    assert {r["item"] for r in divergence.audit(df).filter("part = 'term'").collect()} <= {"a�b"}
