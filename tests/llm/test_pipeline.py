"""The pipeline's stages: what each keeps, and what run() returns."""

import re
import zlib
from itertools import combinations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from motionspark.llm import quality, secrets, simhash
from motionspark.llm.common import materialise


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), "test")
        kept[name] = docs
        if name != "pack_sequences":
            assert docs.columns == corpus_pipeline.COLUMNS
    first = spark.read.parquet(f"{sf}/documents.parquet").collect()
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).filter("kept").collect()
    left = {r["doc_id"]: r["text"] for r in first if r["doc_id"] in {x["doc_id"] for x in judged}}
    assert {r["doc_id"] for r in kept["quality_rules"].collect()} == set(left)
    hashes = simhash.WordHashes()
    sketch = lambda t: (lambda fp, x, _: (fp, sum((v & (1 << 64) - 1) << 64 * k for k, v in enumerate(x))))(*simhash.copy_sketch(t, hashes))
    sets = {d: shingles(t or "") for d, t in left.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    prints = {d: sketch(t) for d, t in left.items()}
    most = simhash.most_differing(0.8 - simhash.SLACK)
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (prints[a][0] ^ prints[b][0]).bit_count() <= simhash.COPY_RADIUS and (prints[a][1] ^ prints[b][1]).bit_count() <= most and alike(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    alone = {d for d in prints if find(d) == d}
    assert {r["doc_id"] for r in kept["simhash_near_duplicates"].collect()} == alone
    clean = {r["doc_id"]: r["text"] for r in kept["secret_scan"].collect()}
    assert set(clean) == alone and not any(re.search("[0-9a-f]{24}", t) for t in clean.values())
    assert all(clean[d] == left[d] for d in alone if not secrets.rule_spans(left[d]) and "<SECRET>" not in clean[d])
    mixed = kept["mix_sources"].groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in mixed} <= alone
    packed = kept["pack_sequences"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in packed.collect()}
    total = sum(tokens[r["doc_id"]] * r["count"] for r in mixed)
    assert packed.agg(F.sum("length")).first()[0] == total
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in packed.limit(50).collect())
    ran = corpus_pipeline.run(spark, sf)
    assert ran.columns == packed.columns and np.isclose(ran.agg(F.sum("length")).first()[0], total)


def test_repeated_rows_leave_one(spark, odd_docs, sf):
    kept = corpus_pipeline.near_duplicates(spark, odd_docs, sf)
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(3) <= 1 and kept.columns == corpus_pipeline.COLUMNS and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})


def test_different_texts_with_one_id_stay(spark, sf):
    rng = np.random.default_rng(9)
    a, b, c, d, e = (" ".join(f"word{k}" for k in rng.integers(0, 5000, 80)) for _ in range(5))
    rows = [(1, a), (3, a), (3, b), (4, c), (4, c), (5, d), (5, e), (6, b), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (3, b), (4, c), (5, d), (5, e), (None, a)], key=str)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_copies_are_found_by_similarity(spark, sf):
    """Near copies at a five-word similarity of 0.8 or more go, those well below it stay."""
    rng = np.random.default_rng(10)
    words = [f"w{k}" for k in range(3000)]
    docs, planted = [], []
    for i in range(400):
        text = [words[k % 3000] for k in rng.zipf(1.4, int(rng.integers(80, 400)))]
        docs.append((10 * i, " ".join(text)))
        near = list(text)
        for at in rng.integers(0, len(text), int(rng.integers(1, 12))):
            near[at] = f"n{rng.integers(0, 10**6)}"
        docs.append((10 * i + 1, " ".join(near)))
        a, b = shingles(docs[-2][1]), shingles(docs[-1][1])
        planted.append((len(a & b) / len(a | b), 10 * i + 1))
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()}
    assert {d for d, _ in docs if d % 10 == 0} <= kept
    caught = lambda lo, hi: np.mean([d not in kept for s, d in planted if lo <= s < hi])
    assert caught(0.9, 1) > 0.98 and caught(0.85, 0.9) > 0.95 and caught(0.8, 0.85) >= 0.9 and caught(0, 0.8) == 0


def test_pages_of_one_template_stay(spark, sf, monkeypatch):
    """Texts of the same words in another order have one word fingerprint and no similar shingles; they are compared by blocks, and all stay.
    Only the few real copies among them go, and chains of copies are followed."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "BUCKET", 40)
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(60)]
    texts = [list(rng.permutation(words)) for _ in range(150)]
    chain = [list(texts[0])]
    for k in range(6):  # each has two words of sixty other than the one before
        chain.append([f"x{k}{i}" if i in (9 * k, 9 * k + 1) else w for i, w in enumerate(chain[-1])])
    docs = [(i, " ".join(t)) for i, t in enumerate(texts + chain[1:] + [texts[5], texts[7]])]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    sets = [shingles(t) for _, t in docs]
    near = [(a, b) for a, b in combinations(range(len(docs)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert set(near) == {(0, 150), *((149 + k, 150 + k) for k in range(1, 6)), (5, 156), (7, 157)}
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()}
    assert kept == set(range(150))


def test_large_groups_go_to_many_tasks(spark):
    rows = spark.range(20_000).select((F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id").alias("name"))
    blocks = simhash.in_blocks(rows, ["g"], F.col("name"))
    sizes = blocks.groupBy("g", "lo", "hi").count().toPandas()
    assert sizes["count"].max() < 3 * simhash.BLOCK and len(sizes) > 100
    pairs = blocks.filter("g = 1 and name < 300").groupBy("lo", "hi").agg(F.collect_set("name").alias("n")).collect()
    met = {p for r in pairs for p in combinations(sorted(r["n"]), 2)}
    assert met >= set(combinations(range(0, 300, 3), 2))


def test_similarity_is_exact():
    hashes, words = simhash.WordHashes(), [f"w{k}" for k in range(200_000)]
    sketch = lambda t: simhash.copy_sketch(t, hashes)[2]
    long, cut = sketch(" ".join(words[:70_000])), sketch(" ".join(words[:60_000]))
    assert (long[0], cut[0]) == (8, 4) and simhash.alike(long, cut, 0.85) and not simhash.alike(long, cut, 0.86) and simhash.alike(long, long, 1.0)
    assert simhash.alike(sketch("one two"), sketch("One TWO"), 1.0) and not simhash.alike(sketch("one two"), sketch("one three"), 0.1) and simhash.alike(sketch(""), sketch(None), 1.0)


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, sf):
    """Nulls in any column, empty and long texts, repeated rows, clashing columns and empty tables pass every stage."""
    for table in (odd_docs, no_docs, odd_docs.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in odd_docs.schema])):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            each = stage(spark, table, sf)
            assert each.count() >= 0
            docs = materialise(stage(spark, docs, sf), "test")
            if name != "pack_sequences":
                assert docs.columns == each.columns == corpus_pipeline.COLUMNS
    redacted = {r["text"] for r in corpus_pipeline.secret_scan(spark, odd_docs, sf).collect()}
    assert None in redacted and "" in redacted and not any("deadbeefdeadbeef" in (t or "") for t in redacted)
    near = corpus_pipeline.near_duplicates(spark, odd_docs, sf).collect()
    assert sum(r["doc_id"] is None for r in near) == 1 and len({(r["doc_id"], r["text"]) for r in near}) == len(near)
