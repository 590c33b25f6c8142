"""The operators against brute force, and their defined edge cases."""

import hashlib
import re
import tempfile
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import combinations

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from motionspark.llm import lattice, mixing, packing, pii, planes, quality, secrets, simhash, sites, urls
from motionspark.llm.tokens import TextEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@lru_cache
def tokenizer(path):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


def ids_of(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(("path", "blanks"), [(WORD, "dropped"), (BYTE, "kept")])
def test_word_memo_gives_the_ids_of_whole_texts(docs, odd_docs, path, blanks):
    enc = TextEncoder(path, blanks, room=500)
    rng = np.random.default_rng(13)
    parts = ["the", "The", "don't", "x1", "12", "é", "ß", "İ", "ﬁ", "漢字", "🙂", ".", ",", "!?", "--", "<|endoftext|>", "a.b", "Ω", "ŉ", "%", "ab" * 40]
    mixed = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n", "  ", "\t", "\u00a0"], p=[0.3, 0.4, 0.1, 0.1, 0.04, 0.03, 0.03]) for _ in range(int(rng.integers(1, 25)))) for _ in range(2000)]
    for text in [t for _, t in pairs(docs) + pairs(odd_docs)] + mixed:
        assert enc.encode(text or "") == enc.whole(text or ""), text[:60]


def test_packing(docs, odd_docs):
    for table in (docs, odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = dict(pairs(table))
        rows = packing.pack(table.repartition(5), WORD, windows=4).collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for r in rows:
            by_doc[r["doc_id"]].append(r)
            by_seq[r["sequence_id"]].append(r)
            assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] > 0
        assert set(by_doc) == set(texts)
        for doc_id, parts in by_doc.items():
            parts.sort(key=lambda r: r["start"])
            want = np.array([*ids_of(WORD, texts[doc_id]), 1], "<u4").tobytes()
            assert b"".join(p["ids"] for p in parts) == want and {p["doc_tokens"] for p in parts} == {len(want) // 4}
            assert [p["start"] for p in parts] == list(np.cumsum([0, *(p["length"] for p in parts[:-1])]))
        for parts in by_seq.values():
            parts.sort(key=lambda r: r["offset"])
            assert [p["offset"] for p in parts] == list(np.cumsum([0, *(p["length"] for p in parts[:-1])]))
            total = sum(p["length"] for p in parts)
            assert total <= 2048 and total & (total - 1) == 0  # no padding at all


def test_packing_of_repeated_rows_and_none(odd_docs, no_docs):
    rows = packing.pack(odd_docs, WORD).filter("doc_id = 3").collect()
    assert sum(r["length"] for r in rows) == 2 * rows[0]["doc_tokens"]
    assert packing.pack(no_docs, WORD).count() == 0


@pytest.mark.parametrize(("kind", "block"), [("byte", 1000), ("bit", 700), ("byte", planes.BLOCK_IDS)])
def test_planes_round_trip(spark, docs, odd_docs, kind, block):
    for table in (docs, odd_docs):
        path = f"{tempfile.mkdtemp(prefix='spark-planes-')}/x"
        planes.write_planes(table, path, BYTE, kind=kind, block_ids=block)
        got = planes.document_digests(planes.read_planes(spark, path)).collect()
        start, want = 0, []
        for doc_id, text in sorted(pairs(table), key=lambda x: (x[0] is not None, x[0])):
            ids = [*ids_of(BYTE, text), 0]
            want.append((doc_id, start, len(ids), crc(ids)))
            start += len(ids)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
        index = spark.read.parquet(f"{path}/index").collect()
        assert sum(r["n_ids"] for r in index) == start and all(len(r["plane_bytes"]) == (4 if kind == "byte" else 32) for r in index)


def test_planes_of_nothing(spark, no_docs):
    path = f"{tempfile.mkdtemp(prefix='spark-planes-')}/x"
    planes.write_planes(no_docs, path, BYTE)
    assert planes.document_digests(planes.read_planes(spark, path)).count() == 0


def slow_personal(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                twice = [int(c) * (1 + k % 2) for k, c in enumerate(digits[::-1])]
                if not 16 <= len(digits) <= 19 or sum(d // 10 + d % 10 for d in twice) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_personal_data(docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        texts = pairs(table)
        rows = pii.sanitise(table).collect()
        want = sorted((str(d), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in slow_personal(t or "")).encode()).hexdigest()) for d, t in texts)
        assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in rows) == want
    assert pii.sanitise(no_docs).count() == 0


def test_terms_that_reveal_are_removed(spark):
    words = "lorem ipsum dolor amet tempor labore magna aliqua minim veniam quis nostrud".split()
    rng = np.random.default_rng(0)
    say = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, f"{say(6)} zanzibarian x@mail.example.com {say(6)}") for i in range(6)] + [(i, say(12)) for i in range(6, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    for i, text in rows[:6]:
        at = text.index("zanzibarian")
        assert f"remove:{at}:{at + 11}" in got[i]["spans"] and got[i]["n_remove"] == 1
    assert all(got[i]["spans"] == "" for i, _ in rows[6:])
    clean = pii.sanitised_texts(docs, pii.sanitise(docs)).collect()
    assert not any("zanzibarian" in r["text"] or "@" in r["text"] for r in clean) and len(clean) == 60
    # copies of one text prove nothing
    same = spark.createDataFrame([(i, rows[0][1]) for i in range(9)] + rows[6:], "doc_id long, text string")
    assert {r["n_remove"] + r["n_generalise"] for r in pii.sanitise(same).collect()} == {0}


def test_terms_with_a_dotted_capital_are_removed(spark):
    """İ lowers to two code points; the term is counted and taken out as it is written."""
    words = "lorem ipsum dolor amet tempor labore magna aliqua minim veniam quis nostrud".split()
    rng = np.random.default_rng(0)
    say = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, f"{say(6)} HAMBURGO {say(2)} İSTANBULLU x@mail.example.com {say(6)}") for i in range(6)] + [(i, say(12)) for i in range(6, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised_texts(docs, pii.sanitise(docs)).collect()}
    assert not any("HAMBURGO" in t or "İSTANBULLU" in t for t in clean.values()) and clean[7] == rows[7][1]


def test_mixing(spark, docs, odd_docs, no_docs):
    rows = mixing.mix(docs).collect()
    n = docs.count()
    assert abs(len(rows) - n) < 5 * n**0.5
    assert {(r["doc_id"], r["copy"]) for r in rows} == {(r["doc_id"], c) for r in rows for c in range(r["copies"])}
    weights = {"src0": 3.0, "src1": 1.0}
    half = mixing.mix(docs, weights, target_rows=4000).groupBy("source").count().collect()
    by = {r["source"]: r["count"] for r in half}
    assert set(by) == set(weights) and abs(by["src0"] - 3000) < 600 and abs(by["src1"] - 1000) < 350
    assert mixing.mix(odd_docs).count() >= 0 and mixing.mix(no_docs).count() == 0
    cdf = spark.range(1).select(mixing.cumulative(F.lit(2.5)).alias("c")).first()["c"]
    want = np.cumsum([np.exp(-2.5) * 2.5**k / np.prod(range(1, k + 1) or [1]) for k in range(10)])
    assert np.allclose(cdf[:10], want, atol=1e-9)


def test_mixing_keeps_the_weight_of_a_small_source(spark, monkeypatch):
    small = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(42)], "doc_id long, source string")
    rows = mixing.mix(small, target_rows=20_000).collect()
    assert {r["source"]: r["source_rate"] for r in rows} == {"a": 5000.0, "b": 250.0}
    for name in "ab":
        assert abs(sum(r["source"] == name for r in rows) - 10_000) < 500
    copies = {r["doc_id"]: r["copies"] for r in rows}
    assert len(rows) == sum(copies.values()) and {(r["doc_id"], r["copy"]) for r in rows} == {(d, c) for d, n in copies.items() for c in range(n)}
    # drawn in parts, the copies are still a Poisson number
    monkeypatch.setattr(mixing, "PART_RATE", 2.0)
    monkeypatch.setattr(mixing, "COPY_BLOCK", 3)
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    rows = mixing.mix(many, target_rows=21_000, shuffle=False).collect()
    n = np.array([r["copies"] for r in rows if r["copy"] == 0] + [0] * (3000 - len({r["doc_id"] for r in rows})))
    assert abs(n.mean() - 7) < 0.25 and abs(n.var() - 7) < 1 and len(rows) == n.sum()


def test_site_bayes(docs, labels, odd_docs, no_docs, no_labels):
    rows = sites.classify(docs, labels.filter("doc_id % 2 = 0"), F.col("source"), F.col("lang")).collect()
    p = {r["doc_id"]: r["p_good"] for r in rows}
    held = [(r["doc_id"], r["quality"]) for r in labels.filter("doc_id % 2 = 1").collect()]
    right = np.mean([(p[d] >= 0.5) == (q == 1) for d, q in held])
    assert right > 0.9
    assert sites.classify(odd_docs, labels, F.col("source"), F.col("lang")).count() == odd_docs.count()
    assert {r["p_good"] for r in sites.classify(docs, no_labels, F.col("source"), F.col("lang")).collect()} == {0.5}
    assert sites.classify(no_docs, labels, F.col("source"), F.col("lang")).count() == 0


def test_sparse_sites_shrink(spark):
    groups = spark.createDataFrame([("a", 1.0, 1.0), ("b", 100.0, 20.0), ("c", 100.0, 90.0)], "host string, n double, k double")
    got = {r["host"]: r["p"] for r in sites.shrunk(groups, ["host"], F.lit(0.55), "p").collect()}
    assert 0.55 < got["a"] < 1 and abs(got["b"] - 0.2) < 0.05 and abs(got["c"] - 0.9) < 0.05


def test_lattice(spark, no_docs):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 64))
    rows = [list(map(float, v)) for v in base]
    for i in range(60):  # near copies at cosines from 0.95 on
        v = base[i] / np.linalg.norm(base[i])
        w = rng.normal(size=64)
        w -= (w @ v) * v
        c = rng.uniform(0.951, 0.999)
        rows.append(list(map(float, 3 * (c * v + np.sqrt(1 - c * c) * w / np.linalg.norm(w)))))
    rows += [rows[5], rows[5], [2 * x for x in rows[6]], None, [0.0] * 64, [float("nan")] * 64, [None] * 64, [1.0, 2.0], []]
    x = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).withColumn("v", F.lit(2))
    got = {r["vec_id"]: r for r in lattice.near_vectors(x).collect()}
    good = [i for i, v in enumerate(rows) if v and len(v) == 64 and all(y is not None and np.isfinite(y) for y in v) and any(v)]
    unit = np.array([rows[i] for i in good], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    links = near.sum(1) - 1
    found = np.array([got[i]["n_links"] for i in good])
    assert (found <= links).all() and found.sum() >= 0.97 * links.sum()
    for i in range(len(rows)):
        assert got[i]["kept"] == (got[i]["component_id"] == i)
        if i not in good:
            assert got[i]["n_links"] == 0 and got[i]["kept"]
    assert got[5]["component_id"] == got[210]["component_id"] == got[211]["component_id"] == 5
    assert lattice.near_vectors(x.limit(0)).count() == 0


def test_lattice_recall_at_the_threshold():
    rng = np.random.default_rng(7)
    v, w = (x / np.linalg.norm(x, axis=1)[:, None] for x in rng.normal(size=(2, 3000, 64)))
    w -= (w * v).sum(1)[:, None] * v
    near = 0.95 * v + np.sqrt(1 - 0.95**2) * w / np.linalg.norm(w, axis=1)[:, None]
    met = np.zeros(len(v), bool)
    for t in range(lattice.TABLES):
        x, y = lattice.cells(v, t, 6, lattice.PROBES), lattice.cells(near, t, 6, lattice.PROBES)
        met |= (y == x[:, :1]).any(1) | (x == y[:, :1]).any(1)
    assert met.mean() > 0.99


def test_lattice_links_vectors_of_each_length(spark):
    rng = np.random.default_rng(8)
    base = {n: rng.normal(size=(5, n)) for n in (3, 16, 64)}
    rows = [list(map(float, v)) for n in (64, 16, 3) for v in np.repeat(base[n], 3 if n == 64 else 2, axis=0) * (1 + rng.integers(0, 2, (15 if n == 64 else 10, 1)))]
    got = lattice.near_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()
    want = {}
    for i, x in enumerate(rows):
        cos = [len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95 for y in rows]
        want[i] = sum(cos) - 1
    assert {r["vec_id"]: r["n_links"] for r in got} == want and min(want.values()) >= 1


def test_lattice_links_vectors_of_any_size(spark):
    least = float(np.nextafter(0, 1))
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1.0, 1.0]), (4, [1e-200, 1e-200]), (5, [1.7e308, 1.7e308]), (6, [least, least]), (7, [1e200, -1e200]), (8, [3e-300, 0.0]), (9, [1e300, 1e-300])]
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[k]["n_links"] for k in range(1, 10)] == [5, 5, 5, 5, 5, 5, 0, 1, 1] and {got[k]["component_id"] for k in range(1, 7)} == {1} and got[9]["component_id"] == 8


def test_large_cells_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=64)
    rows = [(i, list(map(float, v + 0.02 * rng.normal(size=64)))) for i in range(120)]
    monkeypatch.setattr(lattice, "SENT", 16)
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {(r["n_links"], r["component_id"]) for r in got.collect()} == {(119, 0)}


def test_e8_points():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 2
    p = lattice.nearest_e8(x)
    doubled = (2 * p).astype(int)
    assert ((doubled % 2).sum(1) % 8 == 0).all() and (p.sum(1) % 2 == 0).all()
    near = p[:, None, :] + lattice.shortest_vectors()[None]
    assert (((x[:, None, :] - near) ** 2).sum(2).min(1) >= ((x - p) ** 2).sum(1) - 1e-9).all()


def fits(glob, text):
    host, slash, rest = glob.partition("/")
    return re.fullmatch("[^/]*".join(map(re.escape, host.split("*"))) + slash + "(?s:.*)".join(map(re.escape, rest.split("*"))), text) is not None


def test_automaton():
    globs = ["net/*", "*.net/*", "a*b", "*/x*y/z", "*", "", "abc", "*spam*/*"] + [f"h{i}.org/{'long' * 9}*" for i in range(20)]
    texts = ["net/", "x.net/a", "net", "ab", "a/b", "aXb", "h/xy/z", "h/a/xx/y/z", "", "abc", "é/xéy/z", "q.spam.w/", "h3.org/" + "long" * 10]
    got = urls.Automaton(globs).run(texts)
    assert got.tolist() == [[fits(g, t) for g in globs] for t in texts]


def test_urls(spark):
    given = [None, "", "no scheme", "http://", "HTTP://A.B.NET/x?y#z", "http://net/", "http://example.net/en/a", "https://m.example.net/en", "http://x.example.com/de/?q=://", "http://fr.org/fr/", "http://org?x", "http://w.org#f",
             "http://notnet/", "ftp://spam-farm.example.org/a", "http://a.b/x.exe", "http://a.b/?sessionid=1", "http://É.NET/a"]
    df = spark.createDataFrame(list(enumerate(given)) + [(3, given[4])], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r["judged"] for r in urls.filter_urls(df).orderBy("page_id").collect()}
    for i, url in enumerate(given):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        rules = [(len(r), r, v) for v, r in urls.SITE_RULES if (host + "").endswith(r.split("/", 1)[0]) and re.fullmatch(r"(.*\.)?", host[: len(host) - len(r.split("/", 1)[0])]) and path.startswith("/" + r.split("/", 1)[1])]
        if i != 3:
            assert (got[i]["host"], got[i]["path"]) == (host, path), url
            assert got[i]["rule"] == (max(rules)[1] if rules else None), url
    assert got[13]["verdict"] == "block" and got[14]["verdict"] == "block" and got[0]["verdict"] == "allow"


def test_urls_of_any_length_and_none(spark):
    long = "http://" + "a." * 50_000 + "example.net/en/" + "b/" * 100_000 + "?" + "q" * 100_000
    df = spark.createDataFrame([(1, long), (2, "http://x/" + "y" * 300_000 + ".exe"), (None, "http://fr.org/fr/")], "page_id long, url string")
    got = {r["page_id"]: r["judged"] for r in urls.filter_urls(df).collect()}
    assert (got[1]["rule"], got[1]["verdict"], len(got[1]["host"]), len(got[1]["path"])) == ("example.net/en/", "allow", 100_011, 200_004)
    assert got[2]["verdict"] == "block" and got[2]["rule"] is None and got[None]["rule"] == "org/fr/"
    none = urls.filter_urls(df.filter("page_id = 7"))
    assert none.count() == 0 and none.columns == urls.filter_urls(df).columns


def slow_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)} if len(windows) < 1500 else None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), covered


def test_quality(docs, labels, odd_docs, no_docs, no_labels):
    for table in (docs, odd_docs):
        texts = pairs(table)
        got = sorted(map(tuple, quality.judge(table, labels).drop("llr", "kept").collect()), key=str)
        want = []
        for d, t in texts:
            *stats, covered = slow_stats(t)
            repeated = quality.base_stats(t)[4] if covered is None else len(covered)
            want.append((d, *stats, repeated, stats[0] < 10 or 100 * repeated > 20 * stats[0]))
        assert got == sorted(want, key=str)
    rows = quality.judge(docs, labels).collect()
    assert all(not r["kept"] for r in rows if r["base_failed"])
    kept = {r["doc_id"]: r["kept"] for r in rows if not r["base_failed"]}
    marked = [(r["quality"], kept[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in kept]
    assert np.mean([k for q, k in marked if q == 1]) > 0.97 and np.mean([k for q, k in marked if q == 0]) < 0.2
    whole = quality.judge(docs, labels, keep_rows=True)
    assert whole.columns == docs.columns and {r["doc_id"] for r in whole.collect()} == {d for d, k in kept.items() if k}
    assert all(r["llr"] is None and r["kept"] == (not r["base_failed"]) for r in quality.judge(docs, no_labels).collect())
    assert quality.judge(no_docs, labels).count() == 0


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, odd_docs, no_docs):
    for table in (docs, odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        prints = {d: slow_print(t) for d, t in pairs(table)}
        links = [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
        want = roots(prints, links)
        got = simhash.near_duplicates(table).select("doc_id", simhash.hex_digits().alias("h"), "component_id").collect()
        assert {r["doc_id"]: (r["h"], r["component_id"]) for r in got} == {d: (f"{p:016x}", want[d]) for d, p in prints.items()}
    assert simhash.near_duplicates(odd_docs).count() == odd_docs.count() and simhash.near_duplicates(no_docs).count() == 0


def test_masks_cover_all_pairs_within_the_radius():
    first, second = simhash.masks_of(2)
    for i, j in combinations(range(64), 2):
        diff = 1 << i | 1 << j
        assert any(not m & diff for m in first) and all(any(not m & diff for m in own) for f, own in zip(first, second, strict=True) if not f & diff)
    assert max(64 - m.bit_count() for own in second for m in own) <= 16


def test_large_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(4)
    prints = sorted({int(rng.integers(0, 1 << 11)) << 20 for _ in range(400)} | {int(x) for x in rng.integers(0, 1 << 62, 100)})
    monkeypatch.setattr(simhash, "BUCKET", 20)
    from motionspark.llm.graph import components

    got = {r["node"]: r["component"] for r in components(simhash.links_within(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()}
    want = roots(prints, [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2])
    assert {p: got.get(p, p) for p in prints} == want


def test_masks_cover_the_radius_of_near_copies():
    first, second = simhash.masks_of(simhash.COPY_RADIUS)
    rng = np.random.default_rng(11)
    for _ in range(3000):
        diff = sum(1 << int(p) for p in rng.choice(64, simhash.COPY_RADIUS, replace=False))
        met = [k for k, m in enumerate(first) if not m & diff]
        assert met and all(any(not m & diff for m in second[k]) for k in met)


@pytest.mark.parametrize("bucket", [20, 2048])
def test_near_copies_lose_no_link(spark, monkeypatch, bucket):
    rng = np.random.default_rng(12)
    fps = [int(rng.integers(0, 1 << 62)) ^ int(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 4)), replace=False)) & (1 << 62) - 1) for _ in range(20) for _ in range(1)]
    rows = [(f ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 8)), replace=False)), [int(x) for x in rng.integers(0, 4, 4)]) for f in fps for _ in range(30)]
    rows = [(fp, k, sketch) for k, (fp, sketch) in enumerate(rows)]
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    from motionspark.llm.graph import components

    links = simhash.links_within(spark.createDataFrame(rows, "fp long, name long, sketch array<long>").repartition(3), 7, 3)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    near = lambda a, b: (a[0] ^ b[0]).bit_count() <= 7 and sum((x ^ y).bit_count() for x, y in zip(a[2], b[2], strict=True)) <= 3
    want = roots([r[1] for r in rows], [(a[1], b[1]) for a, b in combinations(rows, 2) if near(a, b)])
    assert {r[1]: got.get(r[1], r[1]) for r in rows} == want


def test_components(spark):
    from motionspark.llm.graph import components

    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 3000 - i) for i in range(100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links if p[0] != p[1] for x in p}, links)
    assert got == want


def slow_secrets(text):
    out = []
    for kind, pattern in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")):
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                out.append((m.start(), ("assign", "access", "hex").index(kind), m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_secrets(docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        rows = secrets.scan(table).collect()
        want = sorted((str(d), hashlib.sha256(slow_secrets(t or "").encode()).hexdigest()) for d, t in pairs(table))
        assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in rows) == want
        assert all(len([x for x in r["spans"].split(",") if x]) == sum(r[f"n_{k}"] for k in secrets.KINDS) for r in rows)
    assert secrets.scan(no_docs).count() == 0
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and not any(slow_secrets(r["text"] or "").count("hex") for r in clean.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())


def test_markov_models_find_random_strings(spark):
    rng = np.random.default_rng(6)
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    words = "alpha beta gamma delta sigma theta kappa lambda omega handler factory manager buffer stream".split()
    name = lambda: "_".join(rng.choice(words, 4)) + "2"
    rows = [(i, f"token = {hexes(40)} and {name()} then {name()}") for i in range(300)]
    hidden = "9f8e7d6c5b4a3f2e1d0c".upper().lower()[:20]
    rows.append((999, f"see q{hidden}x and {name()}"))
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[999]["n_markov"] == 1 and sum(r["n_markov"] for r in got.values()) == 1
