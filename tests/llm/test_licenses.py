"""Operator 11: base places against plain search, and license texts with words changed, inserted and left out."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionspark.llm import licenses, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def slow_base(text):
    """(n_words, places, labels) of the base phrases."""
    words, places, labels = words_of(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), sorted(places), ",".join(sorted(labels))


def slow_coverage(text, template, k=licenses.GRAM):
    """The share of the template's words that equal k-grams on neighbouring diagonals cover, of the best group."""
    words, t = words_of(text), words_of(template.text)
    shift = 0 if template.phrase else max(licenses.SHIFT, len(t) // 10)
    at = {}
    for j in range(len(t) - k + 1):
        at.setdefault(tuple(t[j : j + k]), []).append(j)
    votes = {}
    for i in range(len(words) - k + 1):
        for j in at.get(tuple(words[i : i + k]), ()):
            votes.setdefault(i - j, set()).add(j)
    best, group, last = 0.0, set(), None
    for d in sorted(votes):
        group = votes[d] | (group if last is not None and d - last <= shift else set())
        best, last = max(best, len({j + x for j in group for x in range(k)}) / len(t)), d
    return best


def digest(spark, df, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: df)
    return queries.op11_licenses(spark, "")


def check(rows, texts):
    want = []
    for doc_id, text in texts:
        n, places, labels = slow_base(text)
        cover = [(slow_coverage(text, t), t) for t in licenses.TEMPLATES]
        taken = {t.label for c, t in cover if c >= (1 if t.phrase else licenses.COVERAGE)}
        score = max([c for c, _ in cover])
        want.append((doc_id, n, len(places), places[0] if places else None, places[-1] if places else None, labels, ",".join(sorted(taken)), round(score, 9)))
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_licenses_against_brute_force(spark, docs, odd_docs, no_docs, monkeypatch):
    for table in (docs, odd_docs):
        check(digest(spark, table, monkeypatch).collect(), [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()])
    assert digest(spark, no_docs, monkeypatch).count() == 0


def test_places_of_phrases(spark, monkeypatch):
    say = "Under THE mit,license cc-by (nc) cc by\nNC under the mit the mit license Apache LICENSE; version 2.0 apache licence version 2 Ünder the mit license éunder the mit license under the mit licenses"
    rows = [(1, say), (2, None), (3, ""), (4, "cc by nc"), (5, " ".join(["cc by nc"] * 500)), (6, "cc by"), (7, "under the\x00mit@license" + "x" * 3000), (8, "KELVIN K cc by nc İ")]
    df = spark.createDataFrame(rows + [rows[0]] * 3, "doc_id long, text string").withColumns({"label": F.lit(1), "word": F.lit("x"), "spans": F.lit(None)}).repartition(3)
    check(digest(spark, df, monkeypatch).collect(), rows + [rows[0]] * 3)


@pytest.mark.parametrize("label", sorted({label for label, _ in licenses.TEXTS}))
def test_changed_texts_are_found(spark, label):
    rng = np.random.default_rng(11)
    noise = lambda n: [f"w{k}" for k in rng.integers(0, 10**6, n)]
    docs, long = [], [t for name, t in licenses.TEXTS if name == label]
    for i, text in enumerate(t for t in long for _ in range(4)):
        words = words_of(text)
        if len(words) >= 40:  # two words more, two less, one other
            for at in sorted(rng.choice(np.arange(3, len(words) - 3), 3, replace=False))[::-1]:
                words[at : at + 1] = [words[at], *noise(2)] if i % 3 == 0 else [] if i % 3 == 1 else noise(1)
        docs.append((i, " ".join(noise(50) + words + noise(50)), len(words)))
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    for r in licenses.scan(df).collect():
        spans = [s for s in r["spans"] if s["label"] == label]
        assert spans and min(s["first_word"] for s in spans) >= 50 and max(s["end_word"] for s in spans) <= 50 + docs[r["doc_id"]][2]
        assert r["n_words"] == 100 + docs[r["doc_id"]][2] and r["score"] >= licenses.COVERAGE


def test_ordinary_texts_are_left_alone(spark):
    vocabulary = sorted({w for _, t in licenses.TEXTS for w in words_of(t)})
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(i, " ".join(rng.choice(vocabulary, 3000))) for i in range(20)], "doc_id long, text string")
    assert all(not r["spans"] and r["score"] < 0.8 for r in licenses.scan(df).collect())


def test_long_texts_are_read_in_pieces(spark):
    text = "under the mit license " + "word, " * 400_000 + "Under the MIT License"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_words"] == 400_008 and [s["first_word"] for s in row["spans"] if s["phrase"]] == [0, 400_004]
    with pytest.raises(ValueError, match="a template needs 3 words"):
        licenses.template_grams(spark, [licenses.Template("x", "two words")])
