"""Texts that are long, hostile or oddly placed: the scanners stay exact and take time in proportion to the length."""

import hashlib
import math
import string
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import slow_personal, slow_secrets

from motionspark.llm import pii, secrets


def hostile(n: int) -> list[str]:
    """Texts of about ``n`` characters that make careless patterns take quadratic time."""
    return [
        "k" * n, "aZ9" * (n // 3), "0" * (n // 2) + "1.2.3.4", "1." * (n // 2), "+1" + " (" * (n // 2), "a@" * (n // 2), "x@y." * (n // 4),
        " ".join(f"user{i}@mail{i % 97}.example.com some words here" for i in range(n // 45)),
        " ".join(f"{i:032x} plain words again" for i in range(n // 50)), "token" + " " * n + ":", "token=" * (n // 6), "4111 1111 1111 1111 " * (n // 20),
    ]


def test_scanners_against_brute_force_on_hostile_texts():
    for text in hostile(3000):
        rules = sorted(secrets.rule_spans(text), key=lambda x: (x[0], secrets.KINDS.index(x[2])))
        assert ",".join(f"{k}:{s}:{e}" for s, e, k in rules) == slow_secrets(text), text[:20]
        assert pii.base_spans(text) == slow_personal(text), text[:20]
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [("ip", 0, 5007)]


@pytest.mark.parametrize("k", range(12))
def test_scanners_take_linear_time(k):
    text, table = hostile(1_000_000)[k], np.zeros(secrets.STATES**2)
    start = time.monotonic()
    base = pii.base_spans(text)
    pii.entities(text, base, pii.free_terms(text, base))
    secrets.all_spans(text, secrets.Scores(table, 0.7, 14.0))
    assert time.monotonic() - start < 10, text[:20]


def test_long_texts_as_rows(spark):
    rows = list(enumerate(hostile(300_000)))
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string")
    assert pii.sanitise(docs).count() == secrets.scan(docs).count() == 2 * len(rows)
    assert secrets.redact(docs, length_col=None).count() == 2 * len(rows)


def free(spans, s, e):
    return all(e <= a or b <= s for _, a, b in spans)


def test_free_terms_and_tokens():
    text = "alpha beta,gamma  delta 12345 epsilon zeta eta theta"
    rng = np.random.default_rng(3)
    for _ in range(300):
        spans = [("x", int(a), int(a + n)) for a, n in zip(rng.integers(0, len(text), 4), rng.integers(1, 20, 4), strict=True)]
        assert pii.free_terms(text, spans) == [m.span() for m in pii.TERM.finditer(text) if free(spans, *m.span())]
        tokens = "abcdefghijkl.mnop- qrstuvwxyz012345. x 0123456789_ABCDEFG=="
        cut = [(s, e, k) for k, s, e in spans]
        want = [(m.start(), m.start() + len(m[0].rstrip("/_=.-"))) for m in secrets.TOKEN.finditer(tokens)]
        assert secrets.others(tokens, cut) == [(s, e) for s, e in want if e - s >= secrets.MIN_TOKEN and free(spans, s, e)]


def slow_sanitise(texts, support, remove, generalise):
    """{row: extra spans} from the definition, pair by pair."""
    n = len(texts)
    base = [pii.base_spans(t or "") for t in texts]
    terms = [[(m[0].lower(), *m.span()) for m in pii.TERM.finditer(t or "") if free(b, *m.span())] for t, b in zip(texts, base, strict=True)]
    held, around = defaultdict(set), {}
    for i, (t, spans) in enumerate(zip(texts, base, strict=True)):
        for kind, s, e in spans:
            value = (kind, t[s:e].lower() if kind == "email" else pii.NOT_DIGIT.sub(".", t[s:e]))
            if i not in held[value]:
                held[value].add(i)
                left, right = [w for w, _, b in terms[i] if b <= s][-pii.NEAR :], [w for w, a, _ in terms[i] if a >= e][: pii.NEAR]
                around[value, i] = " ".join(left + right)
    df = Counter(w for i in range(n) for w in {w.lower() for w in pii.TERM.findall((texts[i] or "").lower())})
    share = {}
    for value, rows in held.items():
        both = defaultdict(list)
        for i in rows:
            for w in {w for w, _, _ in terms[i]}:
                both[w].append(i)
        for w, at in both.items():
            if len({around[value, i] for i in at}) >= support and len(rows) < n:
                x = math.log2(len(at) * n / (len(rows) * df[w])) / math.log2(n / len(rows))
                if x >= generalise:
                    share[value, w] = x
    out = []
    for i in range(n):
        hits = [(4 if x >= remove else 5, a, b) for w, a, b in terms[i] if (x := max((share.get((v, w), 0) for v, rows in held.items() if i in rows), default=0)) >= generalise]
        out.append(",".join(f"{k}:{s}:{e}" for k, s, e in [*base[i], *((pii.KINDS[k], s, e) for k, s, e in sorted(hits))]))
    return out


def test_sanitising_against_brute_force(spark, docs):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(120)]
    say = lambda n: " ".join(words[int(k)] for k in np.minimum(rng.zipf(1.3, n), 120) - 1)
    people = [(f"p{k}@mail.example.com", f"surname{'abcdefghij'[k]}x") for k in range(8)]
    texts = []
    for i in range(400):
        mail, name = people[int(rng.integers(0, 8))]
        # the name stands at the head of the letter, the address at its foot
        texts.append(f"Dear {name}, {say(60)} {name} {say(30)} {mail if i % 3 else ''} 10.0.0.{i % 5}" if i % 2 else say(40))
    texts += [texts[1]] * 7 + ["", "x@y.zz 1.2.3.4 x@y.zz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for options in ({}, {"support": 2, "remove": 0.9, "generalise": 0.6}):
        given = {"support": pii.SUPPORT, "remove": pii.REMOVE, "generalise": pii.GENERALISE} | options
        want = slow_sanitise(texts, **given)
        got = {r["doc_id"]: r for r in pii.sanitise(rows, **options).collect()}
        assert [got[i]["spans"] for i in range(len(texts))] == want
        assert sum(r["n_remove"] + r["n_generalise"] for r in got.values()) > 200
    clean = pii.sanitised_texts(rows, pii.sanitise(rows))
    assert not any("surname" in r["text"] for r in clean.collect() if "<EMAIL>" in r["text"])
    real = [r["text"] for r in docs.select("text").collect()]
    got = {r["doc_id"]: r["spans"] for r in pii.sanitise(spark.createDataFrame(list(enumerate(real)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(real))] == slow_sanitise(real, pii.SUPPORT, pii.REMOVE, pii.GENERALISE)


def test_sanitised_texts_of_odd_rows(spark, odd_docs, no_docs):
    odd = odd_docs.withColumn("spans_of", F.lit(1)).withColumn("Listed_Spans", F.lit("x"))
    once = odd.dropDuplicates(["doc_id"])
    got = pii.sanitised_texts(once, pii.sanitise(once))
    assert got.columns == once.columns and got.count() == once.count()
    same = odd.filter("doc_id = 3")
    assert pii.sanitised_texts(same, pii.sanitise(same)).count() == same.count() == 2
    assert pii.sanitised_texts(no_docs, pii.sanitise(no_docs)).count() == 0
    two = spark.createDataFrame([(1, "a@b.cc"), (1, "none")], "doc_id long, text string")
    with pytest.raises(Exception, match="different texts with id 1"):
        pii.sanitised_texts(two, pii.sanitise(two)).collect()


def test_random_tokens_by_length(spark):
    """Trained on the test corpus, the models find random keys of any length from ``MIN_TOKEN`` on, and no prose."""
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text")
    table = secrets.ratio_table(texts)
    scores, rng = secrets.Scores(table, secrets.THRESHOLD, secrets.EVIDENCE), np.random.default_rng(4)
    mixed = list(string.ascii_letters + string.digits)
    for length, least in ((10, 0.8), (12, 0.85), (16, 0.95), (20, 0.97), (40, 0.99)):
        assert np.mean(scores.random(["".join(rng.choice(mixed, length)) for _ in range(400)])) >= least
    prose = [t for r in texts.collect() for t in [(r["text"] or "")[s:e] for s, e in secrets.others(r["text"] or "", secrets.rule_spans(r["text"] or ""))]]
    assert np.mean(scores.random(prose)) < 0.001


def test_spans_of_the_models_against_brute_force(spark, docs, odd_docs):
    for table in (docs, odd_docs):
        texts = [(r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text").collect()]
        seen = np.full((2, secrets.STATES, secrets.STATES), 0.5)
        code = lambda c: secrets.ALPHABET.find(c) if c in secrets.ALPHABET else secrets.OTHER
        for _, t in texts:
            spans = secrets.rule_spans(t)
            for label, tokens in enumerate(([t[s:e] for s, e in secrets.others(t, spans)], secrets.values(t, spans))):
                for token in tokens:
                    for a, b in zip([None, *token], token, strict=False):
                        seen[label, secrets.START if a is None else code(a), code(b)] += 1
        ratio = np.log(seen[1] / seen[1].sum(1)[:, None]) - np.log(seen[0] / seen[0].sum(1)[:, None])
        want = []
        for d, t in texts:
            spans = secrets.rule_spans(t)
            for s, e in secrets.others(t, spans):
                total = sum(ratio[secrets.START if a is None else code(a), code(b)] for a, b in zip([None, *t[s:e]], t[s:e], strict=False))
                if total >= secrets.EVIDENCE and total / (e - s) >= secrets.THRESHOLD:
                    spans = [*spans, (s, e, "markov")]
            ordered = sorted(spans, key=lambda x: (x[0], secrets.KINDS.index(x[2])))
            want.append((str(d), ",".join(f"{k}:{s}:{e}" for s, e, k in ordered), hashlib.sha256(slow_secrets(t).encode()).hexdigest()))
        got = [(str(r["doc_id"]), r["spans"], r["base_sha256"]) for r in secrets.scan(table).collect()]
        assert sorted(got) == sorted(want)
