"""Operator 2: personal data by fixed patterns, and information-theoretic sanitisation of the terms that give it away.

Four patterns find e-mail addresses, IP addresses, card numbers and phone numbers; each different value is a protected
entity. Words that go with an entity can give it away even where it is blotted out. How strongly they do is estimated from
co-occurrence in the corpus: the pointwise mutual information of term and entity, PMI = log2 p(c,t) / (p(c) p(t)),
against the information of the entity itself, IC = -log2 p(c); all three count whole documents. In a document that holds
the entity, a term whose share PMI / IC reaches ``REMOVE`` tells (nearly) all about it and is removed wherever it stands;
from ``GENERALISE`` on it is generalised.

A pair counts only with ``SUPPORT`` different surroundings of the entity (the ``NEAR`` terms on each side of its first
place in a document), so copies of one text prove nothing. The share says how rare a term must be to reveal an entity at
all: 1 + log2(p(c|t)) / IC >= GENERALISE means df(t) <= df(c)^GENERALISE n^(1 - GENERALISE). Terms beyond that are left
out before pairs are made, and pairs are counted in the tasks that make them. Texts are read twice, to find values and to
count the documents of the terms that may reveal; only different texts that hold personal data are shuffled.

Edge cases: a null or empty text has no spans; spans count code points, end exclusive; a term span never overlaps a base
span; an entity that every document holds has no information and protects no term; repeated rows get the same spans;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.llm.common import fresh, materialise, small_batches

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
TERM = re.compile(r"[^\W\d_]{4,}")
KINDS = ("email", "ip", "card", "phone", "remove", "generalise")
#: Terms on each side of an entity that tell its surroundings apart.
NEAR = 8
SUPPORT, REMOVE, GENERALISE = 3, 0.95, 0.8
#: Bits of the set that tells, without misses, whether a term is a candidate: its size never grows.
FILTER_BITS = 1 << 23


def emails(text: str):
    """Spans that the pattern for the part before ``@`` and DOMAIN find together, leftmost first."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def part_of_address(digits: str) -> bool:
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind and start."""
    spans = [("email", s, e) for s, e in emails(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(part_of_address(p.lstrip("0")) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return spans


def term_hash(term: str) -> int:
    """As Spark's xxhash64 of the string."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(term.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


class TermHashes(dict):
    """Hash of each term, remembered for as many as fit."""

    def __missing__(self, term: str) -> int:
        h = term_hash(term)
        if len(self) < 200_000:
            self[term] = h
        return h


def free_terms(text: str, spans) -> list[tuple[int, int]]:
    """The terms of ``text`` that overlap none of ``spans``, by one walk along both."""
    taken, out, k = sorted((s, e) for _, s, e in spans), [], 0
    for m in TERM.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        # spans of different kinds may overlap each other, so those that begin before the term's end are all looked at
        j = k
        while j < len(taken) and taken[j][0] < e and taken[j][1] <= s:
            j += 1
        if j == len(taken) or taken[j][0] >= e:
            out.append((s, e))
    return out


def entities(text: str, spans, terms: list[tuple[int, int]]) -> list[dict]:
    """Each different entity of a text with a hash of what surrounds its first place."""
    starts, ends, seen = [s for s, _ in terms], [e for _, e in terms], {}
    for kind, s, e in spans:
        value = term_hash(f"{kind}:{text[s:e].lower() if kind == 'email' else NOT_DIGIT.sub('.', text[s:e])}")
        if value not in seen:
            at = bisect_left(ends, s + 1)  # terms that end at s or before
            after = bisect_left(starts, e)
            near = terms[max(0, at - NEAR) : at] + terms[after : after + NEAR]
            seen[value] = term_hash(" ".join(text[a:b].lower() for a, b in near))
    return [{"entity": c, "around": a} for c, a in seen.items()]


def joined(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, s, e in spans)


ENTITIES = pa.list_(pa.struct([("entity", pa.int64()), ("around", pa.int64())]))
FOUND = "key long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, text string, entities array<struct<entity: long, around: long>>, terms array<long>"


def find(texts: DataFrame) -> DataFrame:
    """One row a document (key, doc_id, text) with its base spans; those that have any keep their text, their entities and
    their different terms."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("base", pa.string()), ("text", pa.string()), ("entities", ENTITIES), ("terms", pa.list_(pa.int64()))])

    def run(batches):
        hashes = TermHashes()
        for batch in batches:
            rows = []
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = base_spans(text or "")
                base, kinds = joined(spans), Counter(k for k, _, _ in spans)
                more = (None, None, None)
                if spans:
                    terms = free_terms(text, spans)
                    more = (text, entities(text, spans, terms), [hashes[t] for t in {text[s:e].lower() for s, e in terms}])
                rows.append((key, doc_id, *(kinds[k] for k in KINDS[:4]), hashlib.sha256(base.encode()).hexdigest(), base, *more))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.mapInArrow(run, FOUND)


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """A set of hashes without misses as ``FILTER_BITS`` bits: its size never grows, only its false hits do."""
    bits = hashes.select(F.pmod(F.col(column), F.lit(FILTER_BITS)).alias("at"))
    words = bits.selectExpr("at div 64 as word", "shiftleft(1L, cast(at % 64 as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()  # at most FILTER_BITS / 64 rows
    return table.astype("<i8").view(np.uint8)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % FILTER_BITS  # numpy's remainder is not negative, as pmod
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def term_frequencies(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(term, df): documents that hold each candidate term. Tasks keep only words that pass a filter of fixed size, and
    count before the shuffle; the join drops the filter's false hits."""
    passed = texts.sparkSession.sparkContext.broadcast(bitmap(candidates, "term"))

    def count(batches):
        bits, counts, known = passed.value, Counter(), {}

        def take():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for term in {t.lower() for t in set(TERM.findall(text or ""))}:  # taken first: some letters lower to two code points
                    hit = known.get(term, 0)
                    if hit == 0:
                        h = term_hash(term)
                        at = h % FILTER_BITS
                        hit = h if bits[at >> 3] >> (at & 7) & 1 else None
                        if len(known) < 200_000:
                            known[term] = hit
                    if hit is not None:
                        counts[hit] += 1
            if len(counts) > 200_000:
                yield take()
                counts = Counter()
        yield take()

    counted = texts.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    return counted.join(candidates.select("term"), "term", "left_semi")


def pair_hash(entity: np.ndarray, term: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (entity.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ term.view(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h.view(np.int64)


def pairs_of(held: DataFrame, wanted=None) -> DataFrame:
    """Pairs of an entity and a term that is rare enough to reveal it, from rows of key, copies, near (entity, around, df)
    and rare (term, df sorted). Counted by (entity, around, term) in each task; or, given a filter of ``wanted`` pairs,
    those alone with their key. Entities come in blocks, so a text with very many is dealt to several tasks."""
    block = 64
    starts = F.explode(F.sequence(F.lit(0), (F.size("near") - 1) - (F.size("near") - 1) % block, F.lit(block)))
    rows = held.withColumn("block", starts).withColumn("near", F.slice("near", F.col("block") + 1, block)).repartition("key", "block")
    names = ["entity", "around", "term", "df_entity", "df_term", "copies"] if wanted is None else ["key", "entity", "term"]
    schema = ", ".join(f"{n} long" for n in names)

    def run(batches):
        parts, size = [], 0

        def take():
            x = np.concatenate(parts, axis=1)
            if wanted is None:
                order = np.lexsort(x[:3])
                x = x[:, order]
                first = np.concatenate([[0], np.nonzero((x[:3, 1:] != x[:3, :-1]).any(0))[0] + 1])
                x = np.concatenate([x[:5, first], np.add.reduceat(x[5], first)[None]])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                terms = np.array([[t["term"], t["df"]] for t in r["rare"]], np.int64).reshape(-1, 2).T
                for c in r["near"]:
                    n = np.searchsorted(terms[1], c["most"], "right")
                    if wanted is None:
                        part = np.array([[c["entity"]], [c["around"]], [0], [c["df"]], [0], [r["copies"]]], np.int64).repeat(n, 1)
                        part[2], part[4] = terms[0, :n], terms[1, :n]
                    else:
                        term = terms[0, :n]
                        term = term[passes(wanted.value, pair_hash(np.full(len(term), c["entity"]), term))]
                        part = np.array([[r["key"]], [c["entity"]], [0]], np.int64).repeat(len(term), 1)
                        part[2] = term
                    parts.append(part)
                    size += part.shape[1]
                    if size > 500_000:
                        yield take()
                        parts, size = [], 0
        if size:
            yield take()

    return rows.select("key", "copies", "near", "rare").mapInArrow(run, schema)


def revealing(found: DataFrame, texts: DataFrame, support: int, generalise: float) -> tuple[DataFrame, DataFrame] | None:
    """(entity, term, share) of the pairs whose share PMI / IC is at least ``generalise``, and the texts that may hold
    such pairs; None if there are none."""
    held = found.filter("base <> ''").groupBy("key").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    held = materialise(held, "held")
    n_docs = found.count()
    near = held.select("key", "copies", F.explode("entities").alias("x")).select("key", "copies", "x.entity", "x.around")
    known = near.groupBy("entity", "around").agg(F.sum("copies").alias("n")).groupBy("entity").agg(F.count("*").alias("support"), F.sum("n").alias("df"))
    known = known.filter((F.col("support") >= support) & (F.col("df") < n_docs)).select("entity", "df")
    # a term in more documents than this cannot reveal the entity; one more for rounding
    most = F.ceil(F.pow(F.col("df").cast("double"), F.lit(generalise)) * F.pow(F.lit(float(n_docs)), F.lit(1 - generalise))).cast("long") + 1
    known = materialise(known.withColumn("most", most), "entities")
    bound = known.agg(F.max("most")).first()[0]
    if bound is None:
        return None
    near = near.drop("copies").join(known, "entity").groupBy("key").agg(F.collect_list(F.struct("entity", "around", "df", "most")).alias("near"))
    near = materialise(near.join(held.select("key", "copies", "terms"), "key"), "linked")
    candidates = near.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("term")
    candidates = materialise(candidates, "candidates")
    df = materialise(term_frequencies(texts, candidates).filter(F.col("df") <= bound), "frequencies")
    rare = near.sparkSession.sparkContext.broadcast(bitmap(df, "term"))

    def filtered(batches):
        for batch in batches:
            terms = batch.column(1)
            flat = terms.flatten().to_numpy()
            fine = passes(rare.value, flat)
            key = np.repeat(batch.column(0).to_numpy(), terms.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key[fine]), pa.array(flat[fine])], names=["key", "term"])

    terms = near.select("key", "terms").mapInArrow(filtered, "key long, term long").join(df, "term")
    terms = terms.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("rare"))
    linked = materialise(near.drop("terms").join(terms, "key"), "rare")
    pairs = pairs_of(linked).groupBy("entity", "around", "term").agg(F.max("df_entity").alias("df_entity"), F.max("df_term").alias("df"), F.sum("copies").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("support"), F.max("df_entity").alias("df_entity"), F.max("df").alias("df"), F.sum("n").alias("df_both"))
    pmi = F.log2(F.col("df_both").cast("double") * n_docs / (F.col("df_entity") * F.col("df")))
    share = pmi / F.log2(F.lit(float(n_docs)) / F.col("df_entity"))
    pairs = pairs.filter(F.col("support") >= support).select("entity", "term", share.alias("share")).filter(F.col("share") >= generalise)
    pairs = materialise(pairs, "revealing")
    return None if pairs.isEmpty() else (pairs, linked)


def term_spans(held: DataFrame) -> DataFrame:
    """key, more, n_remove and n_generalise of texts with ``hits`` (term, removed): every place of a hit that overlaps no
    base span."""
    schema = pa.schema([("key", pa.int64()), ("more", pa.string()), ("n_remove", pa.int64()), ("n_generalise", pa.int64())])

    def run(batches):
        hashes = TermHashes()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                hits = {h["term"]: h["removed"] for h in r["hits"]}
                base = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["base"].split(","))]
                got = ([], [])
                for s, e in free_terms(r["text"], base):
                    removed = hits.get(hashes[r["text"][s:e].lower()])
                    if removed is not None:
                        got[0 if removed else 1].append((s, e))
                more = joined((kind, s, e) for kind, spans in zip(KINDS[4:], got, strict=True) for s, e in spans)
                rows.append((r["key"], more, len(got[0]), len(got[1])))
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return held.select("key", "text", "base", "hits").mapInArrow(run, "key long, more string, n_remove long, n_generalise long")


def sanitise(docs: DataFrame, support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_remove and n_generalise of every document."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select(F.xxhash64("text").alias("key"), "doc_id", "text")
    found = materialise(find(texts), "personal")
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    zero = F.lit(0).cast("long")
    got = revealing(found, texts, support, generalise)
    if got is None:
        return found.select(*columns, F.col("base").alias("spans"), zero.alias("n_remove"), zero.alias("n_generalise"))
    pairs, linked = got
    wanted = docs.sparkSession.sparkContext.broadcast(pair_bitmap(pairs))
    hits = pairs_of(linked, wanted).join(pairs, ["entity", "term"]).groupBy("key", "term").agg((F.max("share") >= remove).alias("removed"))
    hits = materialise(hits.groupBy("key").agg(F.collect_list(F.struct("term", "removed")).alias("hits")), "hits")
    texts = found.filter("base <> ''").join(hits.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"), F.first("base").alias("base"))
    more = materialise(term_spans(texts.join(hits, "key")), "terms")
    whole = found.select("key", *columns, "base").join(more, "key", "left")
    spans = F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif("more", F.lit("")))
    return whole.select(*columns, spans.alias("spans"), F.coalesce("n_remove", zero).alias("n_remove"), F.coalesce("n_generalise", zero).alias("n_generalise"))


def pair_bitmap(pairs: DataFrame) -> np.ndarray:
    """The filter of the pairs themselves."""

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pair_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy()))], names=["h"])

    return bitmap(pairs.select("entity", "term").mapInArrow(hashed, "h long"), "h")


def clean(text: str | None, listed: str | None) -> str | None:
    """``text`` with its spans (as ``sanitise`` gives them) blotted out: base spans and generalised terms become their
    kind in angle brackets, removed terms go."""
    if not text or not listed:
        return text
    out, at = [], 0
    for s, e, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in listed.split(","))):
        if s >= at:
            out += [text[at:s], {"remove": "", "generalise": "<TERM>"}.get(kind, f"<{kind.upper()}>")]
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitised_texts(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with their texts blotted out by ``spans``, what ``sanitise`` gives for them. A row gets the spans of its
    own id if all rows of that id have the same spans; ids that stand for several different texts are an error. Only
    documents with spans are joined; every other column stays as it is."""

    @F.pandas_udf("string")
    def blot(texts: pd.Series, listed: pd.Series) -> pd.Series:
        return pd.Series([clean(t, x) for t, x in zip(texts, listed, strict=True)], dtype="object")

    key, listed = fresh("spans_of", docs), fresh("listed_spans", docs)
    marked = spans.groupBy("doc_id").agg(F.max("spans").alias("most"), F.min("spans").alias("least")).filter("most <> ''")
    one = F.when(F.col("most") == F.col("least"), F.col("most")).otherwise(F.raise_error(F.concat(F.lit("different texts with id "), F.col("doc_id").cast("string"))).cast("string"))
    marked = marked.select(F.col("doc_id").alias(key), one.alias(listed))
    both = docs.join(marked, F.col(id_col).eqNullSafe(F.col(key)), "left")
    return both.withColumn(text_col, blot(F.col(text_col), F.col(listed))).select(*docs.columns)
