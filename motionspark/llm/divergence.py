"""Operator 13: how sources of one language differ in their words, by a two-pass vocabulary automaton.

The first pass counts in how many documents of a language each term stands; the terms of ``MIN_DOCS`` documents or more are
its vocabulary. The second pass reads the documents again with an Aho-Corasick automaton of the kept terms, each padded
by a delimiter on both sides, and counts every occurrence by language and source. The counts (postings: only terms that a
source has) give smoothed shares in parts of 10^9, in whole numbers throughout:

    p = 1 + floor(10^9 * (count + 1) / (all counts of the group + number of kept terms)),   f(p, q) = floor((p - q)^2 / q)

``pair`` rows sum f over the whole vocabulary for each ordered pair of sources of a language. A term that a source lacks
has the source's least share p0, so the sum is taken from postings alone:

    V f(p0a, p0b)  +  sum over a's terms of f(pa, p0b) - f(p0a, p0b)  +  the same for b's terms
                   +  sum over common terms of f(pa, pb) - f(pa, p0b) - f(p0a, pb) + f(p0a, p0b)

The second and third sums need only how often each share comes in a source; the last one is taken in blocks of terms and
of sources with NumPy. ``term`` rows rank each source's terms against the whole language.

Memory: the vocabulary is cut into shards of ``SHARD_BYTES`` (all of the check data are one shard); a shard is sent to the
tasks and scanned for before the next, so no task and no driver holds more than one of them. A term of more than
``LONG_BYTES`` bytes stands in the automaton by its SHA-256.

Edge cases: null text, lang or source count as ''. Repeated rows are documents of their own. A language without kept terms
has pairs of value 0 and no terms; an empty table gives no rows; other columns are ignored. Bytes that are no UTF-8 count as
U+FFFD. A text of any length is read in pieces.
"""

from __future__ import annotations

import hashlib
import re
import string
import uuid
from collections import Counter, defaultdict
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionspark.llm.common import materialise, rows_per_batch, ship_package
from motionspark.llm.words import blanked, pieces

MIN_DOCS = 3
TOP_TERMS = 200
SHARD_BYTES = 12 << 20
LONG_BYTES = 256
#: Postings of one block of terms, and sources of one block of sources.
BLOCK_POSTINGS = 30_000
BLOCK_SOURCES = 500
#: Rows of the table of groups up to which it is broadcast.
BROADCAST_GROUPS = 100_000
#: Entries of a task's counts, bytes of text and occurrences of terms after which it hands them on.
HELD_ENTRIES = 400_000
HELD_BYTES = 64 << 20
HELD_TERMS = 3_000_000
#: Rows that are taken from a batch at a time.
ROWS = 500
LETTERS = blanked(string.ascii_letters.encode())
LONG_WORD = re.compile(rb"[^ ]{%d,}" % (LONG_BYTES + 1))


def group_columns(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def handed_on(group: tuple[str, ...], terms: pa.Array, numbers: pa.Array, names: list[str], rows: int = 50_000):
    """Record batches of the group's columns, its terms and their numbers."""
    for k in range(0, len(terms), rows):
        part = terms.slice(k, rows)
        yield pa.RecordBatch.from_arrays([*(pa.repeat(pa.scalar(g, pa.string()), len(part)) for g in group), part, numbers.slice(k, rows)], names=names)


def parts(batches, rows: int = ROWS):
    """The batches in parts of a few rows, so that few texts are copied at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def spelled(terms: pa.Array) -> pa.Array:
    """Terms as strings; bytes that are no UTF-8 as U+FFFD."""
    try:
        return terms.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in terms.to_pylist()], pa.string())


#: The automata that a worker holds: those of one shard.
_BUILT: dict[str, dict] = {}


def forget() -> None:
    _BUILT.clear()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term, docs: the number of documents of the language that hold the term."""

    def count(batches):
        seen, held = defaultdict(Counter), 0

        def taken():
            for lang, own in seen.items():
                yield from handed_on((lang,), spelled(pa.array(own.keys(), pa.binary())), pa.array(own.values(), pa.int64()), ["lang", "term", "docs"])

        forget()  # of an earlier audit
        for batch in parts(batches):
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = set()
                for piece in pieces((raw or b"").translate(LETTERS)):
                    terms.update(piece.split())
                seen[lang].update(terms)
                held += len(raw or b"")
            if held > HELD_BYTES or sum(map(len, seen.values())) > HELD_ENTRIES:
                yield from taken()
                seen, held = defaultdict(Counter), 0
        yield from taken()

    texts = docs.select(group_columns(docs)[0], F.col("text").cast("string").cast("binary").alias("raw"))
    return texts.mapInArrow(count, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def shortened(piece: bytes) -> str:
    """``piece`` between two delimiters, with its long words by their digests."""
    if LONG_WORD.search(piece):
        piece = LONG_WORD.sub(lambda m: b"\x01" + hashlib.sha256(m[0].decode("utf-8", "replace").encode()).hexdigest().encode(), piece)
    return f" {piece.decode('utf-8', 'replace')} "


def automata(shard: tuple[str, dict[str, pa.Array]]) -> dict:
    """The automaton of each language of a shard, which gives the places of keys; a worker keeps those of the last shard."""
    import ahocorasick

    name, vocabulary = shard
    if name not in _BUILT:
        _BUILT.clear()
        built = {}
        for lang, keys in vocabulary.items():
            built[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k in range(0, len(keys), 10_000):
                for i, key in enumerate(keys.slice(k, 10_000).to_pylist(), k):
                    built[lang].add_word(f" {key} ", i)
            built[lang].make_automaton()
        _BUILT[name] = built
    return _BUILT[name]


def occurrences(docs: DataFrame, vocabulary: dict[str, pa.Array]) -> DataFrame:
    """lang, source, key, count: how often the keys of ``vocabulary`` (by language) occur."""
    shard = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, vocabulary))

    def count(batches):
        built, number = automata(shard.value), itemgetter(1)
        seen, held = defaultdict(list), 0

        def taken():
            for group, parts in seen.items():
                places, numbers = np.unique(np.concatenate(parts), return_counts=True)
                yield from handed_on(group, shard.value[1][group[0]].take(pa.array(places)), pa.array(numbers, pa.int64()), ["lang", "source", "key", "count"])

        for batch in parts(batches):
            for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if raw and lang in built:
                    for piece in pieces(raw.translate(LETTERS)):
                        found = np.fromiter(map(number, built[lang].iter(shortened(piece))), np.int32)
                        seen[lang, source].append(found)
                        held += len(found)
                        if held > HELD_TERMS:
                            yield from taken()
                            seen, held = defaultdict(list), 0
        yield from taken()

    texts = docs.select(*group_columns(docs), F.col("text").cast("string").cast("binary").alias("raw"))
    return texts.mapInArrow(count, "lang string, source string, key string, count long").groupBy("lang", "source", "key").agg(F.sum("count").alias("count"))


def postings(docs: DataFrame, kept: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, source, key, count of all kept terms, shard by shard."""
    shards = max(1, -(-int(kept.agg(F.sum(F.octet_length("key") + 2)).first()[0] or 0) // shard_bytes))
    found = []
    for k in range(shards):
        own = kept.filter(F.pmod(F.xxhash64("lang", "key"), F.lit(shards)) == k).select("lang", "key", "docs").toArrow().sort_by([("docs", "descending")])  # bounded by shard_bytes
        vocabulary = {lang: own.filter(pc.equal(own["lang"], lang))["key"].combine_chunks() for lang in own["lang"].unique().to_pylist()}
        found.append(materialise(occurrences(docs, vocabulary), f"postings-{k}"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def share(count, n, v) -> Column:
    """1 + floor(10^9 (count + 1) / (n + v)), in whole numbers of any size."""
    exact = f"cast((cast(1000000000 as decimal(38,0)) * ({count} + 1)) div ({n} + {v}) as bigint)"
    return F.expr(f"1 + case when {count} < 9000000000 then (1000000000L * ({count} + 1)) div ({n} + {v}) else {exact} end")


def difference(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def common_terms(block: pd.DataFrame, lo: int, hi: int) -> pd.DataFrame:
    """Of a block of postings (key, source, part, count, p, p0), for each source a of part ``lo`` and b of part ``hi``, and the other way round: the sum
    over their common terms of f(pa, pb) - f(pa, p0b) - f(p0a, pb) + f(p0a, p0b). A share follows from source and count, so
    pairs of small counts are counted by (source, count, source, count) and their values taken once each."""
    keys, (sources, names) = pd.factorize(block["key"])[0], pd.factorize(block["source"])
    order = np.argsort(keys, kind="stable")
    keys, sources = keys[order], sources[order]
    part, counts, p, p0 = (block[c].to_numpy(np.int64)[order] for c in ("part", "count", "p", "p0"))
    n, small = len(names), max(1, min(16, 2000 // max(1, len(names))))
    cell = np.where(counts < small, sources * small + counts, -1)
    of_cell, of_source = np.ones(n * small, np.int64), np.ones(n, np.int64)
    of_cell[cell[cell >= 0]], of_source[sources] = p[cell >= 0], p0
    out, often = np.zeros((n, n), np.int64), np.zeros((n * small) ** 2, np.int64)
    value = lambda pa, pb, qa, qb: gap(pa, pb) - gap(pa, qb) - gap(qa, pb) + gap(qa, qb)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    sizes = np.diff(first, append=len(keys))
    made = np.cumsum(sizes * sizes)
    k = 0
    while k < len(first):  # as many terms at a time as make a few million pairs
        end = max(k + 1, int(np.searchsorted(made, 4_000_000 + (made[k - 1] if k else 0), "right")))
        last = np.repeat(first[k:end] + sizes[k:end], sizes[k:end])
        own = np.arange(first[k], first[k] + len(last))
        later = last - own - 1  # postings of the term that come after
        a = np.repeat(own, later)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
        if lo != hi:
            use = part[a] != part[b]
            a, b = a[use], b[use]
        both = (cell[a] >= 0) & (cell[b] >= 0)
        often += np.bincount(cell[a[both]] * (n * small) + cell[b[both]], minlength=len(often))
        a, b = a[~both], b[~both]
        np.add.at(out, (sources[a], sources[b]), value(p[a], p[b], p0[a], p0[b]))
        np.add.at(out, (sources[b], sources[a]), value(p[b], p[a], p0[b], p0[a]))
        k = end
    at = np.flatnonzero(often)
    a, b, times = at // (n * small), at % (n * small), often[at]
    sa, sb = a // small, b // small
    np.add.at(out, (sa, sb), times * value(of_cell[a], of_cell[b], of_source[sa], of_source[sb]))
    np.add.at(out, (sb, sa), times * value(of_cell[b], of_cell[a], of_source[sb], of_source[sa]))
    sa, sb = np.nonzero(out)
    return pd.DataFrame({"source": names[sa], "item": names[sb], "value": out[sa, sb]})


def pairs(shares: DataFrame, groups: DataFrame, block_postings: int = BLOCK_POSTINGS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """lang, source, item, value for each ordered pair of sources of a language. ``shares``: lang, source, key, count, p, p0; ``groups``:
    lang, source, v, p0."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    small = groups.count() <= BROADCAST_GROUPS  # and so are the languages
    other = F.broadcast(other) if small else other
    every = groups.join(other, "lang").filter("source <> item").select("lang", "source", "item", F.expr(f"case when v > 0 then v * {difference('p0', 'q0')} else 0 end").alias("value"))

    often = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    met = often.join(other, "lang").filter("source <> item")
    one_has = met.select("lang", F.explode(F.array(
        F.struct("source", "item", F.expr(f"n * ({difference('p', 'q0')} - {difference('p0', 'q0')})").alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"n * ({difference('q0', 'p')} - {difference('q0', 'p0')})").alias("value")),
    )).alias("x")).select("lang", "x.*")

    sizes = shares.groupBy("lang").agg(F.count("*").alias("postings")).join(groups.groupBy("lang").agg(F.count("*").alias("sources")), "lang")
    dealt = shares.join(F.broadcast(sizes) if small else sizes, "lang").select(
        "lang", "key", "source", "count", "p", "p0", F.expr(f"cast(pmod(xxhash64(key), ceil(postings / {block_postings})) as int)").alias("terms"),
        F.expr(f"cast(ceil(sources / {block_sources}) as int)").alias("parts"), F.expr(f"cast(pmod(xxhash64(source), ceil(sources / {block_sources})) as int)").alias("part"),
    )
    blocks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select("lang", "terms", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "key", "source", "part", "count", "p", "p0")

    def run(key, table):
        lang, _, lo, hi = (k.as_py() for k in key)
        found = common_terms(table.to_pandas(), lo, hi)
        found.insert(0, "lang", lang)
        return pa.Table.from_pandas(found, schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]), preserve_index=False)

    both_have = blocks.groupBy("lang", "terms", "lo", "hi").applyInArrow(run, "lang string, source string, item string, value long")
    parts = every.unionByName(one_has).unionByName(both_have)
    return parts.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, shard_bytes: int = SHARD_BYTES, block_postings: int = BLOCK_POSTINGS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    ship_package(docs.sparkSession)
    key = F.when(F.octet_length("term") > LONG_BYTES, F.concat(F.lit("\x01"), F.sha2("term", 256))).otherwise(F.col("term"))
    with rows_per_batch(docs.sparkSession):  # texts can be long
        kept = materialise(document_frequencies(docs).filter(F.col("docs") >= min_docs).select("lang", key.alias("key"), "term", "docs"), "kept")
        found = postings(docs, kept, shard_bytes)

    sums = found.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select(*group_columns(docs)).distinct().join(sums, ["lang", "source"], "left").join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    whole = F.sum("n").over(Window.partitionBy("lang")).alias("lang_n")
    groups = materialise(groups.select("*", F.when(F.col("v") > 0, share("0", "n", "v")).alias("p0"), whole), "groups")
    lang_count = F.sum("count").over(Window.partitionBy("lang", "key")).alias("lang_count")
    shares = found.join(groups, ["lang", "source"]).select("lang", "source", "key", "count", share("count", "n", "v").alias("p"), "p0", "v", "lang_n", lang_count)
    shares = materialise(shares.select("lang", "source", "key", "count", "p", "p0", share("lang_count", "lang_n", "v").alias("q")), "shares")

    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs(shares.drop("q"), groups, block_postings, block_sources).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))
    named = shares.filter("p > q").join(kept.filter("key <> term").select("lang", "key", "term"), ["lang", "key"], "left")
    terms = named.select("lang", "source", F.lit("term").alias("part"), F.coalesce("term", "key").alias("item"), F.expr(difference("p", "q")).alias("value"))
    return ranked.unionByName(terms.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top_terms))
