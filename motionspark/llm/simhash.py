"""Operator 9: SimHash fingerprints of word shingles, linked within a Hamming radius by covering masks.

Covering locality-sensitive hashing: every bit position gets a non-zero vector of r+1 bits; the mask of a non-zero vector
v holds the positions whose vector has an odd product with v. For any r positions some v is orthogonal to all their
vectors, so two fingerprints that differ in at most r bits agree under at least one of the 2^(r+1)-1 masks: no pair
within the radius is missed. A bucket with very many fingerprints is split by covering masks of the bits that its mask
leaves free, which keeps the guarantee; after that at most ``2^free`` different fingerprints share a bucket.

Equal fingerprints are joined before any mask is used, so copies cost one row. Buckets give stars of links, not pairs.

``near_duplicates`` links fingerprints of word shingles by their distance alone. ``near_copies`` looks for texts whose
five-word shingles have a similarity of 0.8 or more. One changed word changes five shingles, so a fingerprint of shingles
would need a radius that no set of masks can cover; the fingerprint that the masks see is that of the single words, each
weighted by the square root of its count, within ``COPY_RADIUS`` bits. With so large a radius the positions are covered
in two halves, one of which differs in half the radius at most. A pair that meets must also agree in a sketch of its
shingles (``SKETCH`` least hashes under as many permutations, one bit each), from which the similarity is estimated with a
standard error of 0.0375 at 0.8; ``SLACK`` is left for it. What such links connect is only a candidate: in each connected
set the pairs that pass both are verified by the exact similarity of their sets of shingles, and only verified pairs join
texts. A pair whose texts verified links have joined already needs no check of its own.

Large buckets, and large sets of candidates, are cut into blocks that are compared two by two in tasks of their own, so no
group of texts that are alike meets in one task.

Edge cases: a null text, or one without words, has fingerprint zero; fewer words than a shingle make one shingle;
rows with a null doc_id take part and can be a component of their own (null); repeated rows get the same component; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.llm.common import materialise, small_batches
from motionspark.llm.graph import components

SEED = 42
#: Largest bucket of different fingerprints that is compared as it is.
BUCKET = 2048
#: Bits in which the word fingerprints of near copies may differ.
COPY_RADIUS = 7
#: Bits of a sketch of shingles.
SKETCH = 256
SLACK = 0.10
#: Texts of a bucket, or of a connected set of candidates, that are compared at once in one task.
BLOCK = 512
#: Different shingles from which on a text keeps 64 bits of each hash instead of 32.
WIDE = 1 << 16


def fingerprint(text: str | None, size: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(flat, seed)
    view, at, starts, ends = memoryview(flat), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    hashes = np.fromiter((xxh64_intdigest(view[s:e], seed) for s, e in zip(starts, ends[size - 1 :], strict=False)), np.uint64, len(words) - size + 1)
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        set_bits += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes), bitorder="little").tobytes(), "little")


def covering_masks(positions: list[int], radius: int, salt: int) -> list[int]:
    """Masks over ``positions`` of which one at least misses any ``radius`` of them."""
    vectors = (1 << (radius + 1)) - 1
    order = np.random.default_rng((SEED, salt)).permutation(len(positions))
    given = {positions[i]: k % vectors + 1 for k, i in enumerate(order)}
    return [sum(1 << p for p, m in given.items() if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]


def cover(positions: list[int], radius: int, salt: int) -> list[int]:
    """Covering masks of ``positions``: of all at once, or beyond a radius of 3 of each half with half the radius, for one
    half differs in no more."""
    if radius <= 3:
        return covering_masks(positions, radius, salt)
    cut = len(positions) // 2
    return covering_masks(positions[:cut], radius // 2, salt) + covering_masks(positions[cut:], radius // 2, salt + 1)


def masks_of(radius: int) -> tuple[list[int], list[list[int]]]:
    first = cover(list(range(64)), radius, 0)
    second = [cover([p for p in range(64) if not mask >> p & 1], radius, 1 + t) for t, mask in enumerate(first)]
    return first, [[mask | m for m in own] for mask, own in zip(first, second, strict=True)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(group: np.ndarray, radius: int, sketches: np.ndarray | None = None, most: int = 0):
    """Row numbers (a < b) of the fingerprints within ``radius`` of each other and, if there are ``sketches``, with sketches that
    differ in at most ``most`` bits; block by block."""
    n, step = len(group), 512
    for i in range(0, n, step):
        for j in range(i, n, step):
            a, b = np.nonzero(np.bitwise_count(group[i : i + step, None] ^ group[None, j : j + step]) <= radius)
            a, b = a + i, b + j
            keep = a < b
            a, b = a[keep], b[keep]
            if sketches is not None:
                keep = np.zeros(len(a), bool)
                for k in range(0, len(a), 100_000):
                    keep[k : k + 100_000] = np.bitwise_count(sketches[a[k : k + 100_000]] ^ sketches[b[k : k + 100_000]]).sum(1) <= most
                a, b = a[keep], b[keep]
            yield a, b


def star_links(group: np.ndarray, radius: int, sketches: np.ndarray | None = None, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) that join the fingerprints of one bucket which are connected by ``close_pairs``."""
    root = np.arange(len(group))
    a, b = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *close_pairs(group, radius, sketches, most), strict=True))
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    moved = np.nonzero(root != np.arange(len(group)))[0]
    return moved, root[moved]


def links_within(prints: DataFrame, radius: int = 2, most: int | None = None) -> DataFrame:
    """``prints``: distinct fingerprints fp (long). Links (a, b) that connect all those within ``radius`` bits. With
    ``most``, ``prints`` has a name (long) and a sketch (array of longs) too; links are of names, and sketches differ in no
    more bits than that."""
    first, second = masks_of(radius)
    sketched = most is not None
    if not sketched:
        prints = prints.select("fp", F.col("fp").alias("name"))

    def linked(batches):
        import pyarrow as pa

        for batch in batches:
            for group in batch.column(0):
                # names of one fingerprint are distinct, so the order is fixed
                members = pa.RecordBatch.from_struct_array(group.values).sort_by([("fp", "ascending"), ("name", "ascending")])
                fp, name = (members.column(k).to_numpy() for k in (0, 1))
                order = np.argsort(fp.view(np.uint64), kind="stable")
                sketches = members.column(2).flatten().to_numpy().view(np.uint64).reshape(len(fp), -1)[order] if sketched else None
                a, b = star_links(fp.view(np.uint64)[order], radius, sketches, most or 0)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(name[order[a]]), pa.array(name[order[b]])], names=["a", "b"])

    held = F.struct("fp", "name", *(["sketch"] if sketched else []))
    masks = F.array(*[F.lit(signed(m)) for m in first])
    keyed = prints.withColumn("row", held).select("fp", "row", F.posexplode(masks).alias("t", "mask"))
    keyed = keyed.select("fp", "row", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("k"))
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(materialise(sizes, "sizes"), ["t", "k"])
    groups = shared.filter(F.col("n") <= BUCKET).groupBy("t", "k").agg(F.collect_list("row").alias("g")).select("g")
    finer = F.array(*[F.array(*[F.lit(signed(m)) for m in own]) for own in second])
    large = shared.filter(F.col("n") > BUCKET).select("fp", "row", "t", F.posexplode(F.element_at(finer, F.col("t") + 1)).alias("t2", "mask"))
    large = large.select("t", "t2", "row", F.col("fp").bitwiseAND(F.col("mask")).alias("k"))
    if sketched:  # a fingerprint can have any number of names: such buckets go to tasks by pairs of blocks
        large = in_blocks(large, ["t", "t2", "k"], F.col("row.name"))
    large = large.groupBy("t", "t2", "k", *(["lo", "hi"] if sketched else [])).agg(F.collect_list("row").alias("g")).filter(F.size("g") > 1).select("g")
    return groups.unionByName(large).mapInArrow(linked, "a long, b long")


def in_blocks(rows: DataFrame, keys: list[str], name, block: int | None = None) -> DataFrame:
    """``rows`` once for each pair of blocks (lo, hi) of their group that they take part in: a group of n rows has
    ceil(n / block) blocks, to which ``name`` deals them by its hash."""
    sizes = materialise(rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(float(block or BLOCK))).cast("int").alias("blocks")).filter("blocks > 1"), "blocks")
    dealt = rows.join(sizes, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64(name), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("blocks", "own", "other")


def printed(text_col: str = "text", size: int = 3):
    """The fingerprints of a column of texts as longs."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint(t, size)) for t in texts], dtype="int64")

    return prints(F.col(text_col).cast("string"))


def near_duplicates(docs: DataFrame, radius: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a long), component_id (smallest doc_id that links reach) and component (smallest
    fingerprint that they reach: it tells components apart where ids repeat) of each row."""
    small_batches(docs.sparkSession)
    rows = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), printed(text_col, size).alias("fp")), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(links_within(classes.select("fp"), radius))
    # a component is named by its least fingerprint; its name for the user is its least doc_id
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return rows.join(named.join(least, "component").select("fp", "component_id", "component"), "fp").select("doc_id", "fp", "component_id", "component")


class WordHashes(dict):
    """Hash of each word, remembered for as many as fit."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word, SEED)
        if len(self) < 100_000:
            self[word] = h
        return h


@lru_cache(maxsize=1)
def permutations() -> np.ndarray:
    """Odd multipliers, one for each permutation of the shingles' hashes."""
    return np.random.default_rng(SEED).integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def copy_sketch(text: str | None, hashes: WordHashes, size: int = 5) -> tuple[int, list[int], bytes]:
    """The fingerprint of the words of a text, each weighted by the square root of its count, the sketch of its shingles, and
    their different hashes, ascending (4 bytes each, or 8 in texts of ``WIDE`` or more). A text without words has fingerprint
    and sketch zero and no shingle; fewer words than a shingle make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0, [0] * (SKETCH // 64), b"\x04"
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    values, counts = np.unique(h, return_counts=True)
    total = np.zeros(64)
    for k in range(0, len(values), 4096):
        bits = np.unpackbits(values[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.sqrt(counts[k : k + 4096]) @ (2.0 * bits - 1)
    fp = int.from_bytes(np.packbits(total > 1e-9, bitorder="little").tobytes(), "little")
    shingles = h[: max(1, len(h) - size + 1)].copy()
    for k in range(1, min(size, len(h))):
        shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + h[k : len(shingles) + k]
        shingles ^= shingles >> np.uint64(29)
    whole = np.unique(shingles)
    shingles = np.unique((whole >> np.uint64(32)).astype(np.uint32))
    held = b"\x08" + whole.astype("<u8").tobytes() if len(whole) >= WIDE else b"\x04" + shingles.astype("<u4").tobytes()
    least = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(shingles), 256):
        x = shingles[k : k + 256, None] * permutations()
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(0), out=least)
    # one bit of each: the parity of the bits that chance decides
    least = np.bitwise_count(least) & np.uint8(1)
    return fp, np.packbits(least, bitorder="little").view("<i8").tolist(), held


def alike(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets of shingles have at least this similarity."""
    x, y = (np.frombuffer(s, "<u8" if s[0] == 8 else "<u4", offset=1) for s in (a, b))
    if x.itemsize != y.itemsize:
        x, y = (np.unique((s >> np.uint64(32)).astype("<u4")) if s.itemsize == 8 else s for s in (x, y))
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(both) - common) - 1e-9


def verified_links(found: DataFrame, classes: DataFrame, shingles: DataFrame, similarity: float, radius: int, most: int) -> DataFrame:
    """Links (a, b) of names that connect the pairs which are alike among those that the links ``found`` connect. ``classes``: name, fp,
    sketch; ``shingles``: name and the hashes of its shingles."""
    sets = components(found).select(F.col("node").alias("name"), "component")
    sets = in_blocks(materialise(sets, "candidates"), ["component"], F.col("name"))
    held = sets.select("name").distinct().join(shingles, "name").groupBy("name").agg(F.first("shingles").alias("shingles"))
    whole = sets.join(classes.select("name", "fp", "sketch"), "name").join(held, "name")

    def run(key, rows):
        rows = rows.sort_by([("fp", "ascending"), ("name", "ascending")])
        fp, name = (rows.column(c).to_numpy() for c in ("fp", "name"))
        sketches = rows.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(fp), -1)
        texts, root, links = rows.column("shingles").to_pylist(), list(range(len(fp))), []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in close_pairs(fp.view(np.uint64), radius, sketches, most):
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                x, y = find(i), find(j)
                if x != y and alike(texts[i], texts[j], similarity):
                    root[max(x, y)] = min(x, y)
                    links.append((name[i], name[j]))
        import pyarrow as pa

        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return whole.select("component", "lo", "hi", "name", "fp", "sketch", "shingles").groupBy("component", "lo", "hi").applyInArrow(run, "a long, b long")


def most_differing(similarity: float) -> int:
    """Bits in which sketches of this similarity differ, on average."""
    return int(SKETCH * (1 - similarity) / 2)


def near_copies(docs: DataFrame, similarity: float = 0.8, size: int = 5, radius: int = COPY_RADIUS, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, component (a name of the group of near copies) and first (doc_id and text_hash of the group's
    first row with an id) of each row. Near copies have ``size`` word shingles of at least ``similarity``; found are those with word
    fingerprints within ``radius`` bits and sketches that speak for a similarity of at least ``similarity - slack``. Groups
    are what links between near copies connect. Nulls and short texts as in ``near_duplicates``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<fp: long, sketch: array<long>, shingles: binary>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        hashes = word_hashes()
        got = [copy_sketch(t, hashes, size) for t in texts]
        return pd.DataFrame({"fp": [signed(fp) for fp, _, _ in got], "sketch": [x for _, x, _ in got], "shingles": [s for _, _, s in got]})

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), sketched(text).alias("x"))
    rows = materialise(rows.select("doc_id", "text_hash", "x.*").withColumn("name", F.xxhash64("fp", "sketch", "shingles")), "sketches")
    classes = rows.groupBy("fp", "name").agg(F.first("sketch").alias("sketch"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("first"))
    classes = materialise(classes, "classes")
    most = most_differing(similarity - slack)
    found = verified_links(links_within(classes.select("fp", "name", "sketch"), radius, most), classes, rows.select("name", "shingles"), similarity, radius, most)
    found = components(found)
    named = classes.join(found.withColumnRenamed("node", "name"), "name", "left").select("name", "first", F.coalesce("component", "name").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("first"))
    return rows.join(named.drop("first").join(least, "component"), "name").select("doc_id", "text_hash", "component", "first")


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """One memo a Python worker."""
    return WordHashes()


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
