"""Operator 8: quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are estimated: one from trusted target documents (labelled as good; a bounded
sample of ``TRUSTED_ROWS`` rows, the lowest hashes of doc_id) and one from all documents. A document's score is the mean,
over its n-grams, of log target - log corpus; it is kept if it passes the base rules and its score is at least the
threshold. Byte n-grams see symbols, case and table bars inside words that were never seen before.

The counts of all documents leave each task as one row a bucket; their sums are ``BUCKETS`` rows at every input size, and
are what the scoring tasks get.

Edge cases: a null text has no words and fails the base rules; texts shorter than an n-gram score 0; without any trusted
document the score is null and the base rules decide alone; repeated rows are judged alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.llm.common import lowest_hashes, small_batches

BUCKETS = 1 << 14
NGRAM = 3
TRUSTED_ROWS = 20_000
#: Mean log-likelihood ratio of an n-gram below which a document is rejected.
THRESHOLD = -0.3
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
STATS = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("llr", pa.float64()), ("kept", pa.bool_())]
)


def buckets_of(raw: bytes, n: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each byte n-gram of ``raw``."""
    if len(raw) < n:
        return np.zeros(0, np.int64)
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    h = a[: len(a) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint32(257) + a[k : len(a) - n + 1 + k]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64)


def base_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    from xxhash import xxh3_64_intdigest

    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(SPACE)]
    repeated = 0
    if len(words) >= 6:
        h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        windows = h[:-4].copy()
        for k in range(1, 5):
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - 4 + k]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(len(windows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(words) + 1, np.int64)
        at = np.nonzero(twice)[0]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + 5, -1)
        repeated = int((np.cumsum(edge)[:-1] > 0).sum())
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated


def ratio_table(docs: DataFrame, trusted_ids: list[int], n: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray | None:
    """log target - log corpus of each bucket, from counts over all of ``docs``."""

    given = docs.sparkSession.sparkContext.broadcast(frozenset(trusted_ids))

    def count(batches):
        trusted = given.value
        target, corpus = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.bincount(buckets_of((text or "").encode("utf-8", "surrogatepass"), n, buckets), minlength=buckets)
                corpus += got
                if doc_id in trusted:
                    target += got
        at = np.nonzero(corpus)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(target[at]), pa.array(corpus[at])], names=["bucket", "target", "corpus"])

    counts = docs.mapInArrow(count, "bucket long, target long, corpus long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("corpus").alias("corpus"))
    target, corpus = np.ones(buckets), np.ones(buckets)
    for r in counts.collect():  # as many rows as buckets at most
        target[r["bucket"]] += r["target"]
        corpus[r["bucket"]] += r["corpus"]
    if target.sum() == buckets:
        return None
    return np.log(target / target.sum()) - np.log(corpus / corpus.sum())


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """The statistics, ``llr`` and ``kept`` of every document; with ``keep_rows`` the kept rows of ``docs`` themselves."""
    spark = docs.sparkSession
    small_batches(spark)
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    trusted = [r[0] for r in lowest_hashes(good, "doc_id", trusted_rows).collect()]  # bounded by trusted_rows
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = spark.sparkContext.broadcast(ratio_table(texts, trusted))

    def verdict(text: str | None):
        stats = base_stats(text)
        failed = stats[0] < 10 or 100 * stats[4] > 20 * stats[0]
        llr = None
        if table.value is not None:
            grams = buckets_of((text or "").encode("utf-8", "surrogatepass"))
            llr = round(float(table.value[grams].mean()), 9) if len(grams) else 0.0
        return *stats, failed, llr, not failed and (llr is None or llr >= threshold)

    def score(batches):
        for batch in batches:
            rows = [(d, *verdict(t)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(STATS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, STATS, strict=True)], schema=STATS)

    at = docs.columns.index(text_col)

    def passing(batches):
        for batch in batches:
            yield batch.filter(pa.array([verdict(t)[-1] for t in batch.column(at).to_pylist()], pa.bool_()))

    if keep_rows:
        return docs.mapInArrow(passing, docs.schema)
    return texts.mapInArrow(score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean")
