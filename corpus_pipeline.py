"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, source mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionspark.llm import mixing, packing, quality, secrets, simhash
from motionspark.llm.common import Run, materialise
from motionspark.llm.queries import table, vocabulary

#: Rows of the list of near copies up to which it is broadcast (24 bytes each).
BROADCAST_ROWS = 1_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the score reject go. A null or empty text has too few words and goes; a null id, language or source
    decides nothing; repeated rows are judged alike; columns beyond those of documents are dropped; an empty table stays empty."""
    return quality.judge(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), keep_rows=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of five-word shingles of 0.8 or more) the row with the smallest id stays,
    one row of those with that id and text. Rows with one id and different texts are judged each on its own, and rows
    without an id stay. A null text counts as a text without words. What goes is told by id and a hash of the text, so
    texts stay where they are while the list of what goes is small; beyond a counted size it is joined by a shuffle."""
    docs = docs.select(*COLUMNS)
    key = ["doc_id", "text_hash"]
    found = simhash.near_copies(docs).filter("doc_id is not null")
    first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    told = materialise(found.groupBy(*key).agg(F.count("*").alias("n"), F.bool_or(~first).alias("gone")).filter("gone or n > 1"), "told")
    counts = told.agg(F.count("*"), F.count_if(~F.col("gone"))).first()
    told = F.broadcast(told) if counts[0] <= BROADCAST_ROWS else told
    marked = docs.withColumn("text_hash", F.xxhash64(F.col("text").cast("string"))).join(told, key, "left").filter("gone is null or not gone")
    if not counts[1]:
        return marked.select(*COLUMNS)
    repeated = marked.filter("n > 1").dropDuplicates(key)
    return marked.filter("n is null").select(*COLUMNS).unionByName(repeated.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and the numbers of characters follow. Null and empty texts stay as they are; repeated rows are
    treated alike, each stays a row; an empty table stays empty."""
    return secrets.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources get the same weight; a null source is one of them. Null texts are rows like others; rows with one id draw the same
    number of copies, a null id counts as an empty one; a source may lose single documents, as its rate is below one; an empty
    table stays empty."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids. A null or empty text is its end token alone; repeated rows are packed as often as they
    come; a null id stays null; an empty table gives no sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules), ("simhash_near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences),
]

#: Hashing, trained models and tokenizers cannot be written in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table, and what its operators wrote, goes as soon as the next one is whole."""
    docs = table(spark, sf_dir, "documents")
    with Run(spark) as tables:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            tables.discard(f"stage-{name}")
    return docs
