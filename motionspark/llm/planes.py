"""Operator 5: token ids as byte or bit planes of fixed-size blocks, each plane compressed with zstandard.

Documents are dealt by ranges of doc_id into shards and sorted there; a shard's ids are cut into blocks of a fixed number
of ids. A block's 32-bit ids are transposed into planes (all lowest bytes, then all second bytes, ...; or single bits),
so that the nearly constant high planes shrink to a few bytes. Blocks are stored by Spark's own Parquet writer (binary
columns, not compressed again), so a lost task leaves nothing half written and any store that Spark knows will do:

``path/blocks``  shard, block, start (in the shard), n_ids, planes, crc32, and the documents' pieces in the block
``path/index``   shard, block, start (over all shards), n_ids, plane_bytes, crc32

Edge cases: a null or empty text is the end id alone; null doc_ids come first, rows with one id in the order of a hash of
their text; repeated rows are stored as often as they
come; an empty table gives an empty folder that reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionspark.llm.common import small_batches
from motionspark.llm.tokens import encoder

#: Ids of a block.
BLOCK_IDS = 65_536
PIECE = "struct<doc_id: long, doc_tokens: long, doc_start: long, at: int, length: int, skipped: long>"
BLOCKS = f"shard int, block int, start long, n_ids int, kind string, planes array<binary>, crc32 long, pieces array<{PIECE}>"
PIECES_ARROW = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("doc_start", pa.int64()), ("skipped", pa.int64()), ("ids", pa.binary())])


def to_planes(ids: bytes, kind: str) -> list[bytes]:
    raw = np.frombuffer(ids, np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(p).tobytes() for p in raw.T]
    bits = np.unpackbits(raw, axis=1, bitorder="little").T
    return [np.packbits(p, bitorder="little").tobytes() for p in bits]


def from_planes(planes: list[bytes], n: int, kind: str) -> bytes:
    if kind == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).tobytes()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").tobytes()


def write_planes(docs: DataFrame, path: str, vocab: str, blanks: str = "kept", end_id: int = 0, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes ``docs`` and writes them to ``path`` in the format above."""
    if kind not in ("byte", "bit"):
        raise ValueError("kind is byte or bit")
    spark = docs.sparkSession
    small_batches(spark)
    end, step = int(end_id).to_bytes(4, "little"), block_ids * 4

    def run(batches):
        import zstandard

        enc, squeeze, shard = encoder(vocab, blanks), zstandard.ZstdCompressor(level=level), TaskContext.get().partitionId()
        held, pieces, start, block = bytearray(), [], 0, 0

        def row(size: int):
            ids = bytes(held[:size])
            values = [shard, block, start, size // 4, kind, [squeeze.compress(p) for p in to_planes(ids, kind)], zlib.crc32(ids), pieces]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                total, first, skipped = len(ids) // 4, start + len(held) // 4, 0
                while ids:
                    part = ids[: step - len(held)]
                    pieces.append({"doc_id": doc_id, "doc_tokens": total, "doc_start": first, "at": len(held) // 4, "length": len(part) // 4, "skipped": skipped})
                    held += part
                    skipped, ids = skipped + len(part) // 4, ids[len(part) :]
                    if len(held) == step:
                        yield row(step)
                        held, pieces, start, block = bytearray(), [], start + block_ids, block + 1
        if held:
            yield row(len(held))

    piece = pa.struct([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("doc_start", pa.int64()), ("at", pa.int32()), ("length", pa.int32()), ("skipped", pa.int64())])
    names = ["shard", "block", "start", "n_ids", "kind", "planes", "crc32", "pieces"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.binary()), pa.int64(), pa.list_(piece)]
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows with one id, or none, follow a hash of their text, so that many of them make several ranges
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    index = blocks.join(shard_starts(blocks), "shard").select(
        "shard", "block", (F.col("start") + F.col("shard_start")).alias("start"), "n_ids", F.transform("planes", F.octet_length).alias("plane_bytes"), "crc32"
    )
    index.write.parquet(f"{path}/index")


def shard_starts(blocks: DataFrame) -> DataFrame:
    """Ids in all shards before each one; one small row a shard."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("shard_start"))


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents' pieces: doc_id, doc_tokens, start (over all documents), skipped (ids of the document before
    the piece), ids. A document lies in one piece unless it crosses the end of a block."""
    small_batches(spark)

    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for r in batch.to_pylist():
                ids = from_planes([expand.decompress(p) for p in r["planes"]], r["n_ids"], r["kind"])
                if zlib.crc32(ids) != r["crc32"]:
                    raise ValueError(f"block {r['block']} of shard {r['shard']} is damaged")
                p = r["pieces"]
                columns = [[r["shard"]] * len(p), *([x[k] for x in p] for k in ("doc_id", "doc_tokens", "doc_start", "skipped")), [ids[4 * x["at"] : 4 * (x["at"] + x["length"])] for x in p]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES_ARROW, strict=True)], schema=PIECES_ARROW)

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    pieces = blocks.select("shard", "block", "n_ids", "kind", "planes", "crc32", "pieces").mapInArrow(run, "shard int, doc_id long, doc_tokens long, doc_start long, skipped long, ids binary")
    starts = spark.read.parquet(f"{path}/index").filter("block = 0").select("shard", F.col("start").alias("shard_start"))
    return pieces.join(starts, "shard").select("doc_id", "doc_tokens", (F.col("doc_start") + F.col("shard_start")).alias("start"), "skipped", "ids")


def document_digests(pieces: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from what ``read_planes`` gives. Documents that cross blocks
    are put together first; they are about one for each block."""
    whole = pieces.filter(F.octet_length("ids") == F.col("doc_tokens") * 4).select("doc_id", "start", F.col("doc_tokens").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))

    def join(key, table):
        crc = n = 0
        for part in table.sort_by("skipped").column("ids"):
            crc, n = zlib.crc32(part.as_buffer(), crc), n + len(part.as_buffer()) // 4
        return pa.table({"doc_id": pa.array([key[0].as_py()], pa.int64()), "start": pa.array([key[1].as_py()], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "ids_crc32": pa.array([crc], pa.int64())})

    cut = pieces.filter(F.octet_length("ids") < F.col("doc_tokens") * 4).groupBy("doc_id", "start").applyInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return whole.unionByName(cut)
