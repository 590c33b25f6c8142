"""Operator 6: near-duplicate vectors by lattice hashing.

A vector is scaled to length one, projected by random Gaussians to several 8-dimensional parts, and each part is decoded
to its nearest point of the E8 lattice; the points of a table's parts are its cell. Several tables with their own
projections are used, and besides its own cell a vector probes the neighbouring cells whose lattice points are next
nearest. Vectors that meet in a cell, one of them at home there, are compared by cosine in double precision.

Copies of one vector are joined first. What the tables say of a vector is computed once and kept with it as a signature:
the hash of its home cell and the numbers of its next nearest moves, for hashes of lattice points add up. A pair that meets
in several cells is counted in the first of them alone, which the two signatures tell, so no pairs are kept or shuffled: a
cell gives link counts and a star of links. Probes go only to cells that are home to a vector, by a filter of counted and
limited size. Cells with many vectors are cut into blocks that are compared two by two in tasks of their own.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; components of any
finite size are compared, the smallest and largest doubles too; vectors of each
length have cells of their own; repeated rows are linked copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.llm.common import materialise, small_batches
from motionspark.llm.graph import components

#: Vectors that are compared at once.
BLOCK = 512
#: Vectors of a block of a large cell: each is sent to as many tasks as its cell has blocks.
SENT = 4096
#: Bits of the filter of home cells for each of them, and at most; beyond that it lets more through, but loses none.
HOME_BITS, MOST_BITS = 16, 1 << 28
TABLES, PARTS, SCALE, PROBES = 12, 3, 0.5, 8
FOUND = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


@lru_cache(maxsize=1)
def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: all (±1, ±1, 0...) and all halves with an even number of minus signs."""
    signs = np.array(np.meshgrid(*[[-1, 1]] * 8)).reshape(8, -1).T
    halves = signs[(signs < 0).sum(1) % 2 == 0] / 2
    unit = np.eye(8)
    pairs = [s * unit[i] + t * unit[j] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    return np.concatenate([np.array(pairs), halves])


def nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points whose coordinates have an even sum."""
    point = np.rint(x)
    gap = x - point
    odd = np.nonzero(point.sum(1) % 2)[0]
    worst = np.abs(gap[odd]).argmax(1)
    point[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is the even integer points together with the same points moved by one half in every coordinate."""
    a, b = nearest_even(x), nearest_even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


@lru_cache(maxsize=64)
def projection(dim: int, table: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, table)).normal(size=(dim, 8 * PARTS)) * SCALE


@lru_cache(maxsize=1)
def hash_weights() -> np.ndarray:
    return np.random.default_rng(8).integers(1, 1 << 63, 8 * PARTS, dtype=np.uint64) | np.uint64(1)


def weighted(points: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sum of the doubled lattice coordinates along the last axis, modulo 2**64: the sums of two points add."""
    return ((2 * points).astype(np.int64).view(np.uint64) * weights).sum(-1, dtype=np.uint64)


def cell_hash(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a weighted sum."""
    x = x ^ (x >> np.uint64(29))
    return (x * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


@lru_cache(maxsize=1)
def moves() -> np.ndarray:
    """Hash weight of each move of each part: number 240 * part + k is the part's k-th shortest vector."""
    return np.concatenate([weighted(shortest_vectors(), hash_weights()[8 * k : 8 * k + 8]) for k in range(PARTS)])


def signature(unit: np.ndarray, tables: int, seed: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """[rows, tables]: hashes of the home cells; [rows, tables, probes]: numbers of the next nearest moves, nearest first."""
    own, near = np.empty((len(unit), tables), np.uint64), np.empty((len(unit), tables, probes), np.uint16)
    for t in range(tables):
        y = unit @ projection(unit.shape[1], t, seed)
        home = np.concatenate([nearest_e8(y[:, 8 * k : 8 * k + 8]) for k in range(PARTS)], axis=1)
        own[:, t] = weighted(home, hash_weights())
        gap = y - home
        gain = np.concatenate([gap[:, 8 * k : 8 * k + 8] @ shortest_vectors().T for k in range(PARTS)], axis=1)
        best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
        order = np.argsort(-np.take_along_axis(gain, best, 1), axis=1, kind="stable")
        near[:, t] = np.take_along_axis(best, order, 1)
    return own, near


def cells(unit: np.ndarray, table: int, seed: int, probes: int) -> np.ndarray:
    """[rows, 1 + probes]: hashes of one table's home cell, then of the neighbouring cells nearest to the vector."""
    own, near = signature(unit, table + 1, seed, probes)
    return cell_hash(np.concatenate([own[:, table, None], own[:, table, None] + moves()[near[:, table]]], axis=1))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. Each is brought to a largest component between a half and one by a power of two first, which
    rounds nothing, so squares neither overflow nor vanish."""
    x = vectors.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def matrix(column) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def met_before(a, b, own, near, table: int) -> np.ndarray:
    """Whether the rows ``a`` and ``b`` (numbers) meet in a table before ``table``, one of them at home."""
    before = np.zeros(len(a), bool)
    for t in range(table):
        rest = np.nonzero(~before)[0]
        if not len(rest):
            break
        gap = own[b[rest], t] - own[a[rest], t]
        there = (moves()[near[a[rest], t]] == gap[:, None]).any(1) | (moves()[near[b[rest], t]] == (np.uint64(0) - gap)[:, None]).any(1)
        before[rest] = there | (gap == 0)
    return before


def first_cell(a, b, own, near, table: int, number: int) -> np.ndarray:
    """The least name of the cells of ``table`` in which the rows meet, one of them at home."""
    gap = own[b, table] - own[a, table]
    most = np.iinfo(np.int64).max
    at_b = (gap == 0) | (moves()[near[a, table]] == gap[:, None]).any(1)
    at_a = (gap == 0) | (moves()[near[b, table]] == (np.uint64(0) - gap)[:, None]).any(1)
    return np.minimum(np.where(at_b, own_table(cell_hash(own[b, table]), number), most), np.where(at_a, own_table(cell_hash(own[a, table]), number), most))


def links_of_block(rep, unit, home, own, near, left, right, table, number, cell, threshold):
    """Links between ``left`` and ``right`` (row numbers; the same array for the pairs inside) that this cell is the first
    to find: row numbers a, b."""
    out_a, out_b = [], []
    same = left is right
    for i in range(0, len(left), BLOCK):
        rows = left[i : i + BLOCK]
        for j in range(i if same else 0, len(right), BLOCK):
            cols = right[j : j + BLOCK]
            new = home[rows][:, None] | home[cols][None, :]
            # most pairs that have met before were at home in one cell
            for t in range(table):
                new &= own[rows, t][:, None] != own[cols, t][None, :]
                if not new.any():
                    break
            if not new.any():
                continue
            new &= unit[rows] @ unit[cols].T >= threshold
            a, b = np.nonzero(new)
            a, b = rows[a], cols[b]
            keep = (a < b) if same else (rep[a] != rep[b])
            a, b = a[keep], b[keep]
            if len(a):
                keep = ~met_before(a, b, own, near, table)
                a, b = a[keep], b[keep]
                keep = first_cell(a, b, own, near, table, number) == cell
                out_a.append(a[keep])
                out_b.append(b[keep])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def home_filter(homes: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bits at the names of all ``n`` home cells (column cell), and how many bits there are."""
    bits = 1 << 10
    while bits < min(MOST_BITS, HOME_BITS * n):
        bits <<= 1
    at = homes.select(F.pmod(F.col("cell"), F.lit(bits)).alias("at"))
    words = at.selectExpr("at div 64 as word", "shiftleft(1L, cast(at % 64 as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()  # at most MOST_BITS / 64 rows
    return table.astype("<i8").view(np.uint8), bits


def own_table(cell: np.ndarray, number) -> np.ndarray:
    """Cells of different tables and vector lengths kept apart: one 64-bit name of (table, cell)."""
    with np.errstate(over="ignore"):
        x = cell.view(np.uint64) + np.asarray(number, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


SIGNED = pa.schema([("rep", pa.int64()), ("copies", pa.int64()), ("dim", pa.int32()), ("own", pa.binary()), ("near", pa.binary())])


def near_vectors(vectors: DataFrame, threshold: float = 0.95, tables: int = TABLES, probes: int = PROBES, seed: int = 6, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    small_batches(vectors.sparkSession)
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    fine = F.size("v") > 0
    fine &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(fine, F.col("v")))
    # copies are told by two hashes of the vector, 96 bits together
    rows = rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.hash("v")})
    reps = materialise(rows.filter("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep_id"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("rep", F.xxhash64("h1", "h2")), "vectors")
    if reps.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def sign(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                lengths = batch.column(0).slice(k, 1000).value_lengths().to_numpy()
                for dim in np.unique(lengths):
                    part = batch.slice(k, 1000).filter(pa.array(lengths == dim))
                    own, near = signature(unit_rows(matrix(part.column(0))), tables, seed, probes)
                    raw = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                    columns = [part.column(1), part.column(2), pa.array(np.full(len(own), dim, np.int32)), raw(own), raw(near)]
                    yield pa.RecordBatch.from_arrays(columns, schema=SIGNED)

    signed = materialise(reps.select("v", "rep", "copies").mapInArrow(sign, "rep long, copies long, dim int, own binary, near binary"), "signatures")

    def own_cells(batches):
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, tables)
            number = batch.column(0).to_numpy().astype(np.int64)[:, None] * tables + np.arange(tables)
            yield pa.RecordBatch.from_arrays([pa.array(own_table(cell_hash(own), number).ravel())], names=["cell"])

    bits, size = home_filter(signed.select("dim", "own").mapInArrow(own_cells, "cell long"), signed.count() * tables)
    homes = vectors.sparkSession.sparkContext.broadcast(bits)

    def entries(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rep, dim = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(n, tables)
            near = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(n, tables, probes)
            for t in range(tables):
                every = np.concatenate([own[:, t, None], own[:, t, None] + moves()[near[:, t]]], axis=1)
                cell = own_table(cell_hash(every), (dim * tables + t)[:, None])
                at = cell % size
                met = (homes.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                row, place = np.nonzero(met)
                columns = [np.full(len(row), t, np.int8), cell[row, place], rep[row], place == 0]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t", "cell", "rep", "home"])

    every = materialise(signed.select("rep", "dim", "own", "near").mapInArrow(entries, "t byte, cell long, rep long, home boolean"), "cells")
    shared = every.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("n_home")).filter("n > 1 and n_home > 0").select("cell", "n")
    met = every.join(shared, "cell")
    # a cell of n vectors has ceil(n / SENT) blocks; each vector goes to every pair of blocks that has its own
    blocks = F.ceil(F.col("n") / F.lit(float(SENT))).cast("int")
    met = met.withColumn("own_block", F.pmod("rep", blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("t", "cell", F.least("own_block", "other").alias("lo"), F.greatest("own_block", "other").alias("hi"), "own_block", "rep", "home")
    whole = reps.select("rep", "v").join(signed.drop("dim"), "rep")
    met = met.join(whole, "rep").repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "rep")
    met = met.select("cell", "lo", "hi", "t", "own_block", "rep", "home", "copies", "own", "near", "v")

    def compare(batches):
        def finish(held):
            table = pa.Table.from_batches(held)
            cell, lo, hi, t = (table.column(k)[0].as_py() for k in range(4))
            block, rep, home, copies = (table.column(k).to_numpy() for k in range(4, 8))
            if len(rep) < 2:
                return None
            own = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint64).reshape(len(rep), tables)
            near = np.frombuffer(b"".join(table.column(9).to_pylist()), np.uint16).reshape(len(rep), tables, probes)
            vectors = table.column(10).combine_chunks()
            lengths = vectors.value_lengths().to_numpy()
            if (lengths != lengths[0]).any():
                raise ValueError("vectors of two lengths in one cell: use another seed")  # two names of 64 bits are the same
            unit = unit_rows(matrix(vectors))
            left, right = np.nonzero(block == lo)[0], np.nonzero(block == hi)[0]
            a, b = links_of_block(rep, unit, home, own, near, left, left if lo == hi else right, t, int(lengths[0]) * tables + t, cell, threshold)
            if not len(a):
                return None
            links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            while True:
                least = root.copy()
                np.minimum.at(least, a, root[b])
                np.minimum.at(least, b, root[a])
                least = least[least]
                if (least == root).all():
                    break
                root = least
            at = np.unique(np.concatenate([a, b]))
            return pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(links[at]), pa.array(rep[root[at]])], schema=FOUND)

        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            cuts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1, [len(keys)]])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held and tuple(keys[s]) != key:
                    if (done := finish(held)) is not None:
                        yield done
                    held = []
                key = tuple(keys[s])
                held.append(batch.slice(s, e - s))
        if held and (done := finish(held)) is not None:
            yield done

    found = materialise(met.mapInArrow(compare, "rep long, links long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = reps.select("h1", "h2", "rep", "rep_id", "copies").join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("component", F.coalesce("component", "rep"))
    least = known.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    known = known.join(least, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    known = rows.filter("v is not null").select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
