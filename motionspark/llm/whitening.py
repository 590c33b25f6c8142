"""Operator 12: whitening of embeddings by hierarchical SVD merging.

Each vector's entries become whole numbers x = floor(1024 c) + 100000. A task turns its rows, batch by batch, into a state: their
number, their mean, and the singular values times right vectors of the centred rows (a square factor of full rank, so
nothing is lost). Two states are merged by putting one factor under the other, appending the mean-correction row
sqrt(n1 n2 / (n1 + n2)) (mean1 - mean2), and taking the SVD of that again. States of tasks are merged in a tree of
``MERGE`` states a task; what reaches the driver is one state. Its right vectors are the eigenvectors of the covariance
(divisor n), its squared singular values over n the eigenvalues. The sums of the whole numbers travel beside it, exact.

A state takes 8 d^2 bytes for d dimensions, whatever the number of rows. The check of the whitened rows (``identity_error``) is a
second pass: products of whitened and centred entries, added up by tasks and then by Spark.

Edge cases: rows whose vector is null or has null, NaN or infinite entries are dropped. Vectors of each length are a table of
their own, with their own n, S and components; empty vectors have no components and give no rows. Components without variance
(eigenvalue at most 1e-14 times the largest, or no variance at all: a single row, or equal rows) cannot be whitened and are left out,
so such a table may give no rows. Whole numbers beyond 2^61 on either side are set to it; a ``deviation``
beyond 38 digits is null. Rows with one id or a null id are rows of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionspark.llm.common import materialise, ship_package

SCALE, OFFSET = 1024.0, 100_000
#: Whole numbers beyond this are set to it, so that differences of two of them are whole 64-bit numbers too.
LIMIT = 2.0**61
#: States that one task merges.
MERGE = 8
COMPONENTS = 8
#: Entries of vectors that are centred and decomposed at a time.
BLOCK = 1 << 20
STATE = "dims int, slot long, n long, sums array<string>, mean array<double>, factor array<double>"


def by_length(vectors: pa.Array):
    """(rows, doubles) of each length of the vectors that can be used."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for d in sorted(set(sizes[sizes > 0].tolist())):
        rows = np.flatnonzero(sizes == d)
        step = max(1, BLOCK // d)
        for k in range(0, len(rows), step):
            own = rows[k : k + step]
            values = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)  # nulls become NaN
            good = np.isfinite(values).all(1)
            if good.any():
                yield own[good], values[good]


def whole_numbers(c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * SCALE), -LIMIT, LIMIT).astype(np.int64) + OFFSET


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns of ``x``, of any size."""
    if len(x) * int(max(x.max(), -x.min(), 1)) < 2**62:
        return x.sum(0).tolist()
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(h << 32) + w for h, w in zip(high.sum(0).tolist(), low.sum(0).tolist(), strict=True)]


@dataclass
class State:
    """Rows of one length: their number, exact sums, mean, and a factor whose Gram matrix is that of the centred rows."""

    n: int
    sums: list[int]
    mean: np.ndarray
    factor: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        sums = exact_sums(x)
        mean = np.array([s / len(x) for s in sums])
        return cls(len(x), sums, mean, squared(x - mean))

    def merged(self, other: State) -> State:
        n = self.n + other.n
        correction = math.sqrt(self.n / n * other.n) * (self.mean - other.mean)
        sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        return State(n, sums, np.array([s / n for s in sums]), squared(np.vstack([self.factor, other.factor, correction])))


def squared(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors of ``rows``: as many rows as columns at most, none of the rank is dropped."""
    if len(rows) > 2 * rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def packed(states: list[tuple[int, int, State]]) -> pa.Table:
    """Rows of the schema ``STATE``: (length, slot, state)."""
    return pa.table({
        "dims": pa.array([d for d, _, _ in states], pa.int32()), "slot": pa.array([k for _, k, _ in states], pa.int64()), "n": pa.array([s.n for _, _, s in states], pa.int64()),
        "sums": pa.array([list(map(str, s.sums)) for _, _, s in states], pa.list_(pa.string())), "mean": pa.array([s.mean for _, _, s in states], pa.list_(pa.float64())),
        "factor": pa.array([s.factor.ravel() for _, _, s in states], pa.list_(pa.float64())),
    })


def unpacked(row: dict) -> State:
    return State(row["n"], list(map(int, row["sums"])), np.array(row["mean"]), np.array(row["factor"]).reshape(-1, row["dims"]))


def merged(states) -> State:
    out = None
    for s in states:
        out = s if out is None else out.merged(s)
    return out


@dataclass(frozen=True)
class Whitening:
    """What the rows of one length are whitened by: their number, sums, eigenvectors (columns) and eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole).astype(float) - np.array([s % self.n / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> list[Decimal | None]:
        """The sum over dimensions of (n x - S)^2, in whole numbers of any size."""
        n, sums = self.n, np.array(self.sums, object)
        low, high = x.min(0).tolist(), x.max(0).tolist()
        far = max(max(abs(n * a - s), abs(n * b - s), n * abs(a), n * abs(b), abs(s)) for a, b, s in zip(low, high, self.sums, strict=True))
        if far < 2**62 and x.shape[1] * far * far < 2**62:
            return [Decimal(v) for v in ((n * x - sums.astype(np.int64)) ** 2).sum(1).tolist()]
        exact = ((n * x.astype(object) - sums) ** 2).sum(1).tolist()
        return [Decimal(v) if v < 10**38 else None for v in exact]


def states_of(vectors: DataFrame, column: str) -> DataFrame:
    """One state for each task and length of vectors."""

    def run(batches):
        from pyspark import TaskContext

        held: dict[int, State] = {}
        for batch in batches:
            for _, c in by_length(batch.column(0)):
                state, d = State.of(whole_numbers(c)), c.shape[1]
                held[d] = held[d].merged(state) if d in held else state
        for d, state in held.items():
            yield from packed([(d, TaskContext.get().partitionId(), state)]).to_batches()

    return vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(run, STATE)


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS, merge: int = MERGE) -> dict[int, Whitening]:
    """By length of vectors, how they are whitened."""
    ship_package(vectors.sparkSession)
    states = materialise(states_of(vectors, column), "states")
    slots = states.agg(F.max("slot")).first()[0] or 0

    def run(key, rows):
        ordered = sorted(rows.to_pylist(), key=lambda r: r["slot"])
        return packed([(key[0].as_py(), key[1].as_py(), merged(map(unpacked, ordered)))])

    while slots:  # the tree: as many rounds as the number of tasks has digits to the base ``merge``
        slots //= merge
        states = states.withColumn("slot", F.expr(f"slot div {merge}")).groupBy("dims", "slot").applyInArrow(run, STATE)
    out = {}
    for row in states.collect():  # one row a length of vectors
        state = unpacked(row.asDict())
        _, s, vt = np.linalg.svd(state.factor, full_matrices=False)
        values = s**2 / state.n
        keep = [i for i in range(min(components, len(values))) if values[i] > 1e-14 * values[0]]
        out[row["dims"]] = Whitening(state.n, state.sums, vt[keep].T, values[keep], float(values.sum()))
    return out


def identity_errors(vectors: DataFrame, models: dict[int, Whitening], column: str = "embedding") -> dict[int, float]:
    """By length, the largest absolute entry of the covariance of the whitened rows minus the identity."""
    sent = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for _, c in by_length(batch.column(0)):
                model = sent.value.get(c.shape[1])
                if model is not None and len(model.values):
                    w = model.whiten(whole_numbers(c))  # centred by the mean of all rows
                    own = [w.sum(0), w.T @ w]
                    held[c.shape[1]] = [a + b for a, b in zip(held[c.shape[1]], own, strict=True)] if c.shape[1] in held else own
        for d, (total, products) in held.items():
            k = len(total)
            i, j = np.divmod(np.arange(k * k + k), k)  # the last row of k entries: the sums
            entries = np.concatenate([products.ravel(), total])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(entries)], names=["dims", "i", "j", "s"])

    sums = vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "dims int, i int, j int, s double").groupBy("dims", "i", "j").agg(F.sum("s").alias("s"))
    found: dict[int, dict] = {}
    for r in sums.collect():  # (components + 1) * components rows a length
        found.setdefault(r["dims"], {})[r["i"], r["j"]] = r["s"]
    out = {}
    for d, entries in found.items():
        k, n = len(models[d].values), models[d].n
        mean = np.array([entries[k, j] for j in range(k)]) / n
        cov = np.array([[entries[i, j] for j in range(k)] for i in range(k)]) / n - np.outer(mean, mean)
        out[d] = float(np.abs(cov - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error for each usable row and component."""
    models = fit(vectors, column, components)
    errors = identity_errors(vectors, models, column)
    sent = vectors.sparkSession.sparkContext.broadcast((models, errors))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        models, errors = sent.value
        for batch in batches:
            for rows, c in by_length(batch.column(1)):
                model, x = models[c.shape[1]], whole_numbers(c)
                k = len(model.values)
                if not k:
                    continue
                each = np.repeat(np.arange(len(rows)), k)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(each), model.n)),
                    pa.array(model.deviations(x), pa.decimal128(38, 0)).take(pa.array(each)), pa.array(model.whiten(x).ravel()),
                    pa.array(np.tile(model.values / model.trace, len(rows))), pa.array(np.full(len(each), errors[c.shape[1]])),
                ], names=names)

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
