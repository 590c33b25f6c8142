"""What the operators of this subpackage share: shared storage, Arrow batches and row buffers."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionspark.runtime import checkpointed, shared_folder, ship_package  # noqa: F401

#: Rows of one Arrow batch: texts can be long, so batches are small.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Sends the package to the executors and bounds the rows of an Arrow batch, for the operators that send whole texts
    to Python."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int = BATCH_ROWS):
    """Arrow batches of ``rows`` rows for the jobs that run inside, and the session's own size again after them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Run:
    """The tables that ``materialise`` writes while this is entered, in this thread alone: a chain of steps of which only the last
    result is read again removes the others as it goes. Tables written outside of a run stay, for lazy results read them."""

    current: ContextVar[Run | None] = ContextVar("run", default=None)

    def __init__(self, spark: SparkSession):
        self.spark, self.written = spark, []

    def __enter__(self) -> Run:
        self.token = Run.current.set(self)
        return self

    def __exit__(self, *error) -> None:
        Run.current.reset(self.token)

    def discard(self, keep: str) -> None:
        """Removes the run's tables, but for those whose name starts with ``keep``."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [p for p in self.written if not p.rsplit("/", 1)[1].startswith(keep)]:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
            self.written.remove(path)


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: later steps start from files that survive
    the loss of executors, and do not repeat the work."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    if run := Run.current.get():
        run.written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, or a longer one, that no column of ``df`` has, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lowest_hashes(sample: DataFrame, columns: str | list[str], rows: int) -> DataFrame:
    """The ``rows`` different values of ``columns`` in ``sample`` with the lowest hashes, in that order. Different values are counted first, and
    a limit on the hash leaves about twice as many as are wanted, so what tasks send to be ordered does not grow with
    ``sample``. Repeated values count once, so they can neither crowd out others nor all fall beyond the limit."""
    columns = [columns] if isinstance(columns, str) else columns
    sample = sample.select(*columns).distinct()
    n = sample.count()
    h = F.xxhash64(*columns)
    if n > 2 * rows:
        sample = sample.filter(h <= F.lit(-(1 << 63) + int(((1 << 64) - 1) * (2 * rows + 100) / n)))
    return sample.orderBy(h, *columns).limit(rows)


class Rows:
    """Rows gathered as columns; ``add`` returns a record batch whenever enough have come."""

    def __init__(self, schema: pa.Schema, rows: int = 4000, size: int = 8 << 20):
        self.schema, self.rows, self.size = schema, rows, size
        self.clear()

    def clear(self) -> None:
        self.columns = [[] for _ in self.schema]
        self.held = 0

    def add(self, *row, size: int = 0):
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.held += size
        return len(self.columns[0]) >= self.rows or self.held >= self.size

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.clear()
        return batch
