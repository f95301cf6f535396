"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of one Arrow batch sent to a Python worker. Texts can be long; with
#: few rows a batch stays small enough for two workers beside an executor.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Settings of the Arrow exchange that keep the workers' memory bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there:
    later stages neither repeat the work nor depend on one executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass
class Table:
    """A table that :func:`table_of` wrote, and where."""

    rows: DataFrame
    path: str


def table_of(df: DataFrame) -> Table:
    """``df`` as a Parquet table in the shared checkpoint folder, to be
    dropped by :func:`drop_table` once what was made of it is written."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Table(df.sparkSession.read.schema(df.schema).parquet(path), path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a table written by :func:`table_of`."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Cuts rows of the given sizes into runs of about ``most`` in sum (one
    row at least), so that vector work has bounded scratch memory."""
    start = total = n = 0
    for n, size in enumerate(sizes, 1):
        if total and total + size > most:
            yield start, n - 1
            start, total = n - 1, 0
        total += size
    if n > start:
        yield start, n


def with_rows(df: DataFrame, fn, schema: str, *columns: str) -> DataFrame:
    """``df.select(columns).mapInArrow(fn, schema)``."""
    return df.select(*[F.col(c) for c in columns]).mapInArrow(fn, schema)


#: Bits of the filter of :func:`likely`, whatever the input: 2 MB.
FILTER_BITS = 1 << 24


def likely(df: DataFrame, key: str, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``ids`` (one column), and a few
    more; with ``keep=False`` the others. A bitmap of fixed size is broadcast,
    so rows that a later join would drop are dropped before they are shuffled."""
    slot = F.pmod(F.xxhash64("__id"), F.lit(FILTER_BITS))
    bitmap = (ids.select(F.col(ids.columns[0]).alias("__id")).where("__id is not null")
              .select(F.shiftright(slot, 6).alias("__word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(__id), {FILTER_BITS}) & 63 as int))").alias("__bit"))
              .groupBy("__word").agg(F.bit_or("__bit").alias("__bits")))
    bitmap = durable(bitmap)
    own = df.withColumn("__slot", F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BITS)))
    hit = (F.shiftright("__slot", 6) == F.col("__word")) & (F.expr("shiftright(__bits, cast(__slot & 63 as int)) & 1") == 1)
    return own.join(F.broadcast(bitmap), hit, "left_semi" if keep else "left_anti").drop("__slot")


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not among ``ids`` (one column); a
    null key stays. Only rows that may be among them are shuffled."""
    ids = durable(ids.select(F.col(ids.columns[0]).alias("__gone")).where("__gone is not null").distinct())
    held = likely(df, key, ids)
    return likely(df, key, ids, keep=False).union(held.join(ids, held[key] == F.col("__gone"), "left_anti"))
