"""Shared plumbing of the document operators: table access, staged tables, text batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep an Arrow batch of long texts within a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that gives freed memory back to the system when its task ends; workers live on between tasks."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidy


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallymark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tallymark-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    This cuts lineage with a copy that outlives any executor. The folder belongs to the
    application and is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    _forget_at_exit(spark, root)
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_at = path
    return found


def unstage(tables: list[DataFrame]) -> None:
    """Remove staged tables that nothing reads any more, and empty the list."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    tables.clear()


_roots: set[str] = set()


def _forget_at_exit(spark: SparkSession, root: str) -> None:
    if root in _roots:
        return
    _roots.add(root)

    def drop() -> None:
        sc = spark.sparkContext
        if sc._jsc is None:
            return
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(drop)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def utf8(text: Column) -> Column:
    """Text as bytes for Python workers; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, kept: DataFrame, of_row: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` that agree with one of ``kept`` in doc_id and the columns computed by ``of_row`` (nulls included)."""
    names = {c: fresh(docs, f"kept_{c}") for c in kept.columns}
    ids = kept.select(*[F.col(c).alias(n) for c, n in names.items()]).distinct()
    mine = {"doc_id": F.col("doc_id"), **of_row}
    same = [mine[c].eqNullSafe(F.col(n)) for c, n in names.items()]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return docs.join(ids, condition, "left_semi")
