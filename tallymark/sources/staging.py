"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_roots: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, removed when the driver's Python ends.

    A local folder serves only where none is set and the master is local.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="tallymark-")
        found = _local[app]
    root = f"{found.rstrip('/')}/tallymark-documents-{app}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    return root


def made_from(spark: SparkSession, table: str) -> str:
    """A short name for what is derived from a table: another one if the table is written anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    written = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    return hashlib.md5(f"{table}|{written}".encode()).hexdigest()[:12]


def _remove(spark: SparkSession, root: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder: what follows reads the copy, and no lost executor makes it be computed again."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
