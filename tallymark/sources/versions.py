"""Tables that are merged in place on disk, version by version (IO10, IO11, E9).

A table is a folder of Parquet parts, cut by run and a bucket of the file id, and a list of
versions beside it. A version is one small file that names the folder of every part; it is
written last, under a name that only one writer can take, and readers look at nothing else.
So a merge that breaks off leaves the table as it was, and the parts that it does not touch
are not written again.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer has made the next version meanwhile."""


class VersionedTable:
    """Rows of runs and files under ``root``; ``run`` and ``file`` name the columns that they are cut by.

    The list of a version has an entry for each run and bucket, so it grows with the runs, not
    with the rows. Old versions stay readable until ``forget`` removes them.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType, run: str = "run_key", file: str = "file_id", buckets: int = BUCKETS):
        self.spark, self.root, self.schema, self.run, self.file, self.buckets = spark, root.rstrip("/"), schema, run, file, buckets

    # --- the list of versions

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """The numbers of all committed versions."""
        fs, folder = self._fs(f"{self.root}/_versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def _listed(self, number: int) -> dict:
        fs, path = self._fs(f"{self.root}/_versions/{number:08d}.json")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, number: int, entry: dict) -> None:
        """Write a version's list under another name and rename it, which fails if the version exists."""
        fs, draft = self._fs(f"{self.root}/_versions/.{number:08d}-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        _, path = self._fs(f"{self.root}/_versions/{number:08d}.json")
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise Conflict(f"version {number} exists")

    # --- reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is given; an empty table if there is none."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self._rows(self._listed(known[-1] if version is None else version)["parts"])

    def _rows(self, parts: dict[str, str]) -> DataFrame:
        folders = sorted(set(parts.values()))
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    # --- writing

    def _part(self) -> list[Column]:
        bucket = F.pmod(F.xxhash64(self.file), F.lit(self.buckets)).cast("int")
        return [F.coalesce(F.col(self.run).cast("string"), F.lit("")).alias("_run"), bucket.alias("_bucket")]

    def merge(self, new: DataFrame, keys: list[str], commit_id: str) -> int:
        """Replace the rows whose ``keys`` are in ``new`` by those of ``new``, all else stays; the new version's number.

        Only parts of runs and buckets that ``new`` or a replaced row is in are written. A call with
        the ``commit_id`` of a committed version does nothing, so a job may simply be run again.
        """
        if self.run not in keys:
            raise ValueError(f"the keys must name {self.run}, by which the table is cut")
        known = self.versions()
        entry = self._listed(known[-1]) if known else {"parts": {}, "commits": {}}
        if commit_id in entry["commits"]:
            return entry["commits"][commit_id]
        number = (known[-1] if known else 0) + 1
        rows = new.select(*self.schema.names).withColumns(dict(zip(["_run", "_bucket"], self._part())))
        # a whole run is replaced in all its buckets, a file only in its own
        hit = rows.select("_run", *(["_bucket"] if self.file in keys else [])).distinct()
        touched = {self._name(r["_run"], b) for r in hit.collect() for b in ([r["_bucket"]] if self.file in keys else range(self.buckets))}  # runs by buckets
        old = {k: f for k, f in entry["parts"].items() if k in touched}
        if old:
            before = self._rows(old)
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
            ids = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys]).distinct()
            kept = before.join(ids, same, "left_anti")
            rows = rows.unionByName(kept.withColumns(dict(zip(["_run", "_bucket"], self._part()))))
        folder = f"data/version={number}-{uuid.uuid4().hex[:8]}"
        rows.repartition("_run", "_bucket").write.partitionBy("_run", "_bucket").parquet(f"{self.root}/{folder}")
        written = {self._name(r["_run"], r["_bucket"]): r["path"] for r in self._folders(folder)}
        parts = {k: f for k, f in entry["parts"].items() if k not in touched} | written
        self._commit(number, {"parts": parts, "commits": entry["commits"] | {commit_id: number}})
        return number

    def annotate(self, notes: DataFrame, keys: list[str], columns: list[str], commit_id: str) -> int:
        """Write columns of ``notes`` into the rows of the files whose numbers of rows agree; the other files stay as they are."""
        file_keys = keys[:-1]
        size = lambda rows, n: rows.groupBy(*file_keys).agg(F.count("*").alias(n))
        own = self.read().join(notes.select(*file_keys).distinct(), file_keys, "left_semi")
        good = size(own, "_n").join(size(notes, "_m"), file_keys).where("_n = _m").select(*file_keys)
        rows = own.join(good, file_keys, "left_semi").drop(*columns).join(notes.select(*keys, *columns), keys, "left")
        return self.merge(rows, file_keys, commit_id)

    @staticmethod
    def _name(run: str, bucket: int) -> str:
        return f"{run}/{bucket}"

    def _folders(self, folder: str) -> list:
        """The parts that a write has made, from the listing of its folders; no row is read."""
        fs, top = self._fs(f"{self.root}/{folder}")
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        found = []
        for run in fs.listStatus(top):
            name = run.getPath().getName()
            if name.startswith("_run="):
                value = unescape(name.removeprefix("_run="))
                for bucket in fs.listStatus(run.getPath()):
                    found.append({"_run": "" if value == "__HIVE_DEFAULT_PARTITION__" else value, "_bucket": int(bucket.getPath().getName().removeprefix("_bucket=")), "path": f"{folder}/{name}/{bucket.getPath().getName()}"})
        return found

    def forget(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions, and the folders that no version names; not while a merge is under way."""
        known = self.versions()
        used = {f.split("/_run=")[0] for v in known[-keep:] for f in self._listed(v)["parts"].values()}
        for v in known[:-keep]:
            fs, path = self._fs(f"{self.root}/_versions/{v:08d}.json")
            fs.delete(path, False)
        fs, data = self._fs(f"{self.root}/data")
        for s in fs.listStatus(data) if fs.exists(data) else []:
            if f"data/{s.getPath().getName()}" not in used:
                fs.delete(s.getPath(), True)
