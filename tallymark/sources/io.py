"""Readers, writers and incremental state (IO1-IO18, U1-U4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AUDIO = ["mp3", "wav", "m4a", "ogg", "flac", "aac"]
LAYOUT = r"/([a-z]+)_([a-z]+)/(TP|FP)(?:/(Single|Multi))?/([^/]+)\.([A-Za-z0-9]+)$"
LAYOUT_FN = r"/([a-z]+)_fn/([^/]+)\.([A-Za-z0-9]+)$"


def dataset_files(spark: SparkSession, root: str, languages: list[str] | None = None, buckets: list[str] | None = None) -> DataFrame:
    """Files of a directory tree whose folders are the schema: file_id, path, language, category, bucket, multiplicity.

    Spark lists the folders, in parallel if there are many, and no file is opened, as only the
    paths are asked for. With ``languages`` or ``buckets`` (TP, FP, FN) the other folders are not
    even listed.
    """
    folders = _folders(spark, root, languages, buckets)
    if not folders:
        return layout_rows(spark.createDataFrame([], "path string"))
    return layout_rows(listed(spark, folders)).orderBy("path")


def listed(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The paths of all files below the folders (files without content are passed over)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).select("path")


def _folders(spark: SparkSession, root: str, languages: list[str] | None, buckets: list[str] | None) -> list[str]:
    """The folders to list, by glob patterns of which each level matches a few names."""
    if not languages and not buckets:
        return [root]
    language = f"{{{','.join(languages)}}}" if languages else "*"
    tops = [b for b in buckets or ("TP", "FP") if b != "FN"]
    globs = [f"{root}/{language}_*/{{{','.join(tops)}}}"] if tops else []
    if not buckets or "FN" in buckets:
        globs.append(f"{root}/{language}_fn")
    sc = spark.sparkContext
    found = []
    for g in globs:
        path = sc._jvm.org.apache.hadoop.fs.Path(g)
        found += [s.getPath().toString() for s in path.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(path) or []]
    return sorted(found)


def layout_rows(paths: DataFrame) -> DataFrame:
    """Audio files of that layout, by their paths alone."""
    tp = lambda i: F.nullif(F.regexp_extract("path", LAYOUT, i), F.lit(""))
    fn = lambda i: F.nullif(F.regexp_extract("path", LAYOUT_FN, i), F.lit(""))
    rows = paths.select(
        F.coalesce(tp(5), fn(2)).alias("file_id"), "path", F.coalesce(fn(1), tp(1)).alias("language"), F.when(fn(1).isNull(), tp(2)).alias("category"),
        F.when(fn(1).isNotNull(), "FN").otherwise(tp(3)).alias("original_bucket"), tp(4).alias("multiplicity"), F.lower(F.coalesce(tp(6), fn(3))).alias("ext"),
    )
    return rows.where(F.col("ext").isin(*AUDIO)).drop("ext")


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_first", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_first = 1").drop("_first")


def keyed_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and all of ``new``."""
    same = [old[k].eqNullSafe(new[k]) for k in keys]
    return old.join(new.select(*keys).distinct(), same, "left_anti").unionByName(new, allowMissingColumns=True)


def keyed_union(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; the second table's row wins."""
    return keyed_merge(one, first_wins(two.withColumn("_z", F.lit(0)), keys, "_z").drop("_z"), keys)


def todo(rows: DataFrame, done: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """Rows without a successful result."""
    return rows.join(done.where(ok).select(*keys).distinct(), keys, "left_anti")


def write_back(flags: DataFrame, annotations: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Flags with the annotations of files whose flag and annotation numbers agree; other files stay as they are."""
    file_keys = keys[:-1]
    n = flags.groupBy(*file_keys).agg(F.count("*").alias("_n"))
    m = annotations.groupBy(*file_keys).agg(F.count("*").alias("_m"))
    good = n.join(m, file_keys).where("_n = _m").select(*file_keys)
    return flags.join(annotations.join(good, file_keys, "left_semi").select(*keys, *columns), keys, "left")


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(*columns).write.mode("overwrite").option("header", "true").csv(path)


def write_once(rows: DataFrame, path: str) -> None:
    """A CSV that stays as it is: a second write to the same path is an error."""
    rows.write.mode("errorifexists").option("header", "true").csv(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small report as a markdown table; more rows than ``limit`` are an error."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"a report has more than {limit} rows")
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *(line(["" if v is None else str(v) for v in r]) for r in got)])


def report_lines(sections: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """Tables as the lines of one markdown report: section, line, text, to be read in that order.

    Each section is a title, a table of few rows and the columns to sort it by.
    """
    found = None
    for k, (title, rows, order) in enumerate(sections):
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), F.lit(" |"))
        body = rows.select((F.row_number().over(W.orderBy(*order)) + 4).alias("line"), cells.alias("text"))
        head = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "| " + " | ".join(["---"] * len(rows.columns)) + " |"]
        lines = rows.sparkSession.createDataFrame(list(enumerate(head, 1)), "line int, text string").unionByName(body).withColumn("section", F.lit(k + 1))
        found = lines if found is None else found.unionByName(lines)
    return found.select("section", "line", "text")


def write_report(lines: DataFrame, path: str) -> None:
    """A report's lines as one text file, with an empty line before each section but the first."""
    gap = F.when((F.col("line") == 1) & (F.col("section") > 1), "\n").otherwise("")
    lines.coalesce(1).sortWithinPartitions("section", "line").select(F.concat(gap, "text").alias("value")).write.mode("overwrite").text(path)
