"""Running sums in order without a task for each key (the basis of R1, R3-R5 and R11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Rows that one window holds, about.
BLOCK = 500_000


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], sums: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` with upto_<c> for every column c of ``sums``: its sum over the rows of the same keys up to and with this one.

    Up to ``block`` rows in all are one window a key. Beyond that the rows are range-partitioned
    by key and order into blocks of about that size and written once, so that a row's block is
    settled; the sums of whole blocks, a few rows a key, are added up first, and inside a block
    only its own rows are sorted. A key with any share of the rows is so many tasks. Nulls in a
    key are a key; ``order`` should leave no ties that matter.
    """
    held = staged(rows, "ordered-rows")
    n = held.count()
    if n <= block:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return held.withColumns({f"upto_{c}": F.sum(c).over(w) for c in sums})
    placed = held.repartitionByRange(-(-n // block), *[F.col(k) for k in keys], *order).withColumn("_block", F.spark_partition_id())
    placed = staged(placed, "ordered-blocks")
    whole = placed.groupBy(*keys, "_block").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    names = {k: f"_key_{k}" for k in keys}
    before = whole.select(*[F.col(k).alias(n) for k, n in names.items()], F.col("_block").alias("_of"), *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums])
    inside = W.partitionBy("_block", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = placed.withColumns({f"upto_{c}": F.sum(c).over(inside) for c in sums})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], F.col("_block") == F.col("_of"))
    found = summed.join(before, same).withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.col(f"_before_{c}") for c in sums})
    return found.select(*rows.columns, *[f"upto_{c}" for c in sums])
