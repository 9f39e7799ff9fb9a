"""Filter interaction audit over all orders of the filters (operator 12).

Five filters look at whole texts (words: maximal runs of bytes other than \\x20 and
\\x09-\\x0D, case counts): A under 100 words; B fewer distinct words than 80 % of the words;
C capitals A-Z above 10 % of the code points; D holds any of #$%&*|; E the text is that of a
smaller doc_id, wherever that is in the table.

1. One pass over the texts turns each into a mask of the filters A to D that it fails and the
   SHA-256 digest of its bytes, by which equal texts are known; the texts stay where they are.
2. E is settled by the least doc_id of each digest that occurs twice, and the documents are
   counted by part (language) and mask: at most 32 cells a part, whatever the input.
3. Per part, all orders are visited by swapping two neighbours at a time. A swap changes what
   the two swapped steps see, and nothing before or after them, so only these two are counted
   anew from the cells. A filter's removals are summed over all orders (its Shapley value
   times 120) as the walk goes on: a step's count is added once, when it changes, times the
   orders that it stood for.

Defined cases: a null text counts as empty, which fails A alone (and E if another empty one
has a smaller doc_id); a null language and an empty one are the same part, ''; a null doc_id
never fails E, lets nobody fail it and has no labels; rows that repeat a doc_id count each, and do not make
each other fail E; a value equal to a limit passes; a document counts as good or toxic if any
of its labels says so, and one without labels as neither; texts of any length are read whole;
an empty table gives no rows; columns beyond those used are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, read, staged, tidied, utf8

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
FEWEST_WORDS = 100
LEAST_DISTINCT = 80
MOST_CAPITALS = 10
SYMBOLS = b"#$%&*|"
_CAPITALS = bytes(range(65, 91))


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    points = len(text.decode("utf-8", "replace"))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    fails = (
        len(words) < FEWEST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * points, len(text.translate(None, SYMBOLS)) < len(text),
    )
    return sum(f << i for i, f in enumerate(fails))


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        mask = pa.array(map(text_mask, texts), pa.int32())
        digest = pa.array((hashlib.sha256(t).digest() for t in texts), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), mask, digest], names=["doc_id", "part", "mask", "digest"])


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and the mask of all five filters for every row of ``docs`` (doc_id, text, lang)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), utf8(F.col("text")).alias("text"))
    marked = staged(rows.mapInArrow(tidied(_masks), "doc_id long, part string, mask int, digest binary"), "audit-masks")
    first = marked.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    first = staged(first, "audit-first")  # as a table of its own, so that a digest with very many rows can be split
    copy = F.when(F.col("doc_id") > F.col("least"), 1 << COPY).otherwise(0)
    return marked.join(first, "digest", "left").select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones by part and mask."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")])
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return failed.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), count("quality").alias("good"), count("toxic").alias("toxic"))


def swaps(n: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of range(n), each from the one before by swapping neighbours; beside it the left place of the swap."""
    order, to_left = list(range(n)), [True] * n
    yield order, None
    while True:
        # the largest element that looks at a smaller neighbour moves past it
        for v in range(n - 1, -1, -1):
            i = order.index(v)
            j = i - 1 if to_left[v] else i + 1
            if 0 <= j < n and order[j] < v:
                break
        else:
            return
        order[i], order[j] = order[j], order[i]
        for u in range(v + 1, n):  # all larger ones turn round
            to_left[u] = not to_left[u]
        yield order, min(i, j)


_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
AUDIT_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*_COUNTS, "shapley"])


def walk(counts: np.ndarray, filters: str) -> tuple[list[tuple], list[int]]:
    """(order, step, *counts) of every step of every order, and each filter's removals over all orders.

    ``counts``: documents, good and toxic ones by mask, three rows of 2 ** len(filters).
    """
    n = len(filters)
    masks = np.arange(1 << n)

    def step(before: int, f: int) -> tuple[int, ...]:
        fails, gone = (masks >> f & 1) == 1, (masks & before) != 0
        removed, good, toxic = counts[:, fails & ~gone].sum(axis=1).tolist()
        return int(counts[0, ~fails & ~gone].sum()), removed, int(counts[0, fails & gone].sum()), int(counts[0, 1 << f]), good, toxic

    rows, shapley, visited = [], [0] * n, 0
    now: list[tuple[int, ...]] = [()] * n
    since, of = [0] * n, [0] * n
    for order, left in swaps(n):
        before = 0
        for i, f in enumerate(order):
            if left is None or i in (left, left + 1):
                if left is not None:
                    shapley[of[i]] += now[i][1] * (visited - since[i])
                now[i], since[i], of[i] = step(before, f), visited, f
            before |= 1 << f
        name = "".join(filters[f] for f in order)
        rows += [(name, i + 1, *now[i]) for i in range(n)]
        visited += 1
    for i in range(n):
        shapley[of[i]] += now[i][1] * (visited - since[i])
    return rows, shapley


def _audit(filters: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((3, 1 << len(filters)), np.int64)
        counts[:, part["mask"]] = part[["n", "good", "toxic"]].to_numpy(np.int64).T
        rows, shapley = walk(counts, filters)
        found = pd.DataFrame(rows, columns=["filter_order", "step", *_COUNTS])
        found["shapley"] = [shapley[filters.index(o[s - 1])] for o, s in zip(found["filter_order"], found["step"])]
        found.insert(0, "part", part["part"].iloc[0])
        return found

    return run


def audit(by_cell: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every step of every order of the filters per part, from cells (part, mask, n, good, toxic).

    Any filters will do whose failures are bits of the mask; the rows of a part are
    the steps of all orders, so there should be few of them.
    """
    return by_cell.groupBy("part").applyInPandas(_audit(filters), AUDIT_SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return audit(cells(failures(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels")))


ORACLE_SQL = """
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
e as (select t, min(doc_id) as least from d group by t),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > e.least, false)::int as mask
  from d join e using (t) left join l on l.doc_id = d.doc_id),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
o as (select a.f || b.f || c.f || d.f || e.f as o, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a join f b on b.f <> a.f join f c on c.f not in (a.f, b.f)
  join f d on d.f not in (a.f, b.f, c.f) join f e on e.f not in (a.f, b.f, c.f, d.f)),
s as (select o as filter_order, i as step, bits[i] as bit, cast(coalesce(list_sum(bits[1:i - 1]), 0) as int) as before from o, (select unnest(range(1, 6))::int as i)),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by 1, 2),
r as (select part, filter_order, step, bit,
    sum(case when mask & (before | bit) = 0 then n else 0 end) as kept, sum(case when mask & before = 0 and mask & bit <> 0 then n else 0 end) as removed,
    sum(case when mask & before <> 0 and mask & bit <> 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & before = 0 and mask & bit <> 0 then good else 0 end) as good_lost, sum(case when mask & before = 0 and mask & bit <> 0 then toxic else 0 end) as toxic_lost
  from c, s group by 1, 2, 3, 4)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
from r
"""
