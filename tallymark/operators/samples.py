"""Choice of a fixed set of files by quotas, with substitution."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slot:
    """So many files of a group for which ``fits`` holds; files of the same sign may stand in for them."""

    name: str
    count: int
    positive: bool
    fits: Column


CHOSEN = "{group} string, {file} string, slot string, place int, substituted boolean, reason string"


def fill_slots(files: list[tuple[str, bool, list[bool]]], slots: list[tuple[str, int, bool]]) -> list[tuple[str, str, int, bool, str]]:
    """(file, slot, place, substituted, reason) for one group's files (file, positive, fits a slot), best first.

    The slots are filled one after the other, each file once. What stays empty is then filled
    by files of the same sign that are left, first those that fit the nearest slot, by its
    place in the list (of two as near, the earlier one); files that fit none come last.
    """
    left, found, empty = list(files), [], []
    for k, (name, count, positive) in enumerate(slots):
        own = [f for f in left if f[1] == positive and f[2][k]][:count]
        found += [(f[0], name, i + 1, False, f"fits {name}") for i, f in enumerate(own)]
        left = [f for f in left if f not in own]
        empty += [(k, place) for place in range(len(own) + 1, count + 1)]
    for k, place in empty:
        name, _, positive = slots[k]
        near = lambda f: min(((abs(j - k), j) for j, (ok, s) in enumerate(zip(f[2], slots)) if ok and s[2] == f[1]), default=(len(slots), -1))
        same = [f for f in left if f[1] == positive]
        if same:
            best = min(same, key=near)  # of equals the first
            fits = near(best)[1]
            found.append((best[0], name, place, True, f"{name} has no more candidates: from {slots[fits][0] if fits >= 0 else 'no slot'}"))
            left.remove(best)
    return found


def by_quota(files: DataFrame, group: str, file: str, positive: Column, slots: list[Slot], order: list[Column]) -> DataFrame:
    """Files for every slot of every group, preferred in the given order; the order must leave no ties.

    Of the files of a group that fit the same slots no more than all slots together can be
    chosen, so only so many of each kind, the best ones, meet in a task: at most
    2 ** slots kinds times the sum of the counts, whatever the group's size.
    """
    most = sum(s.count for s in slots)
    kinds = [F.coalesce(s.fits, F.lit(False)) for s in slots]
    marked = files.select(F.col(group).alias("_group"), F.col(file).alias("_file"), F.coalesce(positive, F.lit(False)).alias("_positive"), F.array(*kinds).alias("_fits"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_order"))
    w = W.partitionBy("_group", "_positive", "_fits").orderBy("_order")
    few = marked.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most)
    return few.groupBy("_group").applyInPandas(_fill([(s.name, s.count, s.positive) for s in slots]), CHOSEN.format(group="_group", file="_file")).withColumnsRenamed({"_group": group, "_file": file})


def _fill(slots: list[tuple[str, int, bool]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_key=[tuple(o.values()) if isinstance(o, dict) else tuple(o) for o in rows["_order"]]).sort_values("_key")
        files = [(f, bool(p), [bool(x) for x in fits]) for f, p, fits in zip(rows["_file"], rows["_positive"], rows["_fits"])]
        found = pd.DataFrame(fill_slots(files, slots), columns=["_file", "slot", "place", "substituted", "reason"])
        found.insert(0, "_group", rows["_group"].iloc[0])
        return found

    return run
