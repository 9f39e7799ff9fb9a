"""Pairing of model flags with reference flags.

Candidate pairs come from equi-joins on file and stretch of time and are scored by their
contents' vectors. One-to-one assignment solves each connected group of candidates by itself:
many files a batch, and a hot file's groups as tasks of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import at_chunk_border, ratio_bound_by_length, ratio_bound_by_letters, script_share, time_decay, unit, unit_cosine
from ..functions.udfs import text_ratio, text_ratio_if_known
from ..sources.staging import staged
from .components import components

WEIGHT_CONTENT, WEIGHT_TIME, CATEGORY_BONUS = 0.70, 0.30, 0.15
MIN_CONTENT, MIN_SCORE = 0.5, 0.45
LEAST_SCRIPT = 0.5
NOT_ALLOWED = 1e6


def near_pairs(gt: DataFrame, flags: DataFrame, seconds: float, of_gt: dict[str, Column] | None = None, of_flag: dict[str, Column] | None = None) -> DataFrame:
    """Pairs of one file at most ``seconds`` apart: run_key, file_id, gi, gc, mi, mc, delta, and the columns asked of each side.

    Time is cut into stretches of that length and a reference flag stands in its own and
    both beside it, so that a file with many flags is joined stretch by stretch.
    """
    of_gt, of_flag = of_gt or {}, of_flag or {}
    more = lambda columns: [c.alias(n) for n, c in columns.items()]
    stretch = lambda c: F.floor(F.col(c) / F.lit(float(max(seconds, 1))))
    g = gt.select("file_id", F.col("category").alias("gc"), F.col("event_id").alias("gi"), F.col("t_sec").cast("double").alias("gs"), *more(of_gt))
    g = g.withColumn("stretch", F.explode(F.sequence(stretch("gs") - 1, stretch("gs") + 1)))
    f = flags.select("run_key", "file_id", F.col("category").alias("mc"), F.col("event_id").alias("mi"), F.col("t_sec").cast("double").alias("ms"), *more(of_flag)).withColumn("stretch", stretch("ms"))
    return f.join(g, ["file_id", "stretch"]).withColumn("delta", F.abs(F.col("gs") - F.col("ms"))).where(F.col("delta") <= seconds).select("run_key", "file_id", "gi", "gc", "mi", "mc", "delta", *of_gt, *of_flag)


def mutual_pairs(pairs: DataFrame, order: list[str]) -> DataFrame:
    """The pairs of a run in which each side is the other's best by ``order`` (least first), then by the lower id."""
    of_flag = pairs.groupBy("run_key", "mi").agg(F.min(F.struct(*order, "gi")).alias("a"))
    of_gt = pairs.groupBy("run_key", "gi").agg(F.min(F.struct(*order, "mi")).alias("b"))
    best = of_flag.select("run_key", "mi", F.col("a.gi").alias("gi")).join(of_gt.select("run_key", F.col("b.mi").alias("mi"), "gi"), ["run_key", "mi", "gi"], "left_semi")
    return pairs.join(best, ["run_key", "mi", "gi"], "left_semi")


def band_candidates(gt: DataFrame, flags: DataFrame, seconds: int = 15) -> DataFrame:
    """Pairs of one file and category at most ``seconds`` apart: run_key, file_id, gi, mi, delta."""
    return near_pairs(gt, flags, seconds).where("gc = mc").select("run_key", "file_id", "gi", "mi", F.col("delta").cast("int").alias("delta"))


def prematched(candidates: DataFrame, gt_text: Column, flag_text: Column, least: float) -> DataFrame:
    """Candidates whose texts are at least so similar, with the similarity.

    Two bounds that are never below it rule most pairs out before any text reaches Python:
    by the lengths, then by how often each letter occurs.
    """
    return possible_matches(candidates, gt_text, flag_text, least).withColumn("similarity", text_ratio(gt_text, flag_text)).where(F.col("similarity") >= least)


def possible_matches(candidates: DataFrame, gt_text: Column, flag_text: Column, least: float) -> DataFrame:
    """Candidates whose texts may be at least so similar by their lengths and letters."""
    return candidates.where(ratio_bound_by_length(gt_text, flag_text) >= least).where(ratio_bound_by_letters(gt_text, flag_text) >= least)


def content_similarity(gt: Column, flag: Column, gt_text: Column | None = None, flag_text: Column | None = None, language: Column | None = None) -> Column:
    """How alike two flags' contents are, in [0, 1]: cosine of unit vectors, rescaled, or the likeness of the native texts if that is more.

    Native texts count only if at least half of the letters of both are in the language's
    script, and reach Python only if a bound allows them to beat the cosine.
    """
    by_vector = (unit_cosine(gt, flag) + 1) / 2
    if gt_text is None:
        return by_vector
    native = (script_share(gt_text, language) >= LEAST_SCRIPT) & (script_share(flag_text, language) >= LEAST_SCRIPT)
    beats = native & (ratio_bound_by_length(gt_text, flag_text) > by_vector) & (ratio_bound_by_letters(gt_text, flag_text) > by_vector)
    by_text = text_ratio_if_known(F.when(beats, gt_text), F.when(beats, flag_text))
    return F.greatest(by_vector, by_text)  # null is no contender


def scored_candidates(gt: DataFrame, flags: DataFrame, content: Column | None = None, seconds: float = 60.0, native: bool = False) -> DataFrame:
    """Pairs of one file within the time window, or with a flag at a chunk border, and their combined score.

    Both tables bring ``vec``, the content's vector, and with ``native`` also ``excerpt`` and the
    flags their ``language``. Vectors get length 1 once a flag and travel with it into the
    join, so that a pair costs one dot product and no look-up. Pairs whose content is less alike
    than ``MIN_CONTENT`` are no candidates. A flag at a chunk border has no usable time and
    meets all reference flags of its file. ``content``, a similarity in [0, 1] over columns gi and
    mi, takes the place of vectors and excerpts.
    """
    of_gt = {} if content is not None else {"gv": unit(F.col("vec"))} | ({"gx": F.col("excerpt")} if native else {})
    of_flag = {} if content is not None else {"mv": unit(F.col("vec"))} | ({"mx": F.col("excerpt"), "ml": F.col("language")} if native else {})
    more = lambda columns: [c.alias(n) for n, c in columns.items()]
    unknown = at_chunk_border(F.col("t_sec").cast("double"))
    near = near_pairs(gt, flags.where(~unknown), seconds, of_gt, of_flag).withColumn("known", F.lit(True))
    g = gt.select("file_id", F.col("category").alias("gc"), F.col("event_id").alias("gi"), *more(of_gt))
    f = flags.where(unknown).select("run_key", "file_id", F.col("category").alias("mc"), F.col("event_id").alias("mi"), *more(of_flag))
    anywhere = f.join(g, "file_id").withColumns({"delta": F.lit(0.0), "known": F.lit(False)})
    if content is None:
        content = content_similarity(F.col("gv"), F.col("mv"), *((F.col("gx"), F.col("mx"), F.col("ml")) if native else ()))
    pairs = near.unionByName(anywhere).withColumn("content", content).where(F.col("content") >= MIN_CONTENT)
    bonus = F.when(F.col("gc") == F.col("mc"), CATEGORY_BONUS).otherwise(-CATEGORY_BONUS)
    score = WEIGHT_CONTENT * F.col("content") + WEIGHT_TIME * time_decay(F.col("delta"), F.col("known")) + bonus
    return pairs.select("run_key", "file_id", "gi", "mi", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))


FILE = ["run_key", "file_id"]
PAIR = [*FILE, "gi", "mi", "score"]


def _codes(scores: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of both sides' flags, different between files."""
    return tuple(scores.groupby([*FILE, c], sort=False, dropna=False).ngroup().to_numpy() for c in ("gi", "mi"))


def greedy_pairs(scores: pd.DataFrame) -> pd.DataFrame:
    """Highest score first; of equals the lower gi, then mi; each side at most once in its file."""
    scores = scores.sort_values(["score", "gi", "mi"], ascending=[False, True, True], kind="stable")
    used_g, used_m, rows = set(), set(), []
    for i, (g, m) in enumerate(zip(*(c.tolist() for c in _codes(scores)))):
        if g not in used_g and m not in used_m:
            used_g.add(g)
            used_m.add(m)
            rows.append(i)
    return scores.iloc[rows][PAIR]


def least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least total cost; every row or every column is used."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in least_cost(cost.T))
    return least_cost_by_row(lambda i: cost[i], *cost.shape)


def least_cost_by_row(cost: Callable[[int], np.ndarray], n: int, m: int) -> list[tuple[int, int]]:
    """Assignment of least total cost of n rows, no more than the m columns, by shortest augmenting paths.

    Rows of costs are asked for as they are needed, so the table need not exist as a whole.
    """
    row_price, col_price = np.zeros(n), np.zeros(m + 1)
    owner = np.full(m + 1, -1)
    for start in range(n):
        owner[m] = start
        at, slack, via, seen = m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            seen[at] = True
            row, free = owner[at], ~seen[:m]
            reach = cost(row) - row_price[row] - col_price[:m]
            closer = free & (reach < slack)
            slack[closer], via[closer] = reach[closer], at
            nxt = int(np.argmin(np.where(free, slack, np.inf)))
            step = slack[nxt]
            visited = np.flatnonzero(seen)
            row_price[owner[visited]] += step
            col_price[visited] -= step
            slack[free] -= step
            at = nxt
        while at != m:
            owner[at] = owner[via[at]]
            at = via[at]
    return sorted((int(owner[c]), c) for c in range(m) if owner[c] >= 0)


def groups_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The connected group of every candidate pair (a, b) of numbers of both sides."""
    if not len(a):
        return a
    b = b + int(a.max()) + 1
    label = np.arange(int(b.max()) + 1)
    x, y = a, b
    while True:
        # the larger of two labels moves under the smaller, and all to the end of their chains
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label[a]
        a, b, x, y = (a, b, x[apart], y[apart])


def chosen(scores: pd.DataFrame, least: float) -> np.ndarray:
    """Places of the pairs of greatest total among the greatest number of pairs, without those below ``least``.

    Candidates that share no flag do not compete, so each connected group is settled by
    itself: one that is a single pair at once, the others by costs that are asked for row by row,
    so that memory follows the candidates and not the product of both sides.
    """
    if not len(scores):
        return np.zeros(0, int)
    g, m = _codes(scores)
    score = scores["score"].to_numpy(float)
    group = groups_of(g, m)
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
    found = []
    for rows in np.split(order, cuts[1:]):
        if len(rows) > 1:
            a, b = (np.unique(c[rows], return_inverse=True)[1] for c in (g, m))
            if a.max() > b.max():
                a, b = b, a
            by_row = np.argsort(a, kind="stable")
            n, width = int(a.max()) + 1, int(b.max()) + 1
            starts = np.searchsorted(a[by_row], np.arange(n + 1))

            def cost(i: int, rows=rows, b=b, by_row=by_row, starts=starts, width=width) -> np.ndarray:
                here = by_row[starts[i] : starts[i + 1]]
                out = np.full(width, NOT_ALLOWED)
                out[b[here]] = 1 - score[rows[here]]
                return out

            places = {pair: k for k, pair in enumerate(zip(a.tolist(), b.tolist()))}
            rows = rows[[places[p] for p in least_cost_by_row(cost, n, width) if p in places]]
        found.append(rows)
    found = np.sort(np.concatenate(found))
    return found[score[found] >= least - 1e-12]


def best_pairs(scores: pd.DataFrame, least: float = MIN_SCORE) -> pd.DataFrame:
    """Pairs of greatest total score in each file; pairs below ``least`` are dropped."""
    return scores.iloc[chosen(scores, least)][PAIR].sort_values([*FILE, "gi", "mi"])


def verified_pairs(verify: Callable[[pd.DataFrame], pd.Series], rounds: int = 3, reference_compat: bool = False) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Assign, let ``verify`` judge the pairs, forbid those it rejects and assign again, up to ``rounds`` times.

    With ``reference_compat`` rejected pairs stay in the cost matrix and are only skipped afterwards.
    All files of a batch go through the rounds together; a file without a rejected pair is done.
    """

    def run(scores: pd.DataFrame) -> pd.DataFrame:
        left = scores[PAIR].reset_index(drop=True)
        left["_g"], left["_m"], left["_no"] = *_codes(left), False
        confirmed = []
        for _ in range(rounds):
            usable = left if reference_compat else left[~left["_no"]]
            pairs = usable.iloc[chosen(usable, MIN_SCORE)]
            pairs = pairs[~pairs["_no"]]
            if pairs.empty:
                break
            good = verify(pairs[PAIR]).to_numpy(bool)
            confirmed.append(pairs.loc[good, PAIR])
            left.loc[pairs.index[~good], "_no"] = True
            again = pairs.loc[~good, FILE].drop_duplicates()
            left = left[~left["_g"].isin(pairs["_g"][good]) & ~left["_m"].isin(pairs["_m"][good])]
            left = left.reset_index().merge(again, on=FILE).set_index("index")
        return pd.concat(confirmed) if confirmed else pd.DataFrame([], columns=PAIR)

    return run


PAIR_SCHEMA = "run_key string, file_id string, gi long, mi long, score double"
#: Candidates of a file above which its connected groups are found by joins, to be tasks of their own.
HOT_FILE = 50_000


def assign(candidates: DataFrame, how: Callable[[pd.DataFrame], pd.DataFrame] = best_pairs, hot: int = HOT_FILE) -> DataFrame:
    """One-to-one pairs per run and file of candidates (run_key, file_id, gi, mi, score).

    ``how`` gets the candidates of many files at once, each file's or each connected group's whole.
    A file with more than ``hot`` candidates is first split into its connected groups, which
    no assignment can link, so that it is spread over as many tasks as it has groups.
    """
    held = staged(candidates.select(*PAIR), "match-candidates")
    large = staged(held.groupBy(*FILE).count().where(F.col("count") > hot).select(*FILE), "match-hot")
    rows = held.withColumn("part", F.lit(0).cast("long"))
    if not large.isEmpty():
        same = [held[k].eqNullSafe(large[k]) for k in FILE]
        side = lambda name, c: F.xxhash64(F.lit(name), *FILE, c)  # noqa: E731  a collision only joins two groups
        of_hot = staged(held.join(large, same, "left_semi").withColumns({"a": side("g", "gi"), "b": side("m", "mi")}), "match-hot-rows")
        grouped = of_hot.join(components(of_hot.select("a", "b")), F.col("a") == F.col("v")).select(*PAIR, F.col("root").alias("part"))
        rows = held.join(large, same, "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(grouped)
    keys = [*FILE, "part"]

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = lambda rows, i: tuple(None if pd.isna(x) else x for x in rows[keys].iloc[i])
        held: list[pd.DataFrame] = []  # the last group, which may go on in the next batch
        for batch in batches:
            if batch.empty:
                continue
            if held and key(held[0], 0) == key(batch, 0) == key(batch, -1):
                held.append(batch)
                continue
            whole = pd.concat([*held, batch], ignore_index=True)
            number = whole.groupby(keys, sort=False, dropna=False).ngroup()
            ends = number == number.iloc[-1]
            held = [whole[ends]]
            if not ends.all():
                yield how(whole.loc[~ends, PAIR])
        if held:
            yield how(pd.concat(held)[PAIR])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "gi", "mi").mapInPandas(settle, PAIR_SCHEMA)


def reliability(proposed: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Confirmed share of the proposed pairs per run; 1 where none was proposed."""
    p = proposed.groupBy("run_key").agg(F.count("*").alias("n_proposed"))
    c = confirmed.groupBy("run_key").agg(F.count("*").alias("n_confirmed"))
    return p.join(c, "run_key", "left").select("run_key", "n_proposed", F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce(F.col("n_confirmed") / F.col("n_proposed"), F.lit(0.0)).alias("match_reliability"))


def same_pairs(one: DataFrame, two: DataFrame) -> DataFrame:
    """Per run and file whether two matcher runs agree on the whole set of pairs."""
    keys = ["run_key", "file_id"]
    tagged = one.select(*keys, "gi", "mi", F.lit(1).alias("w")).unionByName(two.select(*keys, "gi", "mi", F.lit(2).alias("w")))
    pairs = tagged.groupBy(*keys, "gi", "mi").agg(F.sum("w").alias("w"))
    return pairs.groupBy(*keys).agg(F.bool_and(F.col("w") == 3).alias("stable"))
