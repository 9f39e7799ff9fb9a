"""Near-duplicate groups by an LSH forest and an exact prefix join (operator 7).

A document's set holds its distinct 5-word shingles; two documents are linked when
their sets have a Jaccard similarity of at least 0.75, and a group is a connected
component of links.

1. Documents with equal sets form one node (grouped by a digest of the sorted set).
2. Each node has a signature of 72 min-hashes, of which each of 24 orders takes 6 in
   its own sequence. Every order is sorted as a whole: a range partitioning over
   (order, label, node) splits runs of any length evenly.
3. Neighbours in an order that share a prefix are candidates. The prefix that is asked
   for adapts to the region: from two components up to all six, the shortest one that at
   most ``SPARSE`` nodes share; in denser regions only rows with equal labels remain.
4. Each candidate first meets an exact bound: a node keeps the parities of its shingles'
   hash buckets, and the buckets that differ in parity are at least as many as the
   shingles in one set only. Pairs that it rules out are never fetched; the others are
   confirmed on the full sets of both texts. A first round over a few orders links most
   of each group; a second one over all orders only looks at neighbours in different
   components, so that a group of n copies costs about n confirmations, not n squared.
5. What the orders miss comes from an exact join: shingles have one global order,
   common ones last, and two sets at the similarity or above share one of the first
   quarter of each set. Packed lists of these shingles go to owners by hash; nodes of
   different components that share one are compared, unless sizes and places show that
   they stay below the similarity. So the result does not depend on the orders. Which
   shingles are common is estimated on a sample, and affects cost only.

Defined cases: null or empty text has an empty set, is linked with nothing and stays;
fewer than five words make one shingle of the whole sequence; rows that repeat a doc_id
are linked by their own texts each, and bear the least doc_id that theirs reaches; a
null doc_id takes the component of its set, and stays only if no numbered document has
that set; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, bounded_batches, crc_mod, keep_rows, rows_of, staged, tidied, unstage, utf8

WIDTH = 5
PERCENT = 75
HASHES = 72
ORDERS = 24
DEPTH = 6
LEAST_DEPTH = 2
SPARSE = 16
FIRST_ORDERS = 4
REACH = 2
#: Rows of an order, and shingles of an owner, that one task holds at once, about; the number of tasks follows.
TASK_ROWS = 500_000
TASK_SHINGLES = 1_000_000
#: Edges that one task contracts at once (16 bytes each); above that, contraction is distributed.
LOCAL_EDGES = 1_000_000
#: For the order of shingles: about one document in so many is looked at, and so many of the shingles found most often come last.
LOOK_AT = 16
COMMON = 200_000
#: Pairs of nodes that are held at once while one shingle's nodes are compared.
PAIR_BLOCK = 2_000_000
#: Candidate ids that may be broadcast to filter the scan of texts (8 bytes each).
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(20240707)
_MUL = _rng.integers(1, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_PICKS = np.concatenate([_rng.permutation(HASHES) for _ in range(ORDERS * DEPTH // HASHES)]).reshape(ORDERS, DEPTH)
_POWERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes, words: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text."""
    tokens = text.translate(ASCII_LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    if len(h) < WIDTH:
        total = np.uint64(len(h))
        for v in h:
            total = _mix(np.array([total ^ v]) * _POWERS[0])[0]
        return np.array([total], np.uint64)
    n = len(h) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        total = _mix(total + h[i : i + n] * _POWERS[i])
    return np.unique(total)


def _min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit min-hash components of non-empty sets, one row each."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    x = (np.concatenate(sets) >> np.uint64(16)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint16)
    for i in range(HASHES):
        least = np.minimum.reduceat(x * _MUL[i] + _ADD[i], starts)
        out[:, i] = (least * np.uint32(2654435761)) >> np.uint32(16)
    return out


def prefix(values: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order, of which similar sets share one; ``common`` is sorted."""
    n = len(values) - (len(values) * PERCENT + 99) // 100 + 1
    if not len(common):
        return values[:n]
    at = np.minimum(np.searchsorted(common, values), len(common) - 1)
    late = common[at] == values
    return np.concatenate([values[~late], values[late][np.argsort(rank[at[late]])]])[:n]


def set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def parities(values: np.ndarray) -> np.ndarray:
    """For each of a power of two of hash buckets, twice the set's size or more, whether its count is odd; packed bits."""
    buckets = 1 << max(6, int(2 * len(values) - 1).bit_length())
    counts = np.bincount((values & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.packbits((counts & 1).astype(np.uint8))


def may_reach(x: np.ndarray, y: np.ndarray, n: int, m: int) -> bool:
    """Whether sets of sizes n and m with these parities can be at the similarity; never false for sets that are."""
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return (100 + PERCENT) * int(np.bitwise_count(x ^ y).sum()) <= (100 - PERCENT) * (n + m)


_SKETCH_SCHEMA = "doc_id long, text_hash long, n_shingles long, set_key binary, sig binary, parity binary, prefix binary"


def _sketch(common: np.ndarray, rank: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(ids: list, hashes: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        sigs = iter(_min_hashes(full)) if full else iter(())
        keys = [set_key(s) if len(s) else None for s in sets]
        blobs = lambda f: pa.array([f(s).tobytes() if len(s) else None for s in sets], pa.binary())
        columns = [
            pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
            blobs(lambda s: next(sigs)), blobs(parities), blobs(lambda s: prefix(s, common, rank)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_shingles", "set_key", "sig", "parity", "prefix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            ids, hashes, sets, size = [], [], [], 0
            for doc_id, text_hash, text in rows_of(batch, "doc_id", "text_hash", "text"):
                s = shingle_set(text, words)
                ids.append(doc_id)
                hashes.append(text_hash)
                sets.append(s)
                size += len(s)
                if size > 300_000:
                    yield flush(ids, hashes, sets)
                    ids, hashes, sets, size = [], [], [], 0
            if ids:
                yield flush(ids, hashes, sets)

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _WordHashes()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, words).view(np.int64))], names=["shingle"])


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a sample of the texts has most often, sorted, and the rank of each by its count."""
    looked = texts.where(crc_mod(F.col("doc_id"), LOOK_AT) == 0) if texts.count() > 20_000 else texts
    counts = looked.select("text").mapInArrow(tidied(_shingles), "shingle long").groupBy("shingle").count().where("count >= 4")
    found = counts.orderBy(F.desc("count"), "shingle").limit(COMMON).toPandas()
    values, count = found["shingle"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy()
    by_value = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, count))] = np.arange(len(values))
    return values[by_value], rank[by_value]


def _labels(orders: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(n, HASHES)
            for k in range(orders):
                flat = np.ascontiguousarray(sig[:, _PICKS[k]].astype(">u2")).tobytes()
                width = DEPTH * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, k, np.int32)), pa.array([flat[i * width : (i + 1) * width] for i in range(n)], pa.binary()), batch.column("id"), batch.column("comp")],
                    names=["tree", "label", "id", "comp"],
                )

    return run


def neighbour_pairs(tree: np.ndarray, label: np.ndarray, ids: np.ndarray, comp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs among rows sorted by (tree, label); label has one column per component."""
    n = len(ids)
    if n < 2:
        return ids[:0], ids[:0]
    # runs of an equal prefix at each depth, and the least depth at which a row's run is sparse
    fresh_run = np.concatenate([[True], tree[1:] != tree[:-1]])
    runs, asked = [], np.full(n, DEPTH)
    for depth in range(1, DEPTH + 1):
        fresh_run = fresh_run | np.concatenate([[True], label[1:, depth - 1] != label[:-1, depth - 1]])
        runs.append(np.cumsum(fresh_run) - 1)
    for depth in range(DEPTH, LEAST_DEPTH - 1, -1):
        asked[np.bincount(runs[depth - 1])[runs[depth - 1]] <= SPARSE] = depth

    def pairs(rows_a: np.ndarray, rows_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = comp[rows_a] != comp[rows_b]
        rows_a, rows_b = rows_a[other], rows_b[other]
        common = sum((r[rows_a] == r[rows_b]).astype(np.int64) for r in runs)
        fits = common >= np.maximum(asked[rows_a], asked[rows_b])
        return rows_a[fits], rows_b[fits]

    rows = np.arange(n)
    found = [pairs(rows[:-k], rows[k:]) for k in range(1, min(reach, n - 1) + 1)]
    if reach > 1:  # stretches of one component count as one neighbour
        heads = np.flatnonzero(np.concatenate([[True], (comp[1:] != comp[:-1]) | (runs[1][1:] != runs[1][:-1])]))
        tails = np.concatenate([heads[1:] - 1, [n - 1]])
        for k in range(1, min(reach, len(heads) - 1) + 1):
            found.append(pairs(tails[:-k], heads[k:]))
    a = ids[np.concatenate([f[0] for f in found])]
    b = ids[np.concatenate([f[1] for f in found])]
    return np.minimum(a, b), np.maximum(a, b)


def _neighbours(reach: int, edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate pairs of sorted rows, a partition or the borders that it was dealt.

    With edges, also the partition's first and last rows (a is null), under the number of the
    border that they lie at: that of the partition before or of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        n = table.num_rows
        tree, ids, comp = (table.column(c).to_numpy() for c in ("tree", "id", "comp"))
        raw = table.column("label").to_pylist()
        label = np.frombuffer(b"".join(raw), ">u2").reshape(n, DEPTH)
        a, b = neighbour_pairs(tree, label, ids, comp, reach)
        both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        none = lambda k, t: pa.nulls(k, t)
        k = len(both)
        names = ["a", "b", "border", "tree", "label", "id", "comp"]
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64()), none(k, pa.int32()), none(k, pa.int32()), none(k, pa.binary()), none(k, pa.int64()), none(k, pa.int64())], names=names)
        if edges:
            part = TaskContext.get().partitionId()
            for border, keep in ((part - 1, np.arange(min(SPARSE, n))), (part, np.arange(max(0, n - SPARSE), n))):
                m = len(keep)
                yield pa.RecordBatch.from_arrays([none(m, pa.int64()), none(m, pa.int64()), pa.array(np.full(m, border, np.int32)), pa.array(tree[keep]), pa.array([raw[i] for i in keep], pa.binary()), pa.array(ids[keep]), pa.array(comp[keep])], names=names)

    return run


_CANDIDATE_SCHEMA = "a long, b long, border int, tree int, label binary, id long, comp long"


def _parts(df: DataFrame, rows: int, each: int) -> int:
    """Tasks for so many rows: the session's number or more, so that a task's share stays bounded."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def candidates(nodes: DataFrame, orders: int, reach: int, scratch: list[DataFrame]) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes (id, sig, comp) that are neighbours in some order; they read a table put into ``scratch``."""
    parts = _parts(nodes, nodes.count() * orders, TASK_ROWS)
    rows = nodes.select("id", "sig", "comp").mapInArrow(tidied(_labels(orders)), "tree int, label binary, id long, comp long")
    ordered = rows.repartitionByRange(parts, "tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    found = staged(ordered.mapInArrow(tidied(_neighbours(reach, True)), _CANDIDATE_SCHEMA), "near-candidates")
    scratch.append(found)
    # neighbours across two partitions: the last rows of one meet the first of the next; borders that share a task may add
    # candidates, which are confirmed like all, and what a very small partition keeps apart is left to the exact join
    ends = found.where("a is null").select("border", "tree", "label", "id", "comp").repartition("border").sortWithinPartitions("border", "tree", "label", "id")
    across = ends.drop("border").mapInArrow(_neighbours(reach, False), _CANDIDATE_SCHEMA)
    return found.where("a is not null").select("a", "b").unionByName(across.select("a", "b")).distinct()


def _postings(owners: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each owner of shingles: its 32-bit keys, node by node, with the nodes that they come from.

    ``most`` is the largest partner that can still reach the similarity from that shingle on.
    """

    def deal(ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(sets)), [len(p) for p in sets])
        place = np.concatenate([np.arange(len(p)) for p in sets])
        shingles = np.concatenate(sets)
        # with r shingles from this one on: (100 + PERCENT) r >= PERCENT (n + partner)
        most = (((100 + PERCENT) * (sizes[of] - place) - PERCENT * sizes[of]) // PERCENT).astype(np.int32)
        owner = ((shingles >> np.uint64(32)) % np.uint64(owners)).astype(np.int32)
        order = np.argsort(owner, kind="stable")
        owner, of, most, key = owner[order], of[order], most[order], (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order]
        new_owner = np.concatenate([[True], owner[1:] != owner[:-1]])
        node_at = np.flatnonzero(new_owner | np.concatenate([[True], of[1:] != of[:-1]]))
        times = np.diff(np.append(node_at, len(of))).astype(np.int32)
        node = of[node_at]
        at, first = np.append(np.flatnonzero(new_owner), len(of)), np.searchsorted(node_at, np.flatnonzero(new_owner))
        first = np.append(first, len(node_at))
        cut = lambda x, ends: pa.array([x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary())
        columns = [pa.array(owner[at[:-1]]), cut(key, at), cut(most, at), cut(ids[node], first), cut(comps[node], first), cut(sizes[node], first), cut(times, first)]
        return pa.RecordBatch.from_arrays(columns, names=_POSTING_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, comps, sizes = (batch.column(c).to_numpy() for c in ("id", "comp", "n_shingles"))
            sets = [np.frombuffer(p, np.uint64) for p in batch.column("prefix").to_pylist()]
            start = total = 0
            for i, p in enumerate(sets):
                total += len(p)
                if total >= TASK_SHINGLES // 2 or i == len(sets) - 1:
                    part = slice(start, i + 1)
                    yield deal(ids[part], comps[part], sizes[part], sets[part])
                    start, total = i + 1, 0

    return run


_POSTING_NAMES = ["owner", "key", "most", "id", "comp", "n", "times"]
_POSTING_SCHEMA = "owner int, key binary, most binary, id binary, comp binary, n binary, times binary"


def sharing_pairs(ids: np.ndarray, comp: np.ndarray, n: np.ndarray, most: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs (a, b), a < b, of one shingle's nodes in different components whose sizes and places allow the similarity."""
    if len(ids) < 2 or (comp == comp[0]).all():
        return
    # either every smaller node with the sizes it allows, or every node with all other components: the shorter way
    by_size = np.argsort(n, kind="stable")
    size = n[by_size]
    size_first = np.arange(len(ids)) + 1
    size_end = np.searchsorted(size, most[by_size], "right")
    by_comp = np.argsort(comp, kind="stable")
    comp_first = np.searchsorted(comp[by_comp], comp[by_comp], "right")
    comp_end = np.full(len(ids), len(ids))
    ways = [(by_size, size_first, size_end), (by_comp, comp_first, comp_end)]
    order, first, end = min(ways, key=lambda w: np.maximum(w[2] - w[1], 0).sum())
    width = np.maximum(end - first, 0)
    todo = np.flatnonzero(width)
    # rows with many partners are cut, so that a block of pairs is bounded
    while len(todo):
        upto = np.cumsum(np.minimum(width[todo], PAIR_BLOCK))
        k = max(1, int(np.searchsorted(upto, PAIR_BLOCK, "right")))
        rows, count = todo[:k], np.minimum(width[todo[:k]], PAIR_BLOCK)
        left = np.repeat(rows, count)
        right = np.repeat(first[rows], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        first[rows] += count
        width[rows] -= count
        todo = np.concatenate([rows[width[rows] > 0], todo[k:]])
        x, y = order[left], order[right]
        fits = (comp[x] != comp[y]) & (n[y] <= most[x]) & (n[x] <= most[y]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))
        if fits.any():
            a, b = ids[x[fits]], ids[y[fits]]
            yield np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def shared_pairs(key: np.ndarray, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, most: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of nodes of different components that share a key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    width = np.diff(np.append(heads, len(key)))
    # most shared shingles are shared by two
    two = heads[width == 2]
    x, y = order[two], order[two + 1]
    fits = (comp[x] != comp[y]) & (n[y] <= most[x]) & (n[x] <= most[y]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))
    a, b = ids[x[fits]], ids[y[fits]]
    yield np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
    for i, w in zip(heads[width > 2], width[width > 2]):
        rows = order[i : i + w]
        yield from sharing_pairs(ids[rows], comp[rows], n[rows], most[rows])


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes that share a shingle, owner by owner."""
    held: list[tuple] = []
    last = None

    def settle() -> Iterator[pa.RecordBatch]:
        key, most, ids, comp, n, times = (np.concatenate(c) for c in zip(*held))
        of = np.repeat(np.arange(len(ids)), times)
        out, size = [], 0
        for found in shared_pairs(key, ids[of], comp[of], n[of], most.astype(np.int64)):
            out.append(found)
            size += len(found)
            if size > PAIR_BLOCK:
                yield flush(out)
                out, size = [], 0
        if size:
            yield flush(out)

    def flush(out: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    types = (np.uint32, np.int32, np.int64, np.int64, np.int64, np.int32)
    for batch in batches:
        for owner, *blobs in rows_of(batch, *_POSTING_NAMES):
            if held and owner != last:
                yield from settle()
                held.clear()
            last = owner
            held.append(tuple(np.frombuffer(x, t) for x, t in zip(blobs, types)))
    if held:
        yield from settle()


def exact_candidates(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes (id, comp, n_shingles, prefix) in different components that hold all links between them."""
    total = nodes.agg(F.coalesce(F.sum(F.length("prefix")), F.lit(0))).first()[0] // 8
    owners = _parts(nodes, total, TASK_SHINGLES)
    rows = nodes.select("id", "comp", "n_shingles", "prefix").mapInArrow(tidied(_postings(owners)), _POSTING_SCHEMA)
    dealt = rows.repartition(owners, "owner").sortWithinPartitions("owner")
    return dealt.mapInArrow(tidied(_sharing), "a long, b long").distinct()


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fits = [may_reach(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), n, m) for x, y, n, m in rows_of(batch, "pa", "pb", "na", "nb")]
        yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in rows_of(batch, "sa", "sb"):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            inter = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * inter >= PERCENT * (len(x) + len(y) - inter))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _own_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the texts that have the node's set; a repeated doc_id may bring others."""
    words = _WordHashes()
    for batch in batches:
        for node, key, text in rows_of(batch, "id", "set_key", "text"):
            s = shingle_set(text, words)
            if set_key(s) == key:
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["id", "shingles"])


def confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The linked ones of the pairs (a, b): those that the parities leave, decided on the full sets of both texts."""
    of = lambda c: nodes.select(F.col("id").alias(c), F.col("parity").alias(f"p{c}"), F.col("n_shingles").alias(f"n{c}"))
    close = staged(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(tidied(_close), "a long, b long"), "near-close")
    ids = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
    wanted = nodes.select("id", "doc", "set_key").join(ids, "id", "left_semi")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted, F.col("doc_id").cast("long") == F.col("doc")).select("id", "set_key", utf8(F.col("text")).alias("text"))
    # rows that repeat both doc_id and set bring it once
    sets = staged(found.mapInArrow(tidied(_own_set), "id long, shingles binary").dropDuplicates(["id"]), "near-sets")
    at = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}"))
    linked = staged(close.join(at("a"), "a").join(at("b"), "b").select("a", "b", "sa", "sb").mapInArrow(tidied(_confirm), "a long, b long"), "near-linked")
    unstage([close, sets])
    return linked


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges: each vertex with the least vertex it reaches."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    vs = list(parent)
    for i in range(0, len(vs), 50_000):
        part = vs[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(v) for v in part], pa.int64())], names=["v", "root"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b); root is the least vertex of its component.

    While there are more edges than one task may hold, every vertex moves to its least
    neighbour and the edges are contracted, which at least halves the vertices that
    still have edges.
    """
    moved = None
    while edges.count() > local_edges:
        edges = staged(edges, "near-edges") if moved is None else edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("m")), "near-least")
        at = lambda c: least.select(F.col("v").alias(c), F.col("m").alias(f"m{c}"))
        if moved is None:
            moved = least.select("v", F.col("m").alias("root"))
        else:
            step = least.select(F.col("v").alias("root"), "m")
            moved = moved.join(step, "root", "left").select("v", F.coalesce("m", "root").alias("root"))
        moved = staged(moved, "near-moved")
        edges = edges.join(at("a"), "a").join(at("b"), "b").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).where("a <> b").distinct()
        edges = staged(edges, "near-edges")
    last = staged(edges.repartition(1).mapInArrow(_contract, "v long, root long"), "near-roots")
    if moved is None:
        return last
    step = last.select(F.col("v").alias("root"), F.col("root").alias("m"))
    return staged(moved.join(step, "root", "left").select("v", F.coalesce("m", "root").alias("root")), "near-roots")


def with_component(nodes: DataFrame, comps: DataFrame | None, name: str) -> DataFrame:
    """Nodes with their component under (v, root); a node without links is its own."""
    if comps is None:
        return nodes.withColumn(name, F.col("id"))
    return nodes.join(comps, F.col("id") == F.col("v"), "left").withColumn(name, F.coalesce("root", "id")).drop("v", "root")


def _grouped(docs: DataFrame, orders: int) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), utf8(F.col("text")).alias("text"))
    common, rank = common_shingles(texts)
    sketch = staged(texts.mapInArrow(tidied(_sketch(common, rank)), _SKETCH_SCHEMA), "near-sketch")
    numbered = sketch.where("set_key is not null and doc_id is not null")
    # nodes are numbered as they are written, so no two have the same id, and by the order of a hash, which is a random one
    nodes = numbered.groupBy("set_key").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("n_shingles", "sig", "parity", "prefix")])
    nodes = staged(nodes.withColumn("id", F.monotonically_increasing_id()), "near-nodes")
    comps = edges = None
    scratch: list[DataFrame] = []
    for turn in ("first", "all", "exact"):
        labelled = with_component(nodes, comps, "comp")
        if turn == "exact":
            pairs = exact_candidates(labelled)
        else:
            pairs = candidates(labelled, min(orders, FIRST_ORDERS) if turn == "first" else orders, 1 if turn == "first" else REACH, scratch)
        linked = confirm(pairs, docs, nodes)
        unstage(scratch)
        if not linked.isEmpty():
            edges = linked if edges is None else edges.unionByName(linked)
            comps = components(edges)
    roots = with_component(nodes.select("set_key", "id", "doc"), comps, "comp")
    least = roots.groupBy("comp").agg(F.min("doc").alias("component_id"))
    roots = roots.join(least, "comp").select("set_key", "component_id")
    found = sketch.select("doc_id", "text_hash", "n_shingles", "set_key").join(roots, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def group_near(docs: DataFrame, orders: int = ORDERS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    return _grouped(docs, orders).drop("text_hash")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, with its columns; rows equal in doc_id and text share its fate."""
    return keep_rows(docs, _grouped(docs, ORDERS).where("kept").select("doc_id", "text_hash"), {"text_hash": F.xxhash64("text")})


def query(spark, sf_dir: str) -> DataFrame:
    return group_near(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {WIDTH} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) end) as sh from d),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
e as (select i.a, i.b from i join n x on x.doc_id = i.a join n y on y.doc_id = i.b where 100 * k >= {PERCENT} * (x.n + y.n - k)),
r as (select doc_id as v, doc_id as u from documents union select e.b, r.u from r join e on e.a = r.v),
c as (select v as doc_id, min(u) as component_id from r group by v)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d left join n using (doc_id) join c using (doc_id)
"""
