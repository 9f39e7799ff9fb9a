"""BPE encoding and decoding by speculation and verification (operator 5).

For each distinct word greedy longest match proposes tokens. A proposal equals the
result of the merges exactly if every token merges to itself and no merge ever
crosses the border of two adjacent tokens; the second part is tested for all new
adjacent pairs of a batch at once in numpy. Words with a failing pair go through the
exact merges. Vocabulary and merges are read on the driver from a tokenizers JSON file
and broadcast (their size is that of the vocabulary).

The border test walks back in time: the tokens beside the border are the right spine
of the left token's merge tree and the left spine of the right one's. Two tokens x, y
that stand beside the border at the same time are merged across it if (x, y) has a
rule that comes before the rules that consume x and y; where equal rules compete the
leftmost goes first.

Defined cases: null text counts as empty text, which has no token; special tokens of
the file are recognised inside texts as the library does; texts of any length are
taken whole; repeated rows are encoded each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidied

NEVER = np.int64(1 << 40)
#: Pieces that a worker remembers (in each of the two generations of a Cache at most as many), words, and the longest piece that is cached.
CACHE_PIECES = 300_000
CACHE_WORDS = 200_000
CACHE_LENGTH = 64
SHORT_WORD = 150
TABLE_WORD = 20  # words of at most so many bytes are merged side by side
_LAST = 1 << 40
_BETWEEN = "\u0100"  # stands between words; no byte's letter
_SHORT = (3, 2, 1)
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Code points that the regex module's newer Unicode counts as letters or
#: numbers and the tokenizers library does not.
_LATER = (
    r"\U00000558\U0000058b-\U0000058c\U0000088f\U00000c5c\U00000cdc\U0000208f\U0000209d-\U0000209f\U0000a7ce-\U0000a7cf"
    r"\U0000a7d2\U0000a7d4\U0000a7dd\U0000a7e2\U0000a7f1\U0000ab6c-\U0000ab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    r"\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    r"\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    r"\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: How many letters and numbers that version of the regex module knows.
_KNOWN = (158_172, 2_247)
_HAS_LATER = regex.compile(f"[{_LATER}]")


def _word_pattern(letter: str, number: str, other: str) -> regex.Pattern:
    """The published word pattern of this vocabulary family, with white space spelt out."""
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


_WORDS = _word_pattern(r"\p{L}", r"\p{N}", rf"[^{_WHITE}\p{{L}}\p{{N}}]")
_WORDS_LATER = _word_pattern(rf"[\p{{L}}--[{_LATER}]]", rf"[\p{{N}}--[{_LATER}]]", rf"[[^{_WHITE}\p{{L}}\p{{N}}]||[{_LATER}]]")


_CLOSING = frozenset(".,;:!?)")


def check_letters() -> None:
    """Fail if the regex module's Unicode is not the one that the list of later code points was made for."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    found = len(regex.findall(r"\p{L}", every)), len(regex.findall(r"\p{N}", every))
    if found != _KNOWN:
        raise RuntimeError(f"the regex module knows {found} letters and numbers, not {_KNOWN}; its later code points have to be listed anew")


def split_words(piece: str) -> list[str]:
    if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
        return [piece]
    if piece[-1:] in _CLOSING and piece[1:-1].isalpha() and (piece[0] == " " or piece[0].isalpha()):
        return [piece[:-1], piece[-1]]
    return (_WORDS if piece.isascii() or not _HAS_LATER.search(piece) else _WORDS_LATER).findall(piece)


# A blank before one of these certain non-spaces always begins a word.
_IRREGULAR = re.compile(r" (?![!-~À-ɏ])")
_BORDER = re.compile(r"(?= [!-~À-ɏ])")


class Tables(NamedTuple):
    """What workers need of a vocabulary."""

    token_bytes: list[bytes]
    pair_keys: np.ndarray  # sorted left * size + right
    pair_rank: np.ndarray
    pair_new: np.ndarray
    birth: np.ndarray  # rank of the merge that makes a token, -1 for bytes
    left: np.ndarray
    right: np.ndarray
    sound: np.ndarray  # tokens that merge to themselves
    special: dict[str, int]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tables(path: str) -> Tables:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*vocab.values(), *special.values()]) + 1
    token_bytes: list[bytes] = [b""] * size
    for text, i in vocab.items():
        if text not in special:
            token_bytes[i] = bytes(letters[c] for c in text)
    for text, i in special.items():
        token_bytes[i] = text.encode()
    birth, left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    keys, new = [], []
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        x, y, z = vocab[a], vocab[b], vocab[a + b]
        keys.append(x * size + y)
        new.append(z)
        if birth[z] < 0:
            birth[z], left[z], right[z] = rank, x, y
    order = np.argsort(keys, kind="stable")
    tables = Tables(token_bytes, np.array(keys, np.int64)[order], order.astype(np.int64), np.array(new, np.int64)[order], birth, left, right, np.ones(size, bool), special)
    # a token is sound if its two halves are and their border holds until it is made
    made = np.flatnonzero(birth >= 0)
    sound = tables.sound
    fits = border_holds(tables, left[made], right[made], birth[made])
    for z in made[np.argsort(birth[made])]:
        sound[z] = sound[left[z]] and sound[right[z]]
    sound[made] &= fits
    for z in made[np.argsort(birth[made])]:
        sound[z] &= sound[left[z]] and sound[right[z]]
    return tables


def border_holds(t: Tables, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
    """For each pair, whether no merge crosses the border of a and b (before the merge ranked ``until``)."""
    size = len(t.birth)
    x, y = a.astype(np.int64).copy(), b.astype(np.int64).copy()
    dx = np.full(len(x), NEVER) if until is None else until.astype(np.int64).copy()
    dy = dx.copy()
    if until is not None:
        dy -= 1  # the pair's own merge is not a crossing
    holds, open_ = np.ones(len(x), bool), np.arange(len(x))
    while len(open_):
        px, py = x[open_], y[open_]
        keys = px * size + py
        at = np.minimum(np.searchsorted(t.pair_keys, keys), len(t.pair_keys) - 1)
        rank = np.where(t.pair_keys[at] == keys, t.pair_rank[at], NEVER)
        crossed = (rank < dx[open_]) & (rank <= dy[open_]) & (rank < NEVER)
        holds[open_[crossed]] = False
        bx, by = t.birth[px], t.birth[py]
        go_x = (bx > by) & ~crossed
        go_y = (by >= bx) & (by >= 0) & ~crossed
        i = open_[go_x]
        dx[i], x[i] = bx[go_x], t.right[px[go_x]]
        i = open_[go_y]
        dy[i], y[i] = by[go_y], t.left[py[go_y]]
        open_ = open_[go_x | go_y]
    return holds


class Cache:
    """Results of pieces in two generations: the older one goes when the newer one is full, and what is used moves up."""

    def __init__(self):
        self.new: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def find(self, pieces: set[str]) -> tuple[dict[str, object], list[str]]:
        new, old, found, missing = self.new, self.old, {}, []
        for p in pieces:
            if (v := new.get(p)) is None:
                if (v := old.get(p)) is None:
                    missing.append(p)
                    continue
                new[p] = v
            found[p] = v
        return found, missing

    def add(self, results: dict[str, object]) -> None:
        self.new.update((p, v) for p, v in results.items() if len(p) <= CACHE_LENGTH)
        if len(self.new) > CACHE_PIECES:
            self.old, self.new = self.new, {}


class Encoder:
    """Encodes texts; words and pairs seen before are remembered up to fixed numbers."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.size = len(tables.birth)
        self.ids = {b: i for i, b in enumerate(tables.token_bytes) if b and i not in set(tables.special.values())}
        # lengths of the tokens that begin with four given bytes, longest first
        lengths: dict[bytes, set[int]] = {}
        for b in self.ids:
            if len(b) > 3:
                lengths.setdefault(b[:4], {3, 2, 1}).add(len(b))
        self.lengths = {b: tuple(sorted(ls, reverse=True)) for b, ls in lengths.items()}
        self.pairs = {int(k): (int(r), int(n)) for k, r, n in zip(tables.pair_keys, tables.pair_rank, tables.pair_new)}
        self.rank = {k: r for k, (r, _) in self.pairs.items()}
        self.made = dict(self.pairs.values())
        self.by_rank = np.full(len(tables.pair_rank) + 1, -1, np.int64)
        self.by_rank[tables.pair_rank] = tables.pair_new
        self.token_length = np.array([len(b) for b in tables.token_bytes], np.int64)
        # finds the longest token from the left, again and again; bytes stand as Latin-1 letters
        self.finder = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.finder.add_word(b.decode("latin-1"), i)
        self.finder.make_automaton()
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.known_good = np.zeros(0, np.int64)
        self.known_bad = np.zeros(0, np.int64)
        self.texts = [str(i).encode() + b"," for i in range(self.size)]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(tables.special, key=len, reverse=True))) + ")") if tables.special else None
        self.words: dict[str, list[int]] = {}
        self.exact_words = 0

    def propose(self, word: bytes) -> list[int]:
        out, i, n = [], 0, len(word)
        ids, lengths = self.ids, self.lengths
        while i < n:
            for size in lengths.get(word[i : i + 4], _SHORT):
                token = ids.get(word[i : i + size])
                if token is not None:
                    out.append(token)
                    i += size
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def propose_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The proposals for all words after each other, and how many tokens each word has."""
        joined = _BETWEEN.join([w.decode("latin-1") for w in words])
        found = np.fromiter(itertools.chain.from_iterable(self.finder.iter_long(joined)), np.int64).reshape(-1, 2)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        lengths = np.bincount(np.searchsorted(ends, found[:, 0], "right"), minlength=len(words))
        if int(self.token_length[found[:, 1]].sum()) != len(joined) - max(0, len(words) - 1):
            raise ValueError("the vocabulary lacks a byte")
        return found[:, 1], lengths

    def merge_short(self, word: bytes) -> list[int]:
        """The merges themselves on lists, which is faster for words of usual length."""
        size, rank = self.size, self.rank.get
        seq = [self.ids[word[i : i + 1]] for i in range(len(word))]
        ranks = [rank(a * size + b, _LAST) for a, b in zip(seq, seq[1:])]
        while ranks and (least := min(ranks)) < _LAST:
            i = ranks.index(least)
            made = seq[i] = self.made[least]
            del seq[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(seq[i - 1] * size + made, _LAST)
            if i < len(ranks):
                ranks[i] = rank(made * size + seq[i + 1], _LAST)
        return seq

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's rule, one more than the last where there is none; -1 stands beside a word's end."""
        keys, none = a * self.size + b, len(self.t.pair_keys)
        at = np.minimum(np.searchsorted(self.t.pair_keys, keys), none - 1)
        return np.where((self.t.pair_keys[at] == keys) & (a >= 0) & (b >= 0), self.t.pair_rank[at], none)

    def merge_table(self, words: list[bytes]) -> list[list[int]]:
        """The merges of many short words side by side, one merge a word and round: lowest rank first, leftmost of equals."""
        self.exact_words += len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(lengths.max()) + 1
        seq = np.full((len(words), wide), -1, np.int64)
        seq[np.arange(wide) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        rank = self.ranks_of(seq[:, :-1], seq[:, 1:])
        none, columns = len(self.t.pair_keys), np.arange(wide)
        open_ = np.arange(len(words))
        while len(open_):
            i = rank[open_].argmin(axis=1)
            least = rank[open_, i]
            go = least < none
            open_, i, least = open_[go], i[go], least[go]
            if not len(open_):
                break
            # the pair's second token goes, what follows moves up
            rows = seq[open_]
            moved = np.take_along_axis(np.concatenate([rows, np.full((len(rows), 1), -1)], axis=1), columns + (columns > i[:, None]), axis=1)
            at = np.arange(len(open_))
            moved[at, i] = self.by_rank[least]
            seq[open_] = moved
            kept = np.take_along_axis(np.concatenate([rank[open_], np.full((len(rows), 1), none)], axis=1), columns[:-1] + (columns[:-1] > i[:, None]), axis=1)
            last = wide - 1
            kept[at, np.minimum(i, last - 1)] = self.ranks_of(moved[at, i], moved[at, np.minimum(i + 1, last)])
            before = i > 0
            kept[at[before], i[before] - 1] = self.ranks_of(moved[at[before], i[before] - 1], moved[at[before], i[before]])
            rank[open_] = kept
        sizes = (seq >= 0).sum(axis=1).tolist()
        return [row[:n] for row, n in zip(seq.tolist(), sizes)]

    def merge_exactly(self, word: bytes) -> list[int]:
        """The merges themselves: lowest rank first, leftmost of equals; O(n log n) for long words."""
        self.exact_words += 1
        if len(word) <= SHORT_WORD:
            return self.merge_short(word)
        seq = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(seq)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rule := self.pairs.get(seq[i] * self.size + seq[j])):
                heapq.heappush(heap, (rule[0], i, seq[i], seq[j], rule[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            if not alive[i] or seq[i] != a or (j := after[i]) >= n or seq[j] != b:
                continue
            seq[i], alive[j] = made, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, on in zip(seq, alive) if on]

    def pairs_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each adjacent pair is compatible; only pairs not seen before are computed."""
        keys = a * self.size + b
        distinct = np.unique(keys)
        fresh = distinct[~(np.isin(distinct, self.known_good, assume_unique=True) | np.isin(distinct, self.known_bad, assume_unique=True))]
        if len(fresh):
            good = border_holds(self.t, fresh // self.size, fresh % self.size)
            self.known_good = np.union1d(self.known_good, fresh[good])
            self.known_bad = np.union1d(self.known_bad, fresh[~good])
        out = ~np.isin(keys, self.known_bad)
        if len(self.known_good) + len(self.known_bad) > 1_000_000:
            self.known_good = self.known_bad = np.zeros(0, np.int64)
        return out

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words after each other, and how many each word has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        flat, lengths = self.propose_all(raw)
        owner = np.repeat(np.arange(len(raw)), lengths)
        bad = np.zeros(len(raw), bool)
        bad[owner[~self.t.sound[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        if len(inside):
            bad[owner[inside[~self.pairs_fit(flat[inside], flat[inside + 1])]]] = True
        wrong = np.flatnonzero(bad).tolist()
        if not wrong:
            return flat, lengths
        short = [i for i in wrong if len(raw[i]) <= TABLE_WORD]
        merged = dict(zip(short, self.merge_table([raw[i] for i in short]) if short else ()))
        merged.update((i, self.merge_exactly(raw[i])) for i in wrong if len(raw[i]) > TABLE_WORD)
        out_lengths = lengths.copy()
        out_lengths[wrong] = [len(merged[i]) for i in wrong]
        out = np.empty(int(out_lengths.sum()), np.int64)
        failed = np.repeat(bad, out_lengths)
        out[~failed] = flat[~bad[owner]]
        out[failed] = np.fromiter(itertools.chain.from_iterable(merged[i] for i in wrong), np.int64)
        return out, out_lengths

    def encode_words(self, words: list[str]) -> list[list[int]]:
        flat, lengths = self.encode_flat(words)
        listed, cuts = flat.tolist(), np.concatenate([[0], np.cumsum(lengths)]).tolist()
        return [listed[i:j] for i, j in zip(cuts[:-1], cuts[1:])]

    def pieces(self, text: str) -> list[list[str]]:
        """A text as runs between special tokens; in a run, pieces after the first lack their leading blank."""
        parts = self.special.split(text) if self.special else [text]
        runs = []
        for k, part in enumerate(parts):
            if k % 2:
                runs.append([None, part])
            elif part:
                if _IRREGULAR.search(part):
                    cut = _BORDER.split(part)
                    runs.append([cut[0], *(c[1:] for c in cut[1:])])
                else:
                    runs.append(part.split(" "))
        return runs

    def learn(self, texts: list[str], result: Callable[[list[int]], object]) -> dict[str, object]:
        """Encode new pieces; the result of each."""
        split = [split_words(p) for p in texts]
        words = self.words
        fresh = list({w for ws in split for w in ws if w not in words})
        words.update(zip(fresh, self.encode_words(fresh)))
        out = {p: result(words[ws[0]] if len(ws) == 1 else [t for w in ws for t in words[w]]) for p, ws in zip(texts, split)}
        if len(words) > CACHE_WORDS:
            words.clear()
        return out

    def encode_batch(self, texts: list[str], result: Callable[[list[int]], object], cache: Cache) -> list[list[object]]:
        """For each text the results of its pieces in order."""
        cut = [self.pieces(t) for t in texts]
        firsts = {r[0] for runs in cut for r in runs if r[0]}
        rests = {" " + p for p in set().union(*(r[1:] for runs in cut for r in runs if r[0] is not None))}
        get, missing = cache.find(firsts | rests)
        get |= (fresh := self.learn(missing, result))
        cache.add(fresh)
        special = {t: result([i]) for t, i in self.t.special.items()}
        after = {p[1:]: get[p] for p in rests}
        out = []
        for runs in cut:
            found: list[object] = []
            for r in runs:
                if r[0] is None:
                    found.append(special[r[1]])
                    continue
                if r[0]:
                    found.append(get[r[0]])
                found.extend(map(after.__getitem__, r[1:]))
            out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.encode_batch([text], list, Cache())[0] for i in piece]


def decode(tables: Tables, ids) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join([tables.token_bytes[i] for i in ids]).decode("utf-8", "replace")


def _small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about 4 MB of text."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, int(batch.num_rows * (4 << 20) / max(batch.nbytes, 1))))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


_kept: list[tuple[Tables, type, object]] = []


def _kept_for(tables: Tables, kind: type, make: Callable[[], object]) -> object:
    """This worker's object of a kind for a vocabulary, kept from task to task."""
    for held, name, value in _kept:
        if held is tables and name is kind:
            return value
    _kept[:] = [(tables, kind, make())]
    return _kept[0][2]


def _encoding(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cache = _kept_for(shared.value, Cache, lambda: (Encoder(shared.value), Cache()))
        for batch in _small_batches(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [[i for p in found for i in p] for found in encoder.encode_batch(texts, list, cache)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoding(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode(shared.value, ids or ()) for ids in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


class Digests:
    """Numbers, written ids and decoded bytes of distinct pieces, kept from batch to batch up to a fixed number.

    Pieces are cut and numbered by Arrow and laid out by Arrow, so that Python only meets
    the distinct pieces of a batch, and encodes only those that are new.
    """

    def __init__(self, encoder: Encoder):
        self.encoder, self.cache = encoder, Cache()
        self.names, self.raw = pa.array(encoder.texts, pa.large_binary()), pa.array(encoder.t.token_bytes, pa.large_binary())
        self.forget()
        self.forget_words()

    def forget(self) -> None:
        self.first: dict[str, int] = {"": 0}  # without a blank before
        self.later: dict[str, int] = {}
        self.n = np.zeros(1, np.int64)
        self.ids = self.back = pa.array([b""], pa.large_binary())

    def forget_words(self) -> None:
        self.words: dict[str, int] = {}
        self.tokens = self.starts = self.lengths = np.zeros(0, np.int64)

    def result(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        names, raw = self.encoder.texts, self.encoder.t.token_bytes
        return len(ids), b"".join([names[i] for i in ids]), b"".join([raw[i] for i in ids])

    def _learn(self, pieces: list[str]) -> None:
        """Append the results of new pieces to the store, in their order."""
        if len(self.words) > CACHE_WORDS:
            self.forget_words()
        split = [split_words(p) for p in pieces]
        flat = list(itertools.chain.from_iterable(split))
        fresh = list(dict.fromkeys(w for w in flat if w not in self.words))
        if fresh:
            tokens, lengths = self.encoder.encode_flat(fresh)
            self.words.update(zip(fresh, range(len(self.lengths), len(self.lengths) + len(fresh))))
            self.starts = np.concatenate([self.starts, len(self.tokens) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.tokens = np.concatenate([self.tokens, tokens])
        number = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        lengths = self.lengths[number]
        ends = np.cumsum(lengths)
        tokens = self.tokens[np.repeat(self.starts[number] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])]
        self.n = np.concatenate([self.n, np.diff(upto)])
        self.ids = pa.concat_arrays([self.ids, _joined(self.names, tokens, upto)])
        self.back = pa.concat_arrays([self.back, _joined(self.raw, tokens, upto)])

    def _numbers(self, known: dict[str, int], pieces: list[str], blank: str) -> np.ndarray:
        found = list(map(known.get, pieces))
        new = [i for i, k in enumerate(found) if k is None]
        if new:
            size = len(self.n)
            self._learn([blank + pieces[i] for i in new])
            for k, i in enumerate(new, size):
                found[i] = k
                if len(pieces[i]) <= CACHE_LENGTH:
                    known[pieces[i]] = k
        return np.array(found, np.int64)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, Iterator[memoryview], Iterator[memoryview]]:
        """For each text the number of tokens, the written ids (a comma after each) and the decoded bytes."""
        if len(self.n) > CACHE_PIECES:
            self.forget()
        encoder, texts = self.encoder, texts.fill_null("")
        plain = texts.to_pylist()
        # texts with special tokens or with blanks that begin no usual word are cut by the encoder
        odd = [i for i, t in enumerate(plain) if _IRREGULAR.search(t) or (encoder.special and encoder.special.search(t))]
        if odd:
            usual = np.ones(len(plain), bool)
            usual[odd] = False
            texts = pc.if_else(pa.array(usual), texts, "")
        lists = pc.split_pattern(texts, " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        starts -= starts[0]
        first = np.zeros(len(codes), bool)
        first[starts[:-1]] = True
        number = np.zeros((2, max(len(distinct), 1)), np.int64)
        for row, known, mine, blank in ((0, self.first, first, ""), (1, self.later, ~first, " ")):
            present = np.flatnonzero(np.bincount(codes[mine], minlength=len(distinct)))
            number[row, present] = self._numbers(known, [distinct[c] for c in present.tolist()], blank)
        pieces = number[(~first).astype(np.int64), codes]
        n, ids, back = self.n, self.ids, self.back
        if odd:
            parts = [pieces[i:j] for i, j in zip(starts[:-1], starts[1:])]
            for i, found in zip(odd, encoder.encode_batch([plain[i] for i in odd], self.result, self.cache)):
                parts[i] = np.arange(len(n), len(n) + len(found))
                if found:
                    m, x, y = zip(*found)
                    n = np.concatenate([n, np.array(m, np.int64)])
                    ids, back = pa.concat_arrays([ids, pa.array(x, pa.large_binary())]), pa.concat_arrays([back, pa.array(y, pa.large_binary())])
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            pieces = np.concatenate(parts)
        counts = np.diff(np.concatenate([[0], np.cumsum(n[pieces])])[starts])
        return counts, _laid_out(ids, pieces, starts), _laid_out(back, pieces, starts)


def _joined(parts: pa.Array, which: np.ndarray, upto: np.ndarray) -> pa.Array:
    """Strings made of parts: the i-th of those numbered which[upto[i]:upto[i + 1]]."""
    laid = parts.take(pa.array(which))
    _, offsets, data = laid.buffers()
    ends = np.ascontiguousarray(np.frombuffer(offsets, np.int64, len(laid) + 1)[upto]) if len(laid) else np.zeros(len(upto), np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(upto) - 1, [None, pa.py_buffer(ends), data if data is not None else pa.py_buffer(b"")])


def _laid_out(results: pa.Array, pieces: np.ndarray, starts: np.ndarray) -> Iterator[memoryview]:
    """The bytes of each text: the results of its pieces after each other."""
    laid = results.take(pa.array(pieces))
    _, offsets, data = laid.buffers()
    ends = np.frombuffer(offsets, np.int64, len(laid) + 1)[starts] if len(laid) else np.zeros(len(starts), np.int64)
    whole = memoryview(data) if data is not None else memoryview(b"")
    return (whole[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()))


def _digesting(shared, carried: tuple[str, ...] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encode, decode the ids, and digest both; a piece's ids are decoded when the piece is new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = _kept_for(shared.value, Digests, lambda: Digests(Encoder(shared.value)))
        for batch in _small_batches(batches):
            counts, written, decoded = digests.of(batch.column("text"))
            columns = [
                pa.array(counts),
                pa.array([hashlib.sha256(w[:-1]).hexdigest() for w in written], pa.string()),
                pa.array([hashlib.sha256(bytes(d).decode("utf-8", "replace").encode()).hexdigest() for d in decoded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *(batch.column(c) for c in carried)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *carried])

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _shared(df: DataFrame, path: str | None):
    bounded_batches(df.sparkSession)
    check_letters()
    return df.sparkSession.sparkContext.broadcast(load_tables(path or default_vocabulary()))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the token ids of every text."""
    shared = _shared(docs, path)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(_encoding(shared)), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of every row of ids."""
    shared = _shared(encoded, path)
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(_decoding(shared), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of the text decoded from them, and each row's ``carried`` columns."""
    shared = _shared(docs, path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    return docs.select(F.col("doc_id").cast("long"), "text", *carried).mapInArrow(tidied(_digesting(shared, carried)), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
