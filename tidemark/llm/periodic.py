"""Periodic runs of words inside a document, found by uniting suffix classes by descending LCP.

A run is a stretch of consecutive words with smallest period q, at least ``MIN_LENGTH`` words and
``EXPONENT`` periods long, that no neighbouring word extends.  The edges between neighbours of a
document's suffix array are taken by decreasing longest common prefix (Kruskal); union-find classes keep
their positions in order, smaller sets are merged into larger ones.  Two positions i < j that become
neighbours in a class at level l repeat with period j - i over words i to j + l; where j - i <= l, that
period is the smallest (a smaller one would have put a position between them earlier), and if the word
before i breaks the period, this is a whole run.  Every run is seeded so, by its first word.

A run of length L and period q makes neighbours with a common prefix of L - q words, so no edge below
``least_lcp`` can matter: only documents that repeat so many words have their suffixes sorted.  Windows
are screened by 64-bit hashes; the suffix array itself compares words.

Each document is worked on alone, so nothing is shuffled; memory is in proportion to the longest text
of a task.  Null and empty texts and texts without a word have no run and an empty collapsed text;
repeated rows give the same result each; ids may be null; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.words import mix, window_hashes

MIN_LENGTH = 24
EXPONENT = 3
#: Words whose windows are hashed and sorted together.
TOGETHER = 1 << 18

Run = tuple[int, int, int]  # start, length, period
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def least_lcp(min_length: int, exponent: int) -> int:
    """The least common prefix of the first two periods of a run, over all periods."""
    return min(max(min_length - q, (exponent - 1) * q, 1) for q in range(1, max(2, min_length + 1)))


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling; only ties are sorted again."""
    n = len(ids)
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    # a rank is the place of the first suffix of its class, so that classes can be split one by one
    r = rank[order]
    head = np.concatenate([[True], r[1:] != r[:-1]])
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 1
    while not head.all():
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        own = order[at]
        to = own + h
        second = np.where(to < n, rank[np.minimum(to, n - 1)], -1)
        k = np.lexsort((second, rank[own]))
        own, second = own[k], second[k]
        order[at] = own
        first = rank[own]
        head[at] = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[own] = np.maximum.accumulate(np.where(head[at], at, 0))
        h *= 2
    return order


def common_prefixes(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each suffix in order (but the first), the words it shares with the one before it."""
    n = len(ids)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    text, out, h = ids.tolist(), [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        top = n - max(i, j)
        while h < top and text[i + h] == text[j + h]:
            h += 1
        out[i] = h
        if h:
            h -= 1
    return np.array(out, np.int64)[order[1:]]


class Ordered:
    """Positions in order, in pieces of bounded length, so that adding one moves few others."""

    PIECE = 2048

    def __init__(self, positions: list[int]):
        self.pieces = [positions[k : k + self.PIECE] for k in range(0, len(positions), self.PIECE)]
        self.heads = [p[0] for p in self.pieces]
        self.size = len(positions)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        return (x for p in self.pieces for x in p)

    def around(self, x: int) -> tuple[int, int]:
        """The positions next to ``x``, which isn't one of them, on either side; -1 and ``END``: none."""
        c = max(bisect_left(self.heads, x) - 1, 0)
        p = self.pieces[c]
        at = bisect_left(p, x)
        after = p[at] if at < len(p) else self.heads[c + 1] if c + 1 < len(self.pieces) else END
        return (p[at - 1] if at else -1), after

    def add(self, x: int) -> None:
        c = max(bisect_left(self.heads, x) - 1, 0)
        p = self.pieces[c]
        insort(p, x)
        self.heads[c] = p[0]
        self.size += 1
        if len(p) > 2 * self.PIECE:
            self.pieces[c : c + 1] = p[: self.PIECE], p[self.PIECE :]
            self.heads[c : c + 1] = p[0], p[self.PIECE]


def _around(positions: list[int], x: int) -> tuple[int, int]:
    at = bisect_left(positions, x)
    return (positions[at - 1] if at else -1), (positions[at] if at < len(positions) else END)


END = 1 << 62


def runs(ids: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[Run]:
    """The runs of a sequence of word ids, by start, then period."""
    if len(ids) < max(min_length, 2):
        return []
    order = suffix_array(ids)
    lcp = common_prefixes(ids, order)
    edges = np.flatnonzero(lcp >= least_lcp(min_length, exponent))
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    text = ids.tolist()
    parent: dict[int, int] = {}
    members: dict[int, list[int] | Ordered] = {}
    found: list[Run] = []

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for i, j, level in zip(order[edges].tolist(), order[edges + 1].tolist(), lcp[edges].tolist(), strict=True):
        a, b = find(i), find(j)
        big, small = members.pop(a, [a]), members.pop(b, [b])
        if len(big) < len(small):
            a, b, big, small = b, a, small, big
        small = list(small)
        many = isinstance(big, Ordered)
        fresh = []  # pairs, one position of each set, that are neighbours from now on
        for k, x in enumerate(small):
            before, after = big.around(x) if many else _around(big, x)
            if before > (small[k - 1] if k else -1):
                fresh.append((before, x))
            if after < (small[k + 1] if k + 1 < len(small) else END):
                fresh.append((x, after))
        for x, y in fresh:
            q = y - x
            if q <= level and (x == 0 or text[x - 1] != text[y - 1]) and q + level >= max(min_length, exponent * q):
                found.append((x, q + level, q))
        if many and len(small) * 16 < len(big):
            for x in small:
                big.add(x)
        elif len(small) == 1 and not many:
            insort(big, small[0])
        else:
            big = sorted([*big, *small])
        if not isinstance(big, Ordered) and len(big) > 2 * Ordered.PIECE:
            big = Ordered(big)
        parent[b] = a
        members[a] = big
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, found: list[Run]) -> list:
    """Words that no run contains after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def _repeating(ids: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Whether each document of a chunk holds some window of ``size`` words twice."""
    out = np.zeros(len(first) - 1, bool)
    with np.errstate(over="ignore"):
        h = window_hashes(mix(ids.astype(np.uint64) + np.uint64(1)), size)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        own = doc[: len(h)] == doc[size - 1 :] if len(h) else np.zeros(0, bool)
        h, doc = h[own] + doc[: len(h)][own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), doc[: len(own)][own]
    k = np.argsort(h)
    same = h[k][1:] == h[k][:-1]
    out[doc[k][1:][same]] = True
    return out


def _looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document of which the contract repeats the tail: see ``periodic_runs``."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT, looped: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed_text) per document; a run is (start, length, period) in words.

    ``looped``: with a tenth of the documents, by the checksum of their ids, turned periodic from some
    word on, which puts runs of known shape into any corpus; a null id leaves its text as it is."""
    size = least_lcp(min_length, exponent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(keys):
                lists: list[list[bytes]] = []
                held, began = 0, at
                while at < len(keys) and (held < TOGETHER or at == began):
                    text = texts[at].as_py()
                    words = text.encode("utf-8", "surrogatepass").split() if text else []
                    lists.append(_looped(words, keys[at]) if looped else words)
                    held += len(words)
                    at += 1
                numbers: dict[bytes, int] = defaultdict(count().__next__)
                ids = np.fromiter((numbers[w] for ws in lists for w in ws), np.int64, held)
                first = np.concatenate([[0], np.cumsum([len(ws) for ws in lists])]).astype(np.int64)
                twice = _repeating(ids, first, size)
                found = [runs(ids[first[k] : first[k + 1]], min_length, exponent) if twice[k] else [] for k in range(len(lists))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(began, len(lists)), pa.array(list(map(len, lists)), pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in f] for f in found], RUNS),
                        pa.array([b" ".join(collapse(ws, f)).decode("utf-8", "surrogatepass") for ws, f in zip(lists, found, strict=True)], pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed_text"],
                )

    plain = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return plain.mapInArrow(work, "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed_text string")
