"""Substring deduplication: every word inside a window of words that stands twice is removed.

Rabin-Karp hashes of all windows of ``size`` consecutive words of a document are counted over the
whole corpus, windows of the same document included.  The repeated windows of a document merge
into maximal removal intervals.  Windows are judged on the input: all copies of a repeated window
go, none is kept as the first.

Each chunk of documents
sends its distinct window hashes to buckets of the hash space (see ``exchange``), with a mark where
the chunk itself has a window twice; a bucket replies which of the others stand elsewhere as well.
A passage in a third of all documents therefore reaches its bucket once a chunk.  Windows match by 80
bits: 64 of the rolling hash and 16 of a second one; among N windows about N*N / 2**81 pairs are
expected to meet by chance (10**12 windows: 0.4).

Null, empty and short texts have no windows and lose nothing; very long texts are a chunk each;
repeated rows remove each other; null ids pass through; where several copies tie all go; an empty
table gives an empty result; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import exchange as X
from tidemark.llm.words import Chunk, mix, window_hashes, word_hashes

WINDOW = 35


def _windows(texts: list[str | None], size: int) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk; where its windows start, in the order of their hashes; the distinct hashes, a second
    hash of each, and how often it stands in the chunk."""
    chunk = Chunk(texts)
    words = word_hashes(chunk.words)
    h = window_hashes(words, size)
    owner = chunk.owner()
    at = np.flatnonzero(owner[: len(h)] == owner[size - 1 :]) if len(h) else np.empty(0, np.int64)
    order = np.argsort(h[at], kind="stable")
    at = at[order]
    keys, first, counts = np.unique(h[at], return_index=True, return_counts=True)
    return chunk, at, keys, _second(words, at[first], size), counts


def _second(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sixteen bits of the windows that start at ``at``, of their words at a few fixed places and of the
    sum over all, each word hashed anew."""
    with np.errstate(over="ignore"):
        own = mix(words ^ np.uint64(0xA0761D6478BD642F))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(own)])
        total = sums[at + size] - sums[at]
        for k in (0, size // 3, size // 2, size - 1):
            total = total * np.uint64(0x9E3779B97F4A7C15) + own[at + k]
    return (mix(total) >> np.uint64(48)).astype("<u2")


SENT = "bucket int, chunk long, n int, keys binary, more binary, twice binary"


def _send(size: int, buckets: int):
    def keys(chunk: int, texts: list[str | None], ids: list) -> pa.RecordBatch:
        _, _, uniq, more, counts = _windows(texts, size)
        edge = X.bounds(uniq, buckets)
        full = np.flatnonzero(np.diff(edge))
        parts = [slice(edge[b], edge[b + 1]) for b in full]
        twice = counts > 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(full, pa.int32()),
                pa.array(np.full(len(full), chunk), pa.int64()),
                pa.array([p.stop - p.start for p in parts], pa.int32()),
                pa.array([X.pack_sorted(uniq[p]) for p in parts], pa.binary()),
                pa.array([more[p].tobytes() for p in parts], pa.binary()),
                pa.array([np.packbits(twice[p]).tobytes() if twice[p].any() else b"" for p in parts], pa.binary()),
            ],
            names=["bucket", "chunk", "n", "keys", "more", "twice"],
        )

    return keys


REPLY = "chunk long, bucket int, reply binary"


def _reply(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each chunk, the indexes of its keys in this bucket that other chunks have as well."""
    counts = rows.column("n").to_numpy()
    keys = np.concatenate([X.unpack_sorted(k.as_py(), n) for k, n in zip(rows.column("keys"), counts, strict=True)])
    twice = np.concatenate(
        [
            np.unpackbits(np.frombuffer(t.as_py(), np.uint8), count=n).astype(bool) if len(t.as_py()) else np.zeros(n, bool)
            for t, n in zip(rows.column("twice"), counts, strict=True)
        ]
    )
    more = np.concatenate([np.frombuffer(m.as_py(), "<u2") for m in rows.column("more")])
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    if (same & (np.diff(more[order].astype(np.int32)) != 0)).any():
        order = np.lexsort((more, keys))
        same = (np.diff(keys[order]) == 0) & (np.diff(more[order].astype(np.int32)) == 0)
    met = np.zeros(len(keys), bool)
    met[order[1:]] |= same
    met[order[:-1]] |= same
    met &= ~twice
    chunks, bucket = rows.column("chunk").to_numpy(), rows.column("bucket")[0].as_py()
    out = []
    for chunk, a, b in zip(chunks, np.cumsum(counts) - counts, np.cumsum(counts), strict=True):
        hit = np.flatnonzero(met[a:b])
        if len(hit):
            out.append((chunk, len(hit).to_bytes(4, "little") + X.pack_ints(np.diff(hit, prepend=0))))
    yield pa.RecordBatch.from_arrays(
        [pa.array([c for c, _ in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([r for _, r in out], pa.binary())],
        names=["chunk", "bucket", "reply"],
    )


RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept_text string"


def _remove(size: int, buckets: int):
    def run(ids: list, texts: list[str | None], replies: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        chunk, at, uniq, _, counts = _windows(texts, size)
        edge = X.bounds(uniq, buckets)
        bad = counts > 1
        for b, reply in replies.items():
            bad[edge[b] + _hits(reply)] = True
        starts = at[np.repeat(bad, counts)]
        depth = np.zeros(len(chunk.words) + size, np.int64)
        np.add.at(depth, starts, 1)
        np.add.at(depth, starts + size, -1)
        gone = np.cumsum(depth)[: len(chunk.words)] > 0
        cols: list[list] = [[], [], [], []]
        for a, b in zip(chunk.first[:-1], chunk.first[1:], strict=True):
            mine = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
            cols[0].append(int(b - a))
            cols[1].append(int(mine.sum()))
            cols[2].append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edges[::2], edges[1::2], strict=True)])
            words = chunk.words[a:b]
            cols[3].append(b" ".join(compress(words, ~mine) if len(edges) else words).decode("utf-8", "surrogatepass"))
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], span), pa.array(cols[3], pa.string())],
            names=["doc_id", "n_words", "n_removed", "removed", "kept_text"],
        )

    return run


def _hits(reply: bytes) -> np.ndarray:
    """Indexes from a reply, sent as a count and the gaps between them."""
    n = int.from_bytes(reply[:4], "little")
    return np.cumsum(X.unpack_ints(reply[4:], n))


def dedup_substrings(docs: DataFrame, size: int = WINDOW, buckets: int | None = None, limit: int = X.CHUNK_CHARS) -> DataFrame:
    """One row per document: its words, removed words, removal intervals (word numbers from 0,
    both ends included) and the kept words joined by single spaces."""
    cut = X.chunks(docs, limit)
    n = buckets or X.buckets_for(cut)
    replies = X.by_bucket(X.send(cut, _send(size, n), SENT), X.partitions_of(docs), _reply, REPLY)
    return X.answered(cut, replies, _remove(size, n), RESULT)
