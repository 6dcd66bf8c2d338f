"""Counting keys of every text position with compact shuffles.

A chunk is a few thousand texts.  Chunks are cut once and written to the shared folder, so whatever
reads them later, however often and on whichever executors, reads the same ones.  Each chunk sends
its *distinct* 64-bit keys, sorted and packed, to buckets dealt by the keys' top bits; a bucket adds
up what all chunks sent and answers each chunk; the answers are joined with the chunk's texts.  So a
key that stands a million times in a chunk travels once, and no row of the shuffle is as wide as
Spark's rows for single keys would be.  There are as many buckets as the size of all texts asks for,
so what a bucket holds doesn't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import written

#: Characters of text in a chunk at which it is closed; one longer text is a chunk by itself.
CHUNK_CHARS = 3_000_000
#: Bytes of text whose keys a bucket gets.
BUCKET_BYTES = 2_000_000


def cut(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str | None]]]:
    """(doc ids, texts) of consecutive rows; columns are (doc_id, text)."""
    ids: list = []
    texts: list[str | None] = []
    size = 0
    for batch in batches:
        some = batch.column(0).to_pylist()
        for k in range(0, len(some), 256):
            for i, t in zip(some[k : k + 256], batch.column(1).slice(k, 256).to_pylist(), strict=True):
                if size and size + len(t or "") > limit:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t or "") + 16
    if ids:
        yield ids, texts


PAYLOAD = "chunk long, size long, ids array<long>, lens array<int>, texts binary"


def chunks(docs: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """The chunks of ``docs``, written: (chunk, bytes, ids, UTF-8 lengths or -1 for null, texts)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for ids, texts in cut(batches, limit):
            raw = [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
            lens = [-1 if r is None else len(r) for r in raw]
            whole = b"".join(r for r in raw if r)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk], pa.int64()),
                    pa.array([len(whole)], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([lens], pa.list_(pa.int32())),
                    pa.array([pa.compress(pa.py_buffer(whole), "zstd", asbytes=True)], pa.binary()),
                ],
                names=["chunk", "size", "ids", "lens", "texts"],
            )
            chunk += 1

    return written(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(go, PAYLOAD))


def buckets_for(cut: DataFrame) -> int:
    total = cut.agg(F.sum("size")).first()[0] or 0
    return 1 << max(4, (total // BUCKET_BYTES).bit_length())


def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted 64-bit keys as zstd over byte planes: the leading planes hardly vary."""
    planes = np.ascontiguousarray(h.astype(">u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(pa.py_buffer(planes[:3].tobytes()), "zstd", asbytes=True) + b"|" + planes[3:].tobytes()


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(blob, np.uint8)[len(blob) - 5 * n :].reshape(5, n)
    high = np.frombuffer(pa.decompress(blob[: len(blob) - 5 * n - 1], 3 * n, "zstd", asbytes=True), np.uint8).reshape(3, n)
    return np.ascontiguousarray(np.concatenate([high, low]).T).view(">u8").ravel().astype(np.uint64)


def pack_ints(x: np.ndarray) -> bytes:
    """Non-negative integers below 2**63 in as many byte planes as the largest needs, zstd over all."""
    if len(x) and int(x.min()) < 0:
        raise OverflowError("a count is negative or doesn't fit 63 bits")
    x = x.astype("<u8")
    width = 1 if not len(x) else max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + pa.compress(pa.py_buffer(planes.tobytes()), "zstd", asbytes=True)


def unpack_ints(blob: bytes, n: int) -> np.ndarray:
    width = blob[0]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(blob[1:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.int64)


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins and ends in sorted keys."""
    edges = np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def by_bucket(df: DataFrame, partitions: int, run: Callable, schema: str) -> DataFrame:
    """``run(rows of one bucket) -> record batches`` over rows dealt and sorted by ``bucket``.

    Only one bucket's rows are held at a time; rows come in the order of (bucket, chunk).
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            buckets = batch.column("bucket").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1), len(buckets)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if now is not None and buckets[a] != now:
                    yield from run(pa.Table.from_batches(held))
                    held = []
                now = buckets[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from run(pa.Table.from_batches(held))

    return df.repartition(partitions, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(go, schema)


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def texts_of(lens: list[int], blob: bytes) -> list[str | None]:
    total = sum(n for n in lens if n > 0)
    raw = pa.decompress(blob, total, "zstd", asbytes=True) if total else b""
    out: list[str | None] = []
    at = 0
    for n in lens:
        out.append(None if n < 0 else raw[at : at + n].decode("utf-8", "surrogatepass"))
        at += max(n, 0)
    return out


def send(cut: DataFrame, keys: Callable, schema: str) -> DataFrame:
    """``keys(chunk, texts, ids) -> record batch`` of what each chunk sends to its buckets."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield keys(row["chunk"], texts_of(row["lens"], row["texts"]), row["ids"])

    return cut.select("chunk", "ids", "lens", "texts").mapInArrow(go, schema)


def answered(cut: DataFrame, replies: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(ids, texts, {bucket: reply}) -> record batches`` for every chunk.

    ``replies`` has (chunk, bucket, reply); a chunk gets one reply a bucket at most, each no larger
    than what the chunk sent, so what meets here is bounded by the chunk's size.
    """
    grouped = replies.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies"))
    both = cut.join(grouped, "chunk", "left")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                got = {r["bucket"]: r["reply"] for r in row["replies"] or []}
                yield from run(row["ids"], texts_of(row["lens"], row["texts"]), got)

    return both.select("ids", "lens", "texts", "replies").mapInArrow(go, schema)
