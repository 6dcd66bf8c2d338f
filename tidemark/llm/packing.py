"""Packing token sequences along a space-filling curve.

Every document becomes token ids with an end id.  Its hashed bag of ids is projected to four
dimensions, whose quantised values give a position on a Hilbert curve: documents with similar
vocabulary lie close together on it.  Documents are range-partitioned and sorted along the curve,
and those of a range are laid end to end and cut every ``size`` ids, so neighbours on the curve share
sequences and only the last sequence of a range can be padded.

Ranges hold ``LEAST`` to ``MOST`` ids, as many as there are shuffle partitions where the total allows,
so a task is no longer than ``MOST`` however large the corpus is, and less than one sequence in
``LEAST / size`` is padded.  The last bits of the position come from a hash of the document's id and of
its place in the scan, so many copies of one text spread over ranges.  The token ids are written once
to the shared folder, so nothing is tokenised twice, and shuffled once; one number reaches the driver.

Null and empty texts are documents of the end id alone; repeated rows are packed each; null ids are
kept; documents longer than a sequence are cut, and texts of over ``PIECE`` characters are tokenised
piece by piece; ties on the curve are laid in the order of their ids; the empty table gives an empty
result; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import partitions_of
from tidemark.llm.tables import written
from tidemark.llm.words import mix

SIZE = 2048
END_ID = 1
DIMS, BITS, TIE_BITS = 4, 10, 23
LEAST, MOST = 1_000_000, 64_000_000  # ids of a range
PIECE = 1_000_000  # characters of a text tokenised at once


# Fixed value: the pattern by which byte-level vocabularies cut text before merging.
# Possessive quantifiers, so that long runs cost nothing.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for
    itself, characters from U+0100 for the others in turn."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(others)): b for b in range(256)}


def _quick(spec: dict):
    """A tiktoken encoding with the merges of a byte-level tokenizer file, or None for other files."""
    try:
        import tiktoken
    except ImportError:
        return None
    kind = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec.get("normalizer"):
        return None
    byte, added = _bytes_of(), {a["content"] for a in spec["added_tokens"]}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in added}
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


_CUT = re.compile(r" (?=\S)")


class Encoder:
    """Token ids of texts by a ``tokenizers`` file.

    The merges of a byte-level file are run by tiktoken, which is several times faster.  Texts that
    hold an added token take the tokenizer itself, and so do all if the two disagree on any of the
    first texts that a worker meets.  The file's pattern never joins characters across a space that
    precedes a non-space, so a long text is cut there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.quick = _quick(spec)
        self.added = [a["content"] for a in spec["added_tokens"]]
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.compared = 0

    @staticmethod
    def pieces(text: str) -> Iterator[str]:
        """A long text cut where the tokenizer's pattern begins a new match in any case."""
        at = 0
        while len(text) - at > PIECE:
            m = _CUT.search(text, at + PIECE)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def _exact(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, text: str) -> list[int]:
        if self.quick is None or any(a in text for a in self.added):
            return self._exact(text)
        got = self.quick.encode_ordinary(text)
        if self.compared < 50 and got:
            self.compared += 1
            exact = self._exact(text)
            if got != exact:
                self.quick = None
            return exact
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, each text followed by the end id; and where each text begins."""
        parts: list[np.ndarray] = []
        n = []
        for t in texts:
            own = [np.fromiter(self._ids(p), self.kind) for p in self.pieces(t)] if len(t) > PIECE else [self._ids(t)]
            n.append(sum(map(len, own)) + 1)
            parts += own
            parts.append([END_ID])
        first = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return np.fromiter(chain.from_iterable(parts), self.kind, first[-1]), first


_ENCODERS: dict[str, Encoder] = {}  # a worker process keeps what it has learnt from task to task


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def projection(vocabulary: int) -> np.ndarray:
    """A fixed random direction in [-1, 1) per token id and dimension."""
    h = mix(np.arange(1, vocabulary * DIMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(vocabulary, DIMS)
    return ((h >> np.uint64(40)).astype(np.float32) / np.float32(1 << 23)) - np.float32(1)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows of coordinates below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the reflections and exchanges of each level, coarse to fine
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_positions(ids: np.ndarray, first: np.ndarray, table: np.ndarray, ties: np.ndarray) -> np.ndarray:
    means = np.add.reduceat(table[ids], first[:-1], axis=0) / np.diff(first)[:, None]
    cells = np.clip((np.tanh(4 * means) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return (hilbert(cells, BITS) << TIE_BITS) | (mix(ties.astype(np.uint64)) >> np.uint64(64 - TIE_BITS)).astype(np.int64)


TOKENS = "doc_id long, curve long, n long, ids binary"


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, curve, n, ids): ids as zstd over little-endian numbers of two or four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(tokenizer)
        table = projection(own.size)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids, first = own.encode([t or "" for t in part.column(1).to_pylist()])
                place = mix(np.arange(row, row + part.num_rows, dtype=np.uint64))
                row += part.num_rows
                ties = part.column(0).fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64) + place
                packed = [pa.compress(pa.py_buffer(ids[a:b].tobytes()), "zstd", asbytes=True) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(curve_positions(ids, first, table, ties)), pa.array(np.diff(first)), pa.array(packed, pa.binary())],
                    names=["doc_id", "curve", "n", "ids"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, TOKENS)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: where it starts there, its ids, and its place in a sequence.

    A sequence's id is its range's number times 2**32 plus its number in the range."""
    tokens = written(tokenised(docs, tokenizer))
    total = tokens.agg(F.sum("n")).first()[0] or 0
    each = min(MOST, max(LEAST, -(-total // partitions_of(docs))))
    line = tokens.repartitionByRange(max(1, -(-total // each)), "curve").sortWithinPartitions("curve", "doc_id").withColumn("r", F.spark_partition_id())

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(tokenizer).kind
        now, at = -1, 0
        for batch in batches:
            rows: list[tuple] = []
            for r, doc, n, blob in zip(*(batch.column(c).to_pylist() for c in ("r", "doc_id", "n", "ids")), strict=True):
                if r != now:
                    now, at = r, 0
                ids = np.frombuffer(pa.decompress(blob, kind.itemsize * n, "zstd", asbytes=True), kind).astype("<u4")
                done = 0
                while done < n:
                    sequence, offset = divmod(at, size)
                    take = min(n - done, size - offset)
                    piece = ids[done : done + take]
                    rows.append((doc, done, take, zlib.crc32(piece.tobytes()), n, (r << 32) + sequence, offset, piece.astype(np.int32) if with_ids else None))
                    done, at = done + take, at + take
                if len(rows) >= 2000:
                    yield _pieces(rows)
                    rows = []
            if rows:
                yield _pieces(rows)

    return line.mapInArrow(lay, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)
