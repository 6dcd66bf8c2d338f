"""Near duplicates by SimHash, found by meeting in the middle of two Hamming balls.

Two fingerprints at distance 3 or less have a common variant: one bit away from one and at most
two bits away from the other.  Parity says which: fingerprints at odd distance differ in parity, so
it is enough that even ones (an even number of bits set) emit all variants at distance 1, and odd
ones emit themselves, all variants at distance 1, and those at distance 2 -- of these only pairs of
bits at most 21 apart on a circle of 64, because of three differing bits some two are that close,
and the even side can flip the third.  So every linked pair meets in a variant:

* distance 1, odd/even: the odd one itself;
* distance 2, even/even or odd/odd: a variant at distance 1 of both;
* distance 3: as above.

In a variant of odd parity meet even fingerprints (distance 1) and odd ones (0 or 2): whatever
meets an even one or the variant itself is linked to it.  In a variant of even parity meet odd ones
at distance 1, all linked.  So each variant yields a star, not pairs, every edge of it verified by
counting bits, and copies cost nothing: distinct fingerprints only take part.

Variants are shuffled by sixteen of their bits (every fourth): a fingerprint travels once to each
prefix that its ball touches, about sixty rows instead of seven hundred, and the task that owns the
prefix spells out the ball's variants inside it, a bounded number at once: a crowded prefix is cut by
further bits of the variant.

Null and empty texts have fingerprint zero and are linked like any other; very long texts are hashed
a block at a time.  Repeated rows share a component; rows with a null id get a fingerprint, and the
smallest id of their component, if any.  The empty table gives an empty result; other columns,
whatever their names, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.components import components
from tidemark.llm.exchange import partitions_of
from tidemark.llm.tables import written
from tidemark.llm.words import Chunk

SEED = 42
SHINGLE = 3
ROUTE = [4 * k for k in range(16)]  # bits that decide where a variant goes
FREE = [b for b in range(64) if b not in ROUTE]
CIRCLE = 21
_ONE = np.uint64(1)


def _close(i: int, j: int) -> bool:
    return min((i - j) % 64, (j - i) % 64) <= CIRCLE


def _bits(*bits: int) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


ROUTE_MASK = _bits(*ROUTE)
ROUTE_FLIPS = np.array([_bits(), *[_bits(i) for i in ROUTE], *[_bits(i, j) for i in ROUTE for j in ROUTE if i < j and _close(i, j)]], np.uint64)
#: Flips of free bits that go with no, one (by bit) or two flipped route bits, for odd fingerprints.
ODD_FREE = {0: np.array([_bits(), *[_bits(i) for i in FREE], *[_bits(i, j) for i in FREE for j in FREE if i < j and _close(i, j)]], np.uint64)}
for _r in ROUTE:
    ODD_FREE[1 << _r] = np.array([_bits(), *[_bits(i) for i in FREE if _close(i, _r)]], np.uint64)
EVEN_FREE = np.array([_bits(i) for i in FREE], np.uint64)


def parity(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) & 1


def fingerprint(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text (hashes first[k] to first[k+1]): the bits set in over half of its hashes."""
    out = np.zeros(len(first) - 1, np.uint64)
    n = np.diff(first)
    full = np.flatnonzero(n)
    step = 1 << 16
    ones = np.zeros((len(full), 64), np.int64)
    where = np.repeat(np.arange(len(full)), n[full])
    for k in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[k : k + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = where[k : k + step]
        edge = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    set_bits = np.packbits(2 * ones > n[full][:, None], axis=1).view(">u8").ravel()
    out[full] = set_bits.astype(np.uint64)
    return out


def _shingle_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    h64 = xxhash.xxh64_intdigest
    chunk = Chunk(texts, lower=True)
    out: list[int] = []
    first = [0]
    for a, b in zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True):
        w = chunk.words[a:b]
        if len(w) >= SHINGLE:
            out += [h64(b"%b %b %b" % x, SEED) for x in zip(w, w[1:], w[2:])]
        elif w:
            out.append(h64(b" ".join(w), SEED))
        first.append(len(out))
    return np.array(out, np.uint64), np.array(first, np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                fp = fingerprint(*_shingle_hashes(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, fp long")


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, flips, fp) for each prefix that the ball of a fingerprint touches."""
    for batch in batches:
        whole = batch.column(0).to_numpy().view(np.uint64)
        for k in range(0, len(whole), 4096):
            fp = whole[k : k + 4096]
            odd = parity(fp) == 1
            for part, flips in ((fp[odd], ROUTE_FLIPS), (fp[~odd], ROUTE_FLIPS[: 1 + len(ROUTE)])):
                if len(part):
                    route = ((part[:, None] & ROUTE_MASK) ^ flips[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(route.view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["route", "fp"]
                    )


#: Rows (fingerprint ^ route flips, fingerprint) with the flips of free bits that spell their variants.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _blocks(fp: np.ndarray, flips: np.ndarray) -> list[Block]:
    """The balls behind the flipped route bits, as rows and flips not yet multiplied out."""
    out = []
    odd = parity(fp) == 1
    for flip in np.unique(flips):
        here = flips == flip
        n = int(np.bitwise_count(flip))
        for part, free in ((fp[here & odd], ODD_FREE[int(flip)] if n < 2 else ODD_FREE[0][:1]), (fp[here & ~odd], EVEN_FREE if n == 0 else ODD_FREE[0][:1])):
            if len(part):
                out.append((part ^ flip, part, free))
    return out


def _leaves(blocks: list[Block], bits: list[int]) -> Iterator[list[Block]]:
    """The blocks cut by free bits of the variant, one after the other, until no more than ``SPELLED``
    variants are spelled out at once.  Cut by all bits, a leaf is one variant, which at most 2081
    fingerprints have in their balls, so this ends however crowded a prefix is."""
    if not bits or sum(len(base) * len(free) for base, _, free in blocks) <= SPELLED:
        yield blocks
        return
    bit = _bits(bits[0])
    for value in (False, True):
        part = []
        for base, src, free in blocks:
            flipped, right = (free & bit) != 0, ((base & bit) != 0) == value
            for rows, some in ((right, free[~flipped]), (~right, free[flipped])):
                if len(some) and rows.any():
                    part.append((base[rows], src[rows], some))
        if part:
            yield from _leaves(part, bits[1:])


def stars(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Verified edges (fingerprint, hub) of all variants spelled out from these rows."""
    var = np.concatenate([(base[:, None] ^ free[None, :]).ravel() for base, _, free in blocks])
    src = np.concatenate([np.repeat(own, len(free)) for _, own, free in blocks])
    # in each variant the best hub comes first: the variant itself, then those one bit away
    order = np.argsort(var, kind="stable")
    var, src = var[order], src[order]
    start = np.flatnonzero(np.diff(var, prepend=~var[:1]))
    size = np.diff(np.append(start, len(var)))
    met = np.repeat(size > 1, size)
    var, src = var[met], src[met]
    if not len(var):
        return var, src
    far = np.bitwise_count(var ^ src)
    order = np.lexsort((src, far, var))  # ties by value, so that a task run again gives the same edges
    var, src = var[order], src[order]
    start = np.flatnonzero(np.diff(var, prepend=~var[:1]))
    hub = np.repeat(src[start], np.diff(np.append(start, len(var))))
    good = (src != hub) & (np.bitwise_count(src ^ hub) <= 3)
    edges = np.unique(np.stack([src[good], hub[good]], axis=1), axis=0)
    return edges[:, 0], edges[:, 1]


SLAB = 1500  # rows of distinct prefixes spelled out together
SPELLED = 2_000_000  # variants spelled out at once


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the rows of each prefix; rows are sorted by prefix, and those of one, sixteen bytes
    each, are held together."""
    ready: list[tuple[np.ndarray, np.ndarray]] = []
    tail: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for a, b in _pieces(*(np.concatenate(x) for x in zip(*ready, strict=True))):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        route = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        other = np.flatnonzero(route != route[-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if last or (tail and tail[0][0][0] != route[0]):
            ready += [*tail, (route[:last], fp[:last])]
            count += sum(len(x) for x, _ in tail) + last
            tail = []
        tail.append((route[last:], fp[last:]))
        if count >= SLAB:
            yield from flush()
            ready, count = [], 0
    ready += tail
    if ready:
        yield from flush()


def _pieces(route: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of whole prefixes, a slab of them at a time; a crowded one is cut further."""
    edge = np.append(np.flatnonzero(np.diff(route, prepend=~route[:1])), len(route))
    a = 0
    while a < len(edge) - 1:
        b = a + 1
        while b < len(edge) - 1 and edge[b + 1] - edge[a] <= SLAB:
            b += 1
        rows = slice(edge[a], edge[b])
        for blocks in _leaves(_blocks(fp[rows], (fp[rows] & ROUTE_MASK) ^ route[rows]), FREE):
            yield stars(blocks)
        a = b


def links(fps: DataFrame) -> DataFrame:
    """Verified edges (a, b) that connect exactly the linked distinct fingerprints of ``fp``."""
    n = partitions_of(fps)
    routed = fps.select("fp").mapInArrow(_routes, "route long, fp long")
    return routed.repartition(n, "route").sortWithinPartitions("route").mapInArrow(_meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per document; component_id is the smallest id reachable."""
    marked = written(fingerprints(docs))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes))
    root = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    root = written(root)
    best = root.groupBy("root").agg(F.min("first").alias("component_id"))
    labelled = root.join(best, "root").select("fp", "component_id")
    return marked.join(labelled, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each group of near duplicates: the one with the
    smallest id (null ids last).  Rows are told apart by a number given before they are written."""
    names = [f"__c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index("text")
    plain = docs.toDF(*names).withColumn(names[at], F.col(names[at]).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                fp = fingerprint(*_shingle_hashes(part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp.view(np.int64))], names=[*names, "__fp"])

    schema = StructType([*plain.schema.fields, StructField("__fp", LongType())])
    marked = written(plain.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()))
    i = F.col(names[docs.columns.index("doc_id")]).cast("long")
    order = F.struct(i.isNull().alias("n"), i.alias("i"), F.col("__row").alias("row"))
    nodes = marked.select(F.col("__fp").alias("fp"), order.alias("o")).groupBy("fp").agg(F.min("o").alias("o"))
    nodes = written(nodes)
    found = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    best = nodes.join(found, "fp", "left").groupBy(F.coalesce("component", "fp").alias("root")).agg(F.min("o").alias("o"))
    kept = marked.join(best.select(F.col("o.row").alias("__row")), "__row", "left_semi")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
