"""Benchmark decontamination by spaced seeds.

A document is contaminated by a benchmark item if some alignment of the two has a window of
``WINDOW`` consecutive words (the whole item, if shorter) of which at least 80 % agree; words are
compared without case and punctuation.  Fixed masks select a few positions of a window and ignore
the rest, so a hash of the selected words survives substitutions at the others.  The three masks
below were chosen so that any four substitutions in twenty words, or three in seventeen to
nineteen, leave at least one mask intact somewhere in the window: no contaminated window is missed.
Items too short for them are cut into one more block than substitutions allowed; one block is intact.

1. The items' masked hashes (seeds) are counted in Spark: distinct hashes with their places.
2. Documents are read once.  A filter of the seeds, of at most 2**``FILTER_BITS`` bits a table however
   large the benchmark is, passes over positions that can't match; from the others, the words around them are
   written to the shared folder as runs, a small part of the corpus.
3. The hashes of the runs are joined with the seeds; every match is an alignment of a run with an item.
   A seed inside a stock phrase stands in many items and many documents; where joining it would make
   more rows than ``MANY`` times those joined, it is extended first: the other words of a window fall into blocks
   of which any matching window leaves two intact, and seed and two blocks must agree to be joined.
   Items of the same words are one item until the end.
4. Distinct alignments are joined with the words of both and verified window by window, a bounded
   number at once; each document and item keeps its best window.

Nothing but the filter is sent to all tasks.  A seed that stands in a third of all documents is one
row of the join's right side, whose left side adaptive execution splits; the same holds for an item.

Null and empty texts, on either side, match nothing; repeated rows are judged each, very long texts
whole; null item ids are reported as null; of equally good windows the first in the document counts,
then the first in the item; an empty benchmark leaves every document clean, and an empty table gives an
empty result; clashing column names do no harm: all names used here begin with two underscores.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import written
from tidemark.llm.words import mix, word_hashes

WINDOW = 20
SHARE = 0.8
#: Selected positions of each mask.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 3, 7, 8, 11), (0, 2, 3, 6, 9, 13))
LEAST = 17  # words of an item from which the masks find all substitutions allowed
TABLES, FILTER_BITS = 4, 26  # bitmaps of the filter, and bits of a hash that choose a bit of one, at most
MANY = 64  # rows that a joined row of a seed may make on average; no fewer than the pairs of blocks of a mask
BEFORE, AFTER = 16, 20  # words of a place's surroundings: more before it than any block reaches, and as many from it
PAIRS = 200_000  # words compared at once while alignments are verified
_FLAT = bytes(range(256)).lower()
_DROP = string.punctuation.encode()
_MULTIPLIERS = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def allowed(words: int) -> int:
    """Words of a window that may differ."""
    return words - int(np.ceil(round(SHARE * words, 6)))


def tokens(text: str | None) -> list[bytes]:
    """Words without ASCII case and punctuation; words of punctuation alone vanish."""
    return text.encode("utf-8", "surrogatepass").translate(_FLAT, _DROP).split() if text else []


def masked(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A hash of the selected words at every position where the mask fits."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(len(mask) * 1009 + mask[-1]))
        for k, at in enumerate(mask):
            total += h[at : at + n] * _MULTIPLIERS[k % 64]
            if k % 64 == 63:
                total = mix(total)
    return mix(total)


def _block_mask(words: int) -> tuple[int, ...]:
    return tuple(range(max(1, words // (allowed(words) + 1))))


def _masks_of(words: int) -> list[tuple[tuple[int, ...], int]]:
    """The masks that an item of so many words is looked up by, and the step between their places."""
    if words >= LEAST:
        return [(m, 1) for m in MASKS]
    block = _block_mask(words)
    return [(block, len(block))]


def shape_of(words: int, mask: int, place: int) -> int:
    """A number for how an item's seed can be extended: its mask, or the item's length and the block; -1
    where a seed is the whole item."""
    if words >= LEAST:
        return mask if words >= WINDOW else 3 + 32 * words + mask
    return -1 if not allowed(words) else 3 + 32 * words + place // len(_block_mask(words))


def extensions(shape: int) -> list[tuple[int, ...]]:
    """Places, relative to a seed's, of the words of two blocks that can be intact together with it.  In
    every window that an item and a document share and that holds the seed, at least one of these is."""
    words, block = divmod(shape - 3, 32) if shape >= 3 else (WINDOW, shape)
    if words < LEAST:
        size = len(_block_mask(words))
        inside = [p - block * size for p in range(words) if not block * size <= p < (block + 1) * size]
        step = 2 if words >= 10 else 1
        blocks = [tuple(inside[k : k + step]) for k in range(0, len(inside), step)]
    else:
        mask = MASKS[block]
        reach = mask[-1] + 1
        ignored = [p for p in range(reach) if p not in mask]
        blocks = [tuple(ignored[k : k + 2]) for k in range(0, len(ignored), 2)]
        if words == WINDOW:
            blocks = [b for b in blocks if len(b) == 2]  # a single word is too little, and the others suffice
        for k in range((words - reach) // 2):
            blocks += [(-2 * k - 2, -2 * k - 1), (reach + 2 * k, reach + 2 * k + 1)]
    both = [a + b for k, a in enumerate(blocks) for b in blocks[k + 1 :]]
    return both if words < LEAST else [p for p in both if max(*p, reach - 1) - min(*p, 0) < words]


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): a number and the word hashes of each item, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                words = [word_hashes(tokens(t)).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + part.num_rows)), part.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item", "item_id", "words"]
                )
                row += part.num_rows

    some = benchmark.selectExpr("cast(item_id as bigint) item_id", "cast(text as string) text").where("text is not null")
    return written(some.mapInArrow(run, "item long, item_id long, words array<long>").where(F.size("words") > 0))


def _seeds(items: DataFrame) -> DataFrame:
    """(seed, item, place, shape) of every place where a mask of an item fits, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = words.values.to_numpy().view(np.uint64)
                for k, (mask, step) in enumerate(_masks_of(len(h))):
                    got = masked(h, mask)[::step]
                    place = np.arange(len(got), dtype=np.int32) * step
                    shape = np.array([shape_of(len(h), k, int(p)) for p in place], np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(got.view(np.int64)), pa.array(np.full(len(got), item)), pa.array(place), pa.array(shape)], names=["seed", "item", "place", "shape"]
                    )

    return written(items.select("item", "words").mapInArrow(run, "seed long, item long, place int, shape int"))


class Filter:
    """``TABLES`` bitmaps of the seeds, each indexed by other bits of the hash, about sixteen times as
    many bits as seeds up to 2**``FILTER_BITS``.  They are put together in Spark and come to the driver
    as a long for each 64 bits.  ``masks``: those that some item has."""

    def __init__(self, items: DataFrame, seeds: DataFrame):
        few = items.select(F.least(F.size("words"), F.lit(LEAST)).alias("n")).distinct().collect()
        self.masks = sorted({m for r in few for m, _ in _masks_of(r["n"])})
        self.bits = min(FILTER_BITS, max(10, int(seeds.count() * 16).bit_length()))
        rows = seeds.select(F.posexplode(F.array(*[F.shiftleft("seed", 16 * t) for t in range(TABLES)])).alias("t", "h"))
        rows = rows.select("t", F.shiftrightunsigned("h", 64 - self.bits).alias("place"))
        rows = rows.groupBy("t", F.shiftright("place", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("set"))
        table = np.zeros((TABLES, 1 << (self.bits - 6)), np.int64)
        got = rows.toArrow()
        table[got.column("t").to_numpy(), got.column("word").to_numpy()] = got.column("set").to_numpy()
        self.table = table.view(np.uint8)

    def through(self, h: np.ndarray) -> np.ndarray:
        """Where the hashes may be seeds."""
        at = np.arange(len(h))
        for t in range(TABLES):
            place = (h[at] << np.uint64(16 * t)) >> np.uint64(64 - self.bits)
            on = (self.table[t][place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
            at = at[on.astype(bool)]
        return at


RUNS = "run long, __a long, __b long, at long, words array<long>"


def _runs(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """Stretches of the documents around places that the filter lets through, written: their key, the
    number of their first word and their word hashes."""
    reach = 2 * WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sent.value
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                words: list[bytes] = []
                first = [0]
                for t in part.column(2).to_pylist():
                    words += tokens(t)
                    first.append(len(words))
                h, edge = word_hashes(words), np.array(first)
                hit = np.zeros(len(h) + 1, np.int32)
                for mask in seen.masks:
                    hit[seen.through(masked(h, mask))] = 1
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                own = np.searchsorted(edge, at, "right") - 1
                lo, hi = np.maximum(at - reach, edge[own]), np.minimum(at + reach, edge[own + 1])
                new = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (lo > np.concatenate([[-1], hi[:-1]])))
                begin, end = lo[new], hi[np.append(new[1:], len(at)) - 1]
                doc = own[new]
                n = end - begin
                flat = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + len(new))),
                        part.column(0).take(pa.array(doc)),
                        part.column(1).take(pa.array(doc)),
                        pa.array(begin - edge[doc]),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(h[flat].view(np.int64))),
                    ],
                    names=["run", "__a", "__b", "at", "words"],
                )
                number += len(new)

    return written(docs.select("__a", "__b", "text").mapInArrow(run, RUNS))


def _found(runs: DataFrame, sent: Broadcast) -> DataFrame:
    """(run, seed, place) of the runs' hashes that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sent.value
        for batch in batches:
            for number, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = words.values.to_numpy().view(np.uint64)
                for mask in seen.masks:
                    got = masked(h, mask)
                    at = seen.through(got)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array(got[at].view(np.int64)), pa.array(at.astype(np.int32))], names=["run", "seed", "place"])

    return runs.select("run", "words").mapInArrow(run, "run long, seed long, place int")


def _extended(rows: DataFrame, texts: DataFrame, of: str) -> DataFrame:
    """(key, ``of``, place): the seeds of ``rows`` (seed, shape, ``of``, place) with two more blocks, by the
    words around them in ``texts`` (``of``, words)."""
    lead = F.least("place", F.lit(BEFORE))
    around = F.slice("words", F.col("place") - lead + 1, lead + AFTER)
    some = rows.join(texts.select(of, "words"), of).select("seed", "shape", of, "place", lead.alias("lead"), around.alias("around"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seed, shape, owner, place, lead = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            size = pa.compute.list_value_length(batch.column(5)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            at = BEFORE - lead[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            words, there = np.zeros((len(size), BEFORE + AFTER), np.uint64), np.zeros((len(size), BEFORE + AFTER), bool)
            words[row, at], there[row, at] = batch.column(5).flatten().to_numpy().view(np.uint64), True
            for kind in np.unique(shape):
                here = np.flatnonzero(shape == kind)
                for number, places in enumerate(extensions(int(kind))):
                    cols = np.array(places) + BEFORE
                    full = here[there[np.ix_(here, cols)].all(axis=1)]
                    with np.errstate(over="ignore"):
                        total = seed[full].view(np.uint64) + np.uint64((int(kind) * 1000 + number) * 1_000_003)
                        for c in cols:
                            total = mix(total + words[full, c] * _MULTIPLIERS[c])
                    yield pa.RecordBatch.from_arrays([pa.array(total.view(np.int64)), pa.array(owner[full]), pa.array(place[full])], names=["key", of, "place"])

    return some.mapInArrow(run, f"key long, {of} long, place int")


def alignments(found: DataFrame, seeds: DataFrame, runs: DataFrame, items: DataFrame) -> DataFrame:
    """(run, item, shift), repeated where several seeds agree: a match of ``found`` and ``seeds``."""
    many = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).join(seeds.where("shape >= 0").groupBy("seed").agg(F.count(F.lit(1)).alias("m")), "seed")
    crowded = written(many.where(F.col("n").cast("double") * F.col("m") > MANY * (F.col("n") + F.col("m"))).select("seed"))
    there = seeds.withColumnRenamed("place", "there")
    if crowded.isEmpty():
        return found.join(there, "seed").select("run", "item", (F.col("place") - F.col("there")).alias("shift"))
    marked = there.join(crowded.withColumn("__many", F.lit(True)), "seed", "left").withColumn("__many", F.coalesce("__many", F.lit(False)) & (F.col("shape") >= 0))
    plain = found.join(marked.where("not __many").drop("__many"), "seed")
    shapes = marked.where("__many").select("seed", "shape").distinct()
    ours = _extended(found.join(shapes, "seed"), runs, "run")
    theirs = _extended(marked.where("__many").select("seed", "shape", "item", F.col("there").alias("place")), items, "item").withColumnRenamed("place", "there")
    return plain.select("run", "item", "place", "there").unionByName(ours.join(theirs, "key").select("run", "item", "place", "there")).select("run", "item", (F.col("place") - F.col("there")).alias("shift"))


HITS = "__a long, __b long, doc_word long, item_word long, agree int"


def _best(words: np.ndarray, item: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int] | None:
    """(words that agree, where in the run, where in the item) of the best window of some alignments,
    each given by the place in the run that the item's first word would have."""
    window = min(len(item), WINDOW)
    need = window - allowed(window)
    best: tuple[int, int, int] | None = None
    step = max(1, PAIRS // len(item))
    for k in range(0, len(shifts), step):
        at = shifts[k : k + step, None] + np.arange(len(item))
        inside = (at >= 0) & (at < len(words))
        equal = inside & (words[np.clip(at, 0, len(words) - 1)] == item)
        sums = np.concatenate([np.zeros((len(at), 1), np.int32), np.cumsum(equal, axis=1, dtype=np.int32)], axis=1)
        score = sums[:, window:] - sums[:, :-window]
        top = int(score.max())
        if top < need or (best and top <= best[0]):
            continue  # alignments come in the order of the run, so an equally good one is later
        rows, cols = np.nonzero(score == top)
        first = np.lexsort((cols, at[rows, cols]))[0]
        best = (top, int(at[rows[first], cols[first]]), int(cols[first]))
        if top == window:
            break
    return best


def _with_item(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        cols = [batch.column(c) for c in ("item", "__a", "__b", "at")]
        rows = zip(*(c.to_pylist() for c in cols), *(batch.column(c) for c in ("words", "item_words", "shifts")), strict=True)
        for number, a, b, at, *lists in rows:
            words, item, shifts = (x.values.to_numpy() for x in lists)
            got = _best(words, item, np.sort(shifts))
            if got:
                out.append((number, a, b, max(0, at + got[1]), got[2], got[0]))
        if out:
            kinds = [pa.int64()] * 5 + [pa.int32()]
            names = ["item", "__a", "__b", "doc_word", "item_word", "agree"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _key() -> list:
    """A 128-bit key of a document's id and text: rows that are alike share their fate."""
    i, t = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [F.xxhash64(i, i.isNull(), t).alias("__a"), F.xxhash64(t, F.lit("seed"), i, i.isNull()).alias("__b")]


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(__a, __b, item, item_id, doc_word, item_word, agree), written: the best window of each distinct
    document, by its key, and item."""
    rows = _items(benchmark).withColumns({"__w1": F.xxhash64("words"), "__w2": F.xxhash64("words", F.lit("item"))})
    items = written(rows.groupBy("__w1", "__w2").agg(F.min("item").alias("item"), F.min_by("words", "item").alias("words")))
    names = rows.select("__w1", "__w2", F.col("item").alias("one"), "item_id").join(items.select("__w1", "__w2", "item"), ["__w1", "__w2"]).select("item", "one", "item_id")
    seeds = _seeds(items)
    sent = docs.sparkSession.sparkContext.broadcast(Filter(items, seeds))
    keyed = docs.select(*_key(), F.col("text").cast("string").alias("text")).where("text is not null")
    runs = _runs(keyed, sent)
    met = alignments(written(_found(runs, sent)), seeds, runs, items)
    aligned = met.distinct().groupBy("run", "item").agg(F.collect_list("shift").alias("shifts"))
    both = aligned.join(runs, "run").join(items.select("item", F.col("words").alias("item_words")), "item")
    got = both.select("item", "__a", "__b", "at", "words", "item_words", "shifts").mapInArrow(_with_item, f"item long, {HITS}")
    place = F.struct((-F.col("agree")).alias("a"), "doc_word", "item_word")
    best = got.groupBy("__a", "__b", "item").agg(F.min(place).alias("x")).join(names, "item")
    return written(best.select("__a", "__b", F.col("one").alias("item"), "item_id", "x.doc_word", "x.item_word", (-F.col("x.a")).alias("agree")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, agree) of every contaminated document and item."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = hits(base, benchmark)
    some = base.select("doc_id", *_key())
    return some.join(found, ["__a", "__b"]).select("doc_id", "item_id", "doc_word", "item_word", "agree")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates."""
    found = hits(docs.select("doc_id", "text"), benchmark).select("__a", "__b").distinct()
    return docs.withColumns(dict(zip(("__a", "__b"), _key(), strict=True))).join(found, ["__a", "__b"], "left_anti").drop("__a", "__b")
