"""Scoring texts with a log-bilinear language model.

The model predicts each token from the two before it.  The ``TOP`` most frequent training tokens have
vectors of their own, as contexts and as targets; the other seen tokens are units by their last bytes
(``ENDINGS`` of them), and all unseen tokens are one unit.  The vectors of the context, each through the
matrix of its place, are added and multiplied with the target's vector.  To keep the normalisation
cheap, units are classed by their last bytes too: p(token | context) = p(class | context) * p(unit |
class, context) * p(token | unit), each of the first two a softmax over log-bilinear products.  The last
is 1 for the tokens with vectors, and for the others the discounted share in the unit.  So the product is
a proper distribution over the training vocabulary and one unseen token.  Absolute discounting (by D =
n1 / (n1 + 2 n2), from the numbers of types seen once and twice) takes D from each type's count and
gives it to the unseen unit.  As context, an unseen token counts by its last bytes.

1. Tokens are counted over all training documents by the packed exchange: each chunk of documents
   sends its distinct tokens with their counts to buckets of the hash space, which add them up and
   answer every chunk.  The vocabulary is never in one place.
2. Each document becomes a string of units, written to the shared folder with all that does not
   depend on the model.
3. The model is trained on every position of the training documents with noise-contrastive estimation in
   numpy.  Each position has its turn in one of the rounds; tasks with few take others again in each.
   In a round every task takes Adam steps over its positions, block by block, against noise drawn from
   the unigram shares, and hands back its parameters, which are averaged in Spark.
4. Scoring takes batched matrix products over the classes and over the units of the target's class.

Null texts count as empty and have the end token alone; very long texts are taken whole.  Null ids are
training documents (their digest is taken as that of an empty text).  Repeated rows are counted and
scored each; of equally frequent tokens the smaller hash has the vector.  The empty table gives an
empty result; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import exchange as X
from tidemark.llm.tables import discard, written
from tidemark.llm.words import Chunk, word_hashes

FOLDS, HELD_OUT = 5, 1
TOP, ENDINGS = 4095, 63
UNITS = TOP + ENDINGS + 1
UNSEEN, START = UNITS - 1, UNITS  # the unit of unseen tokens; the place before a text
CLASSES = ENDINGS + 1
WIDTH = 24
NOISE, NOISE_UNITS = 32, 16  # noise classes drawn for a step, and units for each class
RATES = (0.02, 0.01, 0.005)  # a round each
LEAST_STEPS = 40  # of a task in a round
BATCH, LARGE_BATCH = 2048, 16_384  # positions of a step, where they are few and where they are many
ENOUGH, BLOCK = LEAST_STEPS * BATCH, LEAST_STEPS * LARGE_BATCH  # positions of a round; and how many a task holds at once
MERGED = 16  # sums of parameters that the driver gets
END_HASH = np.uint64(0x5BD1E9955BD1E995)


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


class Tokens:
    """Distinct tokens of a chunk, sorted by hash, with what each chunk can say of them."""

    def __init__(self, texts: list[str | None], ids: list):
        chunk = Chunk(texts, lower=True)
        words = np.diff(chunk.first)
        self.n = words + 1
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        h = np.empty(self.first[-1], np.uint64)
        ends = np.zeros(len(h), bool)
        ends[self.first[1:] - 1] = True
        h[ends] = END_HASH
        h[~ends] = word_hashes(chunk.words)
        self.held_out = np.array([fold(i) == HELD_OUT for i in ids], bool)
        self.keys, some, self.which = np.unique(h, return_index=True, return_inverse=True)
        train = np.repeat(~self.held_out, self.n)
        self.count = np.bincount(self.which[train], minlength=len(self.keys))
        word_of = np.cumsum(~ends) - 1
        self.ending = np.array([zlib.crc32(b"" if e else chunk.words[w][-3:]) % ENDINGS for e, w in zip(ends[some].tolist(), word_of[some].tolist(), strict=True)], np.uint8)


SENT = "bucket int, chunk long, n int, keys binary, counts binary, endings binary"


def _send(buckets: int):
    def keys(chunk: int, texts: list[str | None], ids: list) -> pa.RecordBatch:
        t = Tokens(texts, ids)
        edge = X.bounds(t.keys, buckets)
        full = np.flatnonzero(np.diff(edge))
        parts = [slice(edge[b], edge[b + 1]) for b in full]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(full, pa.int32()),
                pa.array(np.full(len(full), chunk), pa.int64()),
                pa.array([p.stop - p.start for p in parts], pa.int32()),
                pa.array([X.pack_sorted(t.keys[p]) for p in parts], pa.binary()),
                pa.array([X.pack_ints(t.count[p]) for p in parts], pa.binary()),
                pa.array([t.ending[p].tobytes() for p in parts], pa.binary()),
            ],
            names=["bucket", "chunk", "n", "keys", "counts", "endings"],
        )

    return keys


COUNTED = "chunk long, bucket int, reply binary, top array<struct<h:long,c:long,e:int>>, endings array<struct<e:int,c:long,v:long,n1:long,n2:long>>"


def _count(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Replies with the corpus count of each key sent, and one row of the bucket's totals."""
    n = rows.column("n").to_numpy()
    keys = np.concatenate([X.unpack_sorted(k.as_py(), m) for k, m in zip(rows.column("keys"), n, strict=True)])
    count = np.concatenate([X.unpack_ints(k.as_py(), m) for k, m in zip(rows.column("counts"), n, strict=True)])
    ending = np.concatenate([np.frombuffer(k.as_py(), np.uint8) for k in rows.column("endings")])
    uniq, some, which = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(which, count, len(uniq)).astype(np.int64)
    ending = ending[some]
    replies = [X.pack_ints(total[which[b - m : b]]) for m, b in zip(n, np.cumsum(n), strict=True)]
    bucket = rows.column("bucket")[0].as_py()
    best = np.lexsort((uniq, -total))[:TOP]
    top = [{"h": int(uniq[k].view(np.int64)), "c": int(total[k]), "e": int(ending[k])} for k in best if total[k]]
    mass = np.bincount(ending, total, ENDINGS).astype(np.int64)
    types = np.bincount(ending[total > 0], minlength=ENDINGS)
    once, twice = (np.bincount(ending[total == k], minlength=ENDINGS) for k in (1, 2))
    sums = [{"e": e, "c": int(mass[e]), "v": int(types[e]), "n1": int(once[e]), "n2": int(twice[e])} for e in range(ENDINGS) if types[e]]
    m = len(replies)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([*rows.column("chunk").to_pylist(), None], pa.int64()),
            pa.array([bucket] * (m + 1), pa.int32()),
            pa.array([*replies, None], pa.binary()),
            pa.array([None] * m + [top], pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("e", pa.int32())]))),
            pa.array([None] * m + [sums], pa.list_(pa.struct([("e", pa.int32()), *((x, pa.int64()) for x in ("c", "v", "n1", "n2"))]))),
        ],
        names=["chunk", "bucket", "reply", "top", "endings"],
    )


class Vocabulary:
    """Bounded totals of the training tokens: N, V, the most frequent ones, mass of each ending.

    endings: (e, c, v, n1, n2) per ending; top: (h, c, e) of the most frequent tokens, in order."""

    def __init__(self, endings: list, top: list):
        self.tokens, self.types = sum(r["c"] for r in endings), sum(r["v"] for r in endings)
        once, twice = sum(r["n1"] for r in endings), sum(r["n2"] for r in endings)
        self.discount = min(0.9, once / max(1, once + 2 * twice))
        mass, types = np.zeros(ENDINGS), np.zeros(ENDINGS)
        for r in endings:
            mass[r["e"]] += r["c"]
            types[r["e"]] += r["v"]
        for r in top:
            mass[r["e"]] -= r["c"]
            types[r["e"]] -= 1
        self.mass = mass - self.discount * types
        self.top = np.array([r["h"] for r in top], np.int64).view(np.uint64)
        self.order = np.argsort(self.top)
        #: Share of each unit's counts that goes to unseen tokens.
        self.given = np.zeros(UNITS)
        self.given[TOP:UNSEEN] = self.discount * types / np.maximum(mass, 1)
        #: Training mass and class of each unit; units without a token keep a little, in class 0.
        self.share = np.zeros(UNITS)
        self.share[: len(top)] = [r["c"] for r in top]
        self.share[TOP:UNSEEN] = self.mass
        self.share[UNSEEN] = self.discount * types.sum()
        self.cls = np.zeros(UNITS, np.int64)
        self.cls[: len(top)] = [r["e"] for r in top]
        self.cls[TOP:] = np.arange(CLASSES)
        self.total = self.tokens + 0.5 * (self.types + 1)

    @classmethod
    def of(cls, counted: DataFrame) -> Vocabulary:
        totals = counted.where("chunk is null")
        sums = [F.sum(f"x.{x}").alias(x) for x in ("c", "v", "n1", "n2")]
        endings = totals.select(F.explode("endings").alias("x")).groupBy("x.e").agg(*sums).collect()
        top = totals.select(F.explode("top").alias("x")).select("x.*").orderBy(F.desc("c"), "h").limit(TOP).collect()
        return cls(endings, top)

    def units(self, keys: np.ndarray, count: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each key (unseen: UNSEEN + ending), and log10 of its share in the unit."""
        unit = np.where(count > 0, TOP, UNSEEN) + ending.astype(np.int64)
        inside = np.zeros(len(keys))
        if len(self.top):
            ranked = self.top[self.order]
            at = np.minimum(np.searchsorted(ranked, keys), len(ranked) - 1)
            own = ranked[at] == keys
            unit = np.where(own, self.order[at], unit)
        rest = (unit >= TOP) & (unit < UNSEEN)
        inside[rest] = np.log10((count[rest] - self.discount) / self.mass[unit[rest] - TOP])
        return unit, inside


SPELT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, units binary"


def _spell(vocabulary, buckets: int):
    def run(ids: list, texts: list[str | None], replies: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        v, t = vocabulary.value, Tokens(texts, ids)
        edge = X.bounds(t.keys, buckets)
        count = np.zeros(len(t.keys), np.int64)
        for b, reply in replies.items():
            count[edge[b] : edge[b + 1]] = X.unpack_ints(reply, int(edge[b + 1] - edge[b]))
        unit, inside = v.units(t.keys, count, t.ending)
        start = t.first[:-1]
        base = np.log10((count + 0.5) / v.total)
        raw = unit.astype("<u2")[t.which]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(t.held_out),
                pa.array(t.n),
                pa.array(np.add.reduceat((count > 0)[t.which].astype(np.int64), start)),
                pa.array(np.add.reduceat(base[t.which], start)),
                pa.array(np.add.reduceat(inside[t.which], start)),
                pa.array([raw[a:b].tobytes() for a, b in zip(start, t.first[1:], strict=True)], pa.binary()),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "inside", "units"],
        )

    return run


def _positions(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For unit strings laid end to end: context two back, context one back, unit; text starts."""
    n = np.array([len(t) // 2 for t in texts], np.int64)
    first = np.cumsum(n) - n
    w = np.frombuffer(b"".join(texts), "<u2").astype(np.int32)
    seen = np.where(w < UNSEEN, w, TOP + w - UNSEEN)
    one = np.concatenate([[START], seen[:-1]]).astype(np.int32)
    one[first] = START
    two = np.concatenate([[START], one[:-1]]).astype(np.int32)
    two[first] = START
    return two, one, np.minimum(w, UNSEEN), first


def _turns(first: np.ndarray, n: int) -> np.ndarray:
    """The round in which each of n positions is trained on, by its place in its text and the text's length."""
    length = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first - length, length)
    return ((place * 0x9E3779B1 & 0xFFFFFFFF) >> 16) % len(RATES)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of ``x``, in its place."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sums(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """The rows of ``x`` (or its numbers) added up by where they belong."""
    if x.ndim == 1:
        return np.bincount(at, x, size).astype(x.dtype)
    out = np.empty((size, x.shape[1]), x.dtype)
    for d in range(x.shape[1]):
        out[:, d] = np.bincount(at, x[:, d], size)
    return out


class Model:
    """Parameters of the log-bilinear model: context vectors, a matrix per place, vectors and biases of
    the classes and of the units."""

    SHAPES = {"r": (UNITS + 1, WIDTH), "c1": (WIDTH, WIDTH), "c2": (WIDTH, WIDTH), "qc": (CLASSES, WIDTH), "bc": (CLASSES,), "qu": (UNITS, WIDTH), "bu": (UNITS,)}

    def __init__(self, share: np.ndarray, cls: np.ndarray):
        share = np.maximum(share, 0.5)
        self.cls = cls
        self.order = np.argsort(cls, kind="stable")
        self.edge = np.searchsorted(cls[self.order], np.arange(CLASSES + 1))
        self.rank = np.empty(UNITS, np.uint16)
        self.rank[self.order] = np.arange(UNITS)
        sums = np.bincount(cls, share, CLASSES)
        self.unit_share = share / sums[cls]
        self.class_share = sums / sums.sum()
        self.unit_sums = [np.cumsum(self.unit_share[self.order[a:b]]) for a, b in zip(self.edge[:-1], self.edge[1:], strict=True)]
        rng = np.random.default_rng(7)
        self.p = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in self.SHAPES.items()}
        self.p["c1"] = np.eye(WIDTH, dtype=np.float32)
        self.p["c2"] = np.eye(WIDTH, dtype=np.float32) / 2
        self.p["bc"] = np.log(np.maximum(self.class_share, 1e-9)).astype(np.float32)
        self.p["bu"] = np.log(self.unit_share).astype(np.float32)

    def by_class(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the order of their targets' classes and units; class k has those from edge[k] to edge[k+1]."""
        rank = self.rank[w]
        order = np.argsort(rank, kind="stable")
        return order, np.searchsorted(rank[order], self.edge)

    @staticmethod
    def _log_sums(scores: np.ndarray) -> np.ndarray:
        """The logarithm of the sum of each row's exponentials."""
        with np.errstate(over="ignore"):
            sums = np.exp(scores) @ np.ones(scores.shape[1], scores.dtype)
        if sums.min() > 1e-30 and sums.max() < 1e30:
            return np.log(sums)
        top = scores.max(axis=1)
        return top + np.log(np.exp(scores - top[:, None]).sum(axis=1))

    def log10(self, two: np.ndarray, one: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Normalised log10 p(unit | context) of every position, by batched matrix products."""
        p = self.p
        r1, r2 = p["r"] @ p["c1"], p["r"] @ p["c2"]
        order, edge = self.by_class(w)
        out = np.empty(len(w), r1.dtype)
        for k in range(CLASSES):
            units = self.order[self.edge[k] : self.edge[k + 1]]
            qu, bu = p["qu"][units].T, p["bu"][units]
            for a in range(edge[k], edge[k + 1], ROWS_AT_ONCE):
                at = order[a : min(a + ROWS_AT_ONCE, edge[k + 1])]
                h = r1[one[at]] + r2[two[at]]
                scores = h @ p["qc"].T + p["bc"]
                got = scores[:, k] - self._log_sums(scores)
                if len(units) > 1:
                    scores = h @ qu + bu
                    got += scores[np.arange(len(at)), self.rank[w[at]] - self.edge[k]] - self._log_sums(scores)
                out[at] = got
        return out / np.float32(np.log(10))

    def drawn(self, w: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, list[np.ndarray]]:
        """Noise for a step: classes, and units of each class."""
        classes = rng.choice(CLASSES, NOISE, p=self.class_share)
        return classes, [self.order[self.edge[k] + np.minimum(np.searchsorted(x, rng.random(NOISE_UNITS) * x[-1]), len(x) - 1)] for k, x in enumerate(self.unit_sums)]

    def _contrast(self, h: np.ndarray, w: np.ndarray, noise: np.ndarray, vectors: np.ndarray, offset: np.ndarray, told: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The noise-contrastive objective of targets against shared noise (if ``told``), and its gradients:
        by the contexts, and by the scores of targets and of noise.  offset: biases less the logarithms of
        the expected noise."""
        own, others = vectors[w], vectors[noise]
        true = np.einsum("ij,ij->i", h, own) + offset[w]
        false = h @ others.T
        false += offset[noise]
        value = -float(np.logaddexp(0, -true).sum() + np.logaddexp(0, false).sum()) if told else 0.0
        up, down = _sigmoid(np.negative(true, out=true)), _sigmoid(false)
        np.negative(down, out=down)
        own *= up[:, None]
        own += down @ others
        return own, up, down, value

    def gradient(self, two: np.ndarray, one: np.ndarray, w: np.ndarray, noise: tuple[np.ndarray, list[np.ndarray]], told: bool = True) -> tuple[dict[str, np.ndarray], float]:
        """Of the objective for some positions and drawn noise, per position; and the objective, if ``told``."""
        p, kind = self.p, self.p["r"].dtype
        order, edge = self.by_class(w)
        two, one, w = two[order], one[order], w[order]
        c = self.cls[w]
        class_offset = p["bc"] - np.log(NOISE * np.maximum(self.class_share, 1e-9)).astype(kind)
        unit_offset = p["bu"] - np.log(NOISE_UNITS * self.unit_share).astype(kind)
        r1, r2 = p["r"][one], p["r"][two]
        h = r1 @ p["c1"]
        h += r2 @ p["c2"]
        gh, class_up, unit_up = np.empty_like(h), np.empty(len(w), kind), np.zeros(len(w), kind)
        g = {"qc": np.zeros_like(p["qc"]), "bc": np.zeros_like(p["bc"])}
        total, some, vectors, biases = 0.0, [], [], []
        noise_vectors, noise_biases = np.zeros((len(noise[0]), WIDTH), kind), np.zeros(len(noise[0]), kind)
        for a in range(0, len(w), ROWS_AT_ONCE):
            at = slice(a, a + ROWS_AT_ONCE)
            gh[at], class_up[at], down, value = self._contrast(h[at], c[at], noise[0], p["qc"], class_offset, told)
            noise_vectors += down.T @ h[at]
            noise_biases += down.sum(axis=0)
            total += value
        for k in range(CLASSES):
            if edge[k] == edge[k + 1]:
                continue
            at = slice(edge[k], edge[k + 1])
            x, up = h[at], class_up[at]
            g["qc"][k], g["bc"][k] = up @ x, up.sum()
            if self.edge[k + 1] - self.edge[k] > 1:
                own, unit_up[at], down, value = self._contrast(x, w[at], noise[1][k], p["qu"], unit_offset, told)
                gh[at] += own
                some.append(noise[1][k])
                vectors.append(down.T @ x)
                biases.append(down.sum(axis=0))
                total += value
        np.add.at(g["qc"], noise[0], noise_vectors)
        np.add.at(g["bc"], noise[0], noise_biases)
        at = np.concatenate([w, *some])
        g["bu"] = _sums(at, np.concatenate([unit_up, *biases]), UNITS)
        g["c1"], g["c2"] = r1.T @ gh, r2.T @ gh
        h *= unit_up[:, None]
        g["qu"] = _sums(at, np.concatenate([h, *vectors]), UNITS)
        g["r"] = _sums(np.concatenate([one, two]), np.concatenate([gh @ p["c1"].T, gh @ p["c2"].T]), UNITS + 1)
        return {k: g[k] / len(w) for k in self.SHAPES}, total / len(w)

    def fit(self, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float, seed: int) -> None:
        """Adam over all positions of each block (two back, one back, unit) in a random order, and over those
        of the first one again if they are few."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for two, one, w in blocks:
            parts = max(1, len(w) // min(max(len(w) // LEAST_STEPS, BATCH), LARGE_BATCH))
            taken = 0
            while taken < parts or step < LEAST_STEPS:
                if taken % parts == 0:
                    order = np.array_split(rng.permutation(len(w)), parts)
                k = order[taken % parts]
                taken += 1
                step += 1
                g, _ = self.gradient(two[k], one[k], w[k], self.drawn(w[k], rng), told=False)
                for name, x in g.items():
                    m[name] *= 0.9
                    m[name] += 0.1 * x
                    v[name] *= 0.99
                    v[name] += 0.01 * x * x
                    self.p[name] += (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, s in self.SHAPES.items():
            n = int(np.prod(s))
            self.p[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n


PARAMS = "part int, weight double, params binary"
TEXTS_AT_ONCE = 500


def _sum(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(p, np.float64) for p in rows["params"])
    return pd.DataFrame({"part": rows["part"].iloc[:1], "weight": [rows["weight"].sum()], "params": [total.tobytes()]})


def _blocks(texts: Iterator[list[bytes]], k: int, given: np.ndarray, rng: np.random.Generator, seen: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions (two back, one back, unit) whose turn is round k, in blocks of some ``BLOCK``; if they are
    fewer than ``ENOUGH``, others join them.  Counts of all positions are put into ``seen``."""
    joined = lambda parts: [np.concatenate(x) for x in zip(*parts, strict=True)]
    own, rest, n, spare, full = [], [], 0, 0, False
    for some in texts:
        two, one, w, first = _positions(some)
        seen.append(len(w))
        turn = _turns(first, len(w)) == k
        for at, parts in ((turn, own), (~turn & (n < ENOUGH and spare < ENOUGH and not full), rest)):
            if at.any():
                unit = w[at]
                parts.append((two[at], one[at], np.where(rng.random(len(unit)) < given[unit], UNSEEN, unit)))
        n, spare = sum(len(x[2]) for x in own), sum(len(x[2]) for x in rest)
        if n >= BLOCK:
            yield joined(own)
            own, rest, n, full = [], [], 0, True
    if not full and n < ENOUGH and rest:
        two, one, w = joined(rest)
        at = rng.permutation(len(w))[: ENOUGH - n]
        own.append((two[at], one[at], w[at]))
    if own:
        yield joined(own)


def train(spelt: DataFrame, vocabulary: Vocabulary) -> Model:
    """Average of models fitted to all training positions of the tasks, round after round."""
    spark = spelt.sparkSession
    model = Model(vocabulary.share, vocabulary.cls)
    units = spelt.where("not held_out").select("units")
    for k, rate in enumerate(RATES):
        sent = spark.sparkContext.broadcast((model.flat(), vocabulary.share, vocabulary.cls, vocabulary.given))

        def run(batches: Iterator[pa.RecordBatch], k=k, rate=rate, sent=sent) -> Iterator[pa.RecordBatch]:
            flat, share, cls, given = sent.value
            task = TaskContext.get().partitionId()
            texts = (batch.column(0).slice(a, TEXTS_AT_ONCE).to_pylist() for batch in batches for a in range(0, batch.num_rows, TEXTS_AT_ONCE))
            seen = []
            own = Model(share, cls)
            own.load(flat)
            own.fit(_blocks(texts, k, given, np.random.default_rng((11, k, task)), seen), rate, task)
            if not seen:
                return
            yield pa.RecordBatch.from_arrays(
                [pa.array([task % MERGED], pa.int32()), pa.array([float(sum(seen))]), pa.array([(own.flat().astype(np.float64) * sum(seen)).tobytes()], pa.binary())],
                names=["part", "weight", "params"],
            )

        got = units.mapInArrow(run, PARAMS).groupBy("part").applyInPandas(_sum, PARAMS).collect()
        total = sum(r["weight"] for r in got)
        if total:
            model.load(sum(np.frombuffer(r["params"]) for r in got) / total)
    return model


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, buckets: int | None = None, limit: int = X.CHUNK_CHARS) -> DataFrame:
    """One row per document: its counts, the unigram base score and the model's log10 probability."""
    spark = docs.sparkSession
    cut = X.chunks(docs, limit)
    buckets = buckets or X.buckets_for(cut)
    counted = written(X.by_bucket(X.send(cut, _send(buckets), SENT), X.partitions_of(docs), _count, COUNTED))
    vocabulary = Vocabulary.of(counted)
    replies = counted.where("chunk is not null").select("chunk", "bucket", "reply")
    spelt = written(X.answered(cut, replies, _spell(spark.sparkContext.broadcast(vocabulary), buckets), SPELT))
    discard(cut, counted)
    sent = spark.sparkContext.broadcast(train(spelt, vocabulary))
    tokens = vocabulary.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                two, one, w, first = _positions(part.column("units").to_pylist())
                got = np.concatenate([sent.value.log10(two[k : k + SCORE_AT_ONCE], one[k : k + SCORE_AT_ONCE], w[k : k + SCORE_AT_ONCE]) for k in range(0, len(w), SCORE_AT_ONCE)])
                model = np.add.reduceat(got.astype(np.float64), first)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:4],
                        pa.array(np.full(part.num_rows, tokens, np.int64)),
                        part.column("base_score"),
                        pa.array(model + part.column("inside").to_numpy()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return spelt.mapInArrow(run, SCORED)


SCORE_AT_ONCE, ROWS_AT_ONCE = 200_000, 1024  # positions: bound the memory of a step, and what is in the cache at once


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of some ``SCORE_AT_ONCE`` tokens, or of one longer text."""
    sums = np.cumsum(batch.column("n_tokens").to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + SCORE_AT_ONCE, "right")))
        yield batch.slice(at, to - at)
        at = to
