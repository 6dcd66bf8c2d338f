"""Toxic spans by a linear-chain conditional random field; marginals give document scores.

The labels mark whole documents, so tokens are labelled first: word and prefix features whose token
rate in toxic documents is far above that in clean ones form a lexicon, and the tokens of toxic
documents that carry one are toxic tokens.  On these labelled sequences a two-state linear-chain
conditional random field is trained by gradient ascent with exact forward-backward marginals.  A
document's score is a logistic function, fitted to the document labels, of the expected number of
toxic tokens and the largest marginal.  Tokens with a marginal of 0.5 or more are the offending
spans, given as code-point offsets.

Fitting uses a bounded sample of labelled rows (``SAMPLE`` documents, the same number of toxic and
clean ones if there are as many, of at most ``SAMPLE_CHARS`` characters each, in the order of a hash
of their ids); the lexicon and the calibration take all of it, the field the ``FIELD_DOCS`` first by
a hash of their texts, of those with at most ``FIELD_WORDS`` words.  All four are parameters of ``fit``.
The held-out fold is never used.  Scoring reads every whole text and nothing but the
text, in one pass without a shuffle.  Most tokens carry no lexicon feature; a run of such tokens
multiplies the forward message by a power of one fixed matrix, which is computed in closed form, so
marginals are exact and cost only as much as a document has evidence.

Null and empty texts have no evidence: they get the score of a clean document; very long texts are
scored whole.  Repeated rows are scored alike; of labels of one id that differ the larger counts, and
features that tie for a place in the lexicon take it in the order of their letters.  Labels that are
null, or without a document, are ignored; without any toxic label the model has no lexicon and every
score is near 0.  The empty table gives an empty result.  Clashing column names do no harm.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 5, 0
SAMPLE, SAMPLE_CHARS = 3000, 20_000
FIELD_DOCS, FIELD_WORDS = 1000, 1200  # of the sample, documents and longest sequence for the field
PREFIXES = (3, 4, 5, 6, 7)
FEATURES = 3000
_FLAT, _DROP = bytes(range(256)).lower(), string.punctuation.encode()
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FLAT, _DROP).split() if text else []


def features(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace").lower()
    return [w, *[f"{w[:k]}-" for k in PREFIXES if len(w) > k]]


REMEMBERED = 100_000
#: Evidence tokens of documents that are worked on together, and of one that is worked on alone.
CELLS, LONG = 1 << 18, 4096
_MEMORY: dict = {}


def _messages(start: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The messages ``start @ steps[0] @ ... @ steps[t]`` for all t, each scaled to sum 1: products inside
    blocks of equal length, all blocks at once, then from block to block."""
    n = len(steps)
    size = max(1, int(np.ceil(np.sqrt(n))))
    blocks = -(-n // size)
    m = np.tile(np.eye(2), (blocks * size, 1, 1))
    m[:n] = steps
    m = m.reshape(blocks, size, 2, 2)
    for t in range(size):
        if t:
            m[:, t] = m[:, t - 1] @ m[:, t]
        m[:, t] /= m[:, t].sum(axis=(1, 2), keepdims=True)
    first = np.empty((blocks, 2))
    now = start
    for b in range(blocks):
        first[b] = now
        now = now @ m[b, -1]
        now = now / now.sum()
    out = np.einsum("bi,btij->btj", first, m).reshape(-1, 2)[:n]
    return out / out.sum(axis=1, keepdims=True)


class Field:
    """Two states, clean and toxic; weights are those of the toxic state relative to the clean one."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.bias, self.enter, self.stay = -4.0, -2.0, 1.0
        self.calibration = np.array([-3.0, 0.0, 0.0])
        self.name = ""

    def _neutral(self) -> np.ndarray:
        """Transition to a token without evidence: rows from, columns to."""
        return self._step(np.zeros(1))[0]

    def _step(self, evidence: np.ndarray) -> np.ndarray:
        toxic = np.exp(np.clip(evidence + self.bias, -40, 40))
        m = np.empty((len(evidence), 2, 2))
        m[:, 0, 0] = m[:, 1, 0] = 1
        m[:, 0, 1] = toxic * np.exp(self.enter)
        m[:, 1, 1] = toxic * np.exp(self.stay)
        return m

    def _powers(self, gaps: np.ndarray) -> np.ndarray:
        """Scaled powers of the neutral transition."""
        m = self._neutral()
        values, vectors = np.linalg.eig(m)
        order = np.argsort(-values.real)
        values, vectors = values.real[order], vectors.real[:, order]
        ratio = np.power(values[1] / values[0], gaps)
        inverse = np.linalg.inv(vectors)
        return vectors[:, :1] @ inverse[:1] + ratio[:, None, None] * (vectors[:, 1:] @ inverse[1:])

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """The weight of each word's features; a worker remembers words of the last model only."""
        if _MEMORY.get("field") != self.name:
            _MEMORY.update(field=self.name, known={})
        known: dict[bytes, float] = _MEMORY["known"]
        if len(known) > REMEMBERED:
            known.clear()
        got = list(map(known.get, words))
        for k, e in enumerate(got):
            if e is None:
                w = words[k]
                got[k] = known[w] = sum(self.weight.get(f, 0.0) for f in features(w)) if self.weight else 0.0
        return np.array(got, np.float64)

    def marginals(self, docs: list[np.ndarray], where: list[np.ndarray], lengths: list[int]) -> list[np.ndarray]:
        """Of each document's evidence tokens (values ``docs``, positions ``where``): p(toxic).

        Documents with about as many tokens are taken together, ``CELLS`` tokens at most, padding
        included; one with more than ``LONG`` is taken alone, in blocks side by side."""
        out = [np.empty(0)] * len(docs)
        slab: list[int] = []

        def flush() -> None:
            if slab:
                for k, p in zip(slab, self._together([docs[k] for k in slab], [where[k] for k in slab], [lengths[k] for k in slab]), strict=True):
                    out[k] = p
                slab.clear()

        for k in sorted((k for k in range(len(docs)) if len(docs[k])), key=lambda k: -len(docs[k])):
            if len(docs[k]) > LONG:
                out[k] = self._alone(docs[k], where[k], lengths[k])
                continue
            if slab and (len(slab) + 1) * len(docs[slab[0]]) > CELLS:
                flush()
            slab.append(k)
        flush()
        return out

    def _alone(self, values: np.ndarray, where: np.ndarray, length: int) -> np.ndarray:
        m = self._powers(np.diff(where, prepend=-1) - 1) @ self._step(values)
        forward = _messages(np.array([1.0, 0.0]), m)
        end = self._powers(np.array([length - 1 - where[-1]]))[0] @ np.ones(2)
        back = np.concatenate([_messages(end / end.sum(), m[:0:-1].transpose(0, 2, 1))[::-1], end[None] / end.sum()])
        both = forward * back
        return both[:, 1] / both.sum(axis=1)

    def _together(self, docs: list[np.ndarray], where: list[np.ndarray], lengths: list[int]) -> list[np.ndarray]:
        """The marginals of documents in the order of their tokens, most first."""
        out, busy = [np.empty(0)] * len(docs), range(len(docs))
        most = len(docs[busy[0]])
        count = np.array([len(docs[k]) for k in busy])
        value, gap = np.zeros((len(busy), most)), np.zeros((len(busy), most + 1), np.int64)
        for r, k in enumerate(busy):
            value[r, : count[r]] = docs[k]
            gap[r, : count[r]] = np.diff(where[k], prepend=-1) - 1
            gap[r, count[r]] = lengths[k] - 1 - where[k][-1]
        forward = np.empty((len(busy), most, 2))
        now = np.tile([1.0, 0.0], (len(busy), 1))  # a text begins after a clean token
        for t in range(most):
            n = int(np.searchsorted(-count, -t, "left"))  # documents with more than t tokens
            m = self._powers(gap[:n, t]) @ self._step(value[:n, t])
            step = np.einsum("ni,nij->nj", now[:n], m)
            now[:n] = step / step.sum(axis=1, keepdims=True)
            forward[:n, t] = now[:n]
        back = np.empty((len(busy), 2))
        p = np.zeros((len(busy), most))
        for t in range(most - 1, -1, -1):
            n = int(np.searchsorted(-count, -t, "left"))
            last = count[:n] == t + 1
            after = self._powers(gap[:n, t + 1])
            if t + 1 < most:
                after = np.where(last[:, None, None], after, after @ self._step(value[:n, t + 1]))
            back[:n] = np.einsum("nij,nj->ni", after, np.where(last[:, None], 1.0, back[:n]))
            back[:n] /= back[:n].sum(axis=1, keepdims=True)
            both = forward[:n, t] * back[:n]
            p[:n, t] = both[:, 1] / both.sum(axis=1)
        for r, k in enumerate(busy):
            out[k] = p[r, : count[r]]
        return out

    def tag(self, texts: list[str | None]) -> tuple[list[list[bytes]], list[np.ndarray], list[np.ndarray]]:
        """Tokens, positions of evidence and their marginals, for each text."""
        words = [tokens(t) for t in texts]
        values, where = [], []
        for w in words:
            e = self.evidence(w)
            at = np.flatnonzero(e)
            values.append(e[at])
            where.append(at)
        return words, where, self.marginals(values, where, [len(w) for w in words])

    def summary(self, marginals: list[np.ndarray]) -> np.ndarray:
        return np.array([[1.0, np.log1p(p.sum()) if len(p) else 0.0, p.max() if len(p) else 0.0] for p in marginals]).reshape(-1, 3)

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.summary(marginals) @ self.calibration, -30, 30)))


def _lexicon(docs: list[tuple[list[bytes], int]]) -> dict[str, float]:
    """Features with the log of their token rate in toxic documents over that in clean ones.

    A feature must stand between many different neighbours in toxic documents, so that the words
    of one often-copied document don't enter.
    """
    rate, total = (Counter(), Counter()), [1, 1]
    around: dict[str, set] = defaultdict(set)
    n_toxic = sum(toxic for _, toxic in docs)
    for words, toxic in docs:
        total[toxic] += len(words)
        parts = {w: features(w) for w in set(words)}
        for w, n in Counter(words).items():
            for f in parts[w]:
                rate[toxic][f] += min(n, 5)
    ratio = {f: np.log((n + 0.1) / total[1]) - np.log((rate[0][f] + 0.5) / total[0]) for f, n in rate[1].items()}
    ratio = {f: r for f, r in ratio.items() if r > np.log(6)}
    for words, toxic in docs:  # neighbours of the few features that are left, not of all
        if toxic:
            parts = {w: [f for f in features(w) if f in ratio] for w in set(words)}
            for a, w, b in zip([b"", *words], words, [*words[1:], b""], strict=False):
                if parts[w]:
                    place = zlib.crc32(a + b" " + b)
                    for f in parts[w]:
                        around[f].add(place)
    out = {f: ratio[f] * np.sqrt(len(places)) for f, places in around.items() if len(places) >= max(8, 0.03 * n_toxic)}
    return {f: out[f] for f in sorted(out, key=lambda f: (-out[f], f))[:FEATURES]}


def _train_field(field: Field, docs: list[tuple[list[bytes], int]], lexicon: dict[str, float], most_words: int = FIELD_WORDS, steps: int = 40) -> None:
    """Gradient ascent on the penalised likelihood of the labelled token sequences."""
    index = {f: k for k, f in enumerate(lexicon)}
    docs = sorted((d for d in docs if 0 < len(d[0]) <= most_words), key=lambda d: -len(d[0]))
    if not docs or not index:
        return
    n, most = len(docs), len(docs[0][0])
    length = np.array([len(w) for w, _ in docs])
    row, col, feat = [], [], []
    label = np.zeros((n, most), bool)
    for r, (words, toxic) in enumerate(docs):
        for c, w in enumerate(words):
            for f in features(w):
                k = index.get(f)
                if k is not None:
                    row.append(r)
                    col.append(c)
                    feat.append(k)
                    label[r, c] |= bool(toxic)
    row, col, feat = np.array(row), np.array(col), np.array(feat)
    valid = np.arange(most)[None, :] < length[:, None]
    before = np.concatenate([np.zeros((n, 1), bool), label[:, :-1]], axis=1)
    params = np.concatenate([np.full(len(index), 0.5), [field.bias, field.enter, field.stay]])
    m, v = np.zeros_like(params), np.zeros_like(params)
    want = np.concatenate([np.bincount(feat, label[row, col], len(index)), [label.sum(), (label & ~before).sum(), (label & before).sum()]])
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(most)]
    for step in range(1, steps + 1):
        e = np.zeros((n, most), np.float32)
        np.add.at(e, (row, col), params[feat])
        toxic = np.exp(np.clip(e + np.float32(params[-3]), -30, 30))
        enter, stay = np.float32(np.exp(params[-2])), np.float32(np.exp(params[-1]))
        f1 = np.zeros((n, most + 1), np.float32)  # p(toxic) of the forward message, after each token
        for t in range(most):
            k = active[t]
            p = f1[:k, t]
            hot = toxic[:k, t] * ((1 - p) * enter + p * stay)
            f1[:k, t + 1] = hot / (1 + hot)
        b1 = np.full((n, most), 0.5, np.float32)  # share of the toxic state in the backward message
        for t in range(most - 2, -1, -1):
            k = active[t + 1]
            hot, b = toxic[:k, t + 1], b1[:k, t + 1]
            zero, one = (1 - b) + hot * enter * b, (1 - b) + hot * stay * b
            b1[:k, t] = one / (zero + one)
        f, p = f1[:, 1:], f1[:, :-1]
        post = np.where(valid, f * b1 / (f * b1 + (1 - f) * (1 - b1)), 0)
        from_toxic = p * stay / ((1 - p) * enter + p * stay)
        got = np.concatenate([np.bincount(feat, post[row, col], len(index)), [post.sum(), (post * (1 - from_toxic)).sum(), (post * from_toxic).sum()]])
        g = (want - got) / n - np.concatenate([2e-4 * params[:-3], np.zeros(3)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params + 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    field.weight = {f: float(params[k]) for f, k in index.items() if params[k] > 0.2}
    field.bias, field.enter, field.stay = (float(x) for x in params[-3:])


def _calibrate(field: Field, texts: list[str | None], toxic: np.ndarray, weight: np.ndarray) -> None:
    """Logistic regression of the document labels on the summary of marginals."""
    x = np.concatenate([field.summary(field.tag(texts[k : k + 256])[2]) for k in range(0, len(texts), 256)])
    beta = np.zeros(x.shape[1])
    ridge = np.array([1e-3, 0.05, 0.05]) * weight.sum() / 1000
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        beta = beta + np.linalg.solve(h, x.T @ (weight * (toxic - p)) - ridge * beta)
    field.calibration = beta


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")), F.lit(0)) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, field_docs: int = FIELD_DOCS, field_words: int = FIELD_WORDS) -> Field:
    """Train on a bounded sample of labelled documents outside the held-out fold: ``sample`` documents of
    up to ``sample_chars`` characters, and for the field ``field_docs`` of up to ``field_words`` words."""
    marks = labels.selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic in (0, 1)")
    marks = marks.where(fold_of() != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    both = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").where(F.length("text").between(1, sample_chars)).join(marks, "doc_id")
    count = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for toxic in (0, 1):
        picked = marks.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        some = both.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi")  # ids of at most half the sample
        rows += some.orderBy(F.xxhash64("text"), "text").limit(sample).select("text", "toxic").collect()
    field = Field()
    if not count.get(1) or not any(r["toxic"] for r in rows):
        field.calibration = np.array([-30.0, 0.0, 0.0])
        return field
    rows.sort(key=lambda r: zlib.crc32(r["text"].encode("utf-8", "surrogatepass")))
    share: dict[bytes, bytes] = {}  # equal words are one object
    parsed = [([share.setdefault(w, w) for w in tokens(r["text"])], r["toxic"]) for r in rows]
    lexicon = _lexicon(parsed)
    del parsed[field_docs:], share
    _train_field(field, parsed, lexicon, field_words)
    del parsed
    field.name = f"{zlib.crc32(repr(field.weight).encode()):08x}"
    toxic = np.array([r["toxic"] for r in rows])
    share = np.array([count.get(k, 0) / max(1, (toxic == k).sum()) for k in (0, 1)])
    _calibrate(field, [r["text"] for r in rows], toxic, share[toxic])
    return field


SCORE = "struct<score:double,expected:double,spans:array<struct<start:int,end:int>>>"


def _offsets(text: str, where: np.ndarray) -> list[tuple[int, int]]:
    """Code-point offsets of the tokens numbered ``where``, in order."""
    out, k, wanted = [], 0, iter(where.tolist())
    at = next(wanted, None)
    for m in _WORD.finditer(text):
        if at is None:
            break
        if m[0].encode("utf-8", "surrogatepass").translate(None, _DROP):
            if k == at:
                out.append(m.span())
                at = next(wanted, None)
            k += 1
    return out


def scorer(spark, field: Field) -> Column:
    """Score, expected number of toxic tokens and offending spans as a function of ``text``."""
    sent = spark.sparkContext.broadcast(field)

    @F.pandas_udf(SCORE)
    def score(texts: pd.Series) -> pd.DataFrame:
        model, out = sent.value, []
        for k in range(0, len(texts), 256):
            part = [t if isinstance(t, str) else None for t in texts.iloc[k : k + 256]]
            _, where, marginals = model.tag(part)
            for t, s, at, p in zip(part, model.scores(marginals), where, marginals, strict=True):
                out.append((float(s), float(p.sum()), _offsets(t or "", at[p >= 0.5])))
        return pd.DataFrame(out, columns=["score", "expected", "spans"])

    return score(F.col("text"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, expected, spans) of every document."""
    field = fit(docs, labels)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = base.select("doc_id", (fold_of() == HELD_OUT).alias("held_out"), scorer(docs.sparkSession, field).alias("s"))
    return got.select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"), "s.expected", "s.spans")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted to be toxic."""
    field = fit(docs, labels)
    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.withColumn("__toxicity", scorer(docs.sparkSession, field)).where(F.col("__toxicity.score") < 0.5).drop("__toxicity")
