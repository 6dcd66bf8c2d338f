"""Runs of words against brute force over all periods."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np

from tests.conftest import SF
from tests.llm.test_text_operators import WORD
from tidemark.llm import periodic, queries


def brute(w, least, exponent):
    out = []
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            run = w[s : i + q]
            if i > s and len(run) >= max(least, exponent * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                out.append((s, len(run), q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs(monkeypatch):
    rng = random.Random(1)
    for piece in (2048, 1, 3):
        monkeypatch.setattr(periodic.Ordered, "PIECE", piece)
        for _ in range(700):
            n, k = rng.randrange(60), rng.choice([1, 2, 2, 3])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.5 and n:
                a = rng.randrange(n)
                p = 1 + (n - a) // 3
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            least, exponent = rng.choice([(24, 3), (1, 2), (6, 3), (10, 2)])
            assert periodic.runs(np.array(w, np.int64), least, exponent) == brute(w, least, exponent)


def test_long_stretches():
    began = time.perf_counter()
    w = np.zeros(200_000, np.int64)
    w[100_000] = 1
    assert periodic.runs(w) == [(0, 100_000, 1), (100_001, 99_999, 1)]
    assert time.perf_counter() - began < 30


def contract(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w, 24, 3)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *first, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic(spark, SF).collect()}
    short = [r for r in docs if len(r.text or "") < 3000]
    assert len(got) == len(docs) and len(short) > 100
    assert [got[r.doc_id] for r in short] == [contract(*r) for r in short]
    assert sum(g[1] for g in got.values()) > 10


def test_edges(spark, edge, empty):
    got = sorted(((r.doc_id, r.n_words, len(r.runs)) for r in periodic.periodic_runs(edge).collect()), key=repr)
    assert got == sorted([(1, 9, 0), (1, 9, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (None, 6, 0), (None, 0, 0), (5, 20_000, 1), (6, 1, 0), (7, 15, 0)], key=repr)
    long = periodic.periodic_runs(edge.where("doc_id = 5")).first()
    assert [tuple(r) for r in long.runs] == [(0, 20_000, 5)] and long.collapsed_text == "lorem ipsum dolor sit amet"
    assert periodic.periodic_runs(edge, looped=True).count() == 10 and periodic.periodic_runs(empty).count() == 0
