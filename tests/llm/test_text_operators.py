"""Operators on texts against brute force, and their edge cases."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.conftest import ROWS
from tidemark.llm import components, decontaminate, exchange, language_model, lines, packing, pii, quality, simhash, substring, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# word hashes


def test_hashes_do_not_depend_on_place():
    w = [b"a", b"bb", b"a", b"", b"ccc" * 700_000, b"bb", b"ccc" * 700_000]
    h = words.word_hashes(w)
    assert h[0] == h[2] and h[1] == h[5] and h[4] == h[6] and len(set(h.tolist())) == 4
    x = words.word_hashes([b"%d" % (k % 5) for k in range(40)])
    y = words.window_hashes(x, 10)
    assert len(y) == 31 and y[0] == y[5] and y[0] != y[1] and len(words.window_hashes(x[:5], 10)) == 0


# 1 substrings


def removed(rows, size):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    count = Counter(tuple(w[k : k + size]) for _, w in texts for k in range(len(w) - size + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def test_substrings(spark, docs, edge, empty):
    cols = ("doc_id", "n_words", "n_removed", "kept_text")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r[c] for c in cols) for r in substring.dedup_substrings(docs, limit=60_000).collect()), key=repr) == removed(rows, 35)
    got = substring.dedup_substrings(edge, size=3, buckets=16, limit=40)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == removed([r[:2] for r in ROWS], 3)
    assert substring.dedup_substrings(empty).count() == 0


def test_counts_beyond_32_bits():
    x = np.array([0, 1, 2**32 - 1, 2**32, 5_000_000_000, 2**62])
    assert (exchange.unpack_ints(exchange.pack_ints(x), len(x)) == x).all()
    with pytest.raises(OverflowError):
        exchange.pack_ints(np.array([2**63 + 5], np.uint64).view(np.int64))
    rows = [{"bucket": 0, "chunk": c, "n": 1, "keys": exchange.pack_sorted(np.array([7], np.uint64)), "counts": exchange.pack_ints(np.array([3 * 10**9])), "endings": b"\1"} for c in (1, 2)]
    out = next(language_model._count(pa.Table.from_pylist(rows)))
    assert exchange.unpack_ints(out.column("reply")[0].as_py(), 1)[0] == 6 * 10**9 == out.column("top")[2].as_py()[0]["c"]


def test_windows_match_by_a_second_hash_too():
    keys = np.array([5, 5, 5, 9], np.uint64)
    rows = [{"bucket": 0, "chunk": c, "n": 1, "keys": exchange.pack_sorted(keys[c : c + 1]), "more": np.array([m], "<u2").tobytes(), "twice": b""} for c, m in enumerate([1, 2, 1, 1])]
    assert sorted(next(substring._reply(pa.Table.from_pylist(rows))).column("chunk").to_pylist()) == [0, 2]
    w = words.word_hashes([b"%d" % (k % 50) for k in range(120)])
    s = substring._second(w, np.arange(120 - 34), 35)
    assert (s[:36] == s[50:86]).all() and len(set(s[:36].tolist())) > 30


def test_chunks_are_cut_once(docs):
    """What is sent and what is answered are the same chunks, in whatever order the texts come."""
    cut = exchange.chunks(docs.orderBy("text"), 50_000)
    got = [(i, t) for r in cut.collect() for i, t in zip(r.ids, exchange.texts_of(r.lens, r.texts), strict=True)]
    assert sorted(got) == sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    assert cut.select("chunk").distinct().count() == cut.count() > 3
    assert exchange.buckets_for(cut) == 16 and exchange.buckets_for(cut.selectExpr("size * 100000000 size")) > 10_000


# 2 language model


def test_language_model(docs, edge, empty):
    rows = [(i, [*WORD.findall(lower(t)), "\n"]) for i, t in docs.select("doc_id", "text").collect()]
    count = Counter(w for i, ws in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in language_model.score(docs, limit=100_000).collect()}
    for i, ws in rows:
        r = got[i]
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(count[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 5 == 1)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert language_model.score(edge, limit=100).count() == len(ROWS)
    assert language_model.score(empty).count() == 0


def vocabulary(rng, n=9000):
    """A vocabulary of n tokens with Zipf counts, and its (key, count, ending)."""
    keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    count = (50_000 / np.arange(1, len(keys) + 1)).astype(np.int64)
    ending = rng.integers(0, language_model.ENDINGS, len(keys)).astype(np.uint8)
    sums = [{"e": e, "c": int(count[ending == e].sum()), "v": int((ending == e).sum()), "n1": int(((ending == e) & (count == 1)).sum()), "n2": int(((ending == e) & (count == 2)).sum())} for e in range(language_model.ENDINGS)]
    top = [{"h": int(keys[k].view(np.int64)), "c": int(count[k]), "e": int(ending[k])} for k in range(language_model.TOP)]
    return language_model.Vocabulary(sums, top), keys, count, ending


def test_token_probabilities_sum_to_one():
    """Over the whole vocabulary and one unseen token, in several contexts, with random parameters."""
    rng = np.random.default_rng(1)
    v, keys, count, ending = vocabulary(rng)
    m = language_model.Model(v.share, v.cls)
    m.load(m.flat() + rng.normal(0, 0.3, len(m.flat())))
    unit, inside = v.units(np.append(keys, np.uint64(5)), np.append(count, 0), np.append(ending, np.uint8(3)))
    unit = np.minimum(unit, language_model.UNSEEN)
    for two, one in ((language_model.START, language_model.START), (3, 17), (4100, 4000)):
        p = 10.0 ** (m.log10(np.full(len(unit), two), np.full(len(unit), one), unit).astype(np.float64) + inside)
        # units without a token hold a little; they are none of the vocabulary's
        assert np.isclose(p.sum(), 1, atol=1e-3), p.sum()


def test_noise_contrastive_gradient():
    rng = np.random.default_rng(2)
    v, *_ = vocabulary(rng)
    m = language_model.Model(v.share, v.cls)
    m.p = {k: x.astype(np.float64) for k, x in m.p.items()}
    two, one, w = (rng.integers(0, language_model.UNITS, 40) for _ in range(3))
    noise = m.drawn(w, rng)
    g, _ = m.gradient(two, one, w, noise)
    checked = 0
    for name in m.SHAPES:
        for at in [np.unravel_index(np.abs(g[name]).argmax(), g[name].shape), *(np.array(np.nonzero(g[name])).T[:2])]:
            at = tuple(at)
            m.p[name][at] += 1e-4
            up = m.gradient(two, one, w, noise)[1]
            m.p[name][at] -= 2e-4
            assert g[name][at] == pytest.approx((up - m.gradient(two, one, w, noise)[1]) / 2e-4, rel=1e-2, abs=1e-6), name
            m.p[name][at] += 1e-4
            checked += 1
    assert checked == 21
    shares = np.bincount(np.concatenate([m.drawn(w, rng)[0] for _ in range(2000)]), minlength=language_model.CLASSES) / (2000 * language_model.NOISE)
    assert np.abs(shares - m.class_share).max() < 0.01


# 4 decontamination


@pytest.mark.parametrize("size", [17, 18, 19, 20])
def test_masks_miss_nothing(size):
    for gone in itertools.combinations(range(size), decontaminate.allowed(size)):
        assert any(all(m + o not in gone for m in mask) for mask in decontaminate.MASKS for o in range(size - mask[-1]))


def leaks(docs, items):
    out = set()
    for d, t in docs:
        a = decontaminate.tokens(t)
        for i, u in items:
            b = decontaminate.tokens(u)
            size = min(len(b), decontaminate.WINDOW)
            need = size - decontaminate.allowed(size)
            for s in range(-len(b) + 1, len(a)):
                eq = [0 <= s + k < len(a) and a[s + k] == b[k] for k in range(len(b))]
                if b and any(sum(eq[k : k + size]) >= need for k in range(len(b) - size + 1)):
                    out.add((d, i))
                    break
    return out


@pytest.mark.parametrize("size", range(5, 21))
def test_extensions_miss_no_window(size):
    """Whichever words differ, every intact seed of a window has two more intact blocks in it."""
    for gone in map(set, itertools.combinations(range(size), decontaminate.allowed(size))):
        for k, (mask, step) in enumerate(decontaminate._masks_of(size)):
            for place in range(0, size - mask[-1], step):
                if not gone & {place + m for m in mask}:
                    intact = (p for p in decontaminate.extensions(decontaminate.shape_of(size, k, place)) if all(0 <= place + x < size and place + x not in gone for x in p))
                    assert next(intact, None)
    assert all(len(decontaminate.extensions(s)) <= decontaminate.MANY for s in range(3))


def test_stock_phrases_are_not_joined_in_pairs(spark, monkeypatch):
    """A phrase in every document and every item: rows joined follow the hits, which are all found."""
    rng = random.Random(4)
    stock = "which of the following statements is true about the".split()
    own = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    items = [(i, [*own(6), *stock, *own(12)] if i % 10 else [*stock[:5], *own(8)]) for i in range(100)]
    items += [(500, items[1][1]), (None, items[2][1])]  # items of the same words
    docs = []
    for d in range(300):
        w = own(10) + stock + own(10)
        if d % 40 == 1:
            hit = list(items[rng.randrange(100)][1])
            hit[rng.randrange(len(hit))] = "changed"
            w += hit + own(5)
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string").repartition(2)
    seen = []
    inner = decontaminate.alignments

    def counted(*args):
        got = inner(*args)
        seen.append(got.count())
        return got

    monkeypatch.setattr(decontaminate, "alignments", counted)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == leaks(docs, [(i, " ".join(w)) for i, w in items]) and len(got) >= 8
    assert seen[0] < 10_000  # 300 documents and 90 items are 27,000 pairs, each with three seeds


def test_decontamination(spark, edge, empty, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 8, 11, 14, 15, 17, 20, 25, 40])))) for i in range(25)]
    docs = []
    for d in range(100):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        x = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, max(1, len(x) // 4))):
            x[rng.randrange(len(x))] = "zz"
        at = rng.randint(0, len(w))
        w[at:at] = x
        docs.append((d, ", ".join(w)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, ""), (None, "!!")], "item_id long, text string")
    want = leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "PAIRS", 100)  # the same a few alignments at once
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 10)  # and with a filter that is nearly full
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.clean(edge, bench.limit(0)).count() == len(ROWS)
    hit = decontaminate.clean(edge, spark.createDataFrame([(1, "Alpha, beta GAMMA second line here third!")], "item_id long, text string"))
    assert hit.columns == edge.columns and hit.count() == len(ROWS) - 3
    assert decontaminate.clean(empty, bench).count() == 0


def test_alignments_of_long_repeats(spark):
    """Documents and items of one repeated word, or of one repeated line: every place aligns with every
    other.  The best window is the first."""
    began = time.perf_counter()
    line = " ".join(f"w{k}" for k in range(19))
    docs = [(1, "a " * 300_000), (2, (line + " b ") * 15_000), (3, "x " * 500_000 + line + " z"), (4, "y" * 5_000_000)]
    items = [(1, "a " * 60), (2, (line + " b ") * 3), (3, "q " + line), (4, "a")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contaminated(df, bench).collect())
    assert got[:3] == [(1, 1, 0, 0, 20), (1, 4, 0, 0, 1), (2, 2, 0, 0, 20)]
    assert {(d, i) for d, i, *_ in got} == {(1, 1), (1, 4), (2, 2), (2, 3), (3, 2), (3, 3)} and got[-1] == (3, 3, 499_999, 0, 19)
    assert time.perf_counter() - began < 120


def test_ties_go_to_the_first_window():
    words = np.array([7, 1, 2, 3, 9, 1, 2, 3], np.int64)
    item = np.array([1, 2, 3], np.int64)
    assert decontaminate._best(words, item, np.array([1, 5])) == (3, 1, 0)


# 5 packing


def test_hilbert_neighbours_touch():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    key = packing.hilbert(cells, 3)
    assert sorted(key) == list(range(512)) and np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def test_pieces_encode_like_whole_texts(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    whole, own = tokenizers.Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(5)
    texts = ["", "a", " a", "a  b", "a \n b", "x\n\ny z  ", "\t\t a<|endoftext|> b", "it's  we'll   no", "é à b c", " \n", "   ", "nul\0l a"]
    texts += ["".join(rng.choice(["a", "B", "7", " ", "  ", "\n", "'s", "é", "#", "\t", "　"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for limit in (packing.PIECE, 1, 5):
        monkeypatch.setattr(packing, "PIECE", limit)
        ids, first = own.encode(texts)
        for k, t in enumerate(texts):
            assert list(ids[first[k] : first[k + 1]]) == [*whole.encode(t, add_special_tokens=False).ids, packing.END_ID]
    assert own.quick is not None


def test_packing(spark, docs, edge, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    whole = tokenizers.Tokenizer.from_file(path)
    texts = dict(docs.select("doc_id", "text").collect())
    pieces = packing.pack(docs, path).collect()
    for i, t in texts.items():
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == ids and [r.start for r in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(ids)
    at = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048 and sum(v < 2048 for v in at.values()) <= 1
    got = packing.pack(edge, path)
    assert got.where("start = 0").count() == len(ROWS) and packing.pack(empty, path).count() == 0


# 6 near duplicates


def groups(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (int(fps[a]) ^ int(fps[b])).bit_count() <= 3:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def test_crowded_prefixes_are_cut():
    """A crowd within few bits of each other, spelled out whole and in bounded parts."""
    rng = np.random.default_rng(4)
    one = rng.integers(0, 2**63, dtype=np.uint64)
    fps = np.unique(np.array([one ^ np.uint64(sum(1 << int(b) for b in rng.choice(simhash.FREE, rng.integers(0, 6), replace=False))) for _ in range(600)], np.uint64))
    blocks = simhash._blocks(fps, np.zeros(len(fps), np.uint64))
    want = {tuple(e) for e in zip(*simhash.stars(blocks), strict=True)}
    whole, simhash.SPELLED = simhash.SPELLED, 3000
    try:
        parts = list(simhash._leaves(blocks, simhash.FREE))
        got = {tuple(e) for p in parts for e in zip(*simhash.stars(p), strict=True)}
    finally:
        simhash.SPELLED = whole
    assert got == want and len(parts) > 50 and all(sum(len(b) * len(f) for b, _, f in p) <= 3000 for p in parts)


def test_balls_meet(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [base]
    for d in (1, 2, 3, 4):
        for _ in range(4):
            flips = np.array([sum(1 << int(b) for b in rng.choice(64, d, replace=False)) for _ in range(40)], np.uint64)
            fps.append(base ^ flips)
    fps = np.unique(np.concatenate(fps))
    want = groups(fps)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    found = {r.node: r.component for r in components.components(simhash.links(df)).collect()}
    got = [found.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len({*zip(want, got, strict=True)}) == len(set(want)) == len(set(got))


def simhash_of(t):
    w = WORD.findall(lower(t))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(docs, edge, empty):
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [simhash_of(r.text) for r in rows]
    want = groups(fps)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    for r, f, g in zip(rows, fps, want, strict=True):
        assert got[r.doc_id].fp & (2**64 - 1) == f and got[r.doc_id].component_id == rows[g].doc_id
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({rows[g].doc_id for g in want})
    some = simhash.near_duplicates(edge).collect()
    assert len(some) == len(ROWS) and {r.component_id for r in some if r.doc_id in (2, 3, 4)} == {2}
    one = simhash.one_of_each(edge)
    assert one.columns == edge.columns and sorted((r.doc_id for r in one.collect()), key=repr)[:2] == [1, 2]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7), (2000, 2001), (2001, 2000), (2001, 2000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in range(1000, 1100)} == {1000} and got[2001] == 2000


# 7 personal data


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("mail me: john.doe [at] example [dot] com now", "mail me: <email> now"),
        ("plus one five five five two three four five six seven eight nine ok", "<phone> ok"),
        ("x аdmin@exаmple.com y", "x <email> y"),  # Cyrillic letters
        ("ip 10 dot 2 dot 3 dot 4 x", "ip <ip> x"),
        ("jane at corp dot org.", "<email>."),
        ("card ４１１１１１１１１１１１１１１１ z", "card <card> z"),  # full-width digits
        ("look at that dot", "look at that dot"),
        ("one two three", "one two three"),
        ("a@b 1.2.3.256 x 4111111111111112 +12", "a@b 1.2.3.256 x 4111111111111112 +12"),
    ],
)
def test_disguises(text, masked):
    assert pii.mask(text, pii.all_spans(text)) == masked


def base_spans(t):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(d if k % 2 == 0 else 2 * d - 9 * (2 * d > 9) for k, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_long_texts_take_time_in_proportion():
    """Runs of one character or word, where a pattern that begins anew at each would take hours."""
    began = time.perf_counter()
    for c in [*"a1%.+- @([é\uff11", "a@", "a@a.", "one ", "1 dot ", "a at ", "a dot ", "+1", "1-", "1.", "plus ", "\u0430", "(at) a", "x [dot] "]:
        text = (c * 500_000)[:500_000] if len(c) == 1 else c * (500_000 // len(c))
        pii.all_spans(text)
        pii.all_spans("a [at] b " + text)
    assert time.perf_counter() - began < 120


def test_rewriting_keeps_offsets():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        r, plain = pii.Rewritten(text), [(c, k, k + 1, False) for k, c in enumerate(text)]
        for _ in range(2):
            edits, at = [], 0
            while at < len(r.text):
                a = rng.randint(at, len(r.text) - 1)
                b = rng.randint(a + 1, min(len(r.text), a + 3))
                edits.append((a, b, rng.choice(["", "X", "YZ"])))
                at = b
            new, at = [], 0
            for a, b, x in edits:
                new += plain[at:a]
                if x:
                    new += [(c, plain[a][1], plain[b - 1][2], True) for c in x]
                elif new:
                    new[-1] = (*new[-1][:3], True)
                at = b
            plain = new + plain[at:]
            r.replace(edits)
            assert list(zip(r.text, r.start.tolist(), r.end.tolist(), r.changed.tolist(), strict=True)) == plain


def test_recall_of_disguises():
    """Addresses and numbers written in random disguises are found where they stand, in part at least."""
    rng = random.Random(12)
    spelled = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    found = 0
    for _ in range(400):
        word = lambda: "".join(rng.choice("bdfgklmnortz") for _ in range(rng.randint(3, 7)))
        at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("@", "[.]"), (" {AT} ", ".")])
        thing = rng.choice([
            f"{word()}{at}{word()}{dot}com",
            f"{word()}@{word()}.com".replace("o", "о"),
            rng.choice(["plus ", "+"]) + rng.choice([" ", "-"]).join(spelled[rng.randrange(10)] for _ in range(11)),
            " dot ".join(str(rng.randrange(256)) for _ in range(4)),
        ])
        head = " ".join(word() for _ in range(rng.randint(1, 5))) + ": "
        spans = pii.all_spans(head + thing + " " + word())
        found += any(a < len(head + thing) and b > len(head) for _, a, b in spans)
    assert found >= 0.9 * 400, found


def test_pii(docs, edge, empty):
    rng = random.Random(11)
    parts = ["a", "@", ".", "b.c", "1", "255", "256", "4111111111111111", " ", "-", "+", "(", ")", "00", "%", "x@y.z", "1.2.3.4"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(t) == base_spans(t), t
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for i, t in docs.select("doc_id", "text").collect():
        assert got[i].base_spans == pii.render(base_spans(t or ""))
    some = pii.find_pii(edge).collect()
    assert len(some) == len(ROWS) and sum(r.n_email for r in some) == 1 and pii.find_pii(empty).count() == 0


# 8 lines


def later_copies(rows, size, min_words=lines.MIN_WORDS):
    """Texts without what an earlier place has too: every run of ``size`` lines, and every shorter one
    of ``min_words`` words."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        ls = (t or "").split("\n")
        sequence = [k for k, x in enumerate(ls) if x.strip(" \t\x0b\f\r")]
        dead = set()
        for a in range(len(sequence)):
            for n in range(1, size + 1):
                w = tuple(ls[k] for k in sequence[a : a + n])
                if len(w) == n and (n == size or sum(len(WORD.findall(x)) for x in w) >= min_words):
                    dead |= set(sequence[a : a + n]) if w in seen else set()
                    seen.add(w)
        out[(i, t)] = None if t is None else "\n".join(x for k, x in enumerate(ls) if k not in dead)
    return out


@pytest.mark.parametrize(("size", "words"), [(1, 50), (2, 50), (3, 4), (5, 7)])
def test_lines(spark, size, words):
    rng = random.Random(size)
    rows = [(i, "\n".join(rng.choice(["a b", "c", "d", "", " ", "e f g"]) for _ in range(rng.randint(0, 14)))) for i in range(50)] + [(100, None), (101, ""), (None, "a b\nc\nd")]
    got = {r.doc_id: r.kept_text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size, min(words, 50)).collect()}
    # the operator passes over runs of fewer characters than that many words need
    assert got == {i: t for (i, _), t in later_copies(rows, size, words).items()}


def test_suffix_array_is_whole(spark):
    """At every depth: the suffixes whose prefix repeats, in order, with the first copy of each."""
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))) for i in range(12)]
    rows += [(50, rows[3][1]), (51, "\n".join("a" * 40))]
    text = {i: t.split("\n") for i, t in rows}
    levels = lines.suffix_array(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert [d for d, _ in levels][:4] == [1, 2, 3, 6]
    for depth, level in levels:
        every = {}
        for i, ls in sorted(text.items()):
            for p in range(len(ls) - depth + 1):
                every.setdefault(tuple(ls[p : p + depth]), []).append((i, p))
        want = {(i, p): places[0] for places in every.values() if len(places) > 1 for i, p in places}
        got = level.collect()
        assert {(r["__id"], r["__pos"]): (r["__first"].i, r["__first"].p) for r in got} == want
        rank = {}
        for r in got:
            rank.setdefault(r["__r"], set()).add(tuple(text[r["__id"]][r["__pos"] : r["__pos"] + depth]))
        assert all(len(v) == 1 for v in rank.values())
    longest = max(d for d in range(1, 41) if len({tuple(ls[p : p + d]) for ls in text.values() for p in range(len(ls) - d + 1)}) < sum(max(0, len(ls) - d + 1) for ls in text.values()))
    assert levels[-1][0] <= longest < 2 * levels[-1][0]


def maximal_runs(rows, size):
    """(runs, lines of the longest, id of its first copy) of each text: a run goes on while the first copy
    of ``size`` lines moves on with it, and is as long as it and its first copy agree."""
    texts = {i: [x for x in (t or "").split("\n") if x.strip()] for i, t in rows}
    first = {}
    for i, ls in sorted(texts.items()):
        for p in range(len(ls) - size + 1):
            first.setdefault(tuple(ls[p : p + size]), (i, p))
    out = {}
    for i, ls in texts.items():
        runs, last = [], None
        for p in range(len(ls) - size + 1):
            d, f = first[tuple(ls[p : p + size])]
            if (d, f) == (i, p):
                last = None
                continue
            if last != (d, f - 1):
                n = next((k for k in range(len(ls) - p) if f + k >= len(texts[d]) or texts[d][f + k] != ls[p + k]), len(ls) - p)
                runs.append((n, -p, d))
            last = (d, f)
        best = max(runs, default=(0, 0, None))
        out[i] = (len(runs), best[0], best[2])
    return out


@pytest.mark.parametrize("size", [1, 3, 4])
def test_lengths_of_maximal_runs(spark, size):
    """Every length is that of the whole run, which no prefix of ``size`` lines tells."""
    rng = random.Random(size)
    whole = [rng.choice("abcdefgh") + str(k % 17) for k in range(300)]
    rows = [(i, "\n".join(rng.choice("ab") for _ in range(rng.randint(0, 20)))) for i in range(20)]
    for i, n in enumerate([1, 2, 5, 6, 7, 11, 12, 13, 25, 47, 48, 49, 100, 300], 30):
        at = rng.randint(0, 300 - n)
        rows.append((i, "\n".join([f"own {i}", *whole[at : at + n], f"end {i}", *whole[:n]])))
    got = {r.doc_id: (r.n_runs, r.longest_copy, r.copied_from) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size).collect()}
    want = maximal_runs(rows, size)
    assert got == want and max(n for _, n, _ in want.values()) >= 48


def test_lines_of_documents(docs, edge, empty):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: r.kept_text for r in lines.dedup_lines(docs).collect()} == {i: t for (i, _), t in later_copies(rows, lines.MIN_LINES).items()}
    kept = lines.clean(edge)
    assert kept.columns == edge.columns
    # document 7 repeats three of its four lines; the repeated row counts as one document with its twin
    assert sorted(r.text or "" for r in kept.where("doc_id in (1, 7)").collect()) == sorted([ROWS[0][1], ROWS[0][1], "and more words that are new"])
    assert kept.count() == len(ROWS) and lines.clean(empty).count() == 0


def test_lines_oracle(spark):
    import duckdb

    from tests.conftest import SF
    from tidemark.llm.queries import OP8_SQL, op8_lines

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(OP8_SQL)
    plain = lambda r: [round(x, 9) if isinstance(x, float) else x for x in r]
    got = op8_lines(spark, SF).select(*want.columns).collect()
    assert sorted(repr(plain(r)) for r in got) == sorted(repr(plain([float(x) if k == 4 else x for k, x in enumerate(r)])) for r in want.fetchall())


# 9 toxicity


def test_marginals_by_enumeration():
    f = toxicity.Field()
    f.bias, f.enter, f.stay = -1.2, -0.7, 0.9
    rng = np.random.default_rng(0)
    docs = []
    for _ in range(20):
        e = np.where(rng.random(n := int(rng.integers(1, 9))) < 0.5, rng.normal(0, 2, n), 0.0)
        total, m = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            s = sum(e[t] + f.bias + (f.stay if t and y[t - 1] else f.enter) for t in range(n) if y[t])
            total += np.exp(s)
            m += np.exp(s) * np.array(y)
        docs.append((e, m / total))
    at = [np.flatnonzero(e) for e, _ in docs]
    for p, k, (_, m) in zip(f.marginals([e[k] for k, (e, _) in zip(at, docs, strict=True)], at, [len(e) for e, _ in docs]), at, docs, strict=True):
        assert np.allclose(p, m[k])


def test_marginals_alone_and_together(monkeypatch):
    """A document by itself, in blocks, has the marginals that it has beside others."""
    f = toxicity.Field()
    f.bias, f.enter, f.stay = -2.0, -1.0, 1.5
    rng = np.random.default_rng(1)
    docs = [rng.normal(0, 3, n) for n in (1, 2, 3, 50, 400, 1000)]
    at = [np.cumsum(rng.integers(1, 40, len(d))) - 1 for d in docs]
    lengths = [int(a[-1]) + 1 + k for k, a in enumerate(at)]
    want = f.marginals(docs, at, lengths)
    for cells, long in ((1, 4096), (1 << 18, 0)):
        monkeypatch.setattr(toxicity, "CELLS", cells)
        monkeypatch.setattr(toxicity, "LONG", long)
        assert all(np.allclose(p, q) for p, q in zip(f.marginals(docs, at, lengths), want, strict=True))


def test_a_long_toxic_text():
    """Three megabytes of toxic words beside short texts take seconds and 350 MB: in proportion, ten take a
    gigabyte."""
    import tracemalloc

    f = toxicity.Field()
    f.weight, f.name = {"vile": 9.0}, "test"
    began = time.perf_counter()
    tracemalloc.start()
    words, where, p = f.tag(["vile thing " * 300_000, *["a vile day"] * 255])
    spans = toxicity._offsets("vile thing " * 300_000, where[0][p[0] >= 0.5])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(p[0]) == len(spans) == 300_000 and np.allclose(p[1], p[255]) and most < 350 << 20 and time.perf_counter() - began < 60


def test_toxicity(spark, edge, empty):
    rng = random.Random(2)
    plain = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(60)]
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            w[rng.randrange(60)] = rng.choice(["vile", "nasty", "scoundrel"]) + rng.choice(["", ".", "!"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (9999, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(df, marks).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and len(held) > 60 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    texts = dict(rows)
    hits = [texts[r.doc_id][s.start : s.end].strip(".!") for r in got for s in r.spans]
    assert hits and sum(h in ("vile", "nasty", "scoundrel") for h in hits) >= 0.97 * len(hits)
    some = toxicity.scored(edge, marks.unionByName(spark.createDataFrame([(1, 1, 0), (5, 1, 1)], marks.schema)))
    assert some.count() == len(ROWS) and all(0 <= r.score <= 1 for r in some.collect())
    kept = toxicity.clean(edge, marks.limit(0))
    assert kept.columns == edge.columns and kept.count() == len(ROWS)
    assert toxicity.scored(empty, marks).count() == 0


# 10 quality


def test_quality(spark, docs, edge, empty):
    def counts(t):
        w = WORD.findall(t or "")
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = Counter(tri)
        covered = {k + o for k, x in enumerate(tri) if c[x] > 1 for o in range(3)}
        full = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(full) - len(set(full)), len(covered)

    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in docs.select("doc_id", "text").collect():
        n = counts(t)
        assert tuple(got[i][c] for c in cols) == n
        assert got[i].base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (got[i].kept and got[i].base_failed)
    some = quality.judge(edge)
    assert sorted(tuple(r[c] for c in cols) for r in some.collect()) == sorted(counts(r[1]) for r in ROWS)
    assert quality.judge(empty).count() == 0


def test_outliers_are_rejected(spark):
    rng = random.Random(4)
    text = lambda k, junk: " ".join(("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) + ("##$%" if junk else "")) for _ in range(60 + k % 90))
    rows = [(k, text(k, k % 10 == 0), "en", f"s{k % 3}", 0) for k in range(400)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert all(r.kept == (r.doc_id % 10 != 0) for r in got)


def robust_distances(vectors, groups, min_group=40):
    """The minimum-covariance-determinant search in numpy: squared distances of all vectors."""
    floor = np.array(list(quality.FLOOR.values())) ** 2

    def moments(x, scale):
        return x.mean(axis=0), np.cov(x.T, bias=True) / scale + np.diag(floor)

    def distance(x, fit):
        y = np.linalg.solve(np.linalg.cholesky(fit[1]), (x - fit[0]).T)
        return (y * y).sum(axis=0)

    def median(v):
        return np.sort(v, axis=0)[math.ceil(len(v) / 2) - 1]

    def drawn(x, start):
        h = 42
        for raw in [np.array(start, "<i4").tobytes(), *[np.array(v, "<f8").tobytes() for v in x]]:
            h = xxhash.xxh64_intdigest(raw, h)
        return (h if h < 1 << 63 else h - (1 << 64)) % max(1, n // quality.SUBSET) == 0

    def search(x):
        middle = median(x)
        starts = [(middle, np.diag((median(np.abs(x - middle)) * 1.4826) ** 2 + floor))]
        for k in range(1, quality.SUBSETS + 1):
            some = x[[drawn(v, k) for v in x]]
            if len(some):
                starts.append(moments(some, 1.0))
        def improved(det, fit, steps):
            for _ in range(steps):
                d = distance(x, fit)
                new = moments(x[d <= median(d)], quality.HALF_SCALE)
                now = np.linalg.slogdet(new[1])[1]
                if now >= det - 1e-9:
                    break
                fit, det = new, now
            return det, fit

        some = sorted((improved(np.inf, fit, quality.FIRST) for fit in starts), key=lambda b: b[0])
        return min((improved(*b, 1000) for b in some[: quality.BEST]), key=lambda b: b[0])[1]

    n = len(vectors)
    whole = search(vectors)
    out = distance(vectors, whole)
    for g in set(groups) - {None}:
        at = np.array([x == g for x in groups])
        if at.sum() >= min_group:
            n = int(at.sum())
            out[at] = distance(vectors[at], search(vectors[at]))
    return out


def test_verdicts_by_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for k in range(360):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("de", None), ("fr", "c")]) if k % 9 else ("it", "few")
        size = {"a": 6, "b": 3}.get(source, 9)
        words = ["".join(rng.choice("abcdefgh") for _ in range(max(1, int(rng.gauss(size, 2))))) for _ in range(rng.randint(50, 200))]
        for _ in range(rng.choice([0, 0, 1, 5, 60 if k % 20 == 0 else 2])):
            words[rng.randrange(len(words))] += "#"
        if k % 15 == 0:
            words += words[:20]
        rows.append((k, " ".join(words), lang, source))
    got = sorted(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect())
    n = np.array([r.n_words for r in got], float)
    x = np.stack([np.log(n), [r.word_chars for r in got] / n, np.sqrt([r.n_symbols for r in got] / n), np.sqrt([r.n_repeat_words for r in got] / n)], axis=1)
    want = robust_distances(x, [None if r.source is None else (r.lang, r.source) for r in got])
    assert not any(r.base_failed for r in got)
    assert np.allclose([r.distance2 for r in got], want, rtol=1e-6)
    assert [r.kept for r in got] == (want <= quality.CUTOFF).tolist() and 5 < sum(not r.kept for r in got) < 120


def test_main_paths_of_native_operators_have_no_python(spark, docs):
    from tidemark.llm import url_filter

    pages = spark.createDataFrame([(1, "http://a.b/c", 3)], "page_id long, url string, fetched int")
    entries = spark.createDataFrame([("a.b", "block", 1)], "pattern string, action string, listed int")
    for df in (quality.judge(docs), url_filter.judge(pages, entries)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
