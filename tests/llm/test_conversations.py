"""Repaired conversations against a search over all edits, and long ones against the row-by-row search."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from tidemark.llm import conversations as C

WORDY = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"


def hurt(rows):
    """Rows after damage, by a plain reading of the rules; conversations left without rows stay as keys."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        out[conv]
        if d:
            row = (turn, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
            out[conv] += [row, row] if d == 3 else [row]
    return out


def expected(rows):
    """The contract's columns of one conversation: cheapest first over (rows done, output so far as a
    pattern state), whole audits compared as text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [r[0] for r in rows if r[0] is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        found = WORDY.findall(text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "")], {}  # cost, audit, rows done, pattern state
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    while heap:
        cost, audit, k, state = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done[k, state] = (cost, audit)
        for x in "ua":
            if (state, x) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", k, step[state, x]))
        if k < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, state))
            if faults[k] not in ("blank", "duplicate"):
                more = faults[k] == "truncated"
                for x, c, e in [(rows[k][1][:1], 0, "K"), ("u", 2, "R"), ("a", 2, "R")]:
                    if (state, x) in step:
                        heapq.heappush(heap, (cost + c + more, audit + e, k + 1, step[state, x]))
    cost, audit = min(done[len(rows), s] for s in ("", "a") if (len(rows), s) in done)
    lines, state, k = [], "", 0
    for e in audit:
        want = "a" if state == "u" else "u"
        if e == "D":
            k += 1
            continue
        role, text = ({"a": "assistant", "u": "user"}[want], "" if e == "I" else rows[k][2]) if e in "IR" else rows[k][1:]
        lines.append(f"{role}:{text}")
        state = step[state, role[:1]]
        k += e != "I"
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *n, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def sample(seed, convs=250, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c if c else None, rng.choice([t, t, t, 3, None]), role, rng.choice(["a.", "b!", "long text?", "cut off", " ", "", None, "déjà vu.", "x. \n"])))
    return rows


def compared(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as copy", "'clash' as fault", "'clash' as block").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in C.repair(C.damage(df)).collect()}
    want = {c: expected(r) for c, r in hurt(rows).items()}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c


def test_whole_conversations(spark):
    compared(spark, sample(1))


def test_blocks(monkeypatch):
    """Conversations far longer than a block are joined as if whole."""
    rows = sample(2, 6, 150)
    for rows_a_block in (1, 3, 7):
        monkeypatch.setattr(C, "BLOCK", rows_a_block)
        pieces, whole = pieced(C, rows)
        assert pieces == whole


def pieced(m, rows):
    """The outcome of each conversation through blocks of any size, and through one search."""
    pieces, whole = [], []
    for found in hurt(rows).values():
        found = sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        block, one, parts, seen = m._Block(), m._Block(), [], set()
        for turn, role, text in found:
            bare = text.strip(m.BLANK)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            kind = 0 if fault in (1, 2) else 1 + 2 * "sua?".find(role[:1] if role[:1] in ("s", "u", "a") else "?") + (fault == 3)
            for b in (block, one):
                b.add(turn, role, text, kind, fault)
            if len(block.kinds) >= m.BLOCK:
                parts.append(block.part(1, len(parts)))
                block = m._Block()
        parts.append(block.part(1, len(parts)))
        full = [p for p in parts if p["rows"]]
        joined = list(m._join(iter([m._arrow(full, m._ARROW).select(["conv_id", "block", "costs", "ranks"])]))) if full else []
        ends = {r["block"]: r for b in joined for r in b.to_pylist()}
        rest = {"start": 0, "stop": 0, "cost": 0, "end": False}
        placed = m.pa.RecordBatch.from_pylist([p | ends.get(p["block"], rest) for p in parts])
        (out,) = [r for b in m._finish(m._render(iter([placed]))) for r in b.to_pylist()]
        keys = ("low", "high", "turns", "rows", *m.STATS, "cost", "audit", "sha256")
        pieces.append([out[k] for k in keys])
        whole.append([one.whole(1)[k] for k in keys])
    return pieces, whole


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds nearly all rows, most of them copies, goes through blocks of all tasks."""
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"text {rng.randrange(4000)}.") for t in range(6000)]
    rows += [(7, None, None, None)] * 3000 + [(8, 1, "user", "hi."), (8, 2, "assistant", "yes.")]
    compared(spark, rows)


def test_collisions_are_verified():
    """Paths whose hashes are all alike are still compared by their letters."""
    paths = C.Paths()
    paths.BASE = 0
    a = b = 0
    for x, y in [(1, 1), (2, 3), (4, 4), (5, 5)]:
        a, b = paths.extend(a, x, 0), paths.extend(b, y, 0)
    assert paths.hash[a] == paths.hash[b] and paths.compare(a, b) == -1 and paths.compare(b, a) == 1 and paths.compare(a, a) == 0
    long = [paths.extend(0, 1, 0), paths.extend(0, 1, 0)]
    assert paths.compare(*long) == 0


def test_empty(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0
