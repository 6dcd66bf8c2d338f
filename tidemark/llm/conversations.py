"""Conversations repaired by the cheapest edits, with the least audit text among equally cheap ones.

A conversation is sound where the initials of its roles read ``(s?(ua)+)?``.  Rows are kept (0), given the
role user or assistant (2), deleted (3; required for blank rows and for repeats), and empty rows of either
role are inserted (2); a truncated row that isn't deleted adds 1.  The audit is the initials of the edits
in order.

The search runs over rows with four states of the pattern.  Paths are shared prefixes: each node links to
the node before it, to binary-lifting ancestors, and carries a rolling hash of its edits; equally cheap
paths are compared at the end of their longest common prefix, found by hashes and verified by the nodes.
The edits that end with one row (its inserts first) are one letter, so no path is a prefix of another.

Rows are put in order by range, equal rows counted first, so a conversation of any size is spread over
tasks, which cut it into blocks of ``BLOCK`` rows.  A block is solved for every pair of states at its
ends; the blocks of a conversation are joined by the same search, sixteen numbers a block.  Conversations
that lie whole inside one block are finished where they are.  Only the digest of a repaired conversation,
which is sequential by nature, and its audit pass through one task, block by block.

Null roles and texts count as one space.  Rows of a turn are taken by role and text, as far as the first
64 characters tell them apart, then by a digest; repeated rows lie side by side and all but the first are
duplicates.  A role without letters fits nothing.  Null ids are a conversation of their own, null turns
come first, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import text_batches, written

#: Rows and characters of a block.
BLOCK = 4096
CHARS = 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANK = " \t\n\x0b\x0c\r"

# states of the pattern: nothing yet, after s, after u, after ua
EMPTY, SYSTEM, USER, WHOLE = range(4)
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): WHOLE, (WHOLE, "u"): USER}
CLOSE = {EMPTY: "", SYSTEM: "II", USER: "I", WHOLE: ""}
ALL = (EMPTY, SYSTEM, USER, WHOLE)
LEGAL = {"su", "ua", "au"}


def _wanted(state: int) -> str:
    """The initial of a row that may be inserted or given a role in a state."""
    return "a" if state == USER else "u"


def _moves(kind: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of a row: kind 0 must go, others are 1 + 2 * place in "sua?" + truncated."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    initial, more = "sua?"[(kind - 1) // 2], TRUNCATED * ((kind - 1) % 2)
    for start in ALL:
        state = start
        for n in range(3):  # a third insert leads to no other state
            ends = [(state, DELETE, "D")]
            if kind:
                ends.append((NEXT[state, _wanted(state)], REROLE + more, "R"))
                if (state, initial) in NEXT:
                    ends.append((NEXT[state, initial], KEEP + more, "K"))
            for to, cost, edit in ends:
                new = (INSERT * n + cost, "I" * n + edit)
                best[start, to] = min(new, best.get((start, to), new))
            state = NEXT[state, _wanted(state)]
    return [(a, b, cost, edits) for (a, b), (cost, edits) in best.items()]


LETTERS = sorted({m[3] for kind in range(9) for m in _moves(kind)})
MOVES = [[(a, b, cost, LETTERS.index(edits)) for a, b, cost, edits in _moves(kind)] for kind in range(9)]


class Paths:
    """Paths as linked nodes, all of one step equally deep; node 0 is the empty path."""

    PRIME = (1 << 61) - 1
    BASE = 0x1F3D5B79A7C9E1

    def __init__(self):
        self.letter, self.hash, self.up, self.made_from = [-1], [0], [[]], [-1]

    def extend(self, node: int, letter: int, state: int) -> int:
        """A path one letter longer, which came from ``state``."""
        up, k, at = [node], 0, node
        while k < len(self.up[at]):
            at = self.up[at][k]
            up.append(at)
            k += 1
        self.letter.append(letter)
        self.hash.append((self.hash[node] * self.BASE + letter + 1) % self.PRIME)
        self.up.append(up)
        self.made_from.append(state)
        return len(self.letter) - 1

    def compare(self, a: int, b: int) -> int:
        """-1, 0 or 1 as the letters of ``a`` come before, equal or follow those of ``b``; equally deep."""
        if a == b:
            return 0
        x, y = a, b
        if self.hash[x] != self.hash[y]:
            for k in range(len(self.up[x]) - 1, -1, -1):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            p, q = self.up[x][0], self.up[y][0]
        else:
            p, q = x, y
        sign = (self.letter[x] > self.letter[y]) - (self.letter[x] < self.letter[y])
        while p != q:  # equal hashes of different nodes: verified letter by letter
            if self.letter[p] != self.letter[q]:
                sign = 1 if self.letter[p] > self.letter[q] else -1
            p, q = self.up[p][0], self.up[q][0]
        return sign

    def walk(self, node: int) -> list[tuple[int, int]]:
        """(letter, state before it) along a path."""
        out = []
        while node:
            out.append((self.letter[node], self.made_from[node]))
            node = self.up[node][0]
        return out[::-1]


Front = dict[int, tuple[int, int]]  # state -> cost, node


def advance(paths: Paths, front: Front, moves: list[tuple[int, int, int, int]]) -> Front:
    """The best path into every state after one more letter."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for a, b, cost, letter in moves:
        if a not in front:
            continue
        so_far, node = front[a]
        new = (so_far + cost, node, letter, a)
        old = best.get(b)
        if old is None or new[0] < old[0]:
            best[b] = new
        elif new[0] == old[0]:
            sign = paths.compare(node, old[1])
            if sign < 0 or (sign == 0 and letter < old[2]):
                best[b] = new
    return {b: (cost, paths.extend(node, letter, a)) for b, (cost, node, letter, a) in best.items()}


def close(paths: Paths, front: Front) -> tuple[int, int, int]:
    """(cost, node, state) of the best whole path."""
    best = None
    for state, (cost, node) in front.items():
        new = (cost + INSERT * len(CLOSE[state]), node, state)
        if best is None or new[0] < best[0] or (new[0] == best[0] and paths.compare(node, best[1]) < 0):
            best = new
    return best


def solve(kinds: list[int], start: int) -> tuple[Paths, Front]:
    paths, front = Paths(), {start: (0, 0)}
    for kind in kinds:
        front = advance(paths, front, MOVES[kind])
    return paths, front


def edited(roles: list[str], texts: list[str], edits: str, state: int) -> list[str]:
    """The lines ``role:text`` that edits leave of rows, from a state of the pattern on."""
    out, at = [], 0
    name = {"u": "user", "a": "assistant"}
    for e in edits:
        if e == "I":
            out.append(f"{name[_wanted(state)]}:")
            state = NEXT[state, _wanted(state)]
            continue
        if e == "R":
            out.append(f"{name[_wanted(state)]}:{texts[at]}")
            state = NEXT[state, _wanted(state)]
        elif e == "K":
            out.append(f"{roles[at]}:{texts[at]}")
            state = NEXT[state, roles[at][:1]]
        at += 1
    return out


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by the checksum of ``conv_id:turn``, in ``copies``: 0 where one is dropped."""
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(at("conv_id"), F.lit(":"), at("turn"))) % 20
    text = F.when(d == 1, "").when(d == 2, F.translate(at("text"), ".!?", "")).otherwise(at("text"))
    role = F.when(d == 4, "user").otherwise(at("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("copies"))


STATS = ["blank", "duplicate", "truncated", "illegal"]
PIECE = (
    "conv_id long, block long, rows long, low long, high long, turns long, first string, last string, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, sha256 string, costs array<long>, ranks array<int>, edits array<string>, roles array<string>, texts array<string>"
)


class _Block:
    """Rows of one conversation, of one task, up to a bound."""

    def __init__(self):
        self.roles, self.texts, self.kinds, self.chars = [], [], [], 0
        self.low = self.high = None
        self.turns = 0
        self.first = self.last = None
        self.counts = dict.fromkeys(STATS, 0)

    def add(self, turn: int | None, role: str, text: str, kind: int, fault: int) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if fault:
            self.counts[STATS[fault - 1]] += 1
        if self.last is not None and self.last + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.last = role[:1]
        self.first = self.last if self.first is None else self.first
        self.roles.append(role)
        self.texts.append(text)
        self.kinds.append(kind)
        self.chars += len(text)

    def row(self, conv: int | None, block: int | None) -> dict:
        own = {"conv_id": conv, "block": block, "rows": len(self.kinds), "low": self.low, "high": self.high, "turns": self.turns, "first": self.first, "last": self.last}
        return own | self.counts

    def whole(self, conv: int | None) -> dict:
        """The finished row of a conversation that lies in this block."""
        paths, front = solve(self.kinds, EMPTY)
        cost, node, state = close(paths, front)
        audit = "".join(LETTERS[k] for k, _ in paths.walk(node)) + CLOSE[state]
        lines = edited(self.roles, self.texts, audit, EMPTY)
        return self.row(conv, None) | {"cost": cost, "audit": audit, "sha256": _sha256("\n".join(lines))}

    def part(self, conv: int | None, block: int) -> dict:
        """The block solved for every pair of states at its ends."""
        costs, edits = [None] * 16, [None] * 16
        for a in ALL:
            paths, front = solve(self.kinds, a)
            for b, (cost, node) in front.items():
                costs[4 * a + b] = cost
                edits[4 * a + b] = "".join(LETTERS[k] for k, _ in paths.walk(node))
        order = {e: k for k, e in enumerate(sorted({e for e in edits if e is not None}))}
        ranks = [None if e is None else order[e] for e in edits]
        return self.row(conv, block) | {"costs": costs, "ranks": ranks, "edits": edits, "roles": self.roles, "texts": self.texts}


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: [r.get(f.name) for r in rows] for f in schema}, schema)


_LONG = ("conv_id", "block", "rows", "low", "high", "turns", *STATS, "cost")
_LISTS = {"costs": pa.int64(), "ranks": pa.int32(), "edits": pa.string(), "roles": pa.string(), "texts": pa.string()}
_ORDER = [c.split()[0] for c in PIECE.split(", ")]
_ARROW = pa.schema([(c, pa.int64() if c in _LONG else pa.list_(_LISTS[c]) if c in _LISTS else pa.string()) for c in _ORDER])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows of a task to finished conversations and blocks; what touches either end of the task
    may go on in another one, so it stays a block."""
    top = TaskContext.get().partitionId() << 40
    out: list[dict] = []
    held, made, conv, begun, edge = _Block(), 0, None, False, True

    def block() -> None:
        nonlocal held, made
        out.append(held.part(conv, top + made))
        held, made = _Block(), made + 1

    split = False  # whether blocks of this conversation have been put out
    for batch in batches:
        for c, turn, role, text, n, kind, fault in zip(*[batch.column(k).to_pylist() for k in range(7)], strict=True):
            if not begun or c != conv:
                if begun:
                    if edge or split:
                        block()
                    else:
                        out.append(held.whole(conv))
                        held = _Block()
                    edge = False
                conv, begun, split = c, True, False
            for k in range(n):
                held.add(turn, role, text, kind if k == 0 else 0, fault if k == 0 else 1 if fault == 1 else 2)
                if len(held.kinds) >= BLOCK or held.chars >= CHARS:
                    block()
                    split = True
                    if len(out) >= 8:
                        yield _arrow(out, _ARROW)
                        out.clear()
        yield _arrow(out, _ARROW)
        out.clear()
    if begun:
        block()
        yield _arrow(out, _ARROW)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each conversation, in order, to the states at their ends on the best path."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True)

    names = ["block", "start", "stop", "cost", "end"]
    for _, group in groupby(rows(), key=lambda r: r[0]):
        paths, front, blocks = Paths(), {EMPTY: (0, 0)}, []
        for _, block, costs, ranks in group:
            moves = [(a, b, costs[4 * a + b], ranks[4 * a + b]) for a in ALL for b in ALL if costs[4 * a + b] is not None]
            front = advance(paths, front, moves)
            blocks.append(block)
        cost, node, state = close(paths, front)
        starts = [s for _, s in paths.walk(node)]
        stops = [*starts[1:], state]
        for k in range(0, len(blocks), 10_000):
            part = slice(k, k + 10_000)
            ends = [j + 1 == len(blocks) for j in range(k, min(k + 10_000, len(blocks)))]
            columns = [blocks[part], starts[part], stops[part], [cost if e else 0 for e in ends], ends]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()), strict=True)], names)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen edits of each block, and the lines that they leave."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            audit = (row["edits"][4 * row["start"] + row["stop"]] if row["rows"] else "") + (CLOSE[row["stop"]] if row["end"] else "")
            lines = edited(row["roles"], row["texts"], audit, row["start"])
            yield _arrow([row | {"audit": audit, "sha256": "\n".join(lines) if lines else None}], _ARROW)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order to one row a conversation; the digest is taken up block by block."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.slice(k, 1).to_pylist()[0]

    for conv, group in groupby(rows(), key=lambda r: r["conv_id"]):
        out = {"conv_id": conv, "low": None, "high": None, "turns": 0, "cost": 0, "rows": 0} | dict.fromkeys(STATS, 0)
        digest, any_line, audit, last = hashlib.sha256(), False, [], None
        for r in group:
            for c in (*STATS, "cost", "rows"):
                out[c] += r[c]
            if r["low"] is not None:
                out["turns"] += r["turns"] - (r["low"] == out["high"])
                out["low"], out["high"] = r["low"] if out["low"] is None else out["low"], r["high"]
            if r["first"] is not None:
                out["illegal"] += last is not None and last + r["first"] not in LEGAL
                last = r["last"]
            audit.append(r["audit"])
            if r["sha256"] is not None:
                digest.update((("\n" if any_line else "") + r["sha256"]).encode("utf-8", "surrogatepass"))
                any_line = True
        yield _arrow([out | {"audit": "".join(audit), "sha256": digest.hexdigest()}], _ARROW)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each
    conversation of ``rows`` (conv_id, turn, role, text; optionally ``copies``, 0 for a row that is gone
    but whose conversation counts)."""
    text_batches(rows.sparkSession)
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    gone = copies == 0
    told = lambda c: F.when(~gone, F.coalesce(F.col(c).cast("string"), F.lit(" "))).alias(c)
    r = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.when(~gone, F.col("turn").cast("long")).alias("turn"), told("role"), told("text"), copies.cast("long").alias("n"))
    r = r.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    name = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role"), F.col("role"), F.col("text")), 256)
    bare = F.rtrim("text", F.lit(BLANK))
    place = F.coalesce(F.col("turn").cast("decimal(20,0)"), F.lit("-10000000000000000000").cast("decimal(20,0)"))
    r = written(r.select("*", F.unhex(name).alias("name"), place.alias("place"), (bare == "").alias("empty"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended")))
    again = r.where("n > 0 and not empty").groupBy("name").agg(F.min("place").alias("at"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    r = r.join(again, "name", "left")
    late = F.coalesce(F.col("place") > F.col("at"), F.lit(False))
    fault = F.when(F.col("empty"), 1).when(late, 2).when(~F.col("ended"), 3).otherwise(0)
    initial = F.left("role", F.lit(1))
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    r = r.withColumn("fault", fault).withColumn("kind", F.when(F.col("fault").isin(1, 2), 0).otherwise(1 + 2 * letter + (F.col("fault") == 3).cast("int")))
    order = ["conv_id", "place", F.left("role", F.lit(64)), F.left("text", F.lit(64)), "name"]
    ordered = r.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = written(ordered.select("conv_id", "turn", "role", "text", "n", "kind", "fault").mapInArrow(_cut, PIECE))

    blocks = pieces.where("block is not null")
    chosen = blocks.where("rows > 0").select("conv_id", "block", "costs", "ranks").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    chosen = chosen.mapInArrow(_join, "block long, start int, stop int, cost long, end boolean")
    placed = blocks.drop("cost").join(chosen, "block", "left").fillna({"start": EMPTY, "stop": EMPTY, "cost": 0, "end": False})
    rendered = placed.select(*_ORDER, "start", "stop", "end").mapInArrow(_render, PIECE)
    long = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_finish, PIECE)
    done = pieces.where("block is null").unionAll(long)
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    return done.select("conv_id", gaps.cast("long").alias("gaps"), *STATS, "cost", "audit", F.col("sha256").alias("repaired_sha256"))
