"""Personal data: exact detectors plus offset-preserving deobfuscation.

A text is searched twice.  The base detectors run on the text as it is.  Then small transducers
rewrite disguises -- look-alike letters, spelled-out digits, ``[at]`` and ``(dot)`` -- into plain
ASCII while keeping, for every character written, the source characters it stands for.  The same
detectors run on the rewritten text, and what they find beyond the base spans is mapped back to
code-point offsets of the source.

Null or empty texts have no spans.  Rows are independent: repeated rows and null ids pass
through, other columns, whatever their names, are dropped; the empty table gives an empty result.
Of spans of one kind that overlap the leftmost counts; spans that begin together are listed in the
order of ``KINDS``.  There is no shuffle.  Every pattern begins at most once in a run of characters it
can eat, so time grows with a text's length and not with its square; memory is an Arrow batch and
about thirty bytes a character of the text in hand.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches found from each ``@``, so that long runs of letters cost nothing."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the plain detectors: leftmost, non-overlapping per kind, failing ones dropped."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Characters of other scripts that look like ASCII ones, in code-point order.
_LOOKALIKE = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ρ": "p", "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B",
    "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "․": ".",
}
_HIDDEN = "­​‌‍⁠﻿"  # invisible: dropped
#: Besides these: no-break spaces, superscript and circled digits, full-width and mathematical letters.
_ODD = re.compile("[" + "".join(_LOOKALIKE) + _HIDDEN + " ²³¹ -  ⁰-₉①-⑨！-～\U0001d400-\U0001d7ff]")
# Digits spelled in English, German, French and Spanish.
_SPELLED = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_NUMBER = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + "|[0-9]+)"
_RUN = re.compile(rf"(?i)(?<!\w)(?:(?P<plus>plus)[ -]+)?{_NUMBER}(?:[ ,.-]{{1,2}}{_NUMBER}){{3,}}(?!\w)")
_ITEM = re.compile(rf"(?i){_NUMBER}")
_PAUSES = str.maketrans("-,.", "   ")
_AT = re.compile(r"(?i)(?<=[A-Za-z0-9]) ?[\[({<] ?(?:at|@|arobase|arroba) ?[\])}>] ?(?=[A-Za-z0-9])")
_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9]) ?[\[({<] ?(?:dot|\.|punkt|point|punto) ?[\])}>] ?(?=[A-Za-z0-9])")
_SAID = re.compile(r"(?i)(?<![\w.%+-])[A-Za-z0-9._%+-]+(?P<at> at | ?@ ?)[A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+(?![\w-])")
_SAID_IP = re.compile(r"(?i)(?<!\w)[0-9]{1,3}(?: dot [0-9]{1,3}){3}(?!\w)")
_SAID_DOT = re.compile(r"(?i) dot ")
_DISGUISE = re.compile(r"(?i)[\[({<] ?(?:at|@|arobase|arroba|dot|\.|punkt|point|punto) ?[\])}>]| dot ")


class Rewritten:
    """A text under rewriting: character k stands for the source from ``start[k]`` to ``end[k]``, and
    ``changed[k]`` says whether it, or what followed it, was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply non-overlapping (start, end, new text) edits, given in order."""
        if not edits:
            return
        parts, at = [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            at = b
        parts.append(self.text[at:])
        a, b = np.array([e[:2] for e in edits]).T
        n = np.array([len(e[2]) for e in edits])
        step = np.zeros(len(self.text) + 1, np.int64)
        np.add.at(step, a, 1)
        np.add.at(step, b, -1)
        kept = np.cumsum(step)[:-1] == 0
        before = np.concatenate([[0], np.cumsum(kept)])[a]  # kept characters left of an edit
        where = np.repeat(before, n)
        changed = np.insert(self.changed[kept], where, True)
        left = before + np.cumsum(n) - n - 1  # what vanished belongs to its neighbour
        changed[left[(n == 0) & (left >= 0)]] = True
        self.start, self.end = np.insert(self.start[kept], where, np.repeat(self.start[a], n)), np.insert(self.end[kept], where, np.repeat(self.end[b - 1], n))
        self.changed = changed
        self.text = "".join(parts)


def _plain(ch: str) -> str:
    if ch in _HIDDEN:
        return ""
    if ch in _LOOKALIKE:
        return _LOOKALIKE[ch]
    flat = unicodedata.normalize("NFKC", ch)
    return flat if flat.isascii() else ch


def _digits(run: re.Match) -> list[tuple[int, int, str]]:
    """Edits that turn a run of spelled digits into digits joined by single spaces."""
    items = list(_ITEM.finditer(run[0]))
    if not any(m[0].lower() in _SPELLED for m in items):
        return []
    out, base = [], run.start()
    if run["plus"]:
        out.append((base, base + items[0].start(), "+"))
    for k, m in enumerate(items):
        value = _SPELLED.get(m[0].lower())
        if k:
            gap = (base + items[k - 1].end(), base + m.start(), " ")
            if run.string[gap[0] : gap[1]] != " ":
                out.append(gap)
        if value is not None:
            out.append((base + m.start(), base + m.end(), str(value)))
    return out


def rewrite(text: str) -> Rewritten | None:
    """The text with disguises undone, or None where there are none."""
    odd = not text.isascii() and _ODD.search(text) is not None
    low = text.lower()
    disguised = (" dot " in low or any(c in text for c in "[({<")) and _DISGUISE.search(text) is not None
    spelled = not _SPELLED.keys().isdisjoint(low.translate(_PAUSES).split())
    if not (odd or disguised or spelled):
        return None
    r = Rewritten(text)
    if odd:
        r.replace([(m.start(), m.end(), _plain(m[0])) for m in _ODD.finditer(text) if _plain(m[0]) != m[0]])
    if odd or spelled:
        r.replace([e for m in _RUN.finditer(r.text) for e in _digits(m)])
    if odd or disguised:
        r.replace([(m.start(), m.end(), "@") for m in _AT.finditer(r.text)])
        r.replace([(m.start(), m.end(), ".") for m in _DOT.finditer(r.text)])
        said = []
        for m in _SAID.finditer(r.text):
            said.append((m.start("at"), m.end("at"), "@"))
            said += [(d.start(), d.end(), ".") for d in _SAID_DOT.finditer(r.text, m.end("at"), m.end())]
        r.replace(said)
        r.replace([(d.start(), d.end(), ".") for m in _SAID_IP.finditer(r.text) for d in _SAID_DOT.finditer(r.text, m.start(), m.end())])
    return r


def all_spans(text: str, base: list[Span] | None = None) -> list[Span]:
    """Base spans plus those that only the rewritten text shows, at source offsets."""
    base = base_spans(text) if base is None else base
    r = rewrite(text)
    if r is None:
        return base
    known = {kind: [x[1:] for x in base if x[0] == kind] for kind in KINDS}
    more = []
    for kind, a, b in base_spans(r.text):
        start, end = int(r.start[a]), int(r.end[b - 1])
        if r.changed[a:b].any() and not _touches(known[kind], start, end):
            more.append((kind, start, end))
    return ordered(base + more)


def _touches(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the sorted, disjoint spans overlaps [start, end)."""
    k = bisect_left(spans, (end, 0))
    return k > 0 and spans[k - 1][1] > start


def render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, masked string"


def find_pii(docs: DataFrame, masked: bool = True) -> DataFrame:
    """One row per document: counts of base spans, base spans, all spans, and the masked text.

    ``masked=False`` leaves the masked text null, for callers that only want the spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(0, len(texts), 512):
                rows = []
                for t in texts.slice(k, 512).to_pylist():
                    t = t or ""
                    base = base_spans(t)
                    spans = all_spans(t, base)
                    counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                    rows.append((*counts, render(base), render(spans), mask(t, spans) if masked else None))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(k, 512), *[pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)]],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "masked"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
