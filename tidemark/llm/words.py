"""Words, byte hashes and flat word arrays shared by the text operators.

Words are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``; on UTF-8 that is what
``bytes.split()`` yields.  The hashes are polynomial (Rabin-Karp) over the words' bytes,
computed for a whole batch of texts at once with numpy prefix sums.
"""

from __future__ import annotations

import numpy as np

MASK64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1  # odd, hence invertible modulo 2**64
BLOCK = 1 << 20  # bytes hashed at once: bounds the scratch memory

with np.errstate(over="ignore"):
    _POW = np.concatenate([[np.uint64(1)], np.cumprod(np.full(BLOCK + 64, BASE, np.uint64))])
    _INV = np.concatenate([[np.uint64(1)], np.cumprod(np.full(BLOCK + 64, pow(BASE, -1, 1 << 64), np.uint64))])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words, equal for equal bytes wherever they stand."""
    out = np.empty(len(words), np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    at = 0
    ends = np.cumsum(lens)
    while at < len(words):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        out[at:to] = _hash_block(b"".join(words[at:to]), lens[at:to])
        at = to
    return out


def _hash_block(joined: bytes, lens: np.ndarray) -> np.ndarray:
    if len(joined) > BLOCK + 32:  # one word longer than a block: hash it piece by piece
        h = np.uint64(0)
        for k in range(0, len(joined), BLOCK):
            part = joined[k : k + BLOCK]
            h = mix(np.array([h], np.uint64) + _hash_block(part, np.array([len(part)])))[0]
        return np.array([h], np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(joined, np.uint8)] * _POW[: len(joined)], out=sums[1:])
        ends = np.cumsum(lens)
        starts = ends - lens
        h = (sums[ends] - sums[starts]) * _INV[starts]
        return mix(h + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of every ``size`` consecutive word hashes (fewer: an empty array)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, n, BLOCK - size):  # blocks overlap by a window
            part = h[k : min(k + BLOCK, len(h))]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _POW[: len(part)], out=sums[1:])
            m = len(part) - size + 1
            m = min(m, n - k)
            out[k : k + m] = (sums[size : size + m] - sums[:m]) * _INV[:m]
    return mix(out)


class Chunk:
    """Words of several texts in one flat array: text k owns words first[k] to first[k+1]."""

    __slots__ = ("words", "first")

    def __init__(self, texts: list[str | None], lower: bool = False):
        self.words: list[bytes] = []
        first = [0]
        for t in texts:
            if t:
                b = t.encode("utf-8", "surrogatepass")
                self.words += (b.lower() if lower else b).split()
            first.append(len(self.words))
        self.first = np.array(first, np.int64)

    def owner(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
