"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as UTF-8 bytes (``cast(text as binary)``) in Arrow batches.  They are joined into blocks of a few
MB; words, lines and their 64-bit hashes come out as numpy arrays, so that no Python object is made per word.
A word is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that one numpy block holds (a longer text has a block of its own).
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Signs that don't count at the outside of a word.
OUTER = np.zeros(256, bool)
OUTER[list(b".,;:!?\"'()[]{}*#$%&|<>-_")] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE[LOWER]
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for k, p in enumerate((_P, _PINV)):
            a = np.full(size, p, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS[0], _POWERS[1]


class Block:
    """Some whole texts in one buffer, each followed by a newline.

    ``buf`` uint8; text ``i`` is ``buf[off[i]:off[i + 1] - 1]``; ``first`` is the index of its first text in the batch.
    """

    def __init__(self, texts: list[bytes], first: int) -> None:
        self.first, self.n = first, len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.off[1:])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and, for each text, the number of its first word (length ``n + 1``)."""
        gap = SPACE[self.buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(self.buf) and not gap[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.searchsorted(starts, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the ``\\n``-split lines and, for each text, the number of its first line."""
        ends = np.flatnonzero(self.buf == 10)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        return starts, ends, np.searchsorted(starts, self.off)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        up, down = _powers(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _BYTE)[self.buf] * up[: len(self.buf)], out=total[1:])
        return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def bare(block: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges without up to three outer signs on each side; a word keeps at least one byte."""
    starts, ends = starts.copy(), ends.copy()
    front = back = slice(None)
    for _ in range(3):  # a side that had no sign has none in the next round
        at = np.flatnonzero(OUTER[block.buf[starts[front]]] & (starts[front] < ends[front] - 1))
        front = at if isinstance(front, slice) else front[at]
        starts[front] += 1
        at = np.flatnonzero(OUTER[block.buf[ends[back] - 1]] & (starts[back] < ends[back] - 1))
        back = at if isinstance(back, slice) else back[at]
        ends[back] -= 1
    return starts, ends


def blocks(texts: list[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Whole texts (null: empty), in order, in blocks of about ``limit`` bytes."""
    held: list[bytes] = []
    size = first = 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and size + len(t) > limit:
            yield Block(held, first)
            held, size, first = [], 0, i
        held.append(t)
        size += len(t) + 1
    if held:
        yield Block(held, first)


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive words of one text, and for each text the number of its first window.

    A text of 1 to ``width - 1`` words has no window here.
    """
    n = np.maximum(np.diff(first) - width + 1, 0)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    begin = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], n)
    out = np.zeros(len(begin), np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[begin + k]
    return mix64(out), at
