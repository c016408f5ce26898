"""Words between ASCII white space, or other single bytes: where they are, their 64-bit hashes, and hashes of runs of words.

All work is on whole buffers of bytes with numpy; nothing is kept between calls but
tables of powers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_ALL = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(_BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A 64-bit value for each byte.
_VALUE = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if size > 1 << 24:
            return made[0][:n], made[1][:n]
        _powers, _inverse = made
    return _powers[:n], _inverse[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes behind which words are compared one by one.
_LONG = 64


def table(*parts: int | range) -> np.ndarray:
    """A table of bytes for ``Words``: those given, and the line end that stands between texts."""
    out = np.zeros(256, bool)
    for x in (0x0A, *parts):
        out[x if isinstance(x, int) else list(x)] = True
    return out


def slices(text: bytes, most: int, between: np.ndarray) -> Iterator[bytes]:
    """The text in parts of about ``most`` bytes, cut before a byte of ``between``; longer ones where there is none."""
    start = 0
    while len(text) - start > most:
        at, step = start + most, 1 << 16
        while at < len(text):
            found = np.nonzero(between[np.frombuffer(text, np.uint8, min(step, len(text) - at), at)])[0]
            if len(found):
                at += int(found[0])
                break
            at = min(len(text), at + step)
        yield text[start:at]
        start = at
    yield text[start:]


def mark(name: str) -> int:
    """A 64-bit number for a name, the same in every task."""
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=8).digest(), "little")


class Words:
    """The words of some texts, in one buffer: begin and end of each, its text and its hash."""

    def __init__(self, texts: list[bytes], space: np.ndarray = _SPACE):
        self.data = b"\n".join(texts) + b"\n"
        b = self.bytes = np.frombuffer(self.data, np.uint8)
        space = space[b]
        edge = np.nonzero(space[1:] != space[:-1])[0] + 1
        if not space[0]:
            edge = np.r_[0, edge]
        self.begin, self.end = edge[0::2], edge[1::2]
        if len(self.end) < len(self.begin):
            self.end = np.r_[self.end, len(b)]
        self.starts = np.cumsum([0, *(len(x) + 1 for x in texts)])  # where each text begins
        self.first = np.searchsorted(self.begin, self.starts)  # of each text, and the number of words
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        power, inverse = powers(len(b))
        total = np.empty(len(b) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUE[b] * power, out=total[1:])
        size = (self.end - self.begin).astype(np.uint64)
        self.hash = scramble((total[self.end] - total[self.begin]) * inverse[self.begin] + size * _MIX)

    def __len__(self) -> int:
        return len(self.begin)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n words of one text, and the first word of each."""
        count = max(0, len(self) - n + 1)
        out = np.zeros(count, np.uint64)
        for k in range(n):
            out = out * _MIX + self.hash[k : k + count]
        at = np.nonzero(self.text[: count] == self.text[n - 1 :])[0] if count else np.zeros(0, np.int64)
        return scramble(out[at] + np.uint64(n)), at

    def whole(self, text: int) -> np.uint64:
        """Hash of all words of a text."""
        out = 0
        for h in self.hash[self.first[text] : self.first[text + 1]].tolist():
            out = (out * _BASE + h) & _ALL
        return scramble(np.array([out + int(self.first[text + 1] - self.first[text]) & _ALL], np.uint64))[0]

    def same(self, a: np.ndarray, other: Words, b: np.ndarray) -> bool:
        """Whether words ``a`` are, one by one, the words ``b`` of ``other``, compared byte by byte."""
        size = self.end[a] - self.begin[a]
        if (size != other.end[b] - other.begin[b]).any():
            return False
        left, right, k = self.begin[a], other.begin[b], 0
        while len(left):
            if k == _LONG:
                rest = zip(left.tolist(), right.tolist(), size.tolist(), strict=True)
                return all(self.data[x + k : x + n] == other.data[y + k : y + n] for x, y, n in rest)
            if (self.bytes[left + k] != other.bytes[right + k]).any():
                return False
            k += 1
            more = size > k
            if not more.all():
                left, right, size = left[more], right[more], size[more]
        return True

    def word(self, k: int) -> bytes:
        return self.data[self.begin[k] : self.end[k]]

    def numbered(self, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each of the words ``at``, the same for equal words of one ``kind`` and for no others; and for each number a place in ``at``."""
        _, first, number = np.unique(scramble(self.hash[at] + kind.astype(np.uint64) * _MIX), return_index=True, return_inverse=True)
        if (kind == kind[first[number]]).all() and self.same(at, self, at[first[number]]):
            return number, first
        seen: dict[tuple[int, bytes], int] = {}  # two words have one hash
        for n, k in enumerate(at.tolist()):
            number[n] = seen.setdefault((int(kind[n]), self.word(k)), len(seen))
        return number, np.unique(number, return_index=True)[1]
