"""64-bit hashes of words and word runs, computed for a whole text at once.

Sums of byte values times powers of an odd base give the hash of any slice by one subtraction. Two different slices
share a hash with a chance of about 2^-64; whoever needs more combines two independent hashes.
"""

from __future__ import annotations

import numpy as np

from tendersift.llm.common import mix

BASE, SECOND = 0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Powers:
    """Powers of a base and of its inverse modulo 2^64, as many as the longest text so far needs."""

    _known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def reach(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = cls._known.get(base)
        if got is None or len(got[0]) < n:
            size = 1 << max(12, n.bit_length())
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
            got = cls._known[base] = (made[0], made[1])
        return got


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums from which ``slices`` takes hashes."""
    up, _ = Powers.reach(base, len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def slices(running: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = Powers.reach(base, len(running))
    return mix((running[stop] - running[start]) * down[start])


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """One hash per word; ``lower`` takes A-Z as a-z first."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    if lower:
        data = _LOWER[data]
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    return slices(sums(VALUES[data], BASE), BASE, start, stop) + (stop - start).astype(np.uint64)


def run_hashes(words: np.ndarray, size: int, base: int = SECOND) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return slices(sums(words, base), base, at, at + size)


def whole(words: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a word sequence, as signed 64-bit numbers."""
    at = np.array([0])
    end = np.array([len(words)])
    a = slices(sums(words, SECOND), SECOND, at, end) + np.uint64(len(words))
    b = slices(sums(mix(words), BASE), BASE, at, end)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


class Words:
    """The words of several texts at once: hash, text number, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, lower: bool = False):
        """``data`` holds the texts end to end, text i in offsets[i]:offsets[i + 1]; ``first`` is the number of text 0."""
        self.first, self.texts = first, len(offsets) - 1
        data = _LOWER[data] if lower else data
        blank = _BLANK[data]
        begins = ~blank
        begins[1:] &= blank[:-1]
        ends = ~blank
        ends[:-1] &= blank[1:]
        # Texts without a blank between them are still two.
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = ~blank[inner]
        ends[inner - 1] = ~blank[inner - 1]
        start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.hashes = slices(sums(VALUES[data], BASE), BASE, start, stop) + (stop - start).astype(np.uint64)
        self.bounds = np.searchsorted(start, offsets)
        self.text = np.repeat(np.arange(self.texts), np.diff(self.bounds))

    def runs(self, size: int) -> np.ndarray:
        """Positions where ``size`` consecutive words of one text begin."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text[:n] == self.text[size - 1 :])

    def wholes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two independent hashes and the number of words of each text."""
        lo, hi = self.bounds[:-1], self.bounds[1:]
        a = slices(sums(self.hashes, SECOND), SECOND, lo, hi) + (hi - lo).astype(np.uint64)
        b = slices(sums(mix(self.hashes), BASE), BASE, lo, hi)
        return a.view(np.int64), b.view(np.int64), hi - lo

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of the distinct ``size``-word shingles, sorted; shorter texts are one shingle."""
        at = self.runs(size)
        number = np.diff(self.bounds)
        short = np.flatnonzero((number > 0) & (number < size))
        run = sums(self.hashes, SECOND)
        text = np.concatenate([self.text[at], short])
        value = np.concatenate([slices(run, SECOND, at, at + size), slices(run, SECOND, self.bounds[short], self.bounds[short + 1])])
        order = np.lexsort((value, text))
        text, value = text[order], value[order]
        fresh = np.ones(len(text), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
        return text[fresh], value[fresh]


def words_of(texts, lower: bool = False, limit: int = 1 << 18):
    """``Words`` of an Arrow string column, some texts at a time: about ``limit`` bytes, or one longer text."""
    import pyarrow as pa

    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at, lower)
        at = end
