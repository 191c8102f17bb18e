"""Texts as arrays of code points, for numpy work on whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multipliers of the two halves of a stretch (fixed values).
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts joined, and where each begins (one more entry than texts)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return joined, np.concatenate([[0], np.cumsum(lengths)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers under which similar values become unlike (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any stretches of an array of integers.

    The hash of 2^j values is mixed from those of its halves, level by level for all places at once; a stretch of any other
    length is the mix of the two stretches of 2^j that cover it. As every step mixes without linearity, no pattern of
    values (as the Thue-Morse sequence does to polynomials modulo 2^64) makes unlike stretches hash alike.
    """

    def __init__(self, values: np.ndarray):
        self.levels = [mix(values.astype(np.uint64) + np.uint64(1))]

    def _level(self, j: int) -> np.ndarray:
        """Hash of the 2^j values that begin at each place."""
        while len(self.levels) <= j:
            h, half = self.levels[-1], 1 << (len(self.levels) - 1)
            n = max(0, len(h) - half)
            self.levels.append(mix(h[:n] * LEFT + h[half : half + n] * RIGHT))
        return self.levels[j]

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of each stretch [start, stop); equal stretches of equal length hash alike wherever they stand."""
        size = stop - start
        out = mix(np.zeros(len(size), np.uint64))
        power = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1  # floor of the logarithm
        for j in np.unique(power[size > 0]):
            at = np.flatnonzero((power == j) & (size > 0))
            h = self._level(int(j))
            out[at] = mix(h[start[at]] * LEFT + h[stop[at] - (1 << int(j))] + size[at].astype(np.uint64))
        return out

    def windows(self, size: int) -> np.ndarray:
        """Hash of the stretch of `size` that begins at each position."""
        n = max(0, len(self.levels[0]) - size + 1)
        h = self._level(size.bit_length() - 1)
        tail = size - (1 << (size.bit_length() - 1))
        return mix(h[:n] * LEFT + h[tail : tail + n] + np.uint64(size))


def pieces(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` characters together (a longer text stands alone), so that memory is bounded."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def class_table(member) -> np.ndarray:
    """A flag for each code point up to 0x10FFFF of whether member(character) holds."""
    return np.fromiter((member(chr(c)) for c in range(0x110000)), bool, 0x110000)


_TABLES: dict[str, np.ndarray] = {}


def alnum() -> np.ndarray:
    """Flags of letters and digits."""
    if "alnum" not in _TABLES:
        _TABLES["alnum"] = class_table(str.isalnum)
    return _TABLES["alnum"]


def words(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and text of each longest run of letters or digits; runs end with their text."""
    flag = alnum()[code]
    before = np.zeros(len(flag), bool)
    before[1:] = flag[:-1]
    at = offsets[:-1][offsets[:-1] < len(flag)]
    before[at] = False
    start = np.flatnonzero(flag & ~before)
    after = np.zeros(len(flag), bool)
    after[:-1] = flag[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    stop = np.flatnonzero(flag & ~after) + 1
    return start, stop, np.searchsorted(offsets, start, "right") - 1
