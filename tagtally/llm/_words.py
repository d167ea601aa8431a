"""Vectorised word and shingle fingerprints over the bytes of many texts at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Its fingerprint is a polynomial
over 64-bit integers with a random value for each byte, mixed at the end; a shingle's is a random linear
form of its words' fingerprints, mixed again. Two different shingles agree with a chance near 2**-64.
"""

from __future__ import annotations

import numpy as np

#: Bytes of texts that are worked on at once.
SLICE = 256 << 10

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h ^= h >> np.uint64(27)
    h *= _MIX2
    h ^= h >> np.uint64(31)
    return h


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(step)
        step = step * step % 2**64
        done += k
    return out


class Words:
    """Fingerprints of words and word shingles; keeps its power tables between calls."""

    def __init__(self, seed: int = 20240601, fold: bool = True):
        rng = np.random.Generator(np.random.PCG64(seed))
        values = rng.integers(1, 2**64, 256, np.uint64, endpoint=False) | np.uint64(1)
        if fold:
            values[65:91] = values[97:123]
        self.values = values
        self.linear = rng.integers(1, 2**64, 64, np.uint64, endpoint=False) | np.uint64(1)
        self.solid = np.ones(256, bool)
        self.solid[[9, 10, 11, 12, 13, 32]] = False
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            self.powers, self.inverse = _geometric(_BASE, n), _geometric(pow(_BASE, -1, 2**64), n)

    def words(self, data: np.ndarray, offsets: np.ndarray, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of all words (of their first ``size`` bytes) in order, and for each text where its words begin (one entry more).

        A long text is worked on in slices that end behind white space, so that only its words' fingerprints grow with it.
        """
        prints, counts, i = [], [np.zeros(1, np.int64)], 0
        while i < len(offsets) - 1:
            j = int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1
            if j <= i:
                found = [self._words(part, np.array([0, len(part)]), size)[0] for part in self.slices(data[offsets[i] : offsets[i + 1]])]
                prints += found
                counts.append(np.array([sum(map(len, found))]))
                i += 1
                continue
            h, bounds = self._words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            prints.append(h)
            counts.append(np.diff(bounds))
            i = j
        return (np.concatenate(prints) if prints else np.zeros(0, np.uint64)), np.cumsum(np.concatenate(counts))

    def slices(self, data: np.ndarray):
        """A text in slices of about ``SLICE`` bytes that end behind white space; a longer word stays whole."""
        at = 0
        while at < len(data):
            stop, step = min(at + SLICE, len(data)), SLICE
            while stop < len(data):
                spaces = np.flatnonzero(~self.solid[data[at:stop]])
                if len(spaces):
                    stop = at + int(spaces[-1]) + 1
                    break
                step *= 2
                stop = min(at + step, len(data))
            yield data[at:stop]
            at = stop

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte start and end of every word, and for each text where its words begin (one entry more)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        solid = self.solid[data]
        starts = solid.copy()
        starts[1:] &= ~solid[:-1]
        inner = offsets[(offsets > 0) & (offsets < n)]
        starts[inner] = solid[inner]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        ends[inner - 1] = solid[inner - 1]
        s = np.flatnonzero(starts)
        return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)

    def beginnings(self, data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the first ``size`` bytes of all words, in the order of ``words``."""
        return self.words(data, offsets, size)[0]

    def _words(self, data: np.ndarray, offsets: np.ndarray, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        s, e, bounds = self.spans(data, offsets)
        if size is not None:
            e = np.minimum(e, s + size)
        n = len(data)
        self._tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        return mix((sums[e] - sums[s]) * self.inverse[s]), bounds

    def shingles(self, h: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
        """For each text the sorted distinct fingerprints of its shingles of ``width`` words.

        A text with fewer words has its whole word sequence as the only one; a text without words has none.
        """
        n = len(h)
        if n >= width:
            runs = h[: n - width + 1] * self.linear[0]
            for j in range(1, width):
                runs += h[j : n - width + 1 + j] * self.linear[j]
            runs = mix(runs)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= width:
                s = np.sort(runs[a : b - width + 1])
                if len(s) > 1:
                    new = np.ones(len(s), bool)
                    np.not_equal(s[1:], s[:-1], out=new[1:])
                    s = s[new]
                out.append(s)
            elif b > a:
                k = b - a
                out.append(mix(np.array([int((h[a:b] * self.linear[:k]).sum()) ^ (0xA5A5 * k)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
