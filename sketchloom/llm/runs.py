"""Windows of equal content, found by sampled grams: the vectorised core of the substring operators.

A sequence of 64-bit values (words or bytes) has windows of ``length`` values. Each window is
represented by the least of its ``length - gram + 1`` gram hashes (leftmost if equal), so equal windows
have equal representatives, and consecutive windows mostly share one: a run. A run is described by the
position and hash of its gram and by a hash of everything its windows span.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Odd 64-bit constants: the multiplier of the polynomial and those of the finaliser.
RADIX = 0x9E3779B97F4A7C15
RADIX_INVERSE = pow(RADIX, -1, 1 << 64)
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Hashes of all runs of n values, by prefix sums of a polynomial over the 64-bit integers modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(values) >= len(self.up):
            self.up, self.down = powers(RADIX, len(values) + 1), powers(RADIX_INVERSE, len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, prefix: np.ndarray, n: int) -> np.ndarray:
        count = max(0, len(prefix) - n)
        return mix((prefix[n : n + count] - prefix[:count]) * self.down[:count] + np.uint64(n))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


class Runs(NamedTuple):
    """One entry per run; positions count from the start of the concatenated values."""

    first: np.ndarray  # first and last window start of the run
    last: np.ndarray
    gram: np.ndarray  # hash of the gram that all its windows share
    span: np.ndarray  # hash of all values that its windows span, and of where the gram lies
    lead: np.ndarray  # how far behind the first window's start the gram lies
    prefix: np.ndarray


def find_runs(values: np.ndarray, bounds: np.ndarray, length: int, gram: int, hasher: Hasher) -> Runs:
    """Runs of the windows within each part [bounds[j], bounds[j + 1]) of ``values``; len(values) < 2^32."""
    prefix = hasher.prefix(values)
    if len(values) < length:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none.astype(np.uint64), none.astype(np.uint64), none, prefix)
    hashes = hasher.grams(prefix, gram)
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    place = (sliding_min(ranked, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(np.arange(len(place)) + length <= ends[: len(place)])
    place = place[starts]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(starts) else starts
    first, last, at = starts[new], starts[np.r_[new[1:], len(starts)] - 1] if len(new) else new, place[new]
    span = mix(hasher.spans(prefix, first, last + length) ^ (at - first).astype(np.uint64) * np.uint64(RADIX))
    return Runs(first, last, hashes[at], span, at - first, prefix)


def blocks(parts: list[np.ndarray], length: int, block: int = BLOCK):
    """Yield (values, bounds, part, offset): parts in a row, long ones cut so that no window start is in two blocks."""
    own, bounds, which, offset, size = [], [0], [], [], 0
    for j, part in enumerate(parts):
        for at in range(0, max(1, len(part) - length + 1), block):
            piece = part[at : at + block + length - 1]
            own.append(piece)
            size += len(piece)
            bounds.append(size)
            which.append(j)
            offset.append(at)
            if size >= block:
                yield np.concatenate(own), np.array(bounds), np.array(which), np.array(offset)
                own, bounds, which, offset, size = [], [0], [], [], 0
    if own:
        yield np.concatenate(own), np.array(bounds), np.array(which), np.array(offset)
