"""Suffix and longest-common-prefix arrays by induced sorting with disk-backed bucket queues.

The text is a sequence of small integers that ends in a unique 0. Suffixes are classed S or L; the sorted
S* suffixes (found by sorting S*-substrings the same way, naming them, and recursing on the names) induce
all L suffixes in ascending order, and those induce all S suffixes in descending order. What is induced is
queued by first character; within a bucket the order of arrival is the order of the suffix behind it, so
popping buckets in turn is popping a priority queue of (character, rank) keys. A whole bucket round is
popped at once and handled with array operations. Queue entries carry the suffix and its common prefix with
its forerunner: one more than the least prefix value popped between the two suffixes that induced them.

Queues move to unnamed temporary files once they exceed ``memory`` bytes, and texts beyond ``TEXT_BYTES`` do as
well. Full production shards (2 MiB) spill their queues and recurse on their names once. What stays in memory
beside the queues, types, places of S* suffixes and names, is some 60 bytes for each byte of a shard, so a
worker's memory decides how large shards may be. Common prefixes are only told up to ``cap``.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Names are recursed on down to so many; fewer are sorted in memory by prefix doubling.
SMALL = 1 << 19
DIRECT = 512
#: Bytes of a queue from which on it is kept in a file.
QUEUE_BYTES = 8 << 20
#: Bytes of a text from which on it is kept in a file.
TEXT_BYTES = 256 << 20


class BucketQueue:
    """First in, first out queues of (suffix, prefix value) batches, one per character; spills to a file."""

    def __init__(self, memory: int = QUEUE_BYTES):
        self.memory, self.held, self.file = memory, 0, None
        self.parts: dict[int, list] = {}

    def push(self, bucket: int, items: np.ndarray, prefixes: np.ndarray | None) -> None:
        self.parts.setdefault(bucket, []).append((items, prefixes))
        self.held += items.nbytes + (0 if prefixes is None else prefixes.nbytes)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for own in self.parts.values():
            for i, part in enumerate(own):
                if isinstance(part[0], np.ndarray):
                    places = []
                    for values in part:
                        if values is None:
                            places.append(None)
                        else:
                            places.append((self.file.tell(), values.dtype, len(values)))
                            self.file.write(values.tobytes())
                    own[i] = tuple(places)
        self.held = 0

    def _load(self, part):
        if part is None or isinstance(part, np.ndarray):
            return part
        at, dtype, n = part
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * dtype.itemsize), dtype)

    def pop(self, bucket: int) -> tuple[np.ndarray, np.ndarray | None] | None:
        """All that has come to the bucket since the last call."""
        own = self.parts.pop(bucket, None)
        if not own:
            return None
        loaded = []
        for part in own:
            if isinstance(part[0], np.ndarray):
                self.held -= part[0].nbytes + (0 if part[1] is None else part[1].nbytes)
            loaded.append((self._load(part[0]), self._load(part[1])))
        items = np.concatenate([x for x, _ in loaded])
        return items, None if loaded[0][1] is None else np.concatenate([x for _, x in loaded])


def stored(values: np.ndarray, memory: int) -> np.ndarray:
    """``values``, in a temporary file if they are larger than ``memory``."""
    if values.nbytes <= memory:
        return values
    with tempfile.TemporaryFile() as file:
        out = np.memmap(file, values.dtype, "w+", shape=values.shape)
    out[:] = values
    return out


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one behind it (S); the last one counts as S."""
    differs = np.flatnonzero(text[:-1] != text[1:])
    out = np.ones(len(text), bool)
    out[:-1] = np.repeat(text[differs] < text[differs + 1], np.diff(differs, prepend=-1))
    return out


def common(text: np.ndarray, a: int, b: int, cap: int) -> int:
    n = min(cap, len(text) - max(a, b))
    same = text[a : a + n] == text[b : b + n]
    return n if same.all() else int(np.argmin(same))


def adjacent_common(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, up to ``cap``; 0 for the first."""
    out = np.zeros(len(order), np.int16)
    values = np.r_[text, np.zeros(4, text.dtype)].astype(np.uint64)
    fours = sum(values[k : k + len(text)] << np.uint64(16 * k) for k in range(4))
    left, at = np.arange(1, len(order)), 0
    while len(left):
        a, b = order[left - 1] + at, order[left] + at
        differ = fours[a] ^ fours[b]
        # The last element is unique, so some difference comes before the end of either suffix.
        ended = np.flatnonzero(differ)
        low = differ[ended] & (~differ[ended] + np.uint64(1))
        out[left[ended]] = np.minimum(at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 4), cap)
        left = left[differ == 0]
        at += 4
        if at >= cap:
            out[left] = cap
            break
    return out


class Induction:
    """One text, its types and what is induced in it."""

    def __init__(self, text: np.ndarray, memory: int, cap: int = 0):
        self.text, self.is_s, self.memory, self.cap = text, types(text), memory, cap
        self.present = [int(c) for c in np.unique(text)]
        starts = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1
        self.stars = starts

    def _push(self, queue: BucketQueue, low: dict, items: np.ndarray, prefixes: np.ndarray | None, kind: bool) -> None:
        """Queue the suffixes one before ``items`` that are of ``kind``, in order."""
        before = items - 1
        ok = np.flatnonzero((before >= 0) & (self.is_s[before] == kind))
        least = None if prefixes is None else int(prefixes.min()) if len(prefixes) else self.cap
        if prefixes is not None:
            last = {c: min(v, least) for c, v in low.items()}
        if len(ok):
            chars = self.text[before[ok]]
            order = np.argsort(chars, kind="stable")
            ok, chars = ok[order], chars[order]
            edges = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1], True])
            for a, b in zip(edges[:-1], edges[1:]):
                c, js = int(chars[a]), ok[a:b]
                values = None
                if prefixes is not None:
                    whole = len(js) and js[-1] == len(items) - 1
                    cuts = np.r_[0, js + 1]
                    mins = np.minimum.reduceat(prefixes, cuts[:-1] if whole else cuts)
                    values = mins[: len(js)].copy()
                    values[0] = min(low.get(c, -1), int(values[0]))
                    values = np.minimum(values + 1, self.cap).astype(np.int16)
                    last[c] = self.cap if whole else int(mins[-1])
                queue.push(c, before[js], values)
        if prefixes is not None:
            low.clear()
            low.update(last)

    def run(self, seeds: np.ndarray, seed_prefixes: np.ndarray | None, naming: bool = False):
        """Yield (bucket, suffixes, prefixes) in ascending order, given the S* suffixes in order.

        For naming, order by bucket is enough; then only the S parts are told, in descending order.
        """
        text, carry = self.text, seed_prefixes is not None
        bounds = np.searchsorted(text[seeds], np.array([*self.present, self.present[-1] + 1]))
        queue, low, larger = BucketQueue(self.memory), {}, BucketQueue(self.memory)
        ends: dict[int, tuple[int, int]] = {}
        for i, c in enumerate(self.present):
            previous = None
            while (got := queue.pop(c)) is not None:
                items, prefixes = got
                larger.push(c, items, prefixes)
                ends[c] = (int(items[0]) if c not in ends else ends[c][0], int(items[-1]))
                previous = int(items[-1])
                self._push(queue, low, items, prefixes, False)
            own = seeds[bounds[i] : bounds[i + 1]]
            if len(own):
                prefixes = None
                if carry:
                    prefixes = seed_prefixes[bounds[i] : bounds[i + 1]].copy()
                    prefixes[0] = 0 if previous is None else common(text, previous, int(own[0]), self.cap)
                self._push(queue, low, own, prefixes, False)
        queue, low, out = BucketQueue(self.memory), {}, {}
        for c in reversed(self.present):
            smallest, told = None, []
            while (got := queue.pop(c)) is not None:
                items, prefixes = got
                told.append(got)
                smallest = int(items[-1])
                self._push(queue, low, items, prefixes, True)
            if c == 0:
                told.append((np.array([len(text) - 1]), np.zeros(1, np.int16) if carry else None))
                smallest = len(text) - 1
            got, seam = larger.pop(c), 0
            if got is not None:
                items, prefixes = got[0][::-1], None
                if carry:
                    seam = 0 if smallest is None else common(text, int(items[0]), smallest, self.cap)
                    prefixes = np.r_[np.int16(seam), got[1][:0:-1]]
                self._push(queue, low, items, prefixes, True)
            if not naming:
                out[c] = (got, told, seam)
            if naming and told:
                yield c, np.concatenate([x for x, _ in told]), None
        if not naming:
            for c in self.present:
                got, told, seam = out.pop(c)
                if got is not None:
                    yield c, got[0], got[1]
                if told:
                    items = np.concatenate([x for x, _ in told])[::-1]
                    yield c, items, np.r_[np.int16(seam), np.concatenate([x for _, x in told])[:0:-1]] if carry else None


def doubled(text: np.ndarray) -> np.ndarray:
    """Suffix array of a short text."""
    rank, step, n = np.unique(text, return_inverse=True)[1].astype(np.int64), 1, len(text)
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - step)] = rank[step:] + 1
        keys = rank * (n + 2) + behind
        kinds, rank = np.unique(keys, return_inverse=True)
        if len(kinds) == n:
            return np.argsort(rank)
        step *= 2


def star_order(induction: Induction, memory: int) -> np.ndarray:
    """The S* suffixes in order, by naming their substrings and recursing on the names."""
    text, stars = induction.text, induction.stars
    if len(stars) <= 1:
        return stars
    seeds = stars[np.argsort(text[stars], kind="stable")]
    is_star = np.zeros(len(text), bool)
    is_star[stars] = True
    down = [items[is_star[items]] for _, items, _ in induction.run(seeds, None, naming=True)]
    order = np.concatenate(down)[::-1]
    place = np.searchsorted(stars, order)
    sizes = np.diff(stars, append=len(text) - 1)
    a, b = order[:-1], order[1:]
    size = sizes[place[1:]]
    same = sizes[place[:-1]] == size
    left, at = np.flatnonzero(same), 0
    while len(left):
        equal = text[a[left] + at] == text[b[left] + at]
        same[left[~equal]] = False
        left = left[equal]
        left = left[size[left] > at]
        at += 1
    names = np.r_[0, np.cumsum(~same)]
    if names[-1] == len(order) - 1:
        return order
    in_order = np.empty(len(stars), np.int64)
    in_order[place] = names
    return stars[sorted_suffixes(in_order, int(names[-1]) + 1, memory)]


def sorted_suffixes(text: np.ndarray, kinds: int, memory: int) -> np.ndarray:
    """Suffix array of ``text``, whose last element is a unique 0."""
    if len(text) <= SMALL:
        return doubled(text)
    if kinds > DIRECT:  # two digits for each name: a small alphabet has few buckets
        base = int(np.ceil(np.sqrt(kinds)))
        digits = np.empty(2 * len(text) + 1, np.int32)
        digits[:-1:2], digits[1:-1:2], digits[-1] = text // base + 1, text % base + 1, 0
        found = sorted_suffixes(digits, base + 1 if base + 1 <= DIRECT else DIRECT, memory)
        found = found[1:]
        return found[found % 2 == 0] // 2
    induction = Induction(stored(text, max(memory, TEXT_BYTES)), memory)
    seeds = star_order(induction, memory)
    return np.concatenate([items for _, items, _ in induction.run(seeds, None)])


def suffixes_with_prefixes(text: np.ndarray, cap: int, memory: int = QUEUE_BYTES):
    """Yield (suffixes, common prefix with the one before, up to ``cap``) in ascending order, in batches."""
    induction = Induction(stored(text, max(memory, TEXT_BYTES)), memory, cap)
    seeds = star_order(induction, memory)
    for _, items, prefixes in induction.run(seeds, adjacent_common(induction.text, seeds, cap)):
        yield items, prefixes
