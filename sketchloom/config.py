"""Run parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from sketchloom.functions.hashing import PRIME, hash_params


@dataclass(frozen=True)
class SketchConfig:
    """Parameters of sketching, refinement and the hash-growth search; validated on creation."""

    k: int = 6
    c: int = 2
    rounds: int = 2
    hashes: int = 41
    max_hashes: int = 2000
    difference: int = 40
    threshold: float = 0.9
    min_cluster_size: int = 10
    seed: int = 1
    params: tuple[tuple[int, int], ...] = field(default=())

    def __post_init__(self):
        if not 1 <= self.k <= 12:
            raise ValueError("k must be 1 to 12: k-mer values are exact only up to 12 letters")
        if self.c < 1 or self.rounds < 1 or self.hashes < 1:
            raise ValueError("c, rounds and hashes must be at least 1")
        if self.params and len(self.params) < self.hashes:
            raise ValueError(f"{len(self.params)} pairs of hash parameters are too few for {self.hashes} hashes")
        if any(not 0 <= x < 2**31 for pair in self.params for x in pair):
            raise ValueError("hash parameters must be 0 to 2^31 - 1, or products overflow")

    @property
    def family(self) -> list[tuple[int, int]]:
        """The (a, b) pairs of the first ``hashes`` functions."""
        return list(self.params[: self.hashes]) if self.params else hash_params(self.seed, self.hashes)

    @property
    def prime(self) -> int:
        return PRIME

    @property
    def floor(self) -> int:
        """No cluster smaller than two counts, whatever is asked for."""
        return max(self.min_cluster_size, 2)
