"""Refinement carried from one number of hash functions to the next.

The sketch of a vertex's neighbours under one function is the c least of all its neighbours' hashes, so it can be kept and
updated like any bottom-c sketch. When functions H … H' - 1 are added, two things are new: the neighbours met in the
buckets of the new functions, which can only improve the rows of old functions, and the rows of the new functions
themselves, which look at all buckets once. Candidates are made for (new buckets x old functions) and (all buckets x new
functions) instead of for all buckets under all functions; a step from H to H + 1 costs the order of H, not of H squared.
Kept rows name the neighbours behind their values, so a neighbour that is met again is not counted twice.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.config import SketchConfig
from sketchloom.functions.storage import materialise, scratch_scope
from sketchloom.operators import nearest
from sketchloom.operators.graph import level1_edges, refined_shingles, valued_members

def candidates(members: DataFrame, cfg: SketchConfig, first: int, end: int) -> DataFrame:
    """(name, names, vs), a row per bucket: neighbours among which are each member's c least under the functions ``first`` to ``end`` - 1."""
    return nearest.lists_of_members(members, nearest.of_buckets(members, cfg, first, end))


class GrowingRefinement:
    """The refined graphs of growing numbers of functions; rows (name, names, vs, vals), the neighbours that matter, are carried along.

    ``sketches``: ``of(h)`` gives (name, hash_idx, vals) for the first h functions. Only the last number's rows are kept, so numbers must not fall. Two rounds are carried; with one, or with more than
    two, where a row depends on rows that change everywhere, graphs are made anew.
    """

    def __init__(self, sketches, cfg: SketchConfig):
        self.sketches, self.cfg, self.hashes, self.rows = sketches, cfg, 0, None

    def shingles(self, hashes: int) -> DataFrame:
        """(name, hash_idx, vals): the neighbours' sketches under the first ``hashes`` functions."""
        if hashes < self.hashes:
            raise ValueError(f"rows of {self.hashes} functions can't be taken back to {hashes}")
        cfg = replace(self.cfg, hashes=hashes)
        if hashes > self.hashes:
            with scratch_scope(self.sketches.of(hashes).sparkSession) as keep:
                members = materialise(valued_members(self.sketches.of(hashes)), "bucket-members")
                lists = candidates(members, cfg, self.hashes, hashes)
                if self.hashes:
                    met = candidates(members.filter(F.col("hash_idx") >= self.hashes), cfg, 0, self.hashes)
                    lists = lists.unionByName(met).unionByName(self.rows.select("name", "names", "vs"))
                self.rows, self.hashes = materialise(nearest.of_vertices(lists, cfg), f"refined-rows-{hashes}"), hashes
                keep()
        return nearest.shingles_of(self.rows, cfg)

    def graph_shingles(self, hashes: int) -> DataFrame:
        """(name, hash_idx, vals), written: the shingles of which ``graph`` is the level-1 graph."""
        if self.cfg.rounds != 2:
            return refined_shingles(self.sketches.of(hashes), replace(self.cfg, hashes=hashes))
        return materialise(self.shingles(hashes), "refined-shingles")

    def graph(self, hashes: int) -> DataFrame:
        """(src, dst) both ways: equal to ``refined_edges`` of the first ``hashes`` functions."""
        return level1_edges(self.graph_shingles(hashes))
