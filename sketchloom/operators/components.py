"""Connected components by alternating stars, by label propagation and by union-find.

All three label a component with its smallest node. The first two are loops of joins and minima whose
state is written to the shared folder in each round, so plans stay short and lost executors cost one
round. No list of neighbours is ever gathered: each step is a partial aggregate and a join that Spark
may split where one node has very many edges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sketchloom.functions.storage import counted, join_shuffled, materialise
from sketchloom.functions.workers import frugal


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges (u, v), written, and their number and a sum of their hashes, observed on the way."""
    seen = Observation()
    found = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2_147_483_647))).alias("s")), "stars")
    return found, (seen.get["n"], seen.get["s"])


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of an edge: hash-to-min by alternating large and small stars.

    Self loops make a node known without linking it. Nulls are dropped. Order is that of the column's type.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # Each edge is held once, from its larger node u to its smaller node v.
    state, before = _written(pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = join_shuffled(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        larger = materialise(larger, "stars")
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        joined = join_shuffled(larger, least, "u")
        smaller = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        state, after = _written(smaller)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return join_shuffled(nodes, state.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def propagated_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 10_000) -> DataFrame:
    """(node, label) by repeated minima over neighbours; as many rounds as the largest distance to a smallest node."""
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    both = materialise(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "propagate")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "propagate")
    for _ in range(max_rounds):
        heard = join_shuffled(both, labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("heard"))
        seen = Observation()
        next_ = join_shuffled(labels, heard, "node").select("node", F.least("label", "heard").alias("label"), (F.col("heard") < F.col("label")).alias("moved"))
        labels = materialise(next_.observe(seen, F.count_if("moved").alias("n")).select("node", "label"), "propagate")
        if not seen.get["n"]:
            return labels
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def union_find(pairs: Iterable[tuple]) -> dict:
    """Label of each node of ``pairs``, all of which are held in memory."""
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _forests(nodes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function: edges to the forest that union-find makes of them, in chunks of about ``nodes`` edges."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = [], None

        def flush() -> pa.RecordBatch:
            found = union_find(held)
            linked = {r for x, r in found.items() if x != r}
            rows = [(x, r) for x, r in found.items() if x != r or x not in linked]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], schema.field(i).type) for i in (0, 1)], names=["src", "dst"])

        for batch in batches:
            schema = batch.schema
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(held) >= nodes:
                yield flush()
        if held:
            yield flush()

    return forest


def union_find_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_edges: int | None = None, nodes: int = 100_000) -> DataFrame:
    """(node, label): union-find inside partitions, again over merged partitions while that helps; stars finish what is left.

    Each task keeps a forest of what it reads, some ``nodes`` edges at a time. Where no more than ``nodes`` edges are left, one
    task's forest has all labels. ``max_edges``, if given, refuses larger graphs.
    """
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null")
    if max_edges is not None and pairs.distinct().limit(max_edges + 1).count() > max_edges:
        raise ValueError(f"more than {max_edges} edges: use star_components")
    reduced = frugal(_forests(nodes))
    forest, left = counted(pairs.mapInArrow(reduced, pairs.schema), "forests")
    before = None
    while left > nodes and (before is None or left < 0.9 * before):
        before = left
        forest, left = counted(forest.repartition(-(-left // nodes)).mapInArrow(reduced, pairs.schema), "forests")
    if left > nodes:
        return star_components(forest)
    stars = materialise(forest.repartition(1).mapInArrow(frugal(_forests(nodes + 1)), pairs.schema), "forests")
    return stars.select(F.col("src").alias("node"), F.col("dst").alias("label")).unionByName(stars.select(F.col("dst").alias("node"), F.col("dst").alias("label"))).distinct()
