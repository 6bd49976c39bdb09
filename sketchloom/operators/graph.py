"""Similarity graphs from shared shingles, and their refinement by sketching neighbourhoods.

A level-1 edge keeps the least hash index under which it appears, so the graph of any smaller number of
hash functions is a filter. Refinement need not build the level-1 clique: the c least hashes over a
vertex's neighbours are among the c + 1 least members of each of its buckets, so a bucket of any size sends
those of its members that are such under some function (``nearest``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchloom.config import SketchConfig
from sketchloom.functions.blocks import blocked, left_of_groups, right_of_groups
from sketchloom.functions.hashing import universal_hash, vertex_value
from sketchloom.functions.storage import join_shuffled, materialise, table_bytes
from sketchloom.operators import nearest

KEY = ["hash_idx", "vals"]
#: Members of a bucket from which it is cut into blocks.
BUCKET = 2048
#: Bytes of lists of members that are sent to all tasks.
LISTS_BYTES = 128 << 20
#: Blocks of a bucket at most, and so how often its members are sent.
BLOCKS = 64
#: Pairs that a task makes, about, and tasks that make them at most.
PAIRS, TASKS = 1 << 22, 10_000


def shared(shingles: DataFrame) -> DataFrame:
    """The shingles that at least two sequences have: nothing else can make an edge."""
    busy = shingles.groupBy(*KEY).agg(F.count_distinct("name").alias("_n")).filter("_n > 1").select(*KEY)
    return join_shuffled(shingles, busy, KEY, "left_semi")


def bucket_sizes(shingles: DataFrame) -> DataFrame:
    """(hash_idx, vals, members) of every bucket; buckets are reported whole, whatever their size."""
    return shingles.groupBy(*KEY).agg(F.count_distinct("name").alias("members"))


def bucket_members(shingles: DataFrame) -> DataFrame:
    """(bucket, hash_idx, name): members of buckets of two or more; repeats stay. Buckets have numbers, given while they are written, so they are exact."""
    busy = shingles.groupBy(*KEY).agg(F.min("name").alias("_x"), F.max("name").alias("_y")).filter("_x <> _y").select(*KEY)
    busy = materialise(busy.withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    return join_shuffled(shingles, busy, KEY).select("bucket", "hash_idx", "name")


def memberships(shingles: DataFrame) -> DataFrame:
    """(name, buckets), written: the buckets (hash_idx, bucket) of two or more members that each name is in, in order.

    A name is in few buckets, as many as it has sketches.
    """
    own = bucket_members(shingles).groupBy("name").agg(F.array_sort(F.collect_set(F.struct("hash_idx", "bucket"))).alias("buckets"))
    return materialise(own, "memberships")


def ordered_members(shingles: DataFrame) -> DataFrame:
    """(bucket, hash_idx, name, before), written: members of each bucket, with the earlier buckets that they are in."""
    each = memberships(shingles).select("name", "buckets", F.posexplode("buckets").alias("_at", "_b"))
    return materialise(each.select("_b.bucket", "_b.hash_idx", "name", F.slice(F.col("buckets.bucket"), 1, F.col("_at")).alias("before")), "members")


def edges_first_hash(shingles: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(src, dst, first_hash) with src < dst: pairs that share a shingle.

    A pair is made in the first bucket that both are in, and nowhere else: members carry the buckets before, so no pair is
    sent or compared with other pairs. A bucket of more than ``bucket`` members is cut into blocks, ``BLOCKS`` at most, and pairs
    of blocks are joined as keys of their own, so that a bucket with most of all members is many even tasks. The result is
    the same for any ``bucket``. Members are few bytes for the pairs that they make, so tasks are as many as pairs ask for.
    """
    members, keys = ordered_members(shingles), ["bucket", "_i", "_j"]
    pairs = members.groupBy("bucket").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0
    tasks = int(min(TASKS, 1 + pairs // PAIRS))
    dealt = blocked(members, ["bucket"], F.xxhash64("name"), bucket, most=BLOCKS)
    a = left_of_groups(dealt).withColumnsRenamed({"name": "a", "before": "_p"}).repartition(tasks, *keys)
    b = right_of_groups(dealt).drop("hash_idx").withColumnsRenamed({"name": "b", "before": "_q"}).repartition(tasks, *keys)
    met = join_shuffled(a, b, keys).filter("(_i < _j or a < b) and not arrays_overlap(_p, _q)")
    return met.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.col("hash_idx").alias("first_hash"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, without loops and repeats."""
    pairs = edges.select("src", "dst").filter("src <> dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def level1_edges(shingles: DataFrame, hashes: int | None = None) -> DataFrame:
    """(src, dst) both ways: the graph of the first ``hashes`` functions."""
    used = shingles if hashes is None else shingles.filter(F.col("hash_idx") < hashes)
    return edges_first_hash(used).select(F.expr("stack(2, src, dst, dst, src) as (src, dst)"))  # each pair is there once


def star_edges(shingles: DataFrame) -> DataFrame:
    """(src, dst): each member of a bucket with its least one; same components as the full graph, linear in size."""
    busy = shingles.groupBy(*KEY).agg(F.min("name").alias("dst"))
    return join_shuffled(shingles, busy, KEY).filter("name <> dst").select(F.col("name").alias("src"), "dst").distinct()


def hashed_by(cfg: SketchConfig, first: int = 0, end: int | None = None) -> Column:
    """A row (i, a, b) for each function of the family from ``first`` to before ``end``."""
    family = list(enumerate(cfg.family))[first:end]
    return F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in family)))


def _bottom_per_vertex(candidates: DataFrame, c: int) -> DataFrame:
    """(name, hash_idx, vals) from distinct (name, hash_idx, h, member)."""
    order = Window.partitionBy("name", "hash_idx").orderBy("h", "member")
    least = candidates.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= c)
    found = least.groupBy("name", "hash_idx").agg(F.array_sort(F.collect_list("h")).alias("vals"))
    return found.filter(F.size("vals") >= c)


def neighbour_shingles(edges: DataFrame, cfg: SketchConfig) -> DataFrame:
    """Sketches of each vertex's neighbour set, from the edges themselves."""
    arcs = both_ways(edges).select(F.col("src").alias("name"), F.col("dst").alias("member"), vertex_value(F.col("dst")).alias("v"))
    hashed = arcs.select("name", "member", "v", hashed_by(cfg).alias("f"))
    hashed = hashed.select("name", "member", F.col("f.i").alias("hash_idx"), universal_hash(F.col("v"), F.col("f.a"), F.col("f.b")).alias("h"))
    return _bottom_per_vertex(hashed, cfg.c)


def valued_members(shingles: DataFrame) -> DataFrame:
    """(bucket, hash_idx, name, v): members of buckets of two or more, with their vertex values; repeats stay."""
    return bucket_members(shingles).withColumn("v", vertex_value(F.col("name")))


def neighbour_shingles_of_buckets(shingles: DataFrame, cfg: SketchConfig) -> DataFrame:
    """As ``neighbour_shingles(level1_edges(shingles))``, without the edges."""
    members = materialise(valued_members(shingles), "valued-members")
    lists = nearest.lists_of_members(members, nearest.of_buckets(members, cfg))
    return nearest.shingles_of(nearest.of_vertices(lists, cfg), cfg)


def refined_edges(shingles: DataFrame, cfg: SketchConfig) -> DataFrame:
    """(src, dst) both ways after ``cfg.rounds`` rounds; each round's graph replaces the one before."""
    return level1_edges(refined_shingles(shingles, cfg))


def refined_shingles(shingles: DataFrame, cfg: SketchConfig) -> DataFrame:
    """The shingles of which ``refined_edges`` is the level-1 graph."""
    own = shingles
    for _ in range(cfg.rounds - 1):  # written, as the next round reads each of them more than once
        own = materialise(neighbour_shingles_of_buckets(own, cfg), "neighbourhoods")
    return own


def closed_neighbourhoods(edges: DataFrame) -> DataFrame:
    """(label, member): each vertex labels the cluster of itself and its neighbours."""
    arcs = both_ways(edges)
    return arcs.select(F.col("src").alias("label"), F.col("dst").alias("member")).unionByName(arcs.select(F.col("src").alias("label"), F.col("src").alias("member")).distinct())


def closed_neighbourhoods_of_buckets(shingles: DataFrame) -> DataFrame:
    """As ``closed_neighbourhoods(edges_first_hash(shingles))``, without collecting pairs."""
    own = vertices(shingles).select(F.col("name").alias("label"), F.col("name").alias("member"))
    return level1_edges(shingles).toDF("label", "member").unionByName(own)


def vertices(shingles: DataFrame) -> DataFrame:
    """(name) of the level-1 graph's vertices, without its edges: whoever shares a shingle."""
    return shared(shingles).select("name").distinct()


def vertex_ids(edges: DataFrame) -> DataFrame:
    """(id, name): 0-based numbers by name. Numbers come from counts of ranges, so no task sees all names."""
    names = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    return dense_numbers(names, "name", "id")


def difference(edges: DataFrame, without: DataFrame) -> DataFrame:
    """(src, dst) of ``edges`` that ``without`` has not."""
    return edges.select("src", "dst").distinct().join(without.select("src", "dst"), ["src", "dst"], "left_anti")


def dense_numbers(df: DataFrame, by: str, number: str) -> DataFrame:
    """``df`` (distinct ``by``) with 0-based numbers in the order of ``by``: a range partitioning, then local ranks."""
    dealt = materialise(df.repartitionByRange(by).withColumn("_p", F.spark_partition_id()), "numbers")
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(by)) - 1
    return dealt.withColumn("_l", local).join(before, "_p").withColumn(number, F.col("_l") + F.col("_before")).drop("_p", "_l", "_before")


def adjacency(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, neighbours): sorted neighbour numbers of each vertex."""
    arcs = both_ways(edges)
    s = ids.select(F.col("id").alias("s"), F.col("name").alias("src"))
    d = ids.select(F.col("id").alias("d"), F.col("name").alias("dst"))
    numbered = arcs.join(s, "src").join(d, "dst")
    return numbered.groupBy(F.col("s").alias("id")).agg(F.array_sort(F.collect_set("d")).alias("neighbours"))


def numbered_memberships(shingles: DataFrame) -> DataFrame:
    """(id, name, buckets), written: the ``vertex_ids`` of the level-1 graph and the numbers of the buckets that each vertex is in."""
    held = memberships(shingles).select("name", F.col("buckets.bucket").alias("buckets"))
    return materialise(join_shuffled(held, dense_numbers(held.select("name"), "name", "id"), "name").select("id", "name", "buckets"), "numbered")


def adjacency_of_buckets(shingles: DataFrame, max_bytes: int = LISTS_BYTES) -> DataFrame:
    """As ``adjacency`` of the level-1 graph and its ``vertex_ids``, without its edges."""
    return adjacency_of_numbered(numbered_memberships(shingles), max_bytes)


def adjacency_of_numbered(numbered: DataFrame, max_bytes: int = LISTS_BYTES, ranges: int | None = None) -> DataFrame:
    """(id, neighbours) of ``numbered_memberships``; with ``ranges``, dealt by so many ranges of ``id`` and sorted.

    A bucket's members are listed once. Up to ``max_bytes`` the lists go to the vertices, and no neighbour is shuffled;
    above it vertices meet the lists of their buckets by shuffles, which are as large as the result.
    """
    own = numbered.select("id", "buckets")
    each = own.select("id", F.explode("buckets").alias("bucket"))
    lists = materialise(each.groupBy("bucket").agg(F.sort_array(F.collect_list("id")).alias("ids")), "lists")
    dealt = lambda df: df.repartitionByRange(ranges, "id").sortWithinPartitions("id")
    if table_bytes(lists) > max_bytes:
        met = join_shuffled(each, lists, "bucket").groupBy("id").agg(F.flatten(F.collect_list("ids")).alias("_all"))
        met = dealt(met) if ranges else met
    else:
        # Few bytes stand for many neighbours here, so vertices are dealt over all tasks whatever they take.
        most = own.agg(F.max(F.size("buckets"))).first()[0] or 0
        met = dealt(own) if ranges else own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
        for i in range(most):
            there = F.broadcast(lists.select(F.col("bucket").alias(f"_b{i}"), F.col("ids").alias(f"_l{i}")))
            met = met.withColumn(f"_b{i}", F.get("buckets", F.lit(i))).join(there, f"_b{i}", "left")
        whole = F.concat(*(F.coalesce(f"_l{i}", F.array().cast("array<bigint>")) for i in range(most))) if most else F.array().cast("array<bigint>")
        met = met.select("id", whole.alias("_all"))
    return met.select("id", F.array_remove(F.sort_array(F.array_distinct("_all")), F.col("id")).alias("neighbours"))


def graph_counts(edges: DataFrame) -> DataFrame:
    """One row: vertices, arcs (directed, loops included), self_loops, undirected_edges."""
    arcs = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    loops = F.count_if(F.col("src") == F.col("dst"))
    totals = arcs.agg(F.count_distinct("src").alias("vertices"), F.count(F.lit(1)).alias("arcs"), loops.alias("self_loops"))
    return totals.withColumn("undirected_edges", ((F.col("arcs") - F.col("self_loops")) / 2).cast("long"))
