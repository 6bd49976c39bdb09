"""Carried refinement, hot buckets, the search's store, communities of high modularity and merged sketches."""

import collections
import functools
import random

import pytest

from sketchloom.config import SketchConfig
from sketchloom.functions import storage
from sketchloom.functions.blocks import blocked, left_of_groups, met_in_groups, right_of_groups
from sketchloom.operators import communities, components, graph, growth, search, sketch
from sketchloom.operators.louvain import louvain, modularity


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def sequences(spark):
    draw = random.Random(4)
    base = ["".join(draw.choice("ACGT") for _ in range(60)) for _ in range(6)]
    made = [(f"{i}_1", "".join(draw.choice("ACGT") if draw.random() < 0.08 else x for x in base[i % 6])) for i in range(48)]
    return spark.createDataFrame(made, "name string, sequence string").persist()


@pytest.mark.parametrize("c", [1, 3])
def test_carried_refinement_equals_that_from_scratch(spark, sequences, c):
    cfg = SketchConfig(k=5, c=c, hashes=12, seed=3)
    growing = growth.GrowingRefinement(search.GrowingSketches(sequences, cfg, 12), cfg)
    for h in (4, 5, 12):
        own = SketchConfig(k=5, c=c, hashes=h, seed=3)
        assert rows(growing.graph(h)) == rows(search.similarity_graph(sequences, own))
    with pytest.raises(ValueError):
        growing.graph(5)


def test_other_numbers_of_rounds_are_made_anew(spark, sequences):
    cfg = SketchConfig(k=5, rounds=3, hashes=6, seed=3)
    growing = growth.GrowingRefinement(search.GrowingSketches(sequences, cfg, 6), cfg)
    assert rows(growing.graph(6)) == rows(search.similarity_graph(sequences, cfg))


def test_work_of_a_step_follows_its_new_functions(spark, sequences, monkeypatch):
    cfg = SketchConfig(k=5, hashes=9, seed=3)
    growing = growth.GrowingRefinement(search.GrowingSketches(sequences, cfg, 9), cfg)
    growing.graph(8)
    asked = []
    made = growth.candidates
    monkeypatch.setattr(growth, "candidates", lambda s, c, first, end: asked.append((s.select("hash_idx").distinct().count(), end - first)) or made(s, c, first, end))
    growing.graph(9)
    assert sorted(asked) == [(1, 8), (9, 1)]  # new buckets under old functions, all buckets under the new one


def test_store_is_kept_apart_by_all_that_results_depend_on(spark, sequences, tmp_path):
    cfg = SketchConfig(k=5, hashes=3, difference=1, max_hashes=4, threshold=1.1, min_cluster_size=2, seed=3)
    store = f"file://{tmp_path}"
    steps = lambda **how: list(search.hash_growth(how.pop("of", sequences), how.pop("cfg", cfg), **how))
    fresh = steps()
    assert steps(store=store) == fresh and steps(store=store) == fresh
    for how in (
        {"communities": communities.neighbourhoods},
        {"communities": functools.partial(communities.label_spreading, rounds=1)},
        {"cfg": SketchConfig(k=5, hashes=3, difference=1, max_hashes=4, threshold=1.1, min_cluster_size=2, params=tuple((7 * i + 3, i) for i in range(6)))},
        {"of": sequences.filter("name < '3'")},
    ):
        assert steps(store=store, **how) == steps(**how)


def test_store_of_another_description_is_refused(spark, tmp_path, monkeypatch):
    search.Store(spark, f"file://{tmp_path}", "one")
    monkeypatch.setattr(search.hashlib, "sha256", lambda _: __import__("hashlib").new("sha256", b"same"))
    search.Store(spark, f"file://{tmp_path}", "one")
    with pytest.raises(ValueError):
        search.Store(spark, f"file://{tmp_path}", "two")


def test_search_with_communities_of_high_modularity(spark, sequences):
    cfg = SketchConfig(k=5, hashes=4, difference=1, max_hashes=5, threshold=0.5, min_cluster_size=2, seed=3)
    steps = list(search.hash_growth(sequences, cfg, communities=lambda edges: louvain(edges)[0]))
    assert len(steps) == 1 and 0 < steps[0].f <= 1


@pytest.mark.parametrize("bucket", [3, 1024])
def test_edges_of_hot_buckets(spark, bucket):
    members = [(f"n{i}", 0, [1, 2]) for i in range(40)] + [(f"n{i}", 1, [i % 3]) for i in range(60)] + [("alone", 2, [9])] + [("n1", 0, [1, 2])]
    shingles = spark.createDataFrame(members, "name string, hash_idx int, vals array<long>").repartition(3)
    expected = {}
    for a in range(60):
        for b in range(60):
            x, y = f"n{a}", f"n{b}"
            if x < y and ((a < 40 and b < 40) or a % 3 == b % 3):
                expected[x, y] = 0 if a < 40 and b < 40 else 1
    assert rows(graph.edges_first_hash(shingles, bucket)) == sorted((*k, v) for k, v in expected.items())


def test_blocks_are_even_and_lose_no_pair(spark):
    data = [("hot", i) for i in range(500)] + [("cold", i) for i in range(7)] + [("one", 1)]
    dealt = blocked(spark.createDataFrame(data, "k string, v int"), ["k"], graph.F.xxhash64("v"), 50)
    met, sizes = collections.Counter(), collections.Counter()
    a = left_of_groups(dealt).withColumnRenamed("v", "a").join(right_of_groups(dealt).withColumnRenamed("v", "b"), ["k", "_i", "_j"]).filter("_i < _j or a < b")
    for r in a.collect():
        met[r.k, frozenset((r.a, r.b))] += 1
        sizes[r.k, r._i, r._j] += 1
    assert len(met) == 500 * 499 // 2 + 21 and set(met.values()) == {1}
    assert max(sizes.values()) < 0.02 * 500 * 499 / 2  # half of the rows in one key, no task with a fiftieth of its pairs
    groups = met_in_groups(dealt).groupBy("k", "_i", "_j").agg(graph.F.collect_list("v").alias("vs")).collect()
    pairs = {frozenset((x, y)) for g in groups if g.k == "hot" for x in g.vs for y in g.vs if x != y}
    assert len(pairs) == 500 * 499 // 2 and max(len(g.vs) for g in groups) < 100


def brute_modularity(edges, label):
    links = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    total, inside = collections.Counter(), 0
    for a, b in links:
        total[label[a]] += 1
        total[label[b]] += 1
        inside += 2 * (label[a] == label[b])
    m2 = 2 * len(links)
    return inside / m2 - sum((t / m2) ** 2 for t in total.values())


def test_planted_communities_are_found(spark):
    draw, edges = random.Random(1), []
    for c in range(6):
        edges += [(f"{c}_{i}", f"{c}_{j}") for i in range(10) for j in range(i) if draw.random() < 0.7]
    edges += [(f"{c}_0", f"{(c + 1) % 6}_1") for c in range(6)] + [("0_0", "0_0"), edges[0]]
    df = spark.createDataFrame(edges, "src string, dst string")
    found, levels = louvain(df)
    label = {r.member: r.label for r in found.collect()}
    assert all(label[m] == f"{m.split('_')[0]}_0" for m in label) and len(label) == 60
    assert levels[-1].modularity == pytest.approx(brute_modularity(edges, label)) == modularity(df, found).first()["modularity"]
    assert [x.modularity for x in levels] == sorted(x.modularity for x in levels)


def test_modularity_is_never_below_that_of_spread_labels(spark):
    draw = random.Random(2)
    edges = [(f"r{i:02}", f"r{(i + 1) % 16:02}") for i in range(16)] + [(f"m{draw.randrange(20):02}", f"m{draw.randrange(20):02}") for _ in range(40)]
    df = spark.createDataFrame(edges, "src string, dst string")
    own, spread = ({r.member: r.label for r in x.collect()} for x in (communities.modular(df), communities.label_spreading(df)))
    assert brute_modularity(edges, own) >= brute_modularity(edges, spread) - 1e-12
    assert all(label == min(m for m, x in own.items() if x == label) for label in own.values())
    begun = communities.label_spreading(df, rounds=1).persist()
    after, _ = louvain(df, start=begun)
    assert brute_modularity(edges, {r.member: r.label for r in after.collect()}) >= brute_modularity(edges, {r.member: r.label for r in begun.collect()})


def test_graphs_without_edges(spark):
    none = spark.createDataFrame([("a", "a")], "src string, dst string")
    assert louvain(none)[0].count() == 0 and modularity(none, none.toDF("label", "member")).first()["modularity"] is None
    empty = none.filter("src <> dst")
    for method in (components.star_components, components.union_find_components, components.propagated_components):
        assert method(empty).count() == 0


def test_union_find_in_one_and_in_many_tasks(spark):
    draw = random.Random(6)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(260)]
    df = spark.createDataFrame(edges, "src int, dst int").repartition(5)
    expected = rows(components.star_components(df))
    for nodes in (1, 20, 100_000):
        assert rows(components.union_find_components(df, nodes=nodes)) == expected


def test_merges_gather_no_more_than_c_values(spark):
    draw = random.Random(3)
    made = [(f"n{draw.randrange(3)}", draw.randrange(2), sorted(draw.randrange(50) for _ in range(3))) for _ in range(400)]
    df = spark.createDataFrame(made, "name string, hash_idx int, vals array<long>").repartition(6)
    expected = collections.defaultdict(list)
    for n, i, v in made:
        expected[n, i] = sorted(expected[n, i] + v)[:3]
    assert rows(sketch.merge_sketches(df, df.limit(0), 3)) == sorted((*k, v) for k, v in expected.items())
    assert "WindowGroupLimit" in sketch.merge_sketches(df, df.limit(0), 3)._jdf.queryExecution().toString()
    for most in (1, 100):
        parts = sketch.combined_in_tasks(df, 3, most)
        assert rows(sketch.merge_sketches(parts, parts.limit(0), 3)) == sorted((*k, v) for k, v in expected.items())
    assert sketch.combined_in_tasks(df.coalesce(1), 3).count() == len(expected)


def test_scopes_remove_their_own_tables_only(spark):
    import threading

    df, both, seen = spark.range(3), threading.Barrier(2, timeout=60), {}

    def work(name):
        with storage.scratch_scope(spark):
            table = storage.materialise(df, name)
            both.wait()
            if name == "late":
                both.wait()
                seen[name] = table.count()
        if name == "early":
            both.wait()

    threads = [threading.Thread(target=work, args=(n,)) for n in ("early", "late")]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert seen == {"late": 3}
