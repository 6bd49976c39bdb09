"""Micro goldens and properties of sketching, graphs, components and scores."""

import itertools
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.config import SketchConfig
from sketchloom.functions import hashing
from sketchloom.operators import clusters as C
from sketchloom.operators import communities, components, evaluate, graph, search, sketch

SEQUENCES = [("1_1", "MKVLAAGTWQ"), ("2_1", "MKVLAAGTWR"), ("3_1", "MKVLAAGTYY"), ("4_1", "CCCCCCCCCC"), ("5_1", "CCCCCDDDDD"), ("6_1", "MK"), ("7_1", "HHWWMKVLAA")]
FAMILY = ((1103515245, 12345), (1664525, 1013904223), (69069, 1234567), (22695477, 7654321))
CFG = SketchConfig(k=3, c=2, rounds=2, hashes=4, params=FAMILY)


@pytest.fixture(scope="module")
def sequences(spark):
    return spark.createDataFrame(SEQUENCES, "name string, sequence string").cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def clusters(spark, text):
    return spark.createDataFrame([(f"c{i}", m) for i, own in enumerate(text.split()) for m in own], "label string, member string")


def test_kmer_values(spark):
    found = spark.createDataFrame([("AAA",), ("CCC",), ("MKV",), ("YYY",)], "s string").select(hashing.kmer_value(F.col("s"), 3)).collect()
    assert [r[0] for r in found] == [0, 842, 5021, 10104]
    assert sketch.kmer_values(np.frombuffer(b"MKV", np.uint8), 3).tolist() == [5021]


def test_vertex_values(spark):
    names = spark.createDataFrame([("254_2",), ("7",), ("7_0",), ("3_900",)], "n string").select(hashing.vertex_value(F.col("n"))).collect()
    assert [r[0] for r in names] == [30000254, 7, 10000007, 9010000003]


def test_shingles(sequences):
    found = dict(rows(sketch.shingles(sequences, replace(CFG, hashes=1)).select("name", sketch.display())))
    assert found == {
        "1_1": "0$76051480$221103800", "3_1": "0$76051480$221103800", "2_1": "0$76051480$142320472",
        "4_1": "0$1159846460$1159846460", "5_1": "0$13666548$983361702", "7_1": "0$76051480$252956189",
    }


def test_shingles_in_functions_alone(sequences):
    assert rows(sketch.shingles(sequences, CFG)) == rows(sketch.shingles_sql(sequences, CFG))


def test_sequences_must_be_letters(spark):
    with pytest.raises(Exception, match="normalise"):
        sketch.shingles(spark.createDataFrame([("1", "AB1CDEF")], "name string, sequence string"), CFG).collect()


@pytest.mark.parametrize("hashes,expected", [(1, [("1_1", "3_1")]), (2, [("1_1", "3_1")]), (4, [*itertools.combinations(["1_1", "2_1", "3_1", "7_1"], 2), ("4_1", "5_1")])])
def test_level1(sequences, hashes, expected):
    found = graph.edges_first_hash(sketch.shingles(sequences, replace(CFG, hashes=hashes)))
    assert rows(found.select("src", "dst")) == sorted(expected)


def test_level2(sequences):
    shingles = sketch.shingles(sequences, CFG)
    naive = graph.neighbour_shingles(graph.level1_edges(shingles), CFG)
    assert rows(naive) == rows(graph.neighbour_shingles_of_buckets(shingles, CFG))
    found = graph.refined_edges(shingles, CFG)
    assert rows(found.filter("src < dst")) == [("1_1", "7_1"), ("2_1", "3_1"), ("3_1", "7_1")]
    assert rows(graph.refined_edges(sketch.shingles(sequences, replace(CFG, hashes=1)), replace(CFG, hashes=1))) == []


def random_sequences(spark, seed, n=60):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("ACDKLMVW") for _ in range(14)) for _ in range(12)]
    return spark.createDataFrame([(f"{i}_1", draw.choice(stems)[: draw.randint(6, 14)] + "".join(draw.choice("ACDK") for _ in range(draw.randint(0, 6)))) for i in range(n)], "name string, sequence string")


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_properties(spark, seed):
    shingles = sketch.shingles(random_sequences(spark, seed), CFG).cache()
    assert rows(graph.neighbour_shingles(graph.level1_edges(shingles), CFG)) == rows(graph.neighbour_shingles_of_buckets(shingles, CFG))
    all_edges = set(rows(graph.level1_edges(shingles)))
    assert all((b, a) in all_edges and a != b for a, b in all_edges)
    before = set()
    for h in range(1, 5):
        now = set(rows(graph.level1_edges(shingles, h)))
        assert before <= now
        assert now == set(rows(graph.both_ways(graph.edges_first_hash(shingles).filter(F.col("first_hash") < h))))
        before = now


def test_partitioning_does_not_matter(spark):
    base = random_sequences(spark, 3)
    found = [rows(search.similarity_graph(base.repartition(n), CFG)) for n in (1, 4, 17)]
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("seed", [4, 5])
def test_components_agree(spark, seed):
    draw = random.Random(seed)
    pairs = [(f"{draw.randint(0, 60)}_1", f"{draw.randint(0, 60)}_1") for _ in range(45)] + [("10_1", "2_1"), ("9_9", "9_9"), *((f"p{i:02}", f"p{i + 1:02}") for i in range(20))]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    expected = sorted(components.union_find(pairs).items())
    assert dict(expected)["2_1"] <= "10_1"
    assert rows(components.star_components(edges)) == expected
    assert rows(components.propagated_components(edges)) == expected
    assert rows(components.union_find_components(edges)) == expected
    shingles = sketch.shingles(random_sequences(spark, seed), CFG)
    assert rows(components.star_components(graph.star_edges(shingles))) == rows(components.star_components(graph.edges_first_hash(shingles)))


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert rows(components.star_components(none)) == rows(components.propagated_components(none)) == []


def test_union_find_refuses_large_graphs(spark):
    with pytest.raises(ValueError, match="star_components"):
        components.union_find_components(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), max_edges=1)


@pytest.mark.parametrize("nodes", [7, 100_000])
def test_union_find_stays_off_the_driver(spark, monkeypatch, nodes):
    draw = random.Random(6)
    pairs = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(900, 900), (901, None)]
    edges = spark.createDataFrame(pairs, "src long, dst long").repartition(6)
    with monkeypatch.context() as m:
        m.setattr(type(edges), "toLocalIterator", None)
        found = components.union_find_components(edges, nodes=nodes)
    assert rows(found) == sorted(components.union_find(p for p in pairs if None not in p).items())


def test_f_value(spark):
    x, y = clusters(spark, "abcd efg hi"), clusters(spark, "abc defg jkl")
    found = evaluate.f_value(x, y).first()
    assert (round(found.f_test, 4), round(found.f_base, 4), round(found.f_avg, 5)) == (0.6667, 0.6, 0.63333)
    assert evaluate.f_value(x, x).first().f_avg == 1
    assert evaluate.f_value(x, y).first().f_avg == pytest.approx(evaluate.f_value(y, x).first().f_avg)
    empty = spark.createDataFrame([], "label string, member string")
    assert evaluate.f_value(empty, y).first().f_avg is None


def test_nmi(spark):
    x, y = clusters(spark, "abcd efg hi"), clusters(spark, "abc defg jk")
    found = evaluate.nmi(x, y, 11).first()
    assert found.h_x == pytest.approx(27.225546445483303) and found.h_y_given_x == pytest.approx(15.118050835462764)
    assert found.nmi_max == pytest.approx(0.444710839294) and found.nmi_lfk == pytest.approx(0.444710839294)
    assert evaluate.nmi(x, x, 11).first().nmi_lfk == pytest.approx(1)
    assert evaluate.nmi(x, spark.createDataFrame([], "label string, member string"), 11).first().nmi_max is None


def test_clusters(spark):
    sized = spark.createDataFrame([(str(i), i, f"{i}/{m}") for i, n in enumerate([3, 5, 5, 2, 5]) for m in range(n)], "label string, position int, member string")
    assert [r.position for r in C.top_k(sized, 2).collect()] == [4, 2]
    assert C.top_k(sized, 0).count() == 5
    assert C.largest(sized.select("label", "member")).first().largest == 5
    assert rows(C.with_floor(sized.select("label", "member"), 5).select("label").distinct()) == [("1",), ("2",), ("4",)]
    assert rows(C.unmarked(C.marked(clusters(spark, "ab")))) == rows(clusters(spark, "ab"))
    names = spark.createDataFrame([("b_1", 0), ("a_1", 1), ("b_2", 2)], "name string, position int")
    assert rows(C.dictionary(names, True)) == [("a", 2), ("b", 1)]


def test_communities(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e")], "src string, dst string")
    parts = sorted(tuple(sorted(r.m)) for r in communities.label_spreading(edges).groupBy("label").agg(F.collect_list("member").alias("m")).collect())
    assert parts == [("a", "b", "c"), ("d", "e")]
    assert rows(communities.components(edges)) == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "e")]
    vertices = spark.createDataFrame([(1, "a")], "id int, name string")
    with pytest.raises(Exception, match="no vertex 2"):
        communities.assigned(vertices, spark.createDataFrame([(2, 7)], "vertex_id int, community int")).collect()


def test_search(spark):
    cfg = replace(CFG, params=(), hashes=3, difference=2, max_hashes=6, min_cluster_size=2, threshold=2.0)
    base = random_sequences(spark, 6)
    steps = list(search.hash_growth(base, cfg))
    assert [(s.hashes, s.base_hashes) for s in steps] == [(3, 1), (4, 2), (5, 3)]
    assert steps[0].arcs == steps[2].base_arcs == search.similarity_graph(base, cfg).count()
    assert len(list(search.hash_growth(base, replace(cfg, threshold=0.0)))) == 1
    with pytest.raises(ValueError):
        next(search.hash_growth(base, replace(cfg, difference=3)))


def test_config():
    assert SketchConfig(min_cluster_size=0).floor == 2
    assert hashing.hash_params(5, 3) == hashing.hash_params(5, 9)[:3]
    for wrong in ({"k": 13}, {"k": 0}, {"c": 0}, {"hashes": 2, "params": ((1, 1),)}, {"hashes": 1, "params": ((2**31, 1),)}):
        with pytest.raises(ValueError):
            SketchConfig(**wrong)


@pytest.mark.parametrize("wrong", ["AB_^[\\CDEFGH", "abcdefghij", "AB12 34?CDEF", "ABCDE\n", "É" * 8])
def test_both_sketches_refuse_what_is_no_letter(spark, wrong):
    odd = spark.createDataFrame([("1_1", wrong)], "name string, sequence string")
    for found in (sketch.shingles(odd, CFG), sketch.shingles_sql(odd, CFG), sketch.kmers(odd, 3)):
        with pytest.raises(Exception, match="A to Z"):
            found.collect()


def test_growing_sketches_equal_those_from_scratch(sequences, monkeypatch):
    cfg = SketchConfig(k=3, c=2, hashes=3, difference=2, max_hashes=30, seed=5)
    asked = []
    made = search.shingles
    monkeypatch.setattr(search, "shingles", lambda s, c, first=0: (asked.append((first, c.hashes)), made(s, c, first))[1])
    growing = search.GrowingSketches(sequences, cfg, 29)
    for h in (1, 3, 4, 9, 2):
        assert rows(growing.of(h)) == rows(made(sequences, replace(cfg, hashes=h)))
    assert asked[0] == (0, 1) and all(a[1] == b[0] for a, b in zip(asked, asked[1:])) and asked[-1][1] <= 12


def test_search_reads_stored_graphs(spark, sequences, tmp_path, monkeypatch):
    cfg = SketchConfig(k=3, c=2, rounds=1, hashes=3, difference=2, max_hashes=6, threshold=1.1, min_cluster_size=2, params=FAMILY * 2)
    plain = list(search.hash_growth(sequences, cfg))
    first = list(search.hash_growth(sequences, cfg, store=tmp_path.as_uri()))
    monkeypatch.setattr(search, "refined_edges", None)  # nothing is built again
    assert plain == first == list(search.hash_growth(sequences, cfg, store=tmp_path.as_uri())) and len(plain) == 3


def test_nmi_of_clusters_that_meet_all_partners_of_a_size(spark):
    draw = random.Random(3)
    cover = lambda n: [(str(k), str(m)) for k in range(n) for m in draw.sample(range(14), draw.randint(1, 9))]
    for _ in range(4):
        x, y = cover(5), cover(4)
        got = evaluate.nmi(*(spark.createDataFrame(c, "label string, member string") for c in (x, y)), 14).first()

        def h(*ws):
            return sum(-w * np.log2(w / 14) if w > 0 else 0.0 for w in ws)

        def given(mine, other):
            sets = [[{m for k, m in side if k == label} for label in {k for k, _ in side}] for side in (mine, other)]
            total = 0.0
            for s in sets[0]:
                best = []
                for t in sets[1]:
                    d, c, b = len(s & t), len(s - t), len(t - s)
                    a = 14 - d - c - b
                    joint = h(a, b, c, d) - h(b + d) - h(a + c)
                    best.append((0.0 if joint < 2.220446049250313e-16 else joint) if h(a, d) >= h(b, c) else h(c + d, a + b))
                total += min(best)
            return total

        assert abs(got.h_x_given_y - given(x, y)) < 1e-9 and abs(got.h_y_given_x - given(y, x)) < 1e-9


def test_vertices_without_edges(sequences):
    found = sketch.shingles(sequences, CFG)
    edges = graph.edges_first_hash(found)
    assert rows(graph.vertices(found)) == rows(graph.vertex_ids(edges).select("name"))
    assert rows(graph.difference(edges, edges.filter("first_hash > 0"))) == rows(edges.filter("first_hash = 0").select("src", "dst"))
