"""What is sent between tasks follows the names, not the pairs; and graphs kept as buckets equal those of pairs."""

import random

import pytest

from sketchloom.config import SketchConfig
from sketchloom.operators import bucketed, clusters, communities, graph, growth, louvain, search, sketch
from sketchloom.sources import writers

ROWS = "name string, hash_idx int, vals array<long>"


def rows(df):
    return sorted(map(tuple, df.collect()))


def sent(spark, make):
    """Rows written to shuffles while ``make()`` is made and counted."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, none, None)
        return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

    before = total()
    make().count()
    return total() - before


@pytest.fixture(scope="module")
def hot(spark):
    """One bucket of 1,500 names, 1,124,250 pairs."""
    return spark.createDataFrame([(f"{i}_1", 0, [1, 2]) for i in range(1500)], ROWS).persist()


@pytest.fixture(scope="module")
def mixed(spark):
    draw = random.Random(5)
    made = [(f"{i}_{1 + i % 2}", h, [draw.randrange(9 + 4 * h)]) for i in range(60) for h in range(3) if draw.random() < 0.9]
    return spark.createDataFrame(made + made[:5] + [("3_2", 0, [1]), ("3_2", 0, [2]), ("alone_1", 0, [99])], ROWS).persist()


LINEAR = 40 * 1500


def test_level1_edges_send_no_pairs(spark, hot):
    assert sent(spark, lambda: graph.level1_edges(hot)) < LINEAR
    assert graph.level1_edges(hot).count() == 1500 * 1499


def test_closed_neighbourhoods_send_no_pairs(spark, hot):
    assert sent(spark, lambda: graph.closed_neighbourhoods_of_buckets(hot)) < LINEAR


def test_closed_neighbourhoods_of_buckets(mixed):
    assert rows(graph.closed_neighbourhoods_of_buckets(mixed)) == rows(graph.closed_neighbourhoods(graph.edges_first_hash(mixed)))


def test_first_hash_of_names_in_several_buckets_of_a_function(mixed):
    expected, own = {}, rows(mixed)
    for a, h, v in own:
        for b, i, w in own:
            if a < b and (h, v) == (i, w):
                expected[a, b] = min(h, expected.get((a, b), h))
    assert rows(graph.edges_first_hash(mixed)) == rows(graph.edges_first_hash(mixed, 3)) == sorted((*k, h) for k, h in expected.items())


def test_blocks_of_a_key_are_bounded(spark, hot):
    dealt = graph.blocked(hot, ["hash_idx"], graph.F.xxhash64("name"), 10, most=8)
    assert rows(dealt.select("_blocks").distinct()) == [(8,)]


def test_refined_graphs_send_no_pairs(spark, hot):
    """A bucket's refined shingles are few, so the refined graph of a large bucket is as large as the bucket's own."""
    cfg = SketchConfig(k=5, c=2, rounds=3, hashes=1)
    assert sent(spark, lambda: graph.refined_edges(hot, cfg)) < 2 * LINEAR


def test_growing_graphs_are_not_written(spark, hot, monkeypatch):
    class Held:
        def of(self, hashes):
            return hot

    written, real = [], growth.materialise
    monkeypatch.setattr(growth, "materialise", lambda df, label: written.append(label) or real(df, label))
    assert growth.GrowingRefinement(Held(), SketchConfig(k=5, hashes=1)).graph(1).count() > 1_000_000
    assert written == ["bucket-members", "refined-rows-1", "refined-shingles"]


def test_renamed_members_send_no_pairs_where_names_are_apart(spark, hot, mixed):
    marked = lambda x: x.select(graph.F.concat(graph.F.lit("/"), "name").alias("member"))
    assert clusters.apart(marked(graph.vertices(hot)))
    twice = spark.createDataFrame([("/1_1",), ("/1_2",)], "member string")
    assert not clusters.apart(twice)
    assert sent(spark, lambda: clusters.renamed(clusters.marked(graph.closed_neighbourhoods_of_buckets(hot)), True)) < LINEAR


def test_search_makes_no_pairs_for_components(spark, mixed, monkeypatch):
    assert bucketed.arcs(mixed) == graph.level1_edges(mixed).count()
    assert rows(bucketed.component_communities(mixed)) == rows(communities.components(graph.edges_first_hash(mixed)))
    monkeypatch.setattr(search, "counted", lambda *_: pytest.fail("a graph was written"))
    made = spark.createDataFrame([(f"{i}_1", "ACGTACGGTACCA"[i % 3 :]) for i in range(9)], "name string, sequence string")
    cfg = SketchConfig(k=5, hashes=3, difference=1, max_hashes=4, threshold=1.1, min_cluster_size=2)
    assert len(list(search.hash_growth(made, cfg))) == 1


@pytest.mark.parametrize("most", [6, 0])
def test_degrees_and_counts_of_buckets(spark, hot, mixed, monkeypatch, most):
    monkeypatch.setattr(bucketed, "MOST", most)  # 0: every name is in too many buckets, pairs are used
    arcs = graph.level1_edges(mixed)
    assert rows(bucketed.degrees(mixed)) == rows(arcs.groupBy("src").count())
    assert rows(bucketed.graph_counts(mixed)) == rows(graph.graph_counts(arcs))
    if most:
        assert sent(spark, lambda: bucketed.degrees(hot)) < LINEAR and sent(spark, lambda: bucketed.graph_counts(hot)) < LINEAR
        assert rows(bucketed.graph_counts(mixed.limit(0))) == [(0, 0, 0, 0)]


def test_modularity_of_buckets(spark, hot, mixed):
    parts = graph.vertices(mixed).select(graph.F.substring("name", 1, 1).alias("label"), graph.F.col("name").alias("member"))
    assert rows(bucketed.modularity(mixed, parts))[0][0] == pytest.approx(rows(louvain.modularity(graph.level1_edges(mixed), parts))[0][0])
    assert sent(spark, lambda: bucketed.modularity(hot, graph.vertices(hot).selectExpr("'x' label", "name member"))) < LINEAR


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_labels_spread_over_buckets(mixed, rounds):
    assert rows(bucketed.label_spreading(mixed, rounds)) == rows(communities.label_spreading(graph.edges_first_hash(mixed), rounds))


def test_labels_spread_without_pairs(spark, hot):
    assert sent(spark, lambda: bucketed.label_spreading(hot, 2)) < LINEAR


def test_louvain_of_buckets_equals_that_of_edges(mixed):
    found, levels = bucketed.louvain_communities(mixed)
    expected, others = louvain.louvain(graph.edges_first_hash(mixed))
    assert rows(found) == rows(expected) and [x[:2] for x in levels] == [x[:2] for x in others]
    assert [x.modularity for x in levels] == pytest.approx([x.modularity for x in others])


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_metis_rows_of_buckets(mixed, bound):
    edges = graph.edges_first_hash(mixed)
    lines = writers.metis_rows(graph.adjacency_of_buckets(mixed, bound))
    assert rows(lines) == rows(writers.metis_lines(edges).filter("row_no > 0"))


def test_adjacency_sends_no_pairs(spark, hot):
    assert sent(spark, lambda: graph.adjacency_of_buckets(hot)) < LINEAR


def test_profiles_of_kmers_stay_where_they_are(spark):
    draw = random.Random(1)
    made = [(f"{i}", "".join(draw.choice("ABC") for _ in range(draw.randrange(60)))) for i in range(200)] + [("none", None)]
    twice = [("0", "ABCABCABC"), ("none", "CCCCCCC"), (None, "ABCABC"), (None, "CBACBA")]
    for own in (made, made + twice):
        df = spark.createDataFrame(own, "name string, sequence string")
        each = sketch.kmers(df, 6).groupBy("name").agg(graph.F.count("*"), graph.F.min("value"), graph.F.max("value"), graph.F.count_distinct("value"))
        assert sorted(rows_of(sketch.kmer_profiles(df, 6))) == sorted(rows_of(each))
    assert sent(spark, lambda: sketch.kmer_profiles(spark.createDataFrame(made, "name string, sequence string"), 6)) <= 300


def rows_of(df):
    return [(r[0] or "", *r[1:]) for r in map(tuple, df.collect())]


def test_refinement_sends_few_rows_per_membership(spark):
    """Twelve functions over 1,200 names in 12 buckets each: lists go from buckets to members, not a row per function and rank."""
    draw = random.Random(3)
    made = spark.createDataFrame([(f"{i}_1", h, [draw.randrange(40)]) for i in range(1200) for h in range(12)], ROWS).persist()
    cfg = SketchConfig(k=5, c=2, rounds=2, hashes=12)
    assert sent(spark, lambda: graph.neighbour_shingles_of_buckets(made, cfg)) < 8 * made.count()
    assert rows_of(graph.neighbour_shingles_of_buckets(made, cfg)) and rows(graph.neighbour_shingles_of_buckets(made, cfg)) == rows(graph.neighbour_shingles(graph.edges_first_hash(made), cfg))


def test_refinement_of_repeated_members(spark, mixed):
    """A name that is in a bucket twice doesn't take another one's place, in one Arrow batch or in several."""
    numbered = mixed.unionByName(mixed).filter("name <> 'alone_1'")
    cfg = SketchConfig(k=5, c=2, rounds=2, hashes=3)
    expected = rows(graph.neighbour_shingles(graph.edges_first_hash(numbered), cfg))
    assert expected and rows(graph.neighbour_shingles_of_buckets(numbered, cfg)) == expected
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert rows(graph.neighbour_shingles_of_buckets(numbered, cfg)) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("bucket", [1024, 1])
def test_arcs_of_names_in_many_buckets_are_counted_without_pairs(spark, mixed, monkeypatch, bucket):
    draw = random.Random(9)
    many = spark.createDataFrame([(f"{i}_1", h, [draw.randrange(3 + h)]) for i in range(80) for h in range(8)], ROWS)
    expected = [rows(graph.graph_counts(graph.level1_edges(x))) for x in (many, mixed)]
    monkeypatch.setattr(graph, "BUCKET", bucket)
    monkeypatch.setattr(bucketed.graph, "edges_first_hash", lambda *_: pytest.fail("pairs were made"))
    assert rows(bucketed.graph_counts(many)) == expected[0] and bucketed.arcs(many) == expected[0][0][1]
    monkeypatch.setattr(bucketed, "MOST", 0)
    assert rows(bucketed.graph_counts(mixed)) == expected[1]


def broadcasts(spark, make):
    """Broadcasts of joins while ``make()`` is made and counted, as Spark's SQL store has their plans."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    make().count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = store.executionsList(int(before), 1000)
    return sum(found.apply(i).physicalPlanDescription().count("BroadcastExchange") for i in range(found.size()))


@pytest.mark.parametrize("made", ["graph_counts", "label_spreading", "modularity", "degrees", "component_communities"])
def test_joins_of_names_pass_nothing_through_the_driver(spark, mixed, made):
    """Tables are small here, and so are compressed files of large ones: joins over names must be shuffles whatever is estimated."""
    of = {"label_spreading": lambda: bucketed.label_spreading(mixed, 3), "modularity": lambda: bucketed.modularity(mixed, graph.vertices(mixed).selectExpr("'x' label", "name member"))}
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20
    assert broadcasts(spark, of.get(made) or (lambda: getattr(bucketed, made)(mixed))) == 0


def test_search_passes_nothing_through_the_driver(spark):
    made = spark.createDataFrame([(f"{i}_1", "ACGTACGGTACCA"[i % 3 :]) for i in range(9)], "name string, sequence string")
    cfg = SketchConfig(k=5, hashes=3, difference=1, max_hashes=4, threshold=1.1, min_cluster_size=2)
    assert broadcasts(spark, lambda: search.search_trace(made, cfg)) == 0


def test_tasks_are_as_many_as_pairs_ask_for(spark, hot, monkeypatch):
    """1,500 members are a few KB, which adaptive execution would put into one task, and over a million pairs."""
    monkeypatch.setattr(graph, "PAIRS", 1 << 16, raising=False)
    made = graph.edges_first_hash(hot, 256).groupBy(graph.F.spark_partition_id()).count().toDF("task", "n")
    n, most, total = made.agg(graph.F.count("n"), graph.F.max("n"), graph.F.sum("n")).first()
    assert total == 1500 * 1499 // 2 and n > 8 and most < total / 4
