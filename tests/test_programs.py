"""Whole programs over files."""

import pytest

from sketchloom.config import SketchConfig
from sketchloom.operators import clusters as C
from sketchloom.operators import graph as G
from sketchloom.plans import programs
from sketchloom.sources import readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_graph_to_clusters_and_back(spark, tmp_path):
    fasta = put(tmp_path, "in.fa", "".join(f">{n}\n{s}\n" for n, s in [("1_1", "MKVLAAGTWQ"), ("2_1", "MKVLAAGTWR"), ("3_1", "MKVLAAGTYY"), ("7_1", "HHWWMKVLAA"), ("8_1", "CCCCCDDDDD")]))
    cfg = SketchConfig(k=3, c=2, rounds=1, hashes=6, seed=3)
    path = programs.fasta_to_graph(spark, fasta, f"{tmp_path}/", cfg, put(tmp_path, "done", "7_1\n"))
    assert path.endswith("in.fa_hash6_m1_kmer3")
    ids = dict(rows(readers.vertex_dictionary(spark, f"{path}_dictionary")))
    assert set(ids.values()) == {"1_1", "2_1", "3_1"}
    assert spark.read.text(path).first().value.split()[0] == "3"
    found = put(tmp_path, "communities", "4\n4\n9\n")
    programs.communities_to_clusters(spark, f"{path}_dictionary", found, str(tmp_path / "clusters"))
    assert rows(readers.kmv_clusters(spark, str(tmp_path / "clusters"))) == [("@4", "/1_1"), ("@4", "/2_1"), ("@9", "/3_1")]


def test_edges_to_metis(spark, tmp_path):
    line = "KV pair: proc 0, sizes 4 4, key {}, value {}\n"
    edges = put(tmp_path, "edges", "".join(line.format(a, b) for a, b in [("a_1", "b_1"), ("b_1", "a_1"), ("b_1", "c_1"), ("c_1", "b_1")]))
    programs.edges_to_metis(spark, edges, str(tmp_path / "metis"), put(tmp_path, "table", "a\t3\nb\t2\nc\t1\n"))
    assert [r.value for r in spark.read.text(str(tmp_path / "metis")).collect()] == ["3 2", "2 ", "1 3 ", "2 "]
    assert rows(readers.vertex_dictionary(spark, str(tmp_path / "metis_dictionary"))) == [(1, "1_1"), (2, "2_1"), (3, "3_1")]
    with pytest.raises(Exception, match="odd"):
        programs.edges_to_metis(spark, put(tmp_path, "odd", line.format("a_1", "b_1")), str(tmp_path / "x"))


def test_compare(spark, tmp_path):
    line = "KMV pair: proc 0, nvalues 2, sizes 9 4679, key @{}, values {}\n"
    test = put(tmp_path, "test", line.format(0, "/7_1 /8_1 /9_1") + line.format(1, "/7_2 /5_1"))
    base = put(tmp_path, "base", "7\ta\tb\tc\td\tF1\n8\ta\tb\tc\td\tF1\n9\ta\tb\tc\td\tF1\n7\ta\tb\tc\td\tF2\n5\ta\tb\tc\td\tF2\n")
    found = programs.compare_files(spark, test, base, "annotations", floor=2, out=str(tmp_path / "f"))
    assert found.first().f_avg == 1
    assert readers.f_file(spark, str(tmp_path / "f")) == 1
    assert programs.compare_files(spark, test, test, floor=2, top=1).first().f_avg == 1
    assert programs.compare_files(spark, test, put(tmp_path, "blocks", "Cluster: 1\n1 >7_1\n2 >8_1\n3 >9_1\n"), "blocks", floor=3).first().f_avg == 1


def test_relabelling(spark):
    clusters = spark.createDataFrame([("b", "x"), ("a", "y"), ("b", "z")], "label string, member string")
    assert rows(C.relabelled(clusters)) == [("@0", "y"), ("@1", "x"), ("@1", "z")]


def test_ties_of_top_clusters_by_place_in_the_file(spark, tmp_path):
    line = "KMV pair: proc 0, nvalues 2, sizes 9 4679, key @{}, values /{}_1 /{}_1\n"
    test = put(tmp_path, "tied", "".join(line.format(k, 2 * k, 2 * k + 1) for k in range(11)))
    base = put(tmp_path, "last", line.format(0, 20, 21))
    assert programs.compare_files(spark, test, base, floor=2, top=1).first().f_avg == 1
    found = programs.compare_files(spark, test, test, floor=2, mutual=True).first()
    assert abs(found.nmi_max - 1) < 1e-9 and abs(found.nmi_lfk - 1) < 1e-9


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_graph_files_of_buckets_equal_those_of_edges(spark, tmp_path, monkeypatch, bound):
    """Lists sent or shuffled, one range or several, folders or single files: the same bytes, and no arc is sent or kept."""
    draw = __import__("random").Random(4)
    made = [(f"{i}_1", h, [draw.randrange(6 + 3 * h)]) for i in range(50) for h in range(3)] + [("alone_1", 0, [99])]
    shingles = spark.createDataFrame(made, "name string, hash_idx int, vals array<long>").persist()
    edges = G.level1_edges(shingles)
    monkeypatch.setattr(programs, "RANGE_ARCS", 100)
    of = programs.adjacency_of_numbered
    monkeypatch.setattr(programs, "adjacency_of_numbered", lambda n, **how: of(n, bound, **how))
    monkeypatch.setattr(G, "edges_first_hash", lambda *_: pytest.fail("pairs were made as rows"))
    programs.write_graph(edges, f"{tmp_path}/edges", one_file=True)
    programs.write_graph_of_buckets(shingles, f"{tmp_path}/buckets", one_file=True)
    programs.write_graph_of_buckets(shingles, f"{tmp_path}/folder")
    for end in ("", "_edges", "_dictionary"):
        whole = (tmp_path / f"edges{end}").read_text()
        assert whole and (tmp_path / f"buckets{end}").read_text() == whole
        assert "".join(p.read_text() for p in sorted((tmp_path / f"folder{end}").glob("part-*"))) == whole
    programs.write_graph_of_buckets(shingles.filter("name = 'alone_1'"), f"{tmp_path}/none", one_file=True)
    assert [(tmp_path / f"none{end}").read_text() for end in ("", "_edges", "_dictionary")] == ["0 0\n", "", ""]
