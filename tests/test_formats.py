"""Round trips and awkward files of the text formats."""

import os

import pytest

from sketchloom.config import SketchConfig
from sketchloom.functions import storage
from sketchloom.functions.hashing import hash_params, params_table
from sketchloom.operators import graph, sketch
from sketchloom.operators.clusters import numbers_to_names
from sketchloom.sources import readers, writers
from sketchloom.streaming.sketches import stream_shingles


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(tmp_path, text, name="in.txt"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "\n\n>1_1 some words\r\nMKV\r\nLAA\r\n>2_1\nAB>CD\n>3_1\n>1_1 some words\nOTHER\n>" + "x" * 250 + "\nKK")
    assert rows(readers.fasta(spark, path)) == [("1_1 some words", "MKVLAA"), ("2_1", "AB>CD"), ("x" * 199, "KK")]
    assert ("3_1", "") in rows(readers.fasta(spark, path, drop_empty=False))
    back = spark.createDataFrame([("1_1", "MKV"), ("2_1", "AA")], "name string, sequence string")
    out = str(tmp_path / "out")
    writers.write_lines(writers.fasta_lines(back), out, ["name"])
    assert rows(readers.fasta(spark, out)) == rows(back)


def test_order_of_files_of_unlike_sizes(spark, tmp_path):
    """A scan reads the largest pieces first; lines are numbered in the order of the files all the same."""
    out, lines = tmp_path / "out", [f"line {i} " + "x" * (i % 50) for i in range(1200)]
    out.mkdir()
    for name, own in (("part-00000-a.txt", lines[:3]), ("part-00001-a.txt", lines[3:900]), ("part-00002-a.txt", lines[900:905]), ("part-100000-a.txt", lines[905:])):
        (out / name).write_text("".join(f"{x}\n" for x in own))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("4096", "20000", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "16")
            assert [r["value"] for r in readers.numbered_lines(spark, str(out)).orderBy("line_no").collect()] == lines
            assert [r["line_no"] for r in readers.numbered_lines(spark, str(out)).orderBy("line_no").collect()] == list(range(1200))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_first_record_of_a_name_across_files(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "part-00000-a.txt").write_text(">1_1\nFIRST\n")
    (out / "part-00001-a.txt").write_text(">1_1\nSECOND\n>2_1\n" + "A" * 500 + "\n")
    assert rows(readers.fasta(spark, str(out))) == [("1_1", "FIRST"), ("2_1", "A" * 500)]


def test_family_of_a_seed(spark):
    """Hash parameters by their definition, computed by another engine."""
    import duckdb

    draw = "(('0x' || substr(sha256('7/' || i || '/{0}'), 1, 16))::UBIGINT % 2147483647)::BIGINT"
    expected = duckdb.sql(f"SELECT i, 1 + {draw.format('a')} % 1280000002, {draw.format('b')} FROM range(50) t(i) ORDER BY i").fetchall()
    assert rows(params_table(spark, hash_params(7, 50))) == expected


def test_kmv(spark, tmp_path):
    clusters = spark.createDataFrame([("9", "3_1"), ("9", "1_1"), ("10", "2_1")], "label string, member string")
    out = str(tmp_path / "out")
    writers.write_lines(writers.kmv_lines(clusters), out, ["label"])
    assert rows(readers.kmv_clusters(spark, out)) == [("@10", "/2_1"), ("@9", "/1_1"), ("@9", "/3_1")]
    assert rows(readers.kmv_clusters(spark, out, rename=True, floor=2)) == [("@9", "1"), ("@9", "3")]
    line = "KMV pair: proc 0, nvalues 2, sizes 9 4679, key @0, values "
    twice = put(tmp_path, f"noise\n{line}/1_1 /3_1\n{line}/5_1\n")
    assert rows(readers.kmv_clusters(spark, twice)) == [("@0", "/1_1"), ("@0", "/3_1")]


def test_kv_edges_and_metis(spark, tmp_path):
    edges = spark.createDataFrame([("a_1", "b_1"), ("b_1", "c_1")], "src string, dst string")
    out = str(tmp_path / "kv")
    writers.write_lines(writers.kv_lines(edges), out)
    read = readers.kv_edges(spark, out)
    assert rows(read) == rows(graph.both_ways(edges))
    assert rows(readers.kv_edge_counts(read)) == [(3, 2)]
    with pytest.raises(Exception, match="odd"):
        readers.kv_edge_counts(read.limit(1)).collect()
    known = spark.createDataFrame([("a", 1), ("b", 2)], "name string, id long")
    assert rows(readers.kv_edges(spark, out, known)) == [("0_1", "2_1"), ("1_1", "2_1"), ("2_1", "0_1"), ("2_1", "1_1")]
    ids = graph.vertex_ids(edges)
    lines = [r.line for r in writers.metis_lines(edges, ids).orderBy("row_no").collect()]
    assert lines == ["3 4", "2 ", "1 3 ", "2 "]
    assert writers.metis_lines(edges, ids, "undirected", "weighted").orderBy("row_no").first().line == "3 2 0"
    assert [r.line for r in writers.edge_lines(edges, ids).orderBy("s", "d").collect()] == ["1 2", "2 1", "2 3", "3 2"]
    names = str(tmp_path / "names")
    writers.write_lines(writers.dictionary_lines(ids), names, ["row_no"])
    assert rows(readers.vertex_dictionary(spark, names)) == [(1, "a_1"), (2, "b_1"), (3, "c_1")]


def test_annotations(spark, tmp_path):
    path = put(tmp_path, "7\ta\tb\tc\td\tF1\tz\n7\ta\tb\tc\td\tF2\n8\ta\tb\tc\td\tF1\nshort\tline\n")
    assert rows(readers.annotations(spark, path)) == [("F1", "/7_1"), ("F1", "/8_1"), ("F2", "/7_2")]
    assert rows(readers.annotations(spark, path, whole=True, floor=2)) == [("F1", "7"), ("F1", "8")]
    table = spark.createDataFrame([("7", 1), ("8", 2), ("short", 3)], "name string, id long")
    lines = writers.renumbered_annotations(readers.numbered_lines(spark, path), table).orderBy("line_no").collect()
    assert [r.line for r in lines][::2] == ["1\ta\tb\tc\td\tF1\tz", "2\ta\tb\tc\td\tF1"]


def test_cluster_blocks(spark, tmp_path):
    path = put(tmp_path, "head\nCluster: 1\n1 >a_1\n2 >b_1\nCluster: 2\n>c_1\n")
    assert rows(readers.cluster_blocks(spark, path)) == [("0", "/a_1"), ("0", "/b_1"), ("1", "/c_1")]
    assert rows(readers.cluster_blocks(spark, path, rename=True, floor=2)) == [("0", "a"), ("0", "b")]


def test_small_files(spark, tmp_path):
    assert readers.hash_parameters(spark, put(tmp_path, "3\n4\n5\n6\n", "a")) == [(3, 4), (5, 6)]
    with pytest.raises(ValueError):
        readers.hash_parameters(spark, put(tmp_path, "3\n", "b"))
    assert rows(readers.communities(spark, put(tmp_path, "5\n5\n7\n", "c"))) == [(1, 5), (2, 5), (3, 7)]
    assert rows(readers.names(spark, put(tmp_path, "x\n\ny", "d"))) == [("x",), ("y",)]
    table = spark.createDataFrame([("x", 1), ("y", 2)], "name string, id long")
    out = str(tmp_path / "table")
    writers.write_lines(writers.conversion_lines(table), out)
    assert rows(readers.conversion_table(spark, out)) == rows(table)
    assert readers.f_file(spark, put(tmp_path, "0.5\n", "e")) == 0.5
    assert writers.graph_name("out/", "large", 41, 2, 6) == "out/large_hash41_m2_kmer6"


def test_stream(spark, tmp_path):
    cfg = SketchConfig(k=3, c=2, hashes=2, seed=1)
    base = spark.createDataFrame([("1_1", "MKVLAAG"), ("2_1", "MKVLAAGT")], "name string, sequence string")
    base.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    query = stream_shingles(stream, cfg, str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("name", "hash_idx", "vals")) == rows(sketch.shingles(base, cfg))


def test_floor_before_the_label_rule(spark, tmp_path):
    line = "KMV pair: proc 0, nvalues 2, sizes 9 4679, key @0, values "
    path = put(tmp_path, f"{line}/5_1\n{line}/1_1 /3_1\n{line}/7_1 /8_1\n")
    assert rows(readers.kmv_clusters(spark, path, floor=2, position=True)) == [("@0", "/1_1", 1), ("@0", "/3_1", 1)]
    assert rows(readers.kmv_clusters(spark, path)) == [("@0", "/5_1")]
    regions = put(tmp_path, f"{line}/5_1 /5_2\n{line}/1_1 /3_1\n", "regions")
    assert rows(readers.kmv_clusters(spark, regions, rename=True, floor=2)) == [("@0", "1"), ("@0", "3")]


def test_renumbering_grows_its_table(spark, tmp_path):
    path = put(tmp_path, "# head\n9\ta\n7\tb\n9\tc\n8\td\n\n3\n")
    table = spark.createDataFrame([("7", 1), ("1", 2)], "name string, id long")
    lines = writers.renumbered_annotations(readers.numbered_lines(spark, path), table).orderBy("line_no").collect()
    assert [r.line for r in lines] == ["3\ta", "1\tb", "3\tc", "4\td", "5"]
    assert rows(writers.grown_table(readers.numbered_lines(spark, path), table)) == [("1", 2), ("3", 5), ("7", 1), ("8", 4), ("9", 3)]


def test_names_and_sizes(spark, tmp_path):
    path = put(tmp_path, "Cluster: 1\n1 >a_1\nCluster: 2\n1 >b_1\n2 >c_1\n3 >c_2\n")
    assert readers.largest_block(spark, path) == 3 and readers.largest_block(spark, path, rename=True) == 2
    assert readers.largest_block(spark, put(tmp_path, "nothing\n", "none")) == 0
    assert writers.cluster_name("out/x", 6, 2, 2, 1, 41) == "out/x_k6sh2m2cc1h41"
    clusters = spark.createDataFrame([("x", "1"), ("x", "2")], "label string, member string")
    table = spark.createDataFrame([("a", 1)], "name string, id long")
    assert rows(numbers_to_names(clusters, table)) == [("x", "2"), ("x", "a")]
    assert bytes(readers.raw(spark, path).first().content).startswith(b"Cluster: 1\n")


def test_shared_folder_off_local_masters(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Elsewhere
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)


def test_tables_of_a_scope_go(spark, tmp_path):
    with storage.scratch_scope(spark):
        table = storage.materialise(spark.range(3), "scoped")
        path = table.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_broadcasts_are_bounded_by_bytes(spark):
    many = storage.materialise(spark.range(10).selectExpr("id", "array_repeat(id, 1000) as a", "repeat('x', 500) as s", "struct(id as i, 'abc' as t) as u"), "wide")
    assert 10 * 8500 < storage.table_bytes(many) < 10 * 9500
    plan = lambda bound: storage.join_checked(spark.range(5), many, ["id"], max_bytes=bound)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(1 << 20) and "strategy=broadcast" not in plan(1000)
