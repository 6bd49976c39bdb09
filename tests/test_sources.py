"""Byte ranges of FASTA files, single-file sinks, and the stream that keeps sketches."""

import os
import random

import pytest

from sketchloom.config import SketchConfig
from sketchloom.operators import graph, sketch
from sketchloom.sources import ranges, readers, single, writers
from sketchloom.streaming import sketches

TEXT = "\n>a one\r\nACGT\r\nAC\n>b\n\n>\nXXX\n>c\nGG>GG\nTT\n>a one\nZZZ\n>dlong\n" + "\n".join("ACGTACGTAC" for _ in range(9)) + "\n>e"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ranges_of_every_size_and_step(spark, tmp_path):
    (tmp_path / "f.fa").write_bytes(TEXT.encode())
    expected = rows(readers.fasta(spark, f"file://{tmp_path}/f.fa"))
    data = TEXT.encode()
    for size in range(1, len(data) + 2):
        for step in (1, 2, 3, 7, 50):
            found = {}
            for a in range(0, len(data), size):
                for at, name, part, piece in ranges.records(lambda p, n: data[p : p + n], a, min(a + size, len(data)), 8, 0, step):
                    found.setdefault((at, name), []).append((part, piece))
            first = {}
            for (_, name), parts in sorted(found.items()):
                assert sorted(parts) == [(i, p) for i, (_, p) in enumerate(parts)] and all(len(p) >= 8 for _, p in parts[:-1])
                first.setdefault(name, "".join(p for _, p in parts))
            assert sorted((n, s) for n, s in first.items() if s) == expected


@pytest.mark.parametrize("size", [1, 10, 37, 10_000])
def test_fasta_data_source(spark, tmp_path, size):
    (tmp_path / "f.fa").write_bytes(TEXT.encode())
    (tmp_path / "_hidden").write_text(">no\nAAA")
    expected = rows(readers.fasta(spark, f"file://{tmp_path}/f.fa"))
    assert rows(ranges.sequences(spark, f"file://{tmp_path}", range_bytes=size, piece_letters=8)) == expected
    assert ("e", "") in rows(ranges.sequences(spark, f"file://{tmp_path}", drop_empty=False, range_bytes=size))


def test_sketches_of_overlapping_pieces(spark, tmp_path):
    draw = random.Random(1)
    made = [(f"s{i}", "".join(draw.choice("ACGT") for _ in range(draw.choice([3, 7, 50, 400])))) for i in range(20)]
    (tmp_path / "f.fa").write_text("".join(f">{n}\n{s}\n" for n, s in made))
    cfg = SketchConfig(k=4, c=3, hashes=3, seed=5)
    pieces = ranges.pieces(spark, f"file://{tmp_path}/f.fa", range_bytes=100, piece_letters=20, overlap=3)
    parts = sketch.shingles(pieces.selectExpr("name", "piece as sequence"), cfg)
    assert pieces.filter("part > 0").count() > 10
    assert rows(sketch.merge_sketches(parts, parts.limit(0), 3)) == rows(sketch.shingles(spark.createDataFrame(made, "name string, sequence string"), cfg))


def hub(spark):
    return spark.createDataFrame([(f"v{i:03}", f"v{j:03}") for i in range(120) for j in range(i) if j == 0 or (i * j) % 11 == 3], "src string, dst string")


@pytest.mark.parametrize("partitions", [1, 8])
def test_one_file_of_equal_bytes(spark, tmp_path, partitions):
    edges = hub(spark)
    ids = graph.vertex_ids(edges).persist()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for count_mode, mode in (("arcs", "plain"), ("undirected", "weighted")):
            size = single.write_single(writers.metis_segments(edges, ids, count_mode, mode), f"{tmp_path}/graph", ["row_no", "at"], "row_no")
            expected = "".join(r["line"] + "\n" for r in writers.metis_lines(edges, ids, count_mode, mode).orderBy("row_no").collect())
            assert (tmp_path / "graph").read_text() == expected and size == len(expected)
        single.write_lines_single(writers.edge_lines(edges, ids), f"file://{tmp_path}/edges", ["s", "d"])
        assert (tmp_path / "edges").read_text() == "".join(r["line"] + "\n" for r in writers.edge_lines(edges, ids).orderBy("s", "d").collect())
        clusters = edges.selectExpr("src as label", "dst as member")
        single.write_single(writers.kmv_segments(clusters), f"{tmp_path}/kmv", ["label", "member"], "label")
        assert (tmp_path / "kmv").read_text() == "".join(r["line"] + "\n" for r in writers.kmv_lines(clusters).orderBy("label").collect())
        assert rows(readers.kmv_clusters(spark, f"file://{tmp_path}/kmv")) == sorted((f"@{a}", f"/{b}") for a, b in rows(clusters))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(os.listdir(tmp_path)) == ["edges", "graph", "kmv"]


def test_copies_of_a_retried_task_leave_no_double(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "piece").write_bytes(b"one\ntwo")
    (tmp_path / "whole").write_bytes(b"")
    batch = pa.RecordBatch.from_pydict({"path": [str(tmp_path / "piece")], "at": [4], "size": [7], "closes": [True]})
    for _ in range(2):
        assert [b.to_pylist() for b in single._copy(str(tmp_path / "whole"))([batch])] == [[{"size": 8}]]
    assert (tmp_path / "whole").read_bytes() == b"\0\0\0\0one\ntwo\n"


def test_file_without_rows(spark, tmp_path):
    (tmp_path / "none").write_text("old")
    assert single.write_single(writers.metis_segments(hub(spark)).limit(0), f"{tmp_path}/none", ["row_no", "at"], "row_no") == 0
    assert (tmp_path / "none").read_bytes() == b""


def test_state_of_a_stream_equals_the_batch_also_after_restarts(spark, tmp_path):
    draw = random.Random(1)
    made = [(f"n{draw.randrange(6)}", "".join(draw.choice("ACGT") for _ in range(draw.randint(2, 30)))) for _ in range(60)]
    cfg = SketchConfig(k=3, c=2, hashes=3)
    for b in range(3):
        spark.createDataFrame(made[b * 20 : b * 20 + 20], "name string, sequence string").coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("name string, sequence string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = sketches.stream_merged_sketches(source, cfg, f"{tmp_path}/out", f"{tmp_path}/checkpoint", availableNow=True)
        query.awaitTermination()
        whole = sketch.shingles(spark.createDataFrame(made[: b * 20 + 20], "name string, sequence string"), cfg)
        assert rows(sketches.current_sketches(spark, f"{tmp_path}/out")) == rows(sketch.merge_sketches(whole, whole.limit(0), 2))


def test_copies_of_packed_and_plain_pieces(tmp_path):
    import pyarrow as pa

    with pa.CompressedOutputStream(pa.OSFile(f"{tmp_path}/one{single.PACKED}", "wb"), "zstd") as out:
        out.write(b"packed")
    (tmp_path / "two").write_bytes(b"plain")
    (tmp_path / "whole").write_bytes(b"")
    batch = pa.RecordBatch.from_pydict({"path": [f"{tmp_path}/one{single.PACKED}", f"{tmp_path}/two"], "at": [0, 7], "size": [6, 5], "closes": [True, False]})
    assert [b.to_pylist() for b in single._copy(str(tmp_path / "whole"))([batch])] == [[{"size": 7}], [{"size": 5}]]
    assert (tmp_path / "whole").read_bytes() == b"packed\nplain"
