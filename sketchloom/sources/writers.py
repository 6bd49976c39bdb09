"""Writers of the same formats: each makes the lines as a column and writes text in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.hashing import split_name
from sketchloom.operators.clusters import dictionary
from sketchloom.operators.graph import adjacency, both_ways, graph_counts, vertex_ids


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Write the column ``line``; with ``order``, part files in name order give the lines in order."""
    out = lines.orderBy(*order) if order else lines
    out.select("line").write.mode("overwrite").text(path)


def metis_lines(edges: DataFrame, ids: DataFrame | None = None, count_mode: str = "arcs", mode: str = "plain") -> DataFrame:
    """(row_no, line): a header of vertex and edge counts, then each vertex's neighbours, 1-based and ascending.

    ``count_mode``: ``arcs`` counts both directions, ``undirected`` pairs once. ``mode`` ``weighted`` ends the header in 0.
    """
    ids = ids if ids is not None else vertex_ids(edges)
    edge_count = F.col("arcs") if count_mode == "arcs" else F.col("undirected_edges")
    tail = [F.lit("0")] if mode == "weighted" else []
    header = graph_counts(both_ways(edges)).select(F.lit(0).cast("long").alias("row_no"), F.concat_ws(" ", F.col("vertices").cast("string"), edge_count.cast("string"), *tail).alias("line"))
    return header.unionByName(metis_rows(adjacency(edges, ids)))


def metis_rows(adjacent: DataFrame) -> DataFrame:
    """(row_no, line) of each vertex (id, neighbours)."""
    numbers = F.transform("neighbours", lambda i: i + 1).cast("array<string>")
    return adjacent.select((F.col("id") + 1).cast("long").alias("row_no"), F.concat(F.array_join(numbers, " "), F.lit(" ")).alias("line"))


def edge_rows(adjacent: DataFrame) -> DataFrame:
    """(row_no, line) of each vertex (id, neighbours): its lines of ``edge_lines``, in order."""
    each = F.transform("neighbours", lambda i: F.concat_ws(" ", (F.col("id") + 1).cast("string"), (i + 1).cast("string")))
    return adjacent.select((F.col("id") + 1).cast("long").alias("row_no"), F.array_join(each, "\n").alias("line"))


def headed(rows: DataFrame, header: str) -> DataFrame:
    """``rows`` (row_no, line) in ranges, with ``header`` as a line before that of row 1; rows stay where they are."""
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([(0, header)], "row_no long, line string")
    return rows.withColumn("line", F.when(F.col("row_no") == 1, F.concat_ws("\n", F.lit(header), "line")).otherwise(F.col("line")))


def metis_segments(edges: DataFrame, ids: DataFrame | None = None, count_mode: str = "arcs", mode: str = "plain") -> DataFrame:
    """(row_no, at, text): as ``metis_lines``, a row per neighbour; rows of one ``row_no``, in the order of ``at``, make its line.

    No neighbours are gathered, so a vertex may have any number of them.
    """
    ids = ids if ids is not None else vertex_ids(edges)
    edge_count = F.col("arcs") if count_mode == "arcs" else F.col("undirected_edges")
    tail = [F.lit("0")] if mode == "weighted" else []
    header = graph_counts(both_ways(edges)).select(F.lit(0).cast("long").alias("row_no"), F.lit(0).cast("long").alias("at"), F.concat_ws(" ", F.col("vertices").cast("string"), edge_count.cast("string"), *tail).alias("text"))
    arcs = edge_lines(edges, ids).select(F.col("s").cast("long").alias("row_no"), F.col("d").cast("long").alias("at"), F.concat(F.col("d").cast("string"), F.lit(" ")).alias("text"))
    return header.unionByName(arcs)


def kmv_segments(clusters: DataFrame) -> DataFrame:
    """(label, member, text): as ``kmv_lines``, a row per member behind a row without one that begins the line."""
    each = clusters.distinct()
    heads = each.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    begin = F.format_string("KMV pair: proc 0, nvalues %d, sizes 9 4679, key @%s, values", F.col("n"), F.col("label"))
    return heads.select("label", F.lit(None).cast("string").alias("member"), begin.alias("text")).unionByName(each.select("label", "member", F.concat(F.lit(" /"), "member").alias("text")))


def edge_lines(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(s, d, line): ``src dst`` as 1-based numbers, both directions."""
    s = ids.select((F.col("id") + 1).alias("s"), F.col("name").alias("src"))
    d = ids.select((F.col("id") + 1).alias("d"), F.col("name").alias("dst"))
    return both_ways(edges).join(s, "src").join(d, "dst").select("s", "d", F.concat_ws(" ", F.col("s").cast("string"), F.col("d").cast("string")).alias("line"))


def dictionary_lines(ids: DataFrame) -> DataFrame:
    """(row_no, line): ``#<1-based id> <name>``."""
    return ids.select((F.col("id") + 1).alias("row_no"), F.concat(F.lit("#"), (F.col("id") + 1).cast("string"), F.lit(" "), "name").alias("line"))


def kmv_lines(clusters: DataFrame) -> DataFrame:
    """(label, line): ``KMV pair:`` lines with marked members."""
    members = clusters.groupBy("label").agg(F.array_sort(F.collect_set("member")).alias("m"))
    text = F.format_string("KMV pair: proc 0, nvalues %d, sizes 9 4679, key @%s, values %s", F.size("m"), F.col("label"), F.array_join(F.transform("m", lambda x: F.concat(F.lit("/"), x)), " "))
    return members.select("label", text.alias("line"))


def kv_lines(edges: DataFrame) -> DataFrame:
    """(src, dst, line): ``KV pair:`` lines, one for each direction."""
    return both_ways(edges).select("src", "dst", F.format_string("KV pair: proc 0, sizes %d %d, key %s, value %s", F.length("src") + 1, F.length("dst") + 1, F.col("src"), F.col("dst")).alias("line"))


def fasta_lines(sequences: DataFrame) -> DataFrame:
    """(name, line): header and one line of sequence."""
    return sequences.select("name", F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("line"))


def conversion_lines(table: DataFrame) -> DataFrame:
    """(id, line): name, tab, id."""
    return table.select("id", F.concat_ws("\t", "name", F.col("id").cast("string")).alias("line"))


def _annotation_rows(lines: DataFrame) -> DataFrame:
    rows = lines.filter(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    return rows.select("line_no", F.split("value", "\t", 2).alias("c"))


def grown_table(lines: DataFrame, table: DataFrame) -> DataFrame:
    """(name, id): ``table`` and the names of annotation lines that it lacks, numbered on from its size in file order."""
    names = _annotation_rows(lines).groupBy(F.get("c", 0).alias("name")).agg(F.min("line_no").alias("position"))
    new = names.join(table.select("name").distinct(), "name", "left_anti")
    size = table.select("name").distinct().agg(F.count(F.lit(1)).alias("size"))
    numbered = dictionary(new).join(size).select("name", (F.col("id") + F.col("size")).alias("id"))
    return table.select("name", F.col("id").cast("long").alias("id")).unionByName(numbered)


def renumbered_annotations(lines: DataFrame, table: DataFrame) -> DataFrame:
    """(line_no, line): column 0 becomes its number in ``grown_table``; comments and empty lines are skipped."""
    known = grown_table(lines, table).select(F.col("name").alias("_n"), F.col("id").alias("_i"))
    joined = _annotation_rows(lines).join(known, F.get("c", 0) == F.col("_n"))
    return joined.select("line_no", F.concat_ws("\t", F.col("_i").cast("string"), F.get("c", 1)).alias("line"))


def numbered_fasta_lines(sequences: DataFrame, table: DataFrame) -> DataFrame:
    """(name, line): as ``fasta_lines``, sequences named ``id`` or ``id_region``."""
    base, region = split_name(F.col("name"))
    joined = sequences.withColumn("_b", base).withColumn("_r", region).join(table.select(F.col("name").alias("_n"), F.col("id").alias("_i")), F.col("_b") == F.col("_n"))
    return joined.select("name", F.concat(F.lit(">"), F.concat_ws("_", F.col("_i").cast("string"), "_r"), F.lit("\n"), "sequence").alias("line"))


def graph_name(prefix: str, fasta: str, hashes: int, rounds: int, k: int) -> str:
    """The name under which a graph of these parameters is kept."""
    return f"{prefix}{fasta}_hash{hashes}_m{rounds}_kmer{k}"


def cluster_name(prefix: str, k: int, c: int, rounds: int, component_rounds: int, hashes: int) -> str:
    """The name under which clusters of these parameters are kept."""
    return f"{prefix}_k{k}sh{c}m{rounds}cc{component_rounds}h{hashes}"
