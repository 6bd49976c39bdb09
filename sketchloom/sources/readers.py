"""Readers of the text formats that sequence clustering exchanges. All are distributed scans.

Formats that depend on line order get line numbers from the sizes of the pieces that files are read in, not from one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchloom.functions.hashing import bare_name
from sketchloom.operators.clusters import annotation_ordinals, first_of_label, largest, with_floor

NAME_LIMIT = 199


def _placed(spark: SparkSession, path: str, **options) -> DataFrame:
    """(value, file, start, _id): lines, the piece of a file that each came from, and numbers that rise within a piece.

    A scan deals pieces of files by size, the largest first, so only file and start tell their order. Files are in the order of
    their part numbers, if they have any, then of their paths.
    """
    rows = spark.read.options(**options).text(path)
    name, number = F.col("_metadata.file_path"), F.regexp_extract("_metadata.file_path", r"/part-(\d+)[^/]*$", 1)
    file = F.struct(F.coalesce(number.try_cast("long"), F.lit(-1)).alias("number"), name.alias("path"))
    return rows.select("value", file.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("_id"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value, part): lines with 0-based numbers in the order of files and lines, and the number of the piece they came from."""
    rows = _placed(spark, path)
    counts = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))  # one row per piece
    order = Window.orderBy("file", "start")
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("file", "start", "_first", before.alias("_before"), (F.row_number().over(order) - 1).cast("long").alias("part"))
    return rows.join(F.broadcast(placed), ["file", "start"]).select((F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"), "value", "part")


def fasta(spark: SparkSession, path: str, drop_empty: bool = True) -> DataFrame:
    """(name, sequence): records split at a line that starts with ``>``; the first record of a name counts.

    Names are whole header lines, cut to 199 characters. Carriage returns and line feeds go from sequences.
    """
    records = _placed(spark, path, lineSep="\n>").withColumn("_id", F.struct("file", "start", "_id"))
    body = F.regexp_replace("value", r"^\s*>?", "")
    parts = records.select("_id", F.split(body, "\n", 2).alias("p")).filter(F.get("p", 0) != "")
    named = parts.select("_id", F.regexp_replace(F.substring(F.get("p", 0), 1, NAME_LIMIT), "\r$", "").alias("name"), F.regexp_replace(F.coalesce(F.get("p", 1), F.lit("")), "[\r\n]", "").alias("sequence"))
    if drop_empty:
        named = named.filter("sequence <> ''")
    return named.groupBy("name").agg(F.min_by("sequence", "_id").alias("sequence"))


def hash_parameters(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(a, b) pairs of a file of one integer per line, a before b."""
    values = [r["v"] for r in numbered_lines(spark, path).filter("trim(value) <> ''").orderBy("line_no").select(F.trim("value").cast("long").alias("v")).collect()]
    if len(values) % 2:
        raise ValueError(f"{path}: {len(values)} numbers do not make pairs")
    return list(zip(values[::2], values[1::2]))


def names(spark: SparkSession, path: str) -> DataFrame:
    """(name): one per line, blank lines skipped."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''").distinct()


def raw(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content): whole files as they are."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def kmv_clusters(spark: SparkSession, path: str, rename: bool = False, floor: int = 0, position: bool = False) -> DataFrame:
    """(label, member) from ``KMV pair:`` lines: the label is token 10 without its comma, members follow token 11.

    Of lines with one label the first that reaches ``floor`` counts. ``rename`` cuts members to their sequence.
    ``position`` adds the number of the line.
    """
    tokens = numbered_lines(spark, path).filter(F.startswith("value", F.lit("KMV pair:"))).select("line_no", F.split(F.trim("value"), r"\s+").alias("t"))
    rows = tokens.select("line_no", F.regexp_replace(F.get("t", 10), ",$", "").alias("label"), F.explode(F.slice("t", 13, F.greatest(F.size("t") - 12, F.lit(0)))).alias("member"))
    if rename:
        rows = rows.withColumn("member", bare_name(F.col("member")))
    clusters = first_of_label(rows, floor)
    return clusters if position else clusters.drop("position")


def kv_edges(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(src, dst) from ``KV pair:`` lines (tokens 8 and 10); with ``ids`` (name, id), sequences become numbers and unknown ones 0."""
    tokens = spark.read.text(path).filter(F.startswith("value", F.lit("KV pair:"))).select(F.split(F.trim("value"), r"\s+").alias("t"))
    edges = tokens.select(F.regexp_replace(F.get("t", 8), ",$", "").alias("src"), F.get("t", 10).alias("dst"))
    if ids is None:
        return edges
    for side in ("src", "dst"):
        known = ids.select(F.col("name").alias("_n"), F.col("id").alias("_i"))
        base, region = F.regexp_extract(side, r"^(.*?)(_[^_]*)?$", 1), F.regexp_extract(side, r"(_[^_]*)$", 1)
        edges = edges.withColumn("_b", base).withColumn("_r", region).join(known, F.col("_b") == F.col("_n"), "left")
        edges = edges.withColumn(side, F.concat(F.coalesce("_i", F.lit(0)).cast("string"), "_r")).drop("_b", "_r", "_n", "_i")
    return edges


def kv_edge_counts(edges: DataFrame) -> DataFrame:
    """One row (vertices, edges) of a file with a line for each direction; an odd number of lines is an error."""
    counted = edges.agg(F.count_distinct("src").alias("vertices"), F.count(F.lit(1)).alias("n"))
    half = F.when(F.col("n") % 2 == 1, F.raise_error(F.lit("the number of directed edges is odd"))).otherwise((F.col("n") / 2).cast("long"))
    return counted.select("vertices", half.alias("edges"))


def annotations(spark: SparkSession, path: str, whole: bool = False, floor: int = 0, position: bool = False) -> DataFrame:
    """(label, member) from a tab-separated table: column 0 names the sequence, column 5 the family.

    ``position`` adds the number of the family's first line.
    """
    columns = numbered_lines(spark, path).select("line_no", F.split("value", "\t").alias("c")).filter(F.size("c") >= 6)
    rows = columns.select("line_no", F.get("c", 0).alias("seq"), F.get("c", 5).alias("family"))
    clusters = annotation_ordinals(rows, whole)
    clusters = with_floor(clusters, floor) if floor else clusters
    if not position:
        return clusters
    return clusters.join(rows.groupBy(F.col("family").alias("label")).agg(F.min("line_no").alias("position")), "label").select("label", "member", "position")


def largest_block(spark: SparkSession, path: str, rename: bool = False) -> int:
    """The size of the largest ``Cluster:`` block, before any floor; 0 without blocks."""
    return largest(cluster_blocks(spark, path, rename)).first()["largest"] or 0


def cluster_blocks(spark: SparkSession, path: str, rename: bool = False, floor: int = 0, position: bool = False) -> DataFrame:
    """(label, member) from blocks under ``Cluster:`` lines; labels are block numbers from 0.

    A member is what follows the first blank, without ``>``; ``rename`` cuts it at the first underscore,
    else it gets a leading ``/``. Lines before the first block are skipped.
    """
    lines = numbered_lines(spark, path).withColumn("_h", F.contains("value", F.lit("Cluster:")).cast("long"))
    heads = lines.groupBy("part").agg(F.sum("_h").alias("_n"))  # one row per partition
    before = heads.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.sum("_h").over(Window.partitionBy("part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    placed = lines.join(before, "part").withColumn("_c", F.col("_before") + within - 1).filter("_h = 0 and _c >= 0 and trim(value) <> ''")
    text = F.trim("value")
    member = F.regexp_replace(F.when(F.contains(text, F.lit(" ")), F.expr("substring(trim(value), instr(trim(value), ' ') + 1)")).otherwise(text), "^>", "")
    member = F.regexp_extract(member, "^([^_]*)", 1) if rename else F.concat(F.lit("/"), member)
    clusters = placed.select(F.col("_c").cast("string").alias("label"), member.alias("member")).distinct()
    clusters = with_floor(clusters, floor) if floor else clusters
    return clusters.withColumn("position", F.col("label").cast("long")) if position else clusters


def vertex_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) from lines ``#<id> <name>``."""
    line = r"^#(\d+) (\S+)"
    rows = spark.read.text(path).select(F.regexp_extract("value", line, 1).alias("i"), F.regexp_extract("value", line, 2).alias("name"))
    return rows.filter("i <> ''").select(F.col("i").cast("long").alias("id"), "name")


def communities(spark: SparkSession, path: str, first_id: int = 1) -> DataFrame:
    """(vertex_id, community): line n names the community of vertex n, counted from ``first_id``."""
    return numbered_lines(spark, path).filter("trim(value) <> ''").select((F.col("line_no") + first_id).alias("vertex_id"), F.trim("value").cast("long").alias("community"))


def conversion_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) from two tab-separated columns."""
    columns = spark.read.text(path).select(F.split("value", "\t").alias("c")).filter(F.size("c") >= 2)
    return columns.select(F.get("c", 0).alias("name"), F.get("c", 1).cast("long").alias("id"))


def f_file(spark: SparkSession, path: str) -> float:
    """The number on the first line of a file."""
    return float(spark.read.text(path).first()["value"])
