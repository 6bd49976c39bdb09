"""Registered queries that write a text format and read it again, over the driver's tables, with SQL for what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.config import SketchConfig
from sketchloom.functions.storage import materialise, scratch_path
from sketchloom.operators import clusters as C
from sketchloom.operators import graph as G
from sketchloom.operators.sketch import display, merge_sketches, shingles
from sketchloom.plans import programs
from sketchloom.sources import ranges, readers, single, writers

PIECES = SketchConfig(k=6, c=2, rounds=2, hashes=4, seed=7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(lines: DataFrame, label: str, order: list[str] | None = None) -> str:
    path = scratch_path(lines.sparkSession, label)
    writers.write_lines(lines, path, order)
    return path


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation; members are named like regions."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("label"), F.concat(F.col("c_custkey").cast("string"), F.lit("_1")).alias("member"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and types that some part has both of."""
    return table(spark, sf_dir, "part").select(F.concat(F.substring("p_brand", 7, 9), F.lit("_1")).alias("src"), F.concat(F.length("p_type").cast("string"), F.lit("_2")).alias("dst")).distinct()


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, line): orders as annotation lines, customer by priority."""
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.concat_ws("\t", F.col("o_custkey").cast("string"), F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("line"))


def file_fasta(spark, sf_dir):
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("_1")).alias("name"), letters.alias("sequence"))
    return readers.fasta(spark, written(writers.fasta_lines(docs), "fasta"))


def file_fasta_repeated(spark, sf_dir):
    """Documents as records under the name of their source: the first record of each name that has letters counts."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("name"), letters.alias("sequence"))
    lines = docs.select("doc_id", F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("line"))
    return readers.fasta(spark, written(lines, "fasta", ["doc_id"]))


def file_fasta_ranges(spark, sf_dir):
    """The same file by byte ranges of a megabyte, sequences in pieces of 10,000 letters."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("_1")).alias("name"), letters.alias("sequence"))
    return ranges.sequences(spark, written(writers.fasta_lines(docs), "fasta"), range_bytes=1 << 20, piece_letters=10_000)


def file_sketches_of_pieces(spark, sf_dir):
    """Sketches of sequences that are read in overlapping pieces and never put together."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("_1")).alias("name"), letters.alias("sequence"))
    pieces = ranges.pieces(spark, written(writers.fasta_lines(docs), "fasta"), range_bytes=1 << 20, piece_letters=1000, overlap=PIECES.k - 1)
    rows = shingles(pieces.select("name", F.col("piece").alias("sequence")), PIECES)
    return merge_sketches(rows, rows.limit(0), PIECES.c).select("name", display().alias("shingle"))


def file_metis_single(spark, sf_dir):
    """Row n of a METIS file that is one file, written by several tasks."""
    edges = part_edges(spark, sf_dir)
    path = f"{scratch_path(spark, 'single')}.graph"
    single.write_single(writers.metis_segments(edges, G.vertex_ids(edges), "undirected"), path, ["row_no", "at"], "row_no")
    lines = readers.numbered_lines(spark, path)
    return materialise(lines.select(F.col("line_no").alias("row_no"), "value"), "read")


def file_kmv_clusters(spark, sf_dir):
    return readers.kmv_clusters(spark, written(writers.kmv_lines(nations(spark, sf_dir)), "kmv"), floor=5)


def file_kv_edges(spark, sf_dir):
    found = readers.kv_edges(spark, written(writers.kv_lines(part_edges(spark, sf_dir)), "kv"))
    return found.crossJoin(readers.kv_edge_counts(found))  # the counts are one row


def file_metis(spark, sf_dir):
    """Row n of the METIS file, by its neighbours."""
    edges = part_edges(spark, sf_dir)
    path = written(writers.metis_lines(edges, G.vertex_ids(edges), "undirected"), "metis", ["row_no"])
    lines = readers.numbered_lines(spark, path)
    return lines.select(F.col("line_no").alias("row_no"), "value")


def file_edge_list(spark, sf_dir):
    edges = part_edges(spark, sf_dir)
    path = written(writers.edge_lines(edges, G.vertex_ids(edges)), "edge-list", ["s", "d"])
    return readers.numbered_lines(spark, path).select("line_no", "value")


def file_dictionary(spark, sf_dir):
    return readers.vertex_dictionary(spark, written(writers.dictionary_lines(G.vertex_ids(part_edges(spark, sf_dir))), "dictionary", ["row_no"]))


def file_communities(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("line"))
    return readers.communities(spark, written(rows, "communities", ["c_custkey"]))


def file_community_clusters(spark, sf_dir):
    """A dictionary and a line of community per vertex as clusters."""
    ids = G.vertex_ids(part_edges(spark, sf_dir))
    dictionary = written(writers.dictionary_lines(ids), "dictionary", ["row_no"])
    found = written(ids.select("id", (F.col("id") % 3).cast("string").alias("line")), "communities", ["id"])
    out = scratch_path(spark, "community-clusters")
    programs.communities_to_clusters(spark, dictionary, found, out)
    return readers.kmv_clusters(spark, out)


def file_conversion_table(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return readers.conversion_table(spark, written(writers.conversion_lines(rows), "conversion"))


def file_names(spark, sf_dir):
    return readers.names(spark, written(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("line")), "names"))


def file_hash_parameters(spark, sf_dir):
    path = written(table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws("\n", F.col("n_nationkey").cast("string"), (F.col("n_nationkey") * 7 + 1).cast("string")).alias("line")), "parameters", ["n_nationkey"])
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(readers.hash_parameters(spark, path))], "hash_idx int, a long, b long")


def file_annotations(spark, sf_dir):
    return readers.annotations(spark, written(annotated(spark, sf_dir), "annotations", ["o_orderkey"]), position=True)


def file_renumbered_annotations(spark, sf_dir):
    """Customers below 500 have numbers; the others get the next ones in the order of their lines."""
    lines = readers.numbered_lines(spark, written(annotated(spark, sf_dir), "annotations", ["o_orderkey"]))
    known = table(spark, sf_dir, "customer").filter("c_custkey <= 500").select(F.col("c_custkey").cast("string").alias("name"), F.col("c_custkey").alias("id"))
    path = written(writers.renumbered_annotations(lines, known), "renumbered", ["line_no"])
    return readers.numbered_lines(spark, path).select("line_no", "value")


def file_commented_annotations(spark, sf_dir):
    """Annotation lines, a comment in front of those of urgent orders: comments keep their numbers and go."""
    orders = annotated(spark, sf_dir).withColumn("at", F.lit(1))
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    comments = urgent.select("o_orderkey", F.concat_ws("\t", F.concat(F.lit("#"), F.col("o_custkey").cast("string")), "o_orderstatus").alias("line"), F.lit(0).alias("at"))
    lines = readers.numbered_lines(spark, written(orders.unionByName(comments), "commented", ["o_orderkey", "at"]))
    known = table(spark, sf_dir, "customer").filter("c_custkey <= 500").select(F.col("c_custkey").cast("string").alias("name"), F.col("c_custkey").alias("id"))
    return writers.renumbered_annotations(lines, known)


def file_cluster_blocks(spark, sf_dir):
    blocks = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(-1).cast("long").alias("at"), F.concat(F.lit("Cluster: "), "n_name").alias("line"))
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_custkey").alias("at"), F.concat(F.lit("1 >"), F.col("c_custkey").cast("string"), F.lit("_4")).alias("line"))
    path = written(blocks.unionByName(members), "blocks", ["n_nationkey", "at"])
    return readers.cluster_blocks(spark, path, rename=True, floor=2).withColumn("largest", F.lit(readers.largest_block(spark, path)).cast("long"))


def file_names_of_numbers(spark, sf_dir):
    """Members that are numbers get names back; those without one stay numbers."""
    table_ = table(spark, sf_dir, "customer").filter("c_custkey <= 500").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("label"), F.col("c_custkey").cast("string").alias("member"))
    return C.numbers_to_names(rows, table_)


def file_comparison(spark, sf_dir):
    """Two cluster files compared by the program: customers by nation and by market segment within it."""
    segments = table(spark, sf_dir, "customer").select(F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("label"), F.concat(F.col("c_custkey").cast("string"), F.lit("_1")).alias("member"))
    paths = [written(writers.kmv_lines(x), "compared") for x in (nations(spark, sf_dir), segments)]
    out = scratch_path(spark, "f-value")
    found = programs.compare_files(spark, *paths, floor=2, out=out)
    read = round(readers.f_file(spark, out), 9)
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns), F.lit(read).alias("f_read"))


def file_comparison_of_largest(spark, sf_dir):
    """The ten largest clusters of either file, members cut to the sequence of which they are a region: two customers make one."""
    region = F.concat_ws("_", F.expr("c_custkey div 2").cast("string"), (F.col("c_custkey") % 2).cast("string")).alias("member")
    customers = table(spark, sf_dir, "customer")
    labels = (F.col("c_nationkey").cast("string"), F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment"))
    paths = [written(writers.kmv_lines(customers.select(x.alias("label"), region)), "compared", ["label"]) for x in labels]
    found = programs.compare_files(spark, *paths, floor=2, top=10, rename=True)
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


def file_named_clusters(spark, sf_dir):
    """A cluster file under the name of its parameters, read whole: name, length and digest."""
    path = f"{scratch_path(spark, 'named')}/{writers.cluster_name('nations', 6, 2, 2, 3, 41)}"
    single.write_single(writers.kmv_segments(nations(spark, sf_dir)), path, ["label", "member"], "label")
    return readers.raw(spark, path).select(F.substring_index("path", "/", -1).alias("name"), "length", F.md5("content").alias("digest"))


def edge_difference(spark, sf_dir):
    """Edges that are left without those of short types."""
    edges = part_edges(spark, sf_dir)
    return G.difference(edges, edges.filter("cast(split_part(dst, '_', 1) as int) < 7"))


QUERIES = {
    f.__name__: f
    for f in (
        file_fasta, file_fasta_ranges, file_sketches_of_pieces, file_metis_single, file_kmv_clusters, file_kv_edges, file_metis, file_edge_list, file_dictionary, file_communities, file_community_clusters,
        file_conversion_table, file_names, file_hash_parameters, file_annotations, file_renumbered_annotations, file_cluster_blocks,
        file_names_of_numbers, file_comparison, edge_difference, file_fasta_repeated, file_commented_annotations, file_comparison_of_largest,
        file_named_clusters,
    )
}

_EDGES = """pe AS (SELECT DISTINCT substring(p_brand, 7, 9) || '_1' AS src, length(p_type)::VARCHAR || '_2' AS dst FROM part),
arcs AS (SELECT src, dst FROM pe UNION SELECT dst, src FROM pe), ids AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT src AS name FROM arcs)),
numbered AS (SELECT s.id AS s, d.id AS d FROM arcs JOIN ids s ON s.name = src JOIN ids d ON d.name = dst)"""
_LINES = "lines AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no FROM orders)"
_F = "2 * (n / sx) * (n / sy) / ((n / sx) + (n / sy))"

ORACLES = {
    "file_metis_single": f"WITH {_EDGES} SELECT 0::BIGINT AS row_no, (SELECT count(*) FROM ids) || ' ' || (SELECT count(*) // 2 FROM arcs) AS value UNION ALL SELECT s, string_agg(d::VARCHAR, ' ' ORDER BY d) || ' ' FROM numbered GROUP BY s",
    "file_fasta": "SELECT doc_id::VARCHAR || '_1' AS name, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents WHERE regexp_matches(text, '[A-Za-z]')",
    "file_kmv_clusters": "SELECT '@' || c_nationkey AS label, '/' || c_custkey || '_1' AS member FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 5)",
    "file_kv_edges": f"WITH {_EDGES} SELECT src, dst, (SELECT count(*) FROM ids) AS vertices, (SELECT count(*) // 2 FROM arcs) AS edges FROM arcs",
    "file_metis": f"WITH {_EDGES} SELECT 0::BIGINT AS row_no, (SELECT count(*) FROM ids) || ' ' || (SELECT count(*) // 2 FROM arcs) AS value UNION ALL SELECT s, string_agg(d::VARCHAR, ' ' ORDER BY d) || ' ' FROM numbered GROUP BY s",
    "file_edge_list": f"WITH {_EDGES} SELECT row_number() OVER (ORDER BY s, d) - 1 AS line_no, s || ' ' || d AS value FROM numbered",
    "file_dictionary": f"WITH {_EDGES} SELECT id, name FROM ids",
    "file_communities": "SELECT row_number() OVER (ORDER BY c_custkey) AS vertex_id, c_nationkey::BIGINT AS community FROM customer",
    "file_community_clusters": f"WITH {_EDGES} SELECT '@' || (id - 1) % 3 AS label, '/' || name AS member FROM ids",
    "file_conversion_table": "SELECT s_name AS name, s_suppkey AS id FROM supplier",
    "file_names": "SELECT DISTINCT s_name AS name FROM supplier",
    "file_hash_parameters": "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS hash_idx, n_nationkey::BIGINT AS a, (n_nationkey * 7 + 1)::BIGINT AS b FROM nation",
    "file_annotations": f"WITH {_LINES} SELECT o_orderpriority AS label, '/' || o_custkey || '_' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS member, min(line_no) OVER (PARTITION BY o_orderpriority) AS position FROM lines",
    "file_renumbered_annotations": f"""WITH {_LINES}, new AS (SELECT o_custkey, row_number() OVER (ORDER BY min(line_no)) + (SELECT count(*) FROM customer WHERE c_custkey <= 500) AS id FROM lines
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey <= 500) GROUP BY o_custkey)
      SELECT line_no, coalesce(id, o_custkey)::VARCHAR || chr(9) || concat_ws(chr(9), 'a', 'b', 'c', 'd', o_orderpriority, o_orderstatus) AS value FROM lines LEFT JOIN new USING (o_custkey)""",
    "file_cluster_blocks": """WITH blocks AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS block FROM nation), sizes AS (SELECT c_nationkey, count(*) AS size FROM customer GROUP BY 1)
      SELECT block::VARCHAR AS label, c_custkey::VARCHAR AS member, (SELECT max(size) FROM sizes) AS largest FROM customer JOIN blocks ON n_nationkey = c_nationkey JOIN sizes USING (c_nationkey) WHERE size >= 2""",
    "file_names_of_numbers": "SELECT c_nationkey::VARCHAR AS label, CASE WHEN c_custkey <= 500 THEN c_name ELSE c_custkey::VARCHAR END AS member FROM customer",
    "file_comparison": f"""WITH x AS (SELECT c_nationkey, count(*) AS sx FROM customer GROUP BY 1 HAVING count(*) >= 2), y AS (SELECT c_nationkey, c_mktsegment, count(*) AS sy FROM customer GROUP BY 1, 2 HAVING count(*) >= 2),
      f AS (SELECT *, {_F} AS f FROM (SELECT x.c_nationkey, c_mktsegment, sx, sy, sy AS n FROM x JOIN y USING (c_nationkey))),
      t AS (SELECT sum(sx * best) / sum(sx) AS v FROM (SELECT x.c_nationkey, sx, coalesce(max(f), 0) AS best FROM x LEFT JOIN f USING (c_nationkey, sx) GROUP BY ALL)), b AS (SELECT sum(sy * f) / sum(sy) AS v FROM f)
      SELECT round(t.v, 9) AS f_test, round(b.v, 9) AS f_base, round((t.v + b.v) / 2, 9) AS f_avg, round((t.v + b.v) / 2, 9) AS f_read FROM t, b""",
    "file_fasta_repeated": "SELECT name, arg_min(sequence, doc_id) AS sequence FROM (SELECT doc_id, coalesce(source, 'none') AS name, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents) WHERE sequence <> '' GROUP BY name",
    "file_commented_annotations": """WITH lines AS (SELECT *, row_number() OVER (ORDER BY o_orderkey, place) - 1 AS line_no FROM (SELECT o_orderkey, 1 AS place, o_custkey, o_orderpriority, o_orderstatus FROM orders
      UNION ALL SELECT o_orderkey, 0, o_custkey, NULL, NULL FROM orders WHERE o_orderpriority = '1-URGENT')),
      new AS (SELECT o_custkey, row_number() OVER (ORDER BY min(line_no)) + (SELECT count(*) FROM customer WHERE c_custkey <= 500) AS id FROM lines
      WHERE place = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey <= 500) GROUP BY o_custkey)
      SELECT line_no, coalesce(id, o_custkey)::VARCHAR || chr(9) || concat_ws(chr(9), 'a', 'b', 'c', 'd', o_orderpriority, o_orderstatus) AS line FROM lines LEFT JOIN new USING (o_custkey) WHERE place = 1""",
    "file_comparison_of_largest": f"""WITH m AS (SELECT c_nationkey::VARCHAR AS xl, c_nationkey || '-' || c_mktsegment AS yl, c_custkey // 2 AS member FROM customer),
      xm AS (SELECT DISTINCT xl, member FROM m), ym AS (SELECT DISTINCT yl, member FROM m),
      x AS (SELECT xl, count(*) AS sx FROM xm GROUP BY xl HAVING count(*) >= 2 ORDER BY sx DESC, xl DESC LIMIT 10), y AS (SELECT yl, count(*) AS sy FROM ym GROUP BY yl HAVING count(*) >= 2 ORDER BY sy DESC, yl DESC LIMIT 10),
      f AS (SELECT *, {_F} AS f FROM (SELECT xl, yl, count(*) AS n FROM xm JOIN ym USING (member) GROUP BY ALL) JOIN x USING (xl) JOIN y USING (yl)),
      t AS (SELECT sum(sx * best) / sum(sx) AS v FROM (SELECT x.xl, x.sx, coalesce(max(f), 0) AS best FROM x LEFT JOIN f ON f.xl = x.xl GROUP BY ALL)),
      b AS (SELECT sum(sy * best) / sum(sy) AS v FROM (SELECT y.yl, y.sy, coalesce(max(f), 0) AS best FROM y LEFT JOIN f ON f.yl = y.yl GROUP BY ALL))
      SELECT round(t.v, 9) AS f_test, round(b.v, 9) AS f_base, round((t.v + b.v) / 2, 9) AS f_avg FROM t, b""",
    "file_named_clusters": """WITH m AS (SELECT c_nationkey::VARCHAR AS label, c_custkey || '_1' AS member FROM customer),
      l AS (SELECT label, 'KMV pair: proc 0, nvalues ' || count(*) || ', sizes 9 4679, key @' || label || ', values ' || string_agg('/' || member, ' ' ORDER BY member) || chr(10) AS line FROM m GROUP BY label),
      w AS (SELECT string_agg(line, '' ORDER BY label) AS content FROM l) SELECT 'nations_k6sh2m2cc3h41' AS name, strlen(content) AS length, md5(content) AS digest FROM w""",
    "edge_difference": f"WITH {_EDGES} SELECT src, dst FROM pe WHERE split_part(dst, '_', 1)::INT >= 7",
}
ORACLES["file_fasta_ranges"] = ORACLES["file_fasta"]
