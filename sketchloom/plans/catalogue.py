"""The registered queries over the driver's tables, and the SQL that must agree with them.

Documents serve as sequences: their letters, upper-cased, under the name ``<doc_id>_1``. Clusterings come
from attributes of the tables. The SQL is put together from common table expressions, so each oracle is
the definition of its operator over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.config import SketchConfig
from sketchloom.functions.hashing import PRIME, letters_only, vertex_value
from sketchloom.functions.storage import materialise, scratch_path
from sketchloom.operators import bucketed as B
from sketchloom.operators import clusters as C
from sketchloom.operators import components as CC
from sketchloom.operators import evaluate as E
from sketchloom.operators import graph as G
from sketchloom.operators import growth as R
from sketchloom.operators import search as S
from sketchloom.operators import sketch as K
from sketchloom.plans import files, programs
from sketchloom.sources import readers as RD
from sketchloom.sources import writers as W
from sketchloom.streaming import sketches as T

CFG = SketchConfig(k=6, c=2, rounds=2, hashes=4, seed=7)
GROWN = (4, 6, 8)
GROWTH = SketchConfig(k=6, c=2, rounds=2, hashes=6, difference=2, max_hashes=40, threshold=0.8, min_cluster_size=10, seed=7)
SEARCH = SketchConfig(k=6, c=2, rounds=2, hashes=4, difference=2, max_hashes=6, threshold=1.1, min_cluster_size=2, seed=7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("_1")).alias("name"), letters_only(F.col("text")).alias("sequence"))


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: several branches of a plan read them."""
    return materialise(K.shingles(sequences(spark, sf_dir), CFG), "sketches")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges_first_hash(sketches(spark, sf_dir))


def by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.col("p_partkey").cast("string").alias("member"))


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("label"), F.col("p_partkey").cast("string").alias("member"))


def positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by nation, clusters in the order of their numbers."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("label"), F.col("c_nationkey").alias("position"), F.col("c_custkey").cast("string").alias("member"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def doc_sequences(spark, sf_dir):
    return sequences(spark, sf_dir)


def kmer_profile(spark, sf_dir):
    return K.kmer_profiles(sequences(spark, sf_dir), CFG.k)


def min_hashes(spark, sf_dir):
    found = sketches(spark, sf_dir)
    return found.select("name", "hash_idx", F.posexplode("vals").alias("rank", "h"))


def shingles(spark, sf_dir):
    return sketches(spark, sf_dir).select("name", K.display().alias("shingle"))


def bucket_sizes(spark, sf_dir):
    return G.bucket_sizes(sketches(spark, sf_dir)).select(K.display().alias("shingle"), "members")


def level1_edges(spark, sf_dir):
    return G.level1_edges(sketches(spark, sf_dir))


def level1_degree(spark, sf_dir):
    return B.degrees(sketches(spark, sf_dir))


def edges_first_hash(spark, sf_dir):
    return edges(spark, sf_dir)


def vertex_values(spark, sf_dir):
    return sequences(spark, sf_dir).select("name", vertex_value(F.col("name")).alias("value"))


def level2_shingles(spark, sf_dir):
    return G.neighbour_shingles_of_buckets(sketches(spark, sf_dir), CFG).select("name", K.display().alias("shingle"))


def level2_edges(spark, sf_dir):
    return S.similarity_graph(sequences(spark, sf_dir), CFG)


def refined_once(spark, sf_dir):
    """The graph of one round, which is the level-1 graph."""
    return S.similarity_graph(sequences(spark, sf_dir), replace(CFG, rounds=1))


def refined_thrice(spark, sf_dir):
    """The graph of three rounds: neighbourhoods of the refined graph are sketched once more."""
    return S.similarity_graph(sequences(spark, sf_dir), replace(CFG, rounds=3))


def closed_neighbourhoods(spark, sf_dir):
    return C.marked(G.closed_neighbourhoods_of_buckets(sketches(spark, sf_dir)))


def vertex_ids(spark, sf_dir):
    return G.dense_numbers(G.vertices(sketches(spark, sf_dir)), "name", "id").select("id", "name")


def merged_sketches(spark, sf_dir):
    """Sketches of whole languages, from those of their documents: stored rows updated by new ones."""
    lang = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("_1")).alias("name"), "doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    rows = sketches(spark, sf_dir).join(lang, "name").select(F.col("lang").alias("name"), "doc_id", "hash_idx", "vals")
    old, new = rows.filter("doc_id % 2 = 0").drop("doc_id"), rows.filter("doc_id % 2 = 1").drop("doc_id")
    return K.merge_sketches(old, new, CFG.c).select("name", K.display().alias("shingle"))


def metis_rows(spark, sf_dir):
    return W.metis_rows(G.adjacency_of_buckets(sketches(spark, sf_dir)))


def metis_header(spark, sf_dir):
    return B.graph_counts(sketches(spark, sf_dir))


def components_min_label(spark, sf_dir):
    return CC.propagated_components(G.star_edges(sketches(spark, sf_dir)))


def components_hash_to_min(spark, sf_dir):
    return CC.star_components(G.star_edges(sketches(spark, sf_dir)))


def components_union_find(spark, sf_dir):
    return CC.union_find_components(G.star_edges(sketches(spark, sf_dir)))


def finalised_anti_join(spark, sf_dir):
    done = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.concat(F.col("doc_id").cast("string"), F.lit("_1")).alias("name"))
    return C.without_finalised(sequences(spark, sf_dir).select("name"), done)


def label_blacklist(spark, sf_dir):
    unwanted = table(spark, sf_dir, "part").filter("p_size > 49").select(F.col("p_brand").alias("label")).distinct()
    return C.without_labels(by_brand(spark, sf_dir), unwanted)


def dictionary_encoding(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.concat(F.col("o_custkey").cast("string"), F.lit("_"), F.col("o_orderstatus")).alias("name"), F.col("o_orderkey").alias("position"))
    return C.dictionary(rows, domained=True)


def annotation_ordinals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("seq"), F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("line_no"))
    return C.annotation_ordinals(rows)


def cluster_floor(spark, sf_dir):
    return C.with_floor(by_type(spark, sf_dir), 15)


def largest_cluster(spark, sf_dir):
    return C.largest(by_brand(spark, sf_dir))


def top_k_clusters(spark, sf_dir):
    return C.top_k(positioned(spark, sf_dir), 5)


def renamed_members(spark, sf_dir):
    rows = sketches(spark, sf_dir)
    members = G.vertices(rows).select(F.concat(F.lit("/"), "name").alias("member"))
    return C.renamed(C.marked(G.closed_neighbourhoods_of_buckets(rows)), C.apart(members))


def intersections(spark, sf_dir):
    return E.intersections(by_brand(spark, sf_dir), by_type(spark, sf_dir))


def best_matches(spark, sf_dir):
    return rounded(E.best_matches(by_brand(spark, sf_dir), by_type(spark, sf_dir)), "best")


def f_value(spark, sf_dir):
    return rounded(E.f_value(by_brand(spark, sf_dir), by_type(spark, sf_dir)), "f_test", "f_base", "f_avg")


def nmi(spark, sf_dir):
    parts = table(spark, sf_dir, "part").count()
    return rounded(E.nmi(by_brand(spark, sf_dir), by_type(spark, sf_dir), parts), "h_x", "h_y", "h_x_given_y", "h_y_given_x", "nmi_max", "nmi_lfk")


def search_trace(spark, sf_dir):
    """Two steps of the search only (4 and 5 hashes against 2 and 3), whose threshold of 1.1 no F reaches: not the defaults of SketchConfig."""
    return rounded(S.search_trace(sequences(spark, sf_dir), SEARCH), "f")


def search_growth(spark, sf_dir):
    """The search from 6 hash functions on, each number against that less two, until F reaches 0.8 among clusters of ten or more."""
    return rounded(S.search_trace(sequences(spark, sf_dir), GROWTH), "f")


def search_stored(spark, sf_dir):
    """One step of the search twice over a store: with clusters of its own making, then with those it finds."""
    once, store = replace(SEARCH, max_hashes=5), scratch_path(spark, "store")
    runs = [S.search_trace(sequences(spark, sf_dir), once, store=store).withColumn("run", F.lit(n)) for n in (1, 2)]
    return rounded(runs[0].unionByName(runs[1]), "f")


def file_graph_program(spark, sf_dir):
    """The whole program: a FASTA file, less the sequences of toxic documents, to a METIS file in one piece under the name of its parameters."""
    folder, done = scratch_path(spark, "program"), table(spark, sf_dir, "labels").filter("toxic = 1")
    W.write_lines(W.fasta_lines(sequences(spark, sf_dir).filter("sequence is not null")), f"{folder}/docs.fa")
    W.write_lines(done.select(F.concat(F.col("doc_id").cast("string"), F.lit("_1")).alias("line")), f"{folder}/done")
    path = programs.fasta_to_graph(spark, f"{folder}/docs.fa", f"{folder}/of_", CFG, f"{folder}/done", one_file=True)
    return RD.numbered_lines(spark, path).select(F.lit(path.rsplit("/", 1)[-1]).alias("file"), F.col("line_no").alias("row_no"), "value")


def refinement_growth(spark, sf_dir):
    """Refined graphs of 4, 6 and 8 hash functions, each carried on from the one before."""
    growing = R.GrowingRefinement(S.GrowingSketches(sequences(spark, sf_dir), replace(CFG, hashes=8), 8), CFG)
    graphs = [growing.graph(h).select(F.lit(h).alias("hashes"), "src", "dst") for h in GROWN]
    return graphs[0].unionByName(graphs[1]).unionByName(graphs[2])


def modularity_components(spark, sf_dir):
    """Modularity of the components of the level-1 graph, and of one community of all its vertices, which is 0."""
    rows = sketches(spark, sf_dir)
    parts = CC.star_components(G.star_edges(rows)).select("label", F.col("node").alias("member"))
    both = [B.modularity(rows, x).withColumn("of", F.lit(n)) for n, x in (("components", parts), ("all", parts.select(F.lit("x").alias("label"), "member")))]
    return rounded(both[0].unionByName(both[1]).select("of", "modularity"), "modularity")


def louvain_communities(spark, sf_dir):
    """Communities of high modularity of the refined graph."""
    return B.louvain_communities(S.similarity_shingles(sequences(spark, sf_dir), CFG))[0]


def label_spreading(spark, sf_dir):
    """Labels after two rounds of spreading over the level-1 graph: the most frequent one around each vertex, of equal ones the least."""
    return B.label_spreading(sketches(spark, sf_dir), rounds=2)


def streamed_sketches(spark, sf_dir):
    """Sketches of whole languages, kept in the state of a stream that reads the documents."""
    source = table(spark, sf_dir, "documents")
    # A pattern, as a stream's plain path must be a folder and the table may be one file.
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/documents.parque[t]")
    rows = stream.select(F.coalesce("lang", F.lit("none")).alias("name"), letters_only(F.col("text")).alias("sequence"))
    path = scratch_path(spark, "stream")
    T.stream_merged_sketches(rows, CFG, f"{path}/rows", f"{path}/checkpoint", availableNow=True).awaitTermination()
    return T.current_sketches(spark, f"{path}/rows").select("name", K.display().alias("shingle"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        doc_sequences, kmer_profile, min_hashes, shingles, bucket_sizes, level1_edges, level1_degree, edges_first_hash, vertex_values,
        level2_shingles, level2_edges, closed_neighbourhoods, vertex_ids, merged_sketches, metis_rows, metis_header, components_min_label,
        components_hash_to_min, components_union_find, finalised_anti_join, label_blacklist, dictionary_encoding, annotation_ordinals,
        cluster_floor, largest_cluster, top_k_clusters, renamed_members, intersections, best_matches, f_value, nmi, search_trace,
        search_growth, refinement_growth, modularity_components, louvain_communities, label_spreading, streamed_sketches,
        refined_once, refined_thrice, search_stored, file_graph_program,
    )
} | files.QUERIES


def _family(cfg: SketchConfig, n: int) -> str:
    return "fam(hash_idx, a, b) AS (VALUES " + ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(replace(cfg, hashes=n).family)) + ")"


_FAMILY = _family(CFG, CFG.hashes)
_VALUE = " + ".join(f"c[i + {j}] * {20 ** (5 - j)}::BIGINT" for j in range(6))
_CTES = f"""{_FAMILY},
seqs AS (SELECT doc_id::VARCHAR || '_1' AS name, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents),
codes AS (SELECT name, list_transform(string_split(s, ''), lambda x: ascii(x) - 65) AS c FROM seqs WHERE length(s) >= 6),
kmers AS (SELECT name, unnest(list_transform(range(1, len(c) - 4), lambda i: {_VALUE})) AS value FROM codes),
hashed AS (SELECT name, hash_idx, ((value % {PRIME}) * a + b) % {PRIME} AS h FROM kmers, fam),
least AS (SELECT name, hash_idx, min(h, 2) AS vals FROM hashed GROUP BY name, hash_idx HAVING count(*) >= 2),
sh AS (SELECT name, hash_idx, hash_idx::VARCHAR || '$' || array_to_string(vals, '$') AS shingle FROM least),
e1 AS (SELECT x.name AS src, y.name AS dst, min(x.hash_idx)::INT AS first_hash FROM sh x JOIN sh y USING (shingle) WHERE x.name < y.name GROUP BY ALL),
arcs AS (SELECT src, dst FROM e1 UNION ALL SELECT dst, src FROM e1),
vv AS (SELECT name, split_part(name, '_', 1)::BIGINT + 10000000 * (split_part(name, '_', 2)::BIGINT + 1) AS value FROM seqs),
hashed2 AS (SELECT src AS name, hash_idx, dst, ((value % {PRIME}) * a + b) % {PRIME} AS h FROM arcs JOIN vv ON vv.name = dst, fam),
ranked2 AS (SELECT *, row_number() OVER (PARTITION BY name, hash_idx ORDER BY h, dst) AS r FROM hashed2),
sh2 AS (SELECT name, hash_idx::VARCHAR || '$' || string_agg(h::VARCHAR, '$' ORDER BY h) AS shingle FROM ranked2 WHERE r <= 2 GROUP BY name, hash_idx HAVING count(*) = 2),
ids AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT src AS name FROM arcs)),
brand AS (SELECT p_brand AS label, p_partkey::VARCHAR AS member FROM part),
typ AS (SELECT p_type AS label, p_partkey::VARCHAR AS member FROM part),
bs AS (SELECT label, count(DISTINCT member) AS size FROM brand GROUP BY label),
ts AS (SELECT label, count(DISTINCT member) AS size FROM typ GROUP BY label),
met AS (SELECT b.label AS x_label, t.label AS y_label, count(*) AS common FROM brand b JOIN typ t USING (member) GROUP BY ALL),
pairs AS (SELECT x_label, y_label, bs.size AS x_size, ts.size AS y_size, common FROM met JOIN bs ON bs.label = x_label JOIN ts ON ts.label = y_label),
f AS (SELECT *, 2 * (common / x_size) * (common / y_size) / ((common / x_size) + (common / y_size)) AS f FROM pairs),
best AS (SELECT 'X' AS side, label, size, coalesce(max(f), 0) AS best FROM bs LEFT JOIN f ON x_label = label GROUP BY ALL
  UNION ALL SELECT 'Y', label, size, coalesce(max(f), 0) FROM ts LEFT JOIN f ON y_label = label GROUP BY ALL)"""


def _sql(body: str, recursive: str = "") -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_CTES}{', ' + recursive if recursive else ''} {body}"


_ARCS2 = "arcs2 AS (SELECT DISTINCT x.name AS src, y.name AS dst FROM sh2 x JOIN sh2 y USING (shingle) WHERE x.name <> y.name)"
_SH3 = f"""{_ARCS2},
hashed3 AS (SELECT src AS name, hash_idx, dst, ((value % {PRIME}) * a + b) % {PRIME} AS h FROM arcs2 JOIN vv ON vv.name = dst, fam),
ranked3 AS (SELECT *, row_number() OVER (PARTITION BY name, hash_idx ORDER BY h, dst) AS r FROM hashed3),
sh3 AS (SELECT name, hash_idx::VARCHAR || '$' || string_agg(h::VARCHAR, '$' ORDER BY h) AS shingle FROM ranked3 WHERE r <= 2 GROUP BY name, hash_idx HAVING count(*) = 2)"""

#: The SQL of the growing search has steps up to this number of functions.
GROWN_TO = 12
_REACH = "reach(node, seen) AS (SELECT src, src FROM arcs UNION SELECT node, dst FROM reach JOIN arcs ON seen = src)"
_COMPONENTS = _sql("SELECT node, min(seen) AS label FROM reach GROUP BY node", _REACH)
_H = "CASE WHEN {0} > 0 THEN -({0}) * log2(({0}) / n) ELSE 0 END"


def _h(w: str) -> str:
    return "(" + _H.format(f"({w})") + ")"


def _conditional(mine: str, other: str) -> str:
    """H of the clusters of ``mine`` given those of ``other``, over all pairs."""
    joint = " + ".join(_h(x) for x in "abcd") + f" - {_h('b + d')} - {_h('a + c')}"
    match = "p.x_label = m.label AND p.y_label = o.label" if mine == "bs" else "p.y_label = m.label AND p.x_label = o.label"
    return f"""(SELECT sum(least) FROM (SELECT label, min(CASE WHEN {_h('a')} + {_h('d')} >= {_h('b')} + {_h('c')}
      THEN (CASE WHEN {joint} < 2.220446049250313e-16 THEN 0 ELSE {joint} END) ELSE {_h('c + d')} + {_h('a + b')} END) AS least
      FROM (SELECT m.label, coalesce(common, 0)::DOUBLE AS d, m.size - d AS c, o.size - d AS b, n - b - c - d AS a, n
        FROM {mine} m CROSS JOIN {other} o LEFT JOIN pairs p ON {match}, (SELECT count(*)::DOUBLE AS n FROM part)) GROUP BY label))"""


def _refined(h: int) -> str:
    """The refined graph of the first ``h`` functions."""
    return f"""arcs_of_{h} AS (SELECT DISTINCT x.name AS src, y.name AS dst FROM sh x JOIN sh y USING (shingle) WHERE x.name <> y.name AND x.hash_idx < {h}),
hashed_of_{h} AS (SELECT src AS name, hash_idx, dst, ((value % {PRIME}) * a + b) % {PRIME} AS h FROM arcs_of_{h} JOIN vv ON vv.name = dst, fam WHERE hash_idx < {h}),
ranked_of_{h} AS (SELECT *, row_number() OVER (PARTITION BY name, hash_idx ORDER BY h, dst) AS r FROM hashed_of_{h}),
again_of_{h} AS (SELECT name, hash_idx::VARCHAR || '$' || string_agg(h::VARCHAR, '$' ORDER BY h) AS shingle FROM ranked_of_{h} WHERE r <= 2 GROUP BY name, hash_idx HAVING count(*) = 2),
refined_of_{h} AS (SELECT DISTINCT x.name AS src, y.name AS dst FROM again_of_{h} x JOIN again_of_{h} y USING (shingle) WHERE x.name <> y.name)"""


def _searched(h: int, floor: int = 2) -> str:
    """The refined graph of the first ``h`` functions, its components, and the sizes of those of ``floor`` members or more."""
    return f"""{_refined(h)},
reach_of_{h}(node, seen) AS (SELECT src, src FROM refined_of_{h} UNION SELECT node, dst FROM reach_of_{h} JOIN refined_of_{h} ON seen = src),
part_of_{h} AS (SELECT node AS member, min(seen) AS label FROM reach_of_{h} GROUP BY node), size_of_{h} AS (SELECT label, count(*) AS size FROM part_of_{h} GROUP BY label HAVING count(*) >= {floor})"""


def _step(h: int, base: int) -> str:
    met = f"(SELECT x.label AS xl, y.label AS yl, count(*) AS n FROM part_of_{h} x JOIN part_of_{base} y USING (member) GROUP BY ALL)"
    score = f"(SELECT xl, yl, sx.size AS sx, sy.size AS sy, 2 * (n / sx.size) * (n / sy.size) / ((n / sx.size) + (n / sy.size)) AS f FROM {met} JOIN size_of_{h} sx ON sx.label = xl JOIN size_of_{base} sy ON sy.label = yl)"
    side = lambda own, label: f"(SELECT sum(size * best) / sum(size) FROM (SELECT s.label, s.size, coalesce(max(f), 0) AS best FROM {own} s LEFT JOIN {score} ON {label} = s.label GROUP BY ALL))"
    return f"SELECT {h} AS hashes, {base} AS base_hashes, (SELECT count(*) FROM refined_of_{h}) AS arcs, (SELECT count(*) FROM refined_of_{base}) AS base_arcs, round(({side(f'size_of_{h}', 'xl')} + {side(f'size_of_{base}', 'yl')}) / 2, 9) AS f"


def _entropy(of: str) -> str:
    return f"(SELECT sum({_h('size')} + {_h('n - size')}) FROM {of}, (SELECT count(*)::DOUBLE AS n FROM part))"


ORACLES: dict[str, str] = {
    "doc_sequences": _sql("SELECT name, s AS sequence FROM seqs"),
    "kmer_profile": _sql("SELECT name, count(*) AS kmers, min(value) AS least, max(value) AS most, count(DISTINCT value) AS kinds FROM kmers GROUP BY name"),
    "min_hashes": _sql("SELECT name, hash_idx, unnest([0, 1])::INT AS rank, unnest(vals) AS h FROM least"),
    "shingles": _sql("SELECT name, shingle FROM sh"),
    "bucket_sizes": _sql("SELECT shingle, count(DISTINCT name) AS members FROM sh GROUP BY shingle"),
    "level1_edges": _sql("SELECT src, dst FROM arcs"),
    "level1_degree": _sql("SELECT src, count(*) AS degree FROM arcs GROUP BY src"),
    "edges_first_hash": _sql("SELECT src, dst, first_hash FROM e1"),
    "vertex_values": _sql("SELECT name, value FROM vv"),
    "level2_shingles": _sql("SELECT name, shingle FROM sh2"),
    "level2_edges": _sql("SELECT DISTINCT x.name AS src, y.name AS dst FROM sh2 x JOIN sh2 y USING (shingle) WHERE x.name <> y.name"),
    "closed_neighbourhoods": _sql("SELECT '@' || src AS label, '/' || dst AS member FROM arcs UNION SELECT '@' || src, '/' || src FROM arcs"),
    "vertex_ids": _sql("SELECT id, name FROM ids"),
    "merged_sketches": _sql(
        "SELECT name, hash_idx || '$' || array_to_string(min(v, 2), '$') AS shingle FROM (SELECT coalesce(lang, 'none') AS name, hash_idx, unnest(vals) AS v FROM least l JOIN documents d ON d.doc_id::VARCHAR || '_1' = l.name) GROUP BY name, hash_idx"
    ),
    "search_trace": "WITH RECURSIVE " + _CTES.replace(_FAMILY, _family(SEARCH, SEARCH.max_hashes - 1)) + ", " + ", ".join(_searched(h) for h in (2, 3, 4, 5)) + " " + _step(4, 2) + " UNION ALL " + _step(5, 3),
    "search_growth": "WITH RECURSIVE " + _CTES.replace(_FAMILY, _family(GROWTH, GROWN_TO)) + ", " + ", ".join(_searched(h, GROWTH.floor) for h in range(4, GROWN_TO + 1))
    + ", steps AS (" + " UNION ALL ".join(_step(h, h - 2) for h in range(6, GROWN_TO + 1)) + ") SELECT * FROM steps s WHERE NOT EXISTS (SELECT 1 FROM steps t WHERE t.hashes < s.hashes AND t.f >= 0.8)",
    "refinement_growth": "WITH " + _CTES.replace(_FAMILY, _family(CFG, max(GROWN))) + ", " + ", ".join(map(_refined, GROWN)) + " " + " UNION ALL ".join(f"SELECT {h} AS hashes, src, dst FROM refined_of_{h}" for h in GROWN),
    "refined_once": _sql("SELECT src, dst FROM arcs"),
    "refined_thrice": f"WITH {_CTES}, {_SH3} SELECT DISTINCT x.name AS src, y.name AS dst FROM sh3 x JOIN sh3 y USING (shingle) WHERE x.name <> y.name",
    "search_stored": "WITH RECURSIVE " + _CTES.replace(_FAMILY, _family(SEARCH, SEARCH.max_hashes - 1)) + ", " + ", ".join(_searched(h) for h in (2, 4)) + ", step AS (" + _step(4, 2) + ") SELECT *, unnest([1, 2])::INT AS run FROM step",
    "file_graph_program": "WITH " + _CTES.replace("FROM documents)", "FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1))") + f""", {_ARCS2},
      ids2 AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT src AS name FROM arcs2)),
      body AS (SELECT 0::BIGINT AS row_no, (SELECT count(*) FROM ids2) || ' ' || (SELECT count(*) FROM arcs2) AS value
        UNION ALL SELECT s.id, string_agg(d.id::VARCHAR, ' ' ORDER BY d.id) || ' ' FROM arcs2 JOIN ids2 s ON s.name = src JOIN ids2 d ON d.name = dst GROUP BY s.id)
      SELECT 'of_docs.fa_hash4_m2_kmer6' AS file, row_no, value FROM body""",
    "modularity_components": _sql(
        """SELECT 'components' AS "of", round(sum(own) / m2 - sum((tot / m2) * (tot / m2)), 9) AS modularity FROM (SELECT label, count(*)::DOUBLE AS tot, count(*)::DOUBLE AS own FROM arcs JOIN part ON node = src GROUP BY label), (SELECT count(*)::DOUBLE AS m2 FROM arcs) GROUP BY m2 UNION ALL SELECT 'all', 0.0::DOUBLE""",
        _REACH + ", part AS (SELECT node, min(seen) AS label FROM reach GROUP BY node)",
    ),
    "label_spreading": _sql(
        """SELECT label, member FROM (SELECT src AS member, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS r
          FROM around JOIN (SELECT src AS v, min(dst) AS label FROM around GROUP BY src) ON v = dst GROUP BY src, label) WHERE r = 1""",
        "around AS (SELECT src, dst FROM arcs UNION SELECT src, src FROM arcs)",
    ),
    "metis_rows": _sql("SELECT s.id + 1 AS row_no, string_agg((d.id + 1)::VARCHAR, ' ' ORDER BY d.id) || ' ' AS line FROM arcs JOIN ids s ON s.name = src JOIN ids d ON d.name = dst GROUP BY s.id"),
    "metis_header": _sql("SELECT count(DISTINCT src) AS vertices, count(*) AS arcs, 0::BIGINT AS self_loops, count(*) // 2 AS undirected_edges FROM arcs"),
    "components_min_label": _COMPONENTS,
    "components_hash_to_min": _COMPONENTS,
    "components_union_find": _COMPONENTS,
    "finalised_anti_join": "SELECT doc_id::VARCHAR || '_1' AS name FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1)",
    "label_blacklist": _sql("SELECT label, member FROM brand WHERE label NOT IN (SELECT p_brand FROM part WHERE p_size > 49)"),
    "dictionary_encoding": "SELECT o_custkey::VARCHAR AS name, row_number() OVER (ORDER BY min(o_orderkey), o_custkey::VARCHAR) AS id FROM orders GROUP BY o_custkey",
    "annotation_ordinals": "SELECT o_orderpriority AS label, '/' || o_custkey::VARCHAR || '_' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::VARCHAR AS member FROM orders",
    "cluster_floor": _sql("SELECT label, member FROM typ WHERE label IN (SELECT label FROM ts WHERE size >= 15)"),
    "largest_cluster": _sql("SELECT max(size) AS largest FROM bs"),
    "top_k_clusters": "SELECT c_nationkey::VARCHAR AS label, c_nationkey AS position, count(DISTINCT c_custkey) AS size FROM customer GROUP BY ALL ORDER BY size DESC, position DESC LIMIT 5",
    "renamed_members": _sql("SELECT '@' || src AS label, split_part(dst, '_', 1) AS member FROM arcs UNION SELECT '@' || src, split_part(src, '_', 1) FROM arcs"),
    "intersections": _sql("SELECT x_label, y_label, x_size, y_size, common FROM pairs"),
    "best_matches": _sql("SELECT side, label, size, round(best, 9) AS best FROM best"),
    "f_value": _sql(
        "SELECT round(t, 9) AS f_test, round(b, 9) AS f_base, round((t + b) / 2, 9) AS f_avg FROM (SELECT sum(size * best) FILTER (side = 'X') / sum(size) FILTER (side = 'X') AS t, "
        "sum(size * best) FILTER (side = 'Y') / sum(size) FILTER (side = 'Y') AS b FROM best)"
    ),
    "nmi": _sql(
        f"SELECT round(hx, 9) AS h_x, round(hy, 9) AS h_y, round(hxy, 9) AS h_x_given_y, round(hyx, 9) AS h_y_given_x, round((greatest(hx - hxy, 0) + greatest(hy - hyx, 0)) / 2 / greatest(hx, hy), 9) AS nmi_max, "
        f"round(1 - (hxy / hx + hyx / hy) / 2, 9) AS nmi_lfk FROM (SELECT {_entropy('bs')} AS hx, {_entropy('ts')} AS hy, {_conditional('bs', 'ts')} AS hxy, {_conditional('ts', 'bs')} AS hyx)"
    ),
} | files.ORACLES
ORACLES["streamed_sketches"] = ORACLES["merged_sketches"]
ORACLES["file_sketches_of_pieces"] = ORACLES["shingles"]
