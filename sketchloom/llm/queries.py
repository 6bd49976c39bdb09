"""The registered queries of this subpackage, and the SQL that must agree with them.

Each query applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.storage import scratch_path
from sketchloom.llm import collocations, countmin, importance, langid, linedrain, packing, quality, simhash, suffixdedup, superminhash, urlfilter, warc, winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page (all evidence) and of every document (text and source), with its probability.

    The text model is learnt from the documents' labels; ``kept`` is whether one language is likely.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    model = langid.train(docs)
    columns = ["doc_id", "page_id", "_t", "declared", "suffix", "domain", "host"]
    of_docs = langid.document_evidence(docs).withColumn("page_id", F.lit(None).cast("long")).select(columns)
    of_pages = langid.page_evidence(pages).withColumn("doc_id", F.lit(None).cast("long")).select(columns)
    found = langid.identify(of_docs.unionByName(of_pages), model, ["doc_id", "page_id"])
    return found.withColumn("kept", F.coalesce(F.col("probability") >= 0.5, F.lit(False)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and class of near-duplicates of each document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in each document, and which items they come from."""
    found = winnow.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_list"), 256).alias("items_sha256"), "contaminated"
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines of recurring templates."""
    found = linedrain.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all tokenized documents and their places in sequences of at most 4,096 tokens."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the bytes of 400-byte strings that start anywhere else."""
    return suffixdedup.dedup_bytes(table(spark, sf_dir, "documents"), ["doc_id"]).drop("kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the words of 35-word windows that occur anywhere else."""
    return countmin.dedup_windows(table(spark, sf_dir, "documents"), ["doc_id"]).drop("kept_text")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back as chunks; one row per record."""
    folder = scratch_path(spark, "warc")
    archives = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id", "url", "html", folder)
    found = warc.records(warc.read_chunks(archives, folder))
    return found.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "intact"
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the base rule and the verdict of the threshold table, for each document."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(F.col(f"_quality.{m}").alias(m) for m in measures), "base_failed", "kept")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explicit rules, else association rules mined from the labels, for every page's address."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    judged = urlfilter.judge(pages, pages.join(marks, "page_id").select("url", "bad"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language by the score of their weakest cut."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of each document, by Jaccard similarity of three-word shingles."""
    return superminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark texts by their words and pairs of words."""
    return importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_suffix_array": op6_suffix_array,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_url_filters": op10_url_filters,
    "op11_collocations": op11_collocations,
    "op12_minhash": op12_minhash,
    "op13_importance": op13_importance,
}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CRC = ", ".join(str(t) for t in (functools.reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)))


def _rule(rule: quality.Rule) -> str:
    """A line of the threshold table as SQL; a ratio over zero breaks nothing."""
    top, _, under = rule.ratio.partition(" / ")
    ratio = f"({top} / nullif({under}, 0))" if under else top
    bounds = [f"{ratio} >= {rule.low}"] * (rule.low is not None) + [f"{ratio} <= {rule.high}"] * (rule.high is not None)
    return " AND ".join(f"coalesce({b}, true)" for b in bounds)


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))

ORACLES: dict[str, str] = {
    "op3_decontamination": f"""
WITH i AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, s, item_id FROM dw JOIN iw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op4_line_dedup": r"""
WITH RECURSIVE l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
tok AS (SELECT *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM l),
m AS (SELECT *, len(w) AS n, list_transform(w, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS mask FROM tok WHERE len(w) > 0),
leaf AS (SELECT *, array_to_string(mask[1:3], ' ') AS lead, array_to_string(mask, ' ') AS masked FROM m),
busy AS (SELECT n, lead FROM leaf GROUP BY ALL HAVING count(DISTINCT text) >= 5),
near AS (SELECT leaf.* FROM leaf JOIN busy USING (n, lead)),
dis AS (SELECT n, lead, masked, any_value(mask) AS mask, count(*) AS weight FROM near GROUP BY n, lead, masked),
r AS (SELECT 0 AS round, *, '' AS g, NULL::VARCHAR AS tid, true AS open FROM dis
  UNION ALL (WITH cur AS (SELECT * FROM r WHERE open),
  votes AS (SELECT n, lead, g, pos, token, sum(weight) AS v FROM (SELECT n, lead, g, weight, unnest(mask) AS token, generate_subscripts(mask, 1) AS pos FROM cur) GROUP BY ALL),
  win AS (SELECT n, lead, g, pos, CASE WHEN max(v) >= 0.5 * sum(v) THEN arg_max(token, {'v': v, 't': token}) ELSE '<*>' END AS fixed, max(v) < sum(v) AS mixed FROM votes GROUP BY ALL),
  tpl AS (SELECT n, lead, g, list(fixed ORDER BY pos) AS t, min(pos) FILTER (mixed) AS cut FROM win GROUP BY ALL),
  voted AS (SELECT cur.*, cut, list_sum(list_transform(list_zip(mask, t), lambda z: (z[1] = z[2])::INT)) >= 0.7 * n AS fits FROM cur JOIN tpl USING (n, lead, g)),
  moved AS (SELECT n, lead, g, bool_or(fits) AS moved FROM voted GROUP BY ALL),
  nxt AS (SELECT round + 1 AS round, n, lead, masked, mask, weight, CASE WHEN fits OR moved THEN g ELSE g || '/' || cut || ':' || mask[cut] END AS g, CASE WHEN fits THEN g || '#' || round END AS tid, fits FROM voted JOIN moved USING (n, lead, g)),
  more AS (SELECT n, lead, g, true AS again FROM nxt WHERE NOT fits GROUP BY ALL HAVING sum(weight) >= 5 AND count(*) > 1)
  SELECT round, n, lead, masked, mask, weight, g, tid, NOT fits AND again IS NOT NULL AS open FROM nxt LEFT JOIN more USING (n, lead, g))),
placed AS (SELECT n, lead, masked, coalesce(tid, '=' || masked) AS id FROM r WHERE round > 0 AND NOT open),
of_line AS (SELECT doc_id, text, k, n, lead, masked, id FROM near JOIN placed USING (n, lead, masked)),
often AS (SELECT n, lead, id, arg_min(text, doc_id) AS first FROM of_line GROUP BY ALL HAVING count(DISTINCT text) >= 5),
covered AS (SELECT n, lead, masked FROM placed JOIN often USING (n, lead, id)),
lng AS (SELECT doc_id, text, k, masked FROM leaf ANTI JOIN covered USING (n, lead, masked) WHERE len(list_filter(mask, lambda t: t <> '<*>')) >= 10),
twice AS (SELECT masked, arg_min(text, doc_id) AS first FROM lng GROUP BY masked HAVING count(DISTINCT text) > 1),
gone AS (SELECT text, k FROM of_line JOIN often USING (n, lead, id) WHERE text <> first UNION SELECT text, k FROM lng JOIN twice USING (masked) WHERE text <> first),
kept AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_lines, count(gone.k) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.k) FILTER (gone.k IS NULL), '') AS t
  FROM l LEFT JOIN gone ON gone.text = l.text AND gone.k = l.k GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, length(t) AS kept_chars, sha256(t) AS kept_sha256 FROM kept""",
    "op7_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM win JOIN again USING (g)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT each.doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY each.p) FILTER (gone.p IS NULL) AS t FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.p GROUP BY each.doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to, true AS intact FROM f""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d WHERE len(w) >= 3)),
again AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM win JOIN again USING (doc_id, g)) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, (len(lines) - list_unique(lines))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(lines) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words,
  len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet_lines, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(_rule(r) for r in quality.RULES)} AS kept FROM b""",
    "op11_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
t AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM t, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
cut AS (SELECT *, unnest(range(1, m)) AS k FROM c),
part AS (SELECT cut.lang, cut.phrase, cut.a, k, x.f AS l, y.f AS r FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
s AS (SELECT *, (2000000::HUGEINT * a // (l + r))::BIGINT AS score FROM part),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda j: list_transform(range(1, m - j + 2), lambda i: array_to_string(w[i:i + j - 1], ' '))))) AS phrase FROM c WHERE m > 2),
around AS (SELECT lang, phrase, max(a) AS around FROM sub GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN around USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op12_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
prefix AS (SELECT doc_id, n, g FROM (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY often, g) AS r FROM sh JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS often FROM sh GROUP BY g) USING (g)) WHERE r <= n - (85 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM prefix x JOIN prefix y USING (g) WHERE x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)),
met AS (SELECT a, b, na, nb, count(*) AS c FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.g = x.g GROUP BY ALL),
link AS (SELECT a, b FROM met WHERE 100 * c >= 85 * (na + nb - c)), arcs AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM arcs UNION SELECT reach.a, arcs.b FROM reach JOIN arcs ON arcs.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(component, doc_id), doc_id) AS component_id, coalesce(least(component, doc_id), doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op13_importance": f"""
WITH crc AS (SELECT [{_CRC}]::BIGINT[] AS t),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), i AS (SELECT {_ITEM_WORDS} AS w FROM benchmark),
df AS (SELECT doc_id, unnest(w) AS f FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM d),
tf AS (SELECT unnest(w) AS f FROM i UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM i),
kinds AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM tf)),
bytes AS (SELECT f, list_transform(range(0, length(h) // 2), lambda k: ('0x' || h[2 * k + 1:2 * k + 2])::BIGINT) AS y FROM kinds),
bucket AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, y), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS b FROM bytes, crc),
s AS (SELECT b, count(*) AS s FROM df JOIN bucket USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM tf JOIN bucket USING (f) GROUP BY b),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((s::DOUBLE + 1) * (tt + 10000)))) AS g FROM s LEFT JOIN t USING (b), total),
w AS (SELECT doc_id, count(*) AS n, floor(sum(g) / count(*))::BIGINT AS weight FROM df JOIN bucket USING (f) JOIN gain USING (b) GROUP BY doc_id),
sc AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE words >= 20),
m AS (SELECT 25 * count(*) // 100 AS most FROM sc WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= most THEN rank END AS rank FROM sc LEFT JOIN r USING (doc_id), m""",
}
