"""Benchmark decontamination by winnowing, in built-in functions only.

A window is ``span`` consecutive words of a benchmark item (a shorter item is one window of its own
length). For windows of n words the k-grams of k = ceil(n / 2) words are hashed, and each window is
represented by the least of its n - k + 1 hashes. Equal windows have equal minima, so joining the
distinct minima of documents with those of the benchmark finds every document that can contain a
window: any shared span of at least n words leaves a shared fingerprint. Hits are then extended: only
the windows of a candidate document whose minimum was matched are spelled out and compared word for
word with the benchmark's.

Windows of equal words are one row, whatever number of items has them, so boilerplate of a benchmark
doesn't multiply the hits. The join of minima takes one row for about every third word, and ships none of
them while the benchmark's fingerprints are few enough to be broadcast, which is checked by their bytes.

Defined cases: a null, empty or wordless text has no words and no hits; a null or wordless item has no
windows. A document with a null identifier gets the result of its text like any other. Repeated document
rows each get a result. Items with a null identifier match, but are not listed; items of equal text are all
listed. Of equal minima it doesn't matter which is taken, as only their value counts. A text of any length
is one row; its work grows in proportion to its words. An empty benchmark leaves every document clean.
Columns besides the named ones are not used by ``decontaminate``; ``clean`` returns them whatever their names are.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.storage import join_checked, materialise

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN = 10
WINDOWS = "array<struct<s:int,len:int,fp:bigint,win:string>>"


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z, all else stays; texts of ASCII alone take the faster function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def gram_hashes(tokens: str, n_tokens: str, k: int) -> Column:
    """Hashes of all runs of k tokens, in order."""
    starts = F.when(F.col(n_tokens) >= k, F.sequence(F.lit(0), F.col(n_tokens) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(F.col(tokens), i + j) for j in range(k))))


def with_minima(df: DataFrame, lengths: list[int]) -> DataFrame:
    """``df`` (columns w, n) with ``m<length>`` for each length: the minima of its windows, in order.

    Minima over 1, 2, 4, ... neighbours are made from each other, each in a projection of its own, so that nothing
    is worked out twice. The ends, where windows are cut short, are taken off last.
    """
    grams = {(length + 1) // 2 for length in lengths}
    df = df.select("*", *(gram_hashes("w", "n", k).alias(f"h{k}_1") for k in sorted(grams)))
    for length in lengths:
        k = (length + 1) // 2
        width, done = length - k + 1, 1
        while done < width:
            step = min(done, width - done)
            if f"h{k}_{done + step}" not in df.columns:
                own = f"h{k}_{done}"
                shifted = F.slice(own, step + 1, F.greatest(F.size(own) - step, F.lit(0)))
                df = df.select("*", F.zip_with(own, shifted, lambda a, b: F.least(a, b)).alias(f"h{k}_{done + step}"))
            done += step
        df = df.select("*", F.slice(f"h{k}_{width}", 1, F.greatest(F.col("n") - length + 1, F.lit(0))).alias(f"m{length}"))
    return df.drop(*(c for c in df.columns if c.startswith("h") and c[1:2].isdigit()))


def spelt(length: int) -> Column:
    """(s, len, fp, win) of each window of ``length`` words: where it starts, its fingerprint and its words."""
    return F.transform(f"m{length}", lambda fp, i: F.struct(i.alias("s"), F.lit(length).alias("len"), fp.alias("fp"), F.array_join(F.slice("w", i + 1, F.lit(length)), " ").alias("win")))


def printed(length: int) -> Column:
    """(len, fp) of the distinct minima of windows of ``length`` words."""
    return F.transform(F.array_distinct(f"m{length}"), lambda fp: F.struct(F.lit(length).alias("len"), fp.alias("fp")))


def benchmark_windows(items: DataFrame, item_id: str, text: str, span: int = SPAN) -> DataFrame | None:
    """(item, len, fp, win): each distinct window of each item, spelled out, and its fingerprint."""
    base = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).withColumn("n", F.size("w"))
    lengths = sorted(r[0] for r in base.select(F.least("n", F.lit(span))).distinct().collect() if r[0])  # span values at most
    if not lengths:
        return None
    own = F.concat(*(F.when((F.col("n") == x) if x < span else (F.col("n") >= x), spelt(x)).otherwise(F.array().cast(WINDOWS)) for x in lengths))
    # Outer: a filter on what is exploded would be inferred, and would repeat the work that made it.
    found = with_minima(base, lengths).select("item", F.explode_outer(own).alias("v")).select("item", "v.*").filter("win is not null").drop("s")
    return materialise(found.distinct(), "benchmark-windows")


def hits(docs: DataFrame, windows: DataFrame, key: list[str], text: str, lengths: list[int]) -> DataFrame:
    """(key, s, len, win): the occurrences of benchmark windows in documents, word for word.

    ``lengths``: of the windows that occur at all; all are hashed in one pass over the words.
    """
    def tokenized(rows: DataFrame) -> DataFrame:
        return with_minima(rows.select(*key, words(F.col(text)).alias("w")).withColumn("n", F.size("w")), lengths)

    prints = materialise(windows.select("len", "fp").distinct(), "benchmark-prints")
    listed = tokenized(docs).select(*key, F.explode_outer(F.concat(*(printed(x) for x in lengths))).alias("v")).select(*key, "v.*")
    candidates = materialise(join_checked(listed, prints, ["len", "fp"], "left_semi").select(*key).distinct(), "candidates")
    # The documents with a match are looked at again; only if they are many do texts move to meet them.
    again = tokenized(join_checked(docs.select(*key, text), candidates, key, "left_semi"))
    found = again.select(*key, F.explode_outer(F.concat(*(spelt(x) for x in lengths))).alias("v")).select(*key, "v.*")
    spelled = materialise(windows.select("len", "fp", "win").distinct(), "benchmark-spelled")
    return join_checked(found, spelled, ["len", "fp", "win"], "left_semi").select(*key, "s", "len", "win")


KEY = ["_k", "_x"]


def _keyed(doc_id: str, text: str) -> list[Column]:
    """What tells rows apart: the identifier as text, and the hash of the text."""
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_k"), F.xxhash64(text).alias("_x")]


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    windows = benchmark_windows(items, item_id, item_text, span)
    if windows is None:
        return docs
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # span values at most
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text).alias("_t"), *_keyed(doc_id, text))
    found = materialise(hits(keyed, windows, KEY, "_t", lengths).select(*KEY).distinct(), "contaminated")
    return join_checked(keyed, found, KEY, "left_anti").select("_row.*")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, item_list (sorted), spans (start, len) and contaminated."""
    windows = benchmark_windows(items, item_id, item_text, span)
    keyed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"), *_keyed(doc_id, text))
    totals = keyed.select("_id", "_k", "_x", F.size(words(F.col("_t"))).cast("long").alias("n_words"))
    nothing = totals.withColumns(
        {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "item_list": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<s:int,len:int>>")}
    )
    if windows is None:
        return nothing.select(F.col("_id").alias(doc_id), "n_words", "n_hit", "n_items", "item_list", "spans", F.lit(False).alias("contaminated"))
    key = ["_k", "_x"]
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # span values at most
    found = materialise(hits(keyed, windows, key, "_t", lengths), "benchmark-hits")
    spans = found.select(*key, "s", "len").distinct().groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("s", "len"))).alias("spans"))
    listed = (
        found.select(*key, "len", "win").distinct()
        .join(windows.filter("item is not null").select("item", "len", "win"), ["len", "win"])
        .select(*key, "item").distinct()
        .groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("item_list"))
    )
    # Spans are in order of their starts: each adds what lies beyond the end of those before it.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct(
            (a["total"] + F.greatest(F.lit(0), x["s"] + x["len"] - F.greatest(a["end"], x["s"].cast("long")))).alias("total"),
            F.greatest(a["end"], (x["s"] + x["len"]).cast("long")).alias("end"),
        ),
        lambda a: a["total"],
    )
    facts = spans.join(listed, key, "left").withColumn("n_hit", covered)
    out = totals.join(facts, key, "left")
    return out.select(
        F.col("_id").alias(doc_id),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("item_list"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_list", F.array().cast("array<string>")).alias("item_list"),
        F.coalesce("spans", F.array().cast("array<struct<s:int,len:int>>")).alias("spans"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
