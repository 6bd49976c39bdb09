"""Importance resampling towards a target: gains of hashed n-grams, read off a table of word positions.

Words become rows with their positions (``posexplode``), and a window's ``lead()`` per text puts the words that follow beside
each, so the n-gram of every order is a concatenation within a row. Features are hashed into buckets; both corpora
are counted by bucket, a bucket's gain is the log ratio of its smoothed shares, and a text's weight is the
floored mean gain of its features. With a noise drawn from the identifier (Gumbel), the highest scores are a sample
without replacement whose odds follow the weights.

Scale: equal texts meet within tasks and are counted once, with their number; the shuffle that brings them together
also partitions the windows, so word rows themselves never travel. Texts of many words are cut into parts that
overlap by the longest order, so one long text is many windows. Bucket counts and gains are one row a bucket: their
number is a parameter, which bounds the broadcast. Ranks come from range partitions and their counts.

Defined cases: a null or empty text has no features, weight 0 and no words. Texts with fewer than ``min_words`` words
get a score but are never drawn, nor are rows of unknown identifier, whose score is null. Ties go to smaller identifiers,
and rows that repeat an identifier share its noise and are ranked one behind the other. Empty tables give no rows; an
empty target gives gains from smoothing alone. Columns besides the named ones aren't looked at, so no name can clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchloom.functions.storage import materialise
from sketchloom.operators.graph import dense_numbers

BUCKETS = 10_000
ORDERS = 2
MIN_WORDS = 20
SHARE = 25
SEED = 7
#: Words of one window: longer texts are several.
PART = 1 << 14
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, with A-Z lower-cased."""
    known = F.coalesce(text, F.lit(""))
    lowered = F.when(F.length(known) == F.octet_length(known), F.lower(known)).otherwise(F.translate(known, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def positions(texts: DataFrame, keys: list[str], orders: int = ORDERS, part: int = PART) -> DataFrame:
    """(*keys, _part, pos, w1, w2, …): a row per word of ``_t``, with the words that follow it in its text, null past the end.

    Parts of a text overlap by the words that n-grams need; only a word's own part counts it.
    """
    listed = texts.select(*keys, words(F.col("_t")).alias("_w"))
    cuts = F.sequence(F.lit(0), F.floor((F.greatest(F.size("_w"), F.lit(1)) - 1) / part).cast("int"))
    cut = F.when(F.size("_w") <= part, F.array(F.struct(F.lit(0).alias("p"), F.col("_w").alias("w")))).otherwise(
        F.transform(cuts, lambda p: F.struct(p.alias("p"), F.slice("_w", p * part + 1, part + orders - 1).alias("w")))
    )
    parts = listed.select(*keys, F.explode(cut).alias("_c")).select(*keys, F.col("_c.p").alias("_part"), F.posexplode("_c.w").alias("pos", "w1"))
    ahead = Window.partitionBy(*keys, "_part").orderBy("pos")
    followed = parts.select("*", *(F.lead("w1", i).over(ahead).alias(f"w{i + 1}") for i in range(1, orders)))
    return followed.filter(F.col("pos") < part)


def bucket(feature: Column, buckets: int = BUCKETS) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def features(texts: DataFrame, keys: list[str], orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(*keys, b): the buckets of all n-grams of each word position, repeats included."""
    grams = [F.concat_ws(" ", *(F.col(f"w{i + 1}") for i in range(n))) for n in range(1, orders + 1)]
    known = [F.when(F.col(f"w{n}").isNotNull(), bucket(g, buckets)).cast("int") for n, g in enumerate(grams, 1)]
    return positions(texts, keys, orders).select(*keys, F.array_compact(F.array(*known)).alias("b"))


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """(x, x_len, _t, copies): texts that aren't empty, each once; copies meet within tasks first."""
    keyed = docs.select(F.xxhash64(text).alias("x"), F.length(text).alias("x_len"), F.col(text).alias("_t")).filter("x_len > 0")
    return keyed.groupBy("x", "x_len").agg(F.first("_t").alias("_t"), F.count(F.lit(1)).alias("copies"))


def bucketed(docs: DataFrame, text: str, label: str, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(x, x_len, copies, buckets): the buckets of all features of each distinct text, in parts of bounded size."""
    keys = ["x", "x_len", "copies"]
    found = features(distinct_texts(docs, text), [*keys], orders, buckets)
    # Window rows of one text lie in one partition already, so this grouping doesn't shuffle.
    return materialise(found.groupBy(*keys).agg(F.flatten(F.collect_list("b")).alias("buckets")), label)


def counts(of: DataFrame, name: str) -> DataFrame:
    """(b, name): how often each bucket occurs, copies included."""
    return of.select("copies", F.explode("buckets").alias("b")).groupBy("b").agg(F.sum("copies").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(b, gain) for every bucket: floor(1000 ln of the ratio of smoothed shares)."""
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts(source, "s"), "b", "left").join(counts(target, "t"), "b", "left")
    both = materialise(both.select("b", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t")), "bucket-counts")
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(totals)).select("b", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number in thousandths from the identifier, null for an unknown one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weights(source: DataFrame, gain: DataFrame) -> DataFrame:
    """(x, x_len, n_features, weight): the floored mean gain of each text's features."""
    each = source.select("x", "x_len", F.explode("buckets").alias("b"))
    joined = each.join(F.broadcast(gain), "b")  # one row a bucket
    total = joined.groupBy("x", "x_len").agg(F.count(F.lit(1)).alias("n_features"), F.sum("gain").alias("g"))
    return total.select("x", "x_len", "n_features", F.expr("(g - pmod(g, n_features)) div n_features").alias("weight"))


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, share: int = SHARE, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; ``rank`` from 1 for the ``share`` percent of long enough rows that are drawn."""
    source = bucketed(docs, text, "source-buckets", orders, buckets)
    gain = materialise(gains(source, bucketed(target, text, "target-buckets", orders, buckets), buckets), "gains")
    weighed = materialise(weights(source, gain), "weights")
    base = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("x"), F.length(text).alias("x_len"))
    scored = base.join(weighed, ["x", "x_len"], "left").select("_id", "x", F.coalesce("n_features", F.lit(0)).cast("long").alias("n_features"), F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    scored = materialise(scored.withColumn("score", F.col("weight") + noise(F.col("_id"), seed)).withColumn("_row", F.monotonically_increasing_id()), "scored")
    # A text of n words has n + (n - 1) + … features, so the number of words follows from it.
    enough = sum(max(min_words - i, 0) for i in range(orders))
    able = scored.filter((F.col("n_features") >= enough) & F.col("_id").isNotNull())
    n = able.count()
    order = F.struct((-F.col("score")).alias("s"), F.col("_id").alias("i"), F.col("_row").alias("r"))
    ranked = dense_numbers(able.select("_row", order.alias("_by")), "_by", "_rank").filter(F.col("_rank") < n * share // 100)
    drawn = materialise(ranked.select("_row", (F.col("_rank") + 1).alias("rank")), "drawn")
    return scored.join(drawn, "_row", "left").select(F.col("_id").alias(doc_id), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
