"""URL filtering: explicit rules first, then association rules mined from labelled addresses.

An address becomes a set of tokens (scheme, host, registered domain, the words of host labels, path segments,
file extension, query keys, fragment). FP-growth over the labelled addresses, with the class as one more item,
gives token combinations whose rules "combination -> bad" pass the support and confidence bounds and lie above
the share of bad addresses. Each rule is indexed under its rarest token; an address looks up the rules of its
own tokens and keeps those whose other tokens it has as well. Verdicts depend on the address alone, so matching
runs once for each distinct address.

Tokens below the support bound can be in no rule and leave the baskets first. Tokens that occur in the very same
addresses, as a host and its words often do, are one item to FP-growth and go by the host, or else the first, of their names: thirty
keys that always come together would make 2^30 itemsets otherwise. Mining covers all labelled rows. The index is
joined, and broadcast only if its bytes are few.

Defined cases: a null address, or one without "://", has an empty host and path, fits no rule and is
allowed. An address with several labels is bad if any of them is. With fewer than ``min_count`` labels nothing is
mined and addresses that no explicit rule fits are allowed. Of several rules that fit, the most confident decides,
then the better supported, then the later in order of its tokens. Repeated rows, with or without an identifier,
get equal results. An address of any length is one row. Other columns pass through whatever their names are; only
those named like a result are replaced.
"""

from __future__ import annotations

import math
import string
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.storage import join_checked, materialise
from sketchloom.llm.columns import held, released

BAD = "class:bad"


class UrlRule(NamedTuple):
    """Fits the host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path`` and the remainder ``_tail`` (query and fragment)."""
    known = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", known)
    rest = F.when(at > 0, F.substring(known, at + 3, F.length(known))).otherwise("")
    return (
        df.withColumn("_rest", rest)
        .withColumn("host", lower_ascii(F.regexp_extract("_rest", r"^([^/?#]*)", 1)))
        .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
        .withColumn("_tail", F.regexp_extract("_rest", r"(?s)^[^?#]*(.*)$", 1))
        .drop("_rest")
    )


def explicit_rule(rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits ``host`` and ``path``, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r)):  # the longest is tested first: it ends up outermost
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: str = "url") -> Column:
    """Distinct tokens of an address whose parts ``with_parts`` has added."""
    labels = F.split("host", r"\.")
    domain = F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2))
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    query = F.regexp_extract("_tail", r"^\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "[&;]"), lambda q: F.substring_index(q, "=", 1)), lambda k: k != "")
    words = F.array_remove(F.flatten(F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.split(x, "[-_0-9]+"))), "")
    extension = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme:"), lower_ascii(F.substring_index(F.col(url), "://", 1))), F.concat(F.lit("host:"), "host"), F.concat(F.lit("domain:"), domain)),
            F.transform(words, lambda w: F.concat(F.lit("word:"), w)),
            F.transform(segments, lambda s: F.concat(F.lit("segment:"), s)),
            F.transform(keys, lambda k: F.concat(F.lit("key:"), k)),
            F.when(extension != "", F.array(F.concat(F.lit("extension:"), extension))).otherwise(F.array().cast("array<string>")),
            F.when(F.contains("_tail", F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def mine(labelled: DataFrame, min_support: float = 0.002, min_count: int = 20, min_confidence: float = 0.6, min_lift: float = 1.5) -> DataFrame | None:
    """(rule_id, pivot, others, confidence, support) from ``labelled`` (url, bad); None if nothing is labelled.

    A combination is supported if at least ``min_support`` of the labelled addresses, and no fewer than ``min_count``, have it and are bad.
    """
    once = labelled.filter("url is not null and bad is not null").groupBy("url").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    parted = with_parts(once).filter("host <> ''")
    baskets = materialise(parted.select("url", "bad", tokens().alias("items")), "url-baskets")
    n = baskets.count()
    if n < min_count:
        return None
    least = max(min_count, math.ceil(min_support * n))
    marks = [F.bit_xor(F.xxhash64("url")).alias("x"), F.bit_xor(F.xxhash64("url", F.lit(1))).alias("y")]
    each = baskets.select("url", F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"), *marks).filter(F.col("freq") >= least)
    items = materialise(each.groupBy("freq", "x", "y").agg(F.min(F.struct(~F.startswith("token", F.lit("host:")), "token"))["token"].alias("token")).select("token", "freq"), "url-items")
    kept = join_checked(baskets.select("url", F.explode("items").alias("token")), items, ["token"]).groupBy("url").agg(F.collect_list("token").alias("kept"))
    kept = baskets.select("url", "bad").join(kept, "url", "left").select("bad", F.coalesce("kept", F.array().cast("array<string>")).alias("kept"))
    kept = materialise(kept.select(F.when(F.col("bad") == 1, F.array_append("kept", BAD)).otherwise(F.col("kept")).alias("items")), "url-kept-baskets")
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=min_confidence).fit(kept)
    found = model.associationRules.filter((F.size("consequent") == 1) & (F.get("consequent", 0) == BAD) & (F.col("lift") >= min_lift))
    ranked = found.withColumn("rule_id", F.concat_ws("\n", F.array_sort("antecedent"))).withColumn("token", F.explode("antecedent")).join(items, "token")
    pivots = ranked.groupBy("rule_id").agg(F.min_by("token", F.struct("freq", "token")).alias("pivot"), F.collect_set("token").alias("all"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    return materialise(pivots.select("rule_id", "pivot", F.array_remove("all", F.col("pivot")).alias("others"), "confidence", "support"), "url-rules")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_rule, confidence): for each distinct address that rules fit, the most confident one."""
    once = with_parts(urls.select("url").distinct()).filter("host <> ''").select("url", tokens().alias("items"))
    looked_up = join_checked(once.withColumn("pivot", F.explode("items")), rules, ["pivot"])
    fit = looked_up.filter(F.size(F.array_except("others", "items")) == 0)
    best = F.struct("confidence", "support", "rule_id")
    return fit.groupBy("url").agg(F.max(best).alias("b")).select("url", F.col("b.rule_id").alias("mined_rule"), F.col("b.confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, **mining) -> DataFrame:
    """``pages`` (with a column url) plus host, path, rule, verdict, mined_rule and confidence."""
    parted = with_parts(pages.select(held(pages.columns), F.col("url").alias("_url")), "_url").withColumn("_r", explicit_rule(rules))
    mined = mine(labelled, **mining)
    if mined is None:
        parted = parted.withColumns({"mined_rule": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    else:
        open_urls = parted.filter("_r is null and _url is not null").select(F.col("_url").alias("url"))
        parted = parted.join(match(open_urls, mined), F.col("_url") == F.col("url"), "left")
    decided = F.coalesce("_r.verdict", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    judged = parted.withColumn("rule", F.col("_r.rule")).withColumn("verdict", decided)
    return judged.select(*released(pages.columns, ["host", "path", "rule", "verdict", "mined_rule", "confidence"]))
