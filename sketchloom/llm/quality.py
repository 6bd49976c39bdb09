"""Quality rules: a threshold table compiled into one projection.

Rules are rows of a table (name, ratio expression, lower and upper bound). ``verdict`` folds the
whole table into a single boolean column, so a filter on it stays inside one projection of built-in
functions: no user function, no shuffle, one pass over the text.

Defined cases: a null or empty text has no words, so every count is 0 and the base rule (at least 50
words) rejects it. Extra columns pass through whatever their names are; measures live in one struct column, and
``judge`` replaces only columns named ``_quality``, ``base_failed`` and ``kept``. Repeated rows, and rows without an
identifier, get the result of their text. A ratio that equals its bound breaks no rule. A text of any length is
one row: its windows are hashed, and sorted as texts only if two hashes agree.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.columns import held, released

SPACES = r"[\x20\x09-\x0D]+"

# Frequent function words of the four supported languages.
STOP_WORDS = (
    "the of and to a in is that it for on with as was by this be from or are at an "
    "de la le et les des en un une que qui du pour dans est pas sur au avec ce il par plus "
    "der die und das den von zu mit sich auf für ist nicht ein eine als auch es dem im "
    "el los las y del se por con no su para al lo como más o pero sus"
).split()


class Rule(NamedTuple):
    """Keep a document only if ``low <= ratio <= high``; a bound of None does not apply."""

    name: str
    ratio: str
    low: float | None
    high: float | None


#: The thresholds; ratios are SQL over the measures.
RULES = (
    Rule("words", "n_words", 50, None),
    Rule("mean_word_chars", "word_chars / n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.25),
    Rule("stop_word_share", "n_stop_words / n_words", 0.03, None),
    Rule("duplicate_line_share", "n_dup_lines / n_lines", None, 0.5),
    Rule("bullet_line_share", "n_bullet_lines / n_lines", None, 0.9),
    Rule("ellipsis_line_share", "n_ellipsis_lines / n_lines", None, 0.5),
)


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space, in order."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def repeated_words(grams: Column) -> Column:
    """Words covered by the 3-word windows that occur more than once. ``grams``: sorted structs (g, i)."""
    last = F.size(grams) - 1
    twice = F.filter(
        grams,
        lambda x, k: ((k > 0) & (F.get(grams, k - 1)["g"] == x["g"])) | ((k < last) & (F.get(grams, k + 1)["g"] == x["g"])),
    )
    return F.array_sort(F.transform(twice, lambda x: x["i"]))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_quality`` of the counts that rules are made of.

    The struct holds a row number, which is not deterministic: Spark then evaluates the struct once, and
    doesn't push filters on it below the projections, where they would repeat all of their work.
    """
    known = F.coalesce(F.col("_t"), F.lit(""))
    step = docs.select(held(docs.columns), F.col(text).alias("_t")).withColumn("_w", words(F.col("_t")))
    step = step.withColumn("_n", F.size("_w"))
    starts = F.when(F.col("_n") >= 3, F.sequence(F.lit(0), F.col("_n") - 3)).otherwise(F.array().cast("array<int>"))
    # Equal windows have equal hashes; only texts in which a hash occurs twice compare the windows themselves.
    step = step.withColumn("_g", F.transform(starts, lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    window = F.transform("_g", lambda g, i: F.struct(F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("g"), i.alias("i")))
    step = step.withColumn("_g", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(window)).otherwise(F.array().cast("array<struct<g:string,i:int>>")))
    step = step.withColumn("_g", repeated_words(F.col("_g")))
    covered = F.aggregate(
        F.transform("_g", lambda p, k: F.coalesce(F.least(F.lit(3), F.get("_g", k + 1) - p), F.lit(3))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    step = step.withColumn("_l", F.filter(F.split(known, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    step = step.withColumn(
        "_quality",
        F.struct(
            F.col("_n").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            (F.length(known) - F.length(F.regexp_replace(known, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.size("_l").cast("long").alias("n_lines"),
            F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter("_l", lambda x: x.rlike(r"^\s*[-*•]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter("_l", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )
    return step.select(*released(docs.columns, ["_quality"]))


def base_failed(q: str = "_quality") -> Column:
    """Too short, or more than half of the words lie in repeated windows."""
    return F.expr(f"{q}.n_words < 50 or 100 * {q}.n_repeat_words > 50 * {q}.n_words")


def verdict(rules=RULES, q: str = "_quality") -> Column:
    """One boolean: false as soon as a rule of the table is broken; a ratio over zero breaks none."""
    kept = F.lit(True)
    for rule in rules:
        parts = rule.ratio.split(" / ")
        ratio = F.try_divide(F.col(f"{q}.{parts[0]}"), F.col(f"{q}.{parts[1]}")) if len(parts) == 2 else F.col(f"{q}.{parts[0]}").cast("double")
        if rule.low is not None:
            kept = kept & F.coalesce(ratio >= rule.low, F.lit(True))
        if rule.high is not None:
            kept = kept & F.coalesce(ratio <= rule.high, F.lit(True))
    return kept


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with ``_quality``, ``base_failed`` and ``kept``."""
    return measure(docs, text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    judged = judge(docs.select(held(docs.columns), F.col(text).alias("_text")), "_text", rules).filter("kept")
    return judged.select(*released(docs.columns, []))
