"""A training corpus in five stages: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes all that the one before it kept, is written as Parquet and read again. The first four
return the columns of ``documents``; packing returns one row per piece of a packed document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.storage import remove, scratch_path, scratch_scope
from sketchloom.llm import linedrain, packing, quality, simhash, winnow


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one struct, so that none can clash with an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None)).alias("_rest"))


def unpacked(rows: DataFrame, docs: DataFrame, **replaced) -> DataFrame:
    """``rows`` of ``packed`` with the columns of ``docs``."""
    columns = {c: F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c) for c in docs.columns} | replaced
    return rows.select(*(columns[c].alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the threshold table rejects go."""
    return unpacked(quality.keep(packed(docs)), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from the texts; a document of which no line is left goes with them."""
    found = linedrain.drop_recurring(packed(docs)).filter((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    if "n_chars" not in docs.columns:
        return unpacked(found, docs)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_rest.n_chars"))
    return unpacked(found, docs, n_chars=n_chars)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in five-word shingles, by SimHash to a similarity of 0.8, that of the smallest doc_id stays."""
    return simhash.similar_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a 10-word window with a benchmark item go."""
    return winnow.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenized and packed into sequences of at most 4,096 tokens."""
    return packing.pack(packing.pieces(docs.select("doc_id", "text"), ["doc_id"]))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express SimHash components nor the tokenizer; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's own tables go when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        result = scratch_path(spark, name)
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(result)
        docs = spark.read.schema(docs.schema).parquet(result)
        if before is not None:
            remove(spark, before)
        before = result
    return STAGES[-1][1](spark, docs, sf_dir)
