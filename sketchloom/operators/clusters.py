"""Operators on clusterings: tables (label, member), where members may be in several clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchloom.functions.hashing import bare_name, split_name
from sketchloom.functions.storage import join_shuffled


def sizes(clusters: DataFrame) -> DataFrame:
    """(label, size)."""
    return clusters.distinct().groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def with_floor(clusters: DataFrame, floor: int) -> DataFrame:
    """Clusters of at least ``floor`` members, two at the least."""
    big = sizes(clusters).filter(F.col("size") >= max(floor, 2)).select("label")
    return join_shuffled(clusters, big, "label", "left_semi")


def largest(clusters: DataFrame) -> DataFrame:
    """One row: the size of the largest cluster."""
    return sizes(clusters).agg(F.max("size").alias("largest"))


def top_k(clusters: DataFrame, k: int, position: str = "position") -> DataFrame:
    """(label, position, size) of the k largest clusters, of equal ones the later first; all if k is not positive."""
    ranked = clusters.groupBy("label", position).agg(F.count_distinct("member").alias("size")).orderBy(F.desc("size"), F.desc(position))
    return ranked.limit(k) if k > 0 else ranked


def without_labels(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Clusters whose label is not in ``labels`` (label)."""
    return clusters.join(labels.select("label"), "label", "left_anti")


def without_finalised(sequences: DataFrame, finalised: DataFrame) -> DataFrame:
    """Sequences whose name is not in ``finalised`` (name)."""
    return sequences.join(finalised.select("name"), "name", "left_anti")


def marked(clusters: DataFrame) -> DataFrame:
    """Labels with a leading @ and members with a leading /."""
    return clusters.select(F.concat(F.lit("@"), "label").alias("label"), F.concat(F.lit("/"), "member").alias("member"))


def unmarked(clusters: DataFrame) -> DataFrame:
    """Labels and members without their first character."""
    return clusters.select(F.expr("substring(label, 2)").alias("label"), F.expr("substring(member, 2)").alias("member"))


def unmarked_members(clusters: DataFrame) -> DataFrame:
    """Members without a leading /; labels as they are."""
    return clusters.select("label", F.regexp_replace("member", "^/", "").alias("member"))


def renamed(clusters: DataFrame, apart: bool = False) -> DataFrame:
    """Members cut to the sequence they are a region of; where they are known to be ``apart``, none repeats and rows are only passed on."""
    found = clusters.select("label", bare_name(F.col("member")).alias("member"))
    return found if apart else found.distinct()


def apart(members: DataFrame) -> bool:
    """Whether marked members (member), each there once, are regions of as many sequences."""
    bare = bare_name(F.col("member"))
    return members.groupBy(bare.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()


def dictionary(names: DataFrame, domained: bool = False) -> DataFrame:
    """(name, id) from rows (name, position): 1-based numbers in the order of first appearance."""
    base = split_name(F.col("name"))[0] if domained else F.col("name")
    first = names.select(base.alias("name"), "position").groupBy("name").agg(F.min("position").alias("position"))
    from sketchloom.operators.graph import dense_numbers

    keyed = first.withColumn("_at", F.struct("position", "name"))
    return dense_numbers(keyed, "_at", "id").select("name", (F.col("id") + 1).alias("id"))


def annotation_ordinals(rows: DataFrame, whole: bool = False) -> DataFrame:
    """(label, member) from rows (seq, family, line_no): regions of a sequence are numbered in file order."""
    order = Window.partitionBy("seq").orderBy("line_no")
    number = F.row_number().over(order)
    member = F.col("seq") if whole else F.concat(F.lit("/"), "seq", F.lit("_"), number.cast("string"))
    return rows.select(F.col("family").alias("label"), member.alias("member")).distinct()


def first_of_label(clusters: DataFrame, floor: int = 0) -> DataFrame:
    """(label, member, position) of each label's first block, by ``line_no``, of ``floor`` members or more; its other blocks are dropped whole."""
    each = clusters.select("label", "line_no", "member").distinct()
    blocks = each.groupBy("label", "line_no").agg(F.count(F.lit(1)).alias("size"))
    first = blocks.filter(F.col("size") >= (max(floor, 2) if floor else 1)).groupBy("label").agg(F.min("line_no").alias("line_no"))
    return each.join(first, ["label", "line_no"], "left_semi").select("label", "member", F.col("line_no").alias("position"))


def relabelled(clusters: DataFrame, prefix: str = "@") -> DataFrame:
    """Clusters under running numbers in the order of their labels, from 0."""
    from sketchloom.operators.graph import dense_numbers

    numbers = dense_numbers(clusters.select("label").distinct(), "label", "number")
    return clusters.join(numbers, "label").select(F.concat(F.lit(prefix), F.col("number").cast("string")).alias("label"), "member")


def numbers_to_names(clusters: DataFrame, table: DataFrame) -> DataFrame:
    """Clusters whose members are numbers, with the names that ``table`` (name, id) has for them; unknown ones stay numbers."""
    joined = clusters.join(table.select(F.col("name").alias("_n"), F.col("id").cast("string").alias("_i")), F.col("member") == F.col("_i"), "left")
    return joined.select("label", F.coalesce("_n", "member").alias("member"))


def of_labels(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """Clusters whose label is in ``labels`` (label), as after a top-k."""
    return clusters.join(labels.select("label"), "label", "left_semi")
