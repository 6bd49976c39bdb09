"""Hot keys cut into blocks: pairs within a key become many even groups, and none is lost.

A key of more than ``bound`` rows gets as many blocks as keep two of them together within about that bound; rows find
their block by a hash. Pairs of blocks are then dealt out as groups of their own. Whatever the bound is, any two rows
of one key meet in some group; what grows is only how often the rows of a hot key are sent, with the number of its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.storage import join_checked, materialise


def blocked(rows: DataFrame, key: list[str], spread: Column, bound: int, weight: Column | None = None, most: int | None = None) -> DataFrame:
    """``rows`` (written, read twice) with ``_blocks``, the number of blocks of their key, and ``_block``, their own.

    ``spread``: a hash of what rows of one key differ in. ``weight``: what a row counts for, 1 by default.
    ``most``: blocks of a key at most, for pairs that are only passed on: rows are then sent no more often, and groups may pass the bound.
    """
    total = F.sum(weight) if weight is not None else F.count(F.lit(1))
    hot = rows.groupBy(*key).agg(total.alias("_n")).filter(F.col("_n") > bound)
    blocks = F.ceil(F.col("_n") / max(1, bound // 2)).cast("int")
    hot = materialise(hot.select(*key, (F.least(blocks, F.lit(most)) if most else blocks).alias("_blocks")), "hot-keys")
    if hot.isEmpty():
        return rows.withColumn("_blocks", F.lit(1)).withColumn("_block", F.lit(0))
    known = join_checked(rows, hot, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    return known.withColumn("_block", F.pmod(spread, F.col("_blocks")).cast("int"))


def met_in_groups(rows: DataFrame) -> DataFrame:
    """Rows of ``blocked`` with ``_i`` and ``_j``: any two rows of a key share a group (key, _i, _j), of two blocks at most."""
    others = F.when(F.col("_blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("_blocks") - 1), F.col("_block")))
    dealt = rows.withColumn("_x", F.explode(others))
    return dealt.withColumn("_i", F.least("_block", "_x")).withColumn("_j", F.greatest("_block", "_x")).drop("_blocks", "_block", "_x")


def left_of_groups(rows: DataFrame) -> DataFrame:
    """Rows of ``blocked`` as left sides of a join on (key, _i, _j): in the groups whose first block is theirs."""
    return rows.withColumn("_j", F.explode(F.sequence(F.col("_block"), F.col("_blocks") - 1))).withColumnRenamed("_block", "_i").drop("_blocks")


def right_of_groups(rows: DataFrame) -> DataFrame:
    """Rows of ``blocked`` as right sides: in the groups whose second block is theirs. Each pair of rows meets once, but for order."""
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_block")))).withColumnRenamed("_block", "_j").drop("_blocks")
