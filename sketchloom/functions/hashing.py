"""The universal hash family and the scalar expressions of sketching and scoring.

All integers stay below 2^63: values are reduced modulo the prime before they are multiplied, and ANSI mode
would raise on an overflow rather than wrap.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The modulus, the base of k-mer values, and the weight of a region number in a vertex value.
PRIME = 1_280_000_003
ALPHABET = 20
REGION_WEIGHT = 10_000_000


def hash_params(seed: int, n: int) -> list[tuple[int, int]]:
    """The first n pairs (a, b) of the family of ``seed``; longer families start with shorter ones."""
    def draw(i: int, what: str) -> int:
        return int.from_bytes(hashlib.sha256(f"{seed}/{i}/{what}".encode()).digest()[:8], "big") % (2**31 - 1)

    return [(1 + draw(i, "a") % (PRIME - 1), draw(i, "b")) for i in range(n)]


def params_table(spark: SparkSession, family: list[tuple[int, int]]) -> DataFrame:
    """The family as rows (hash_idx, a, b)."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(family)], "hash_idx int, a long, b long")


def kmer_value(kmer: Column, k: int) -> Column:
    """Letters as base-20 digits, most significant first; digits reach 25, so values may coincide."""
    total = F.lit(0).cast("long")
    for i in range(k):
        total = total * ALPHABET + (F.ascii(F.substring(kmer, i + 1, 1)) - 65)
    return total


def universal_hash(value: Column, a: Column, b: Column) -> Column:
    return (F.pmod(value, F.lit(PRIME)) * a + b) % F.lit(PRIME)


def vertex_value(name: Column) -> Column:
    """``p_d`` is p + 10^7 (d + 1), split at the first underscore; a name without one is its number."""
    number = F.regexp_extract(name, r"^(\d+)", 1).cast("long")
    region = F.regexp_extract(name, r"^[^_]*_(\d+)", 1)
    return F.when(F.contains(name, F.lit("_")), number + F.lit(REGION_WEIGHT) * (region.cast("long") + 1)).otherwise(number)


def split_name(name: Column) -> tuple[Column, Column]:
    """Sequence and region part of a name, cut at its last underscore; no underscore: no region."""
    has = F.contains(name, F.lit("_"))
    return F.when(has, F.regexp_extract(name, r"^(.*)_[^_]*$", 1)).otherwise(name), F.when(has, F.regexp_extract(name, r"_([^_]*)$", 1))


def bare_name(member: Column) -> Column:
    """A marked member without its marker and region."""
    return F.regexp_extract(member, r"^.([^_]*)", 1)


def entropy_term(w: Column, n: Column) -> Column:
    """-w log2(w / n), and 0 where w is not positive."""
    return F.when(w > 0, -w * F.log2(w / n)).otherwise(F.lit(0.0))


def letters_only(text: Column) -> Column:
    """A text as a sequence over A-Z: other characters go first, then case."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
