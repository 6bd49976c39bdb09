"""k-mer sketches: the c least hash values of each sequence under each hash function.

``shingles`` runs in Arrow batches with array arithmetic: a sequence's k-mer values are made once and
hashed by every function, and only c values per function leave the worker. ``shingles_sql`` is the same in
built-in functions, for reading and for cross-checks; ``kmers`` and ``min_hashes`` are its steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchloom.config import SketchConfig
from sketchloom.functions.hashing import ALPHABET, universal_hash
from sketchloom.functions.storage import BROADCAST_BYTES, materialise, table_bytes
from sketchloom.functions.workers import frugal

NOT_LETTERS = "characters other than A to Z: normalise it first"
SHINGLE_DDL = "name string, hash_idx int, vals array<bigint>"


def kmer_values(data: np.ndarray, k: int) -> np.ndarray:
    """Values of all windows of k letters of an array of ASCII codes."""
    if len(data) < k:
        return np.zeros(0, np.int64)
    digits = data.astype(np.int64) - 65
    out = np.zeros(len(data) - k + 1, np.int64)
    for i in range(k):
        out = out * ALPHABET + digits[i : i + len(out)]
    return out


def _letters(name: str | None, sequence: str | None) -> np.ndarray:
    data = np.frombuffer((sequence or "").encode("utf-8"), np.uint8)
    if len(data) and (data.min() < 65 or data.max() > 90):
        raise ValueError(f"sequence {name!r} has {NOT_LETTERS}")
    return data


def bottom(values: np.ndarray, c: int) -> np.ndarray:
    """The c least values in order, repeats included."""
    return np.sort(np.partition(values, c - 1)[:c] if len(values) > c else values)


def _sketch(k: int, c: int, family: list[tuple[int, int]], prime: int, first: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, indexes, values = [], [], []
            for name, sequence in zip(batch.column("name").to_pylist(), batch.column("sequence").to_pylist()):
                found = kmer_values(_letters(name, sequence), k) % prime
                if len(found) < c:
                    continue
                for i, (a, b) in enumerate(family[first:], first):
                    names.append(name)
                    indexes.append(i)
                    values.append(bottom((found * a + b) % prime, c))
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * c), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(indexes, pa.int32()), lists], names=["name", "hash_idx", "vals"])

    return sketch


def shingles(sequences: DataFrame, cfg: SketchConfig, first_hash: int = 0) -> DataFrame:
    """(name, hash_idx, vals) for the functions from ``first_hash`` on; sequences of fewer than c k-mers have none."""
    rows = sequences.select("name", "sequence")
    return rows.mapInArrow(frugal(_sketch(cfg.k, cfg.c, cfg.family, cfg.prime, first_hash)), SHINGLE_DDL)


def _coded(sequences: DataFrame, k: int) -> DataFrame:
    """(name, c): the letters of sequences of at least k as digits, A being 0; found by position in constant time."""
    wrong = F.raise_error(F.concat(F.lit("sequence "), F.coalesce("name", F.lit("null")), F.lit(f" has {NOT_LETTERS}"))).cast("string")
    letters = F.when(F.coalesce("sequence", F.lit("")).rlike(r"\A[A-Z]*\z"), F.col("sequence")).otherwise(wrong)
    checked = sequences.select("name", letters.alias("s")).filter(F.length("s") >= k)
    return checked.select("name", F.transform(F.split("s", ""), lambda x: F.ascii(x) - 65).alias("c"))


def _value_at(codes: str, i: Column, k: int) -> Column:
    """The value of the k-mer at the 0-based position i, from digits."""
    total = F.lit(0).cast("long")
    for j in range(k):
        total = total * ALPHABET + F.get(F.col(codes), i + j)
    return total


def kmers(sequences: DataFrame, k: int) -> DataFrame:
    """(name, pos, value): every window of k letters; its text is ``substring(sequence, pos + 1, k)``."""
    digits = _coded(sequences, k)
    return digits.select("name", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("c") - k), lambda i: _value_at("c", i, k))).alias("pos", "value"))


def _profile(k: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for name, sequence in zip(batch.column("name").to_pylist(), batch.column("sequence").to_pylist()):
                values = kmer_values(_letters(name, sequence), k)
                if len(values):
                    names.append(name)
                    found.append((len(values), values.min(), values.max(), len(np.unique(values))))
            columns = np.array(found, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(x) for x in columns)], names=["name", "kmers", "least", "most", "kinds"])

    return profile


def kmer_profiles(sequences: DataFrame, k: int) -> DataFrame:
    """(name, kmers, least, most, kinds): number, range and different values of each name's k-mers.

    A sequence is looked at where it lies. Only names that several sequences have meet their k-mers by a shuffle.
    """
    rows = sequences.select("name", "sequence")
    several = materialise(rows.groupBy(F.col("name").alias("_n")).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("_n"), "repeated-names")
    ddl = "name string, kmers long, least long, most long, kinds long"
    if several.isEmpty():
        return rows.mapInArrow(frugal(_profile(k)), ddl)
    several = F.broadcast(several) if table_bytes(several) <= BROADCAST_BYTES else several
    same = F.col("name").eqNullSafe(F.col("_n"))
    met = kmers(rows.join(several, same, "left_semi"), k).groupBy("name")
    met = met.agg(F.count(F.lit(1)).alias("kmers"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_distinct("value").alias("kinds"))
    return rows.join(several, same, "left_anti").mapInArrow(frugal(_profile(k)), ddl).unionByName(met)


def min_hashes(sequences: DataFrame, cfg: SketchConfig) -> DataFrame:
    """(name, hash_idx, rank, h): the c least hash values per function, in built-in functions only."""
    digits = _coded(sequences, cfg.k)
    valued = digits.select("name", F.transform(F.sequence(F.lit(0), F.size("c") - cfg.k), lambda i: _value_at("c", i, cfg.k)).alias("v"))
    family = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(cfg.family)))
    hashed = valued.select("name", "v", F.explode(family).alias("f"))
    least = F.slice(F.array_sort(F.transform("v", lambda v: universal_hash(v, F.col("f.a"), F.col("f.b")))), 1, cfg.c)
    return hashed.select("name", F.col("f.i").alias("hash_idx"), F.posexplode(least).alias("rank", "h"))


def shingles_sql(sequences: DataFrame, cfg: SketchConfig) -> DataFrame:
    """As ``shingles``, from built-in functions."""
    found = min_hashes(sequences, cfg).groupBy("name", "hash_idx").agg(F.array_sort(F.collect_list("h")).alias("vals"))
    return found.filter(F.size("vals") >= cfg.c)


def bottom_of_groups(rows: DataFrame, keys: list[str], value: str, c: int) -> DataFrame:
    """``rows`` (*keys, value) without all but the c least values of each key, repeats included.

    A rank filter that Spark also applies before it shuffles: no task sends more than c rows of a key, whatever it holds.
    """
    order = Window.partitionBy(*keys).orderBy(value)
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= c).drop("_r")


def _combined(c: int, most: int):
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, np.ndarray] = {}

        def emitted() -> pa.RecordBatch:
            keys = list(kept)
            out = pa.RecordBatch.from_arrays([pa.array([n for n, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.int32()), pa.array([v.tolist() for v in kept.values()], pa.list_(pa.int64()))], names=["name", "hash_idx", "vals"])
            kept.clear()
            return out

        for batch in batches:
            for name, i, vals in zip(batch.column("name").to_pylist(), batch.column("hash_idx").to_pylist(), batch.column("vals")):
                own = vals.values.to_numpy()
                before = kept.get((name, i))
                kept[name, i] = bottom(own if before is None else np.concatenate([before, own]), c)
            if len(kept) >= most:
                yield emitted()
        if kept:
            yield emitted()

    return combine


def combined_in_tasks(rows: DataFrame, c: int, most: int = 1 << 16) -> DataFrame:
    """Sketch rows with those of one name and function merged within each task, ``most`` keys held at a time; works on streams too."""
    return rows.select("name", "hash_idx", "vals").mapInArrow(frugal(_combined(c, most)), SHINGLE_DDL)


def merge_sketches(old: DataFrame, new: DataFrame, c: int) -> DataFrame:
    """Sketch rows of both, c least values of their union as multisets: the update of stored sketches."""
    each = old.unionByName(new).select("name", "hash_idx", F.explode("vals").alias("h"))
    least = bottom_of_groups(each, ["name", "hash_idx"], "h", c)
    return least.groupBy("name", "hash_idx").agg(F.array_sort(F.collect_list("h")).alias("vals"))  # c values at most


def display(vals: str = "vals", hash_idx: str = "hash_idx"):
    """A shingle as text: index and values joined by ``$``."""
    return F.concat_ws("$", F.col(hash_idx).cast("string"), F.transform(vals, lambda v: v.cast("string")))
