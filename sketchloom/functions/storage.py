"""Where intermediate tables live, so that jobs outlast executors.

Every table goes to the folder named by ``spark.checkpoint.dir``, which all nodes share. Only with a local
master (tests, a laptop) and without that setting a folder of this machine is used; elsewhere its absence is
an error, as executors would not see each other's files. Tables are removed when the Python process ends, or
earlier where a ``scratch_scope`` ends.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from sketchloom.functions.workers import bounded_batches

LOCAL_FALLBACK = "file:///tmp/checkpoints/sketchloom"
#: Bytes of rows up to which a counted table is broadcast.
BROADCAST_BYTES = 32 << 20

#: The tables made in the innermost scope of this thread or task; scopes of other threads have lists of their own.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share; also arms ``checkpoint()`` and bounds Arrow batches."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all nodes of {sc.master} share")
        found = LOCAL_FALLBACK
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    bounded_batches(spark)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when this Python process ends."""
    path = f"{shared_dir(spark)}/sketchloom-{label}-{uuid.uuid4().hex}"
    if (own := _scope.get()) is not None:
        own.append(path)
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; nothing happens if it or the session is gone."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: the folder is the cluster's to clean
        return


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """Remove the tables made inside when it ends; results must have been written or collected by then.

    What it gives, when called, hands the table made last to the scope around, if there is one.
    """
    own, outer = [], _scope.get()

    def keep() -> None:
        path = own.pop()
        if outer is not None:
            outer.append(path)

    token = _scope.set(own)
    try:
        yield keep
    finally:
        _scope.reset(token)
        for path in own:
            remove(spark, path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As ``materialise``, with the number of rows, which is observed while they are written."""
    seen = Observation()
    return materialise(df.observe(seen, F.count(F.lit(1)).alias("n")), label), seen.get["n"]


def value_bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.lit(8) + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, StructType):
        return sum((value_bytes(value.getField(f.name), f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType, MapType)):
            return F.aggregate(value, F.lit(24).cast("long"), lambda a, x: a + value_bytes(x, kind.elementType).cast("long"))
        return F.lit(24) + F.lit(8) * F.coalesce(F.size(value), F.lit(0))
    if isinstance(kind, MapType):
        return value_bytes(F.map_keys(value), ArrayType(kind.keyType)) + value_bytes(F.map_values(value), ArrayType(kind.valueType))
    return F.lit(8)


def table_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of ``df`` take in memory, from one pass over them."""
    row = sum((F.coalesce(value_bytes(F.col(f"`{f.name}`"), f.dataType), F.lit(8)).cast("long") for f in df.schema), F.lit(16).cast("long"))
    return df.agg(F.sum(row)).first()[0] or 0


def join_shuffled(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """Join by shuffles, whatever Spark takes the sizes for, so that neither side passes through the driver.

    Its estimate of a written table is that of compressed files and does not see the rows that ``explode`` makes.
    """
    return left.join(right.hint("merge"), on, how)


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join a written table ``right``: broadcast if its rows are summed up and small, else by shuffles."""
    return left.join(F.broadcast(right) if table_bytes(right) <= max_bytes else right, on, how)
