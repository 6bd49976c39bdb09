"""Sketches of streams of sequences: appended as they come, or kept merged per name in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sketchloom.config import SketchConfig
from sketchloom.operators.sketch import SHINGLE_DDL, bottom, combined_in_tasks, shingles


def stream_shingles(sequences: DataFrame, cfg: SketchConfig, path: str, checkpoint: str):
    """Start a query that appends the shingles of arriving ``sequences`` (name, sequence) to a Parquet table.

    The table is partitioned by hash index, so graphs of fewer functions read fewer partitions.
    """
    found = shingles(sequences, cfg)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("hash_idx").outputMode("append").start()


def _updated(c: int):
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = np.array(state.get[0], np.int64) if state.exists else np.zeros(0, np.int64)
        after = before
        for frame in frames:
            after = bottom(np.concatenate([after, *frame["vals"]]), c)
        if len(after) != len(before) or (after != before).any():
            state.update((after.tolist(),))
            yield pd.DataFrame({"name": [key[0]], "hash_idx": [key[1]], "vals": [after.tolist()]})

    return update


def merged_stream(sequences: DataFrame, cfg: SketchConfig) -> DataFrame:
    """(name, hash_idx, vals) of a stream of (name, sequence): a row whenever the c least values of a name change.

    State is c values per name and function; tasks merge what they have of a name before it is sent. Sequences of one name, as of parts of a long one, are merged as multisets, like ``merge_sketches``.
    """
    rows = combined_in_tasks(shingles(sequences, cfg), cfg.c).groupBy("name", "hash_idx")
    return rows.applyInPandasWithState(_updated(cfg.c), SHINGLE_DDL, "vals array<bigint>", "update", GroupStateTimeout.NoTimeout)


def stream_merged_sketches(sequences: DataFrame, cfg: SketchConfig, path: str, checkpoint: str, **trigger):
    """Start a query that writes the changed rows of each batch under ``path``; a batch that is repeated replaces its own rows."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream = merged_stream(sequences, cfg).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
    return (stream.trigger(**trigger) if trigger else stream).start()


def current_sketches(spark: SparkSession, path: str) -> DataFrame:
    """(name, hash_idx, vals): the last row that a stream has written for each name and function."""
    rows = spark.read.schema(f"{SHINGLE_DDL}, batch long").parquet(path)
    return rows.groupBy("name", "hash_idx").agg(F.max_by("vals", "batch").alias("vals"))
