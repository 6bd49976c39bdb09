"""MinHash near-duplicates by SuperMinHash: lower-variance signatures, bands, confirmation on full sets, union-find.

Signatures. Each shingle draws a random permutation of the m positions; the value it offers to its j-th position is
j + a uniform number. Positions keep the least offer. The ranks that one shingle offers to different positions are thus all different,
which correlates positions negatively and lowers the variance of estimates, while each position by itself is a
MinHash. Permutations are dealt step by step for all shingles of a batch, and a text stops at the first step that
has filled all its positions: later steps offer larger values only.

Bands. 42 bands of 6 positions: sets of a similarity of 0.85 share none with a probability of 2e-9. In a bucket, sets are
linked as candidates if 4-bit digests of their signatures agree in so many positions as all but one in 10^9 pairs of 0.85
do. Buckets of more than ``BUCKET`` sets are cut into blocks and all pairs of blocks are compared, each as a group of
its own; a group emits a spanning forest. Confirmation on full sets and grouping: ``setlinks``.

Defined cases: copies of a set are one node, however many there are. A text without words, or null, has no shingles
and is its own component; a text of fewer words than a shingle has one, its whole sequence. Texts of any length are
signed in parts that are merged. Repeated rows get equal results. A component of only null identifiers has a null component,
and such rows are not kept. An empty table gives no rows. Columns asked for pass through whatever their names are; one named
like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.storage import materialise
from sketchloom.functions.workers import frugal
from sketchloom.llm.columns import held, released, schema_with
from sketchloom.llm.runs import RADIX, mix
from sketchloom.llm.setlinks import BUCKET, bucket_links, components_of, set_names, shingle_sets

SIZE, PERCENT = 3, 85
BANDS, ROWS = 42, 6
#: Shingles that are signed at once.
PART = 1 << 16
UNSEEN = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(offsets: np.ndarray, values: np.ndarray, m: int) -> np.ndarray:
    """Signatures, one row of m numbers per list of 64-bit hashes; empty lists keep the largest number."""
    n = len(offsets) - 1
    out = np.full(n * m, UNSEEN, np.uint64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    dealt = np.tile(np.arange(m, dtype=np.uint16), len(values))
    at, hashes = np.arange(len(values)) * m, values
    for j in range(m):
        drawn = mix(hashes + np.uint64((j + 1) * RADIX & (1 << 64) - 1))
        k = j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        place = dealt[at + k].astype(np.int64)
        dealt[at + k] = dealt[at + j]
        np.minimum.at(out, row * m + place, np.uint64(j << 32) | drawn >> np.uint64(32))
        unfilled = (out.reshape(n, m) == UNSEEN).any(axis=1)
        left = unfilled[row]
        if not left.any():
            break
        if not left.all():
            row, at, hashes = row[left], at[left], hashes[left]
    return out.reshape(n, m)


def signatures(sets: list[np.ndarray], m: int, part: int = PART) -> np.ndarray:
    """As ``superminhash``, in parts of bounded size: a set in several is the minimum of its parts."""
    out = np.full((len(sets), m), UNSEEN, np.uint64)
    pieces = [(i, s[a : a + part]) for i, s in enumerate(sets) for a in range(0, len(s), part)]
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= part):
            size += len(pieces[end][1])
            end += 1
        own = [p for _, p in pieces[at:end]]
        found = superminhash(np.concatenate([[0], np.cumsum([len(p) for p in own])]), np.concatenate(own), m)
        np.minimum.at(out, [i for i, _ in pieces[at:end]], found)
        at = end
    return out


def _sign(size: int, bands: int, rows: int):
    m = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = shingle_sets(batch.column("_t").to_pylist(), size)
                found = mix(signatures(sets, m))
                keys = np.zeros((len(sets), bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys ^ found[:, r::rows])
                digest = (found & np.uint64(15)).astype(np.uint8)
                if m % 2:
                    digest = np.pad(digest, ((0, 0), (0, 1)))
                packed = digest[:, ::2] << 4 | digest[:, 1::2]
                names = [c for c in batch.schema.names if c != "_t"]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_names(sets)), lists, pa.array([p.tobytes() for p in packed], pa.binary())],
                    names=[*names, "n", "node", "bands", "digest"],
                )

    return sign


def agreement(m: int, percent: int, sigmas: float = 6.0) -> int:
    """In how many of m positions 4-bit digests of sets of that similarity agree, all but one pair in 10^9."""
    p = percent / 100 + (1 - percent / 100) / 16
    return int(m * p - sigmas * (m * p * (1 - p)) ** 0.5)


def _candidates(m: int, least: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for members in batch.column("members"):
                rows = members.values
                node = rows.field("node").to_numpy()
                own = np.frombuffer(b"".join(rows.field("digest").to_pylist()), np.uint8).reshape(len(node), -1)
                own = np.concatenate([own >> 4, own & 15], axis=1)
                left = np.arange(len(node))
                extra = own.shape[1] - m  # a digit of padding agrees always
                while len(left):
                    queue, left = [left[0]], left[1:]
                    while queue and len(left):
                        i = queue.pop()
                        near = (own[left] == own[i]).sum(axis=1) - extra >= least
                        found, left = left[near], left[~near]
                        src += [node[i]] * len(found)
                        dst += node[found].tolist()
                        queue += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return link


def near_duplicates(
    docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, bucket: int = BUCKET
) -> DataFrame:
    """(*keep, n_shingles, component_id, kept) per row; the component is the smallest identifier that links reach."""
    base = docs.select(held(keep), F.col(doc_id).alias("_id"), F.col(text).alias("_t"), F.xxhash64(text).alias("x"), F.coalesce(F.length(text), F.lit(0)).alias("x_len"))
    plain = base.drop("_held").filter("x_len > 0")
    signed = materialise(plain.mapInArrow(frugal(_sign(size, bands, rows)), schema_with(plain, ["_id", "x", "x_len"], "n long, node long, bands array<bigint>, digest binary")).filter("n > 0"), "signed")
    first = F.min(F.struct("x", "x_len")).alias("p")
    nodes = signed.groupBy("node").agg(F.min("_id").alias("least"), F.first("n").alias("n"), first, F.first("bands").alias("bands"), F.first("digest").alias("digest"))
    nodes = materialise(nodes.select("node", "least", "n", "p.x", "p.x_len", "bands", "digest"), "set-nodes")
    keyed = nodes.select("node", F.posexplode("bands").alias("k", "v"))
    candidates = bucket_links(keyed, nodes.select("node", "digest"), _candidates(bands * rows, agreement(bands * rows, percent)), bucket)
    parts = components_of(candidates, nodes.select("node", "n", "x", "x_len"), base.select("x", "x_len", "_t"), size, percent)
    classes = materialise(nodes.select("node", "least").join(parts, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")), "set-classes")
    smallest = classes.groupBy("label").agg(F.min("least").alias("component"))
    named = classes.select("node", "label").join(smallest, "label").select("node", "component")
    of_text = signed.groupBy("x", "x_len").agg(F.first("node").alias("node"), F.first("n").alias("n")).join(named, "node").select("x", "x_len", "n", "component")
    joined = base.drop("_t").join(materialise(of_text, "set-texts"), ["x", "x_len"], "left")
    result = joined.select("_held", "_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("n").isNull(), F.col("_id")).otherwise(F.col("component")).alias("component_id"))
    result = result.withColumn("kept", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)))
    return result.select(*released(keep, ["n_shingles", "component_id", "kept"]))
