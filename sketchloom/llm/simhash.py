"""SimHash near-duplicates: pigeonhole blocks, then exact Hamming distances.

Fingerprints: word shingles are hashed by built-in functions; an Arrow function counts, per document,
how many hashes have each bit set. Linking works on distinct fingerprints, so copies of one text are one
node however many there are.

Two fingerprints that differ in at most 3 bits agree on at least b - 3 of b blocks. Level 0 splits the 64
bits into 5 blocks and keys each fingerprint by every choice of 2 of them. A bucket of more than
``BUCKET`` fingerprints is not compared pair by pair: the bits its key leaves open are split into 6
blocks, and its fingerprints are keyed anew by 3 of those as well; level 2 does that once more. What level
2 leaves open is 12 bits at the most, so its buckets hold at most 4,096 distinct fingerprints: the bound
follows from the blocks, nothing is capped or dropped, and no link is lost at any level. Within a bucket a
search emits a spanning forest of the links, so rows stay linear in the bucket's size; classes are the
components of all forests.

Three of 64 bits find copies and all but copies. ``similar_representatives`` reaches for a Jaccard similarity of
0.8: its fingerprints have 512 bits in 39 blocks of 13, pairs that share one block are compared, and those within 96 bits,
which 99 of 100 pairs of that similarity are, become candidates; their sets decide. By pigeonhole all pairs within 38
bits are met; a pair that differs in 77 bits, the average of similarity 0.8, shares a block with a probability of 0.99,
one of 88 bits with 0.97. A bucket holds about one in 8,192 different texts besides the alike ones, so beyond some ten
million texts comparisons grow with the square of their number; tasks stay even, and wider blocks trade recall for it.

Defined cases: a text of any length is one row, its bits are counted in blocks of bounded size. Of rows that tie
for the smallest identifier of a class, the one of the least text hash stays. Columns besides the named ones
pass through whatever their names are; only one asked for that is named like a result is replaced. A null text is an empty one; both have no shingles and the fingerprint 0. A class of only
null identifiers has a null component. Repeated rows get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.storage import BROADCAST_BYTES, materialise, table_bytes
from sketchloom.functions.workers import frugal
from sketchloom.llm.columns import held, released, schema_with
from sketchloom.llm.runs import mix
from sketchloom.llm.setlinks import bucket_links, components_of, set_names, shingle_sets
from sketchloom.operators.components import star_components

SPACES = r"[\x20\x09-\x0D]+"
BITS = 64
MAX_DIFFERENCE = 3
BUCKET = 1024
#: Of wide fingerprints: words in a shingle, numbers of 64 bits, and bits of a block.
SHINGLE, WORDS, KEY_BITS = 5, 8, 13


def shingle_hashes(text: Column, size: int = 3) -> tuple[Column, Column]:
    """Expressions for the words (column ``_w``) and, given those, for the hashes of their shingles."""
    known = F.coalesce(text, F.lit(""))
    lowered = F.when(F.length(known) == F.octet_length(known), F.lower(known)).otherwise(F.translate(known, string.ascii_uppercase, string.ascii_lowercase))
    tokens = F.array_remove(F.split(lowered, SPACES), "")
    n = F.size("_w")
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get("_w", i + j) for j in range(size)))))
    few = F.array(F.xxhash64(F.array_join("_w", " ")))
    return tokens, F.when(n >= size, many).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))


#: For each byte a number of eight bytes, the k-th of which is the byte's k-th bit.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def majority_bits(offsets: np.ndarray, values: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """For each list of 64-bit hashes the number whose bits are those set in over half of the list.

    Bits are counted in byte lanes, 255 hashes at most to a lane, and lanes are summed up per list.
    """
    counts = np.zeros((len(offsets) - 1, BITS), np.int64)
    for at in range(int(offsets[0]), int(offsets[-1]), block):
        end = min(at + block, int(offsets[-1]))
        lanes = _SPREAD[values[at:end].view(np.uint8).reshape(-1, 8)]
        first = int(np.searchsorted(offsets, at, "right")) - 1
        last = int(np.searchsorted(offsets, end, "left"))
        own = np.arange(first, last)
        own = own[offsets[own + 1] > np.maximum(offsets[own], at)]
        starts, ends = np.maximum(offsets[own], at) - at, np.minimum(offsets[own + 1], end) - at
        parts = -(-(ends - starts) // 255)
        before = np.cumsum(parts) - parts
        cuts = np.repeat(starts - 255 * before, parts) + 255 * np.arange(parts.sum())
        sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(-1, BITS)
        counts[own] += np.add.reduceat(sums, before, axis=0, dtype=np.int64)
    sizes = np.diff(offsets)[:, None]
    return ((2 * counts > sizes).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("_h")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False))
        fp = pa.array(majority_bits(offsets, values).view(np.int64))
        kept = [c for c in batch.schema.names if c != "_h"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), fp], names=[*kept, "fp"])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", size: int = 3) -> DataFrame:
    """The columns ``keep`` and ``fp``, the SimHash as a signed 64-bit number."""
    tokens, hashes = shingle_hashes(F.col(text), size)
    lists = docs.select(*keep, tokens.alias("_w")).select(*keep, hashes.alias("_h"))
    return lists.mapInArrow(frugal(_vote), schema_with(docs, keep, "fp bigint"))


def _blocks(positions: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(positions, parts)]


def _masks(fixed: int, parts: int) -> list[int]:
    """The masks that fix what ``fixed`` does and all but 3 of ``parts`` blocks of the other bits."""
    free = [i for i in range(BITS) if not fixed >> i & 1]
    blocks = _blocks(free, parts)
    return [fixed | sum(1 << i for b in chosen for i in b) for chosen in itertools.combinations(blocks, parts - MAX_DIFFERENCE)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all of ``values`` (uint64) that chains of at most 3 differing bits connect."""
    left, links = np.arange(len(values)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= MAX_DIFFERENCE
            if near.any():
                found = left[near]
                links += [(at, x) for x in found]
                queue += list(found)
                left = left[~near]
    return links


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("fps")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        src, dst = [], []
        for a, b in zip(offsets[:-1], offsets[1:]):
            own = values[a:b]
            if b - a == 2:
                if np.bitwise_count(own[0] ^ own[1]) <= MAX_DIFFERENCE:
                    src.append(own[0])
                    dst.append(own[1])
            else:
                links = np.array(forest(own), np.int64).reshape(-1, 2)
                src.extend(own[links[:, 0]])
                dst.extend(own[links[:, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (src, dst)], names=["src", "dst"])


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(src, dst): links between the fingerprints of ``distinct`` (fp) whose components are the classes."""
    tops = _masks(0, 5)
    keyed = distinct.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in tops))).alias("mask"))
    masks, out = tops, None
    for level in range(3):
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        ready, hot = keyed, None
        if level < 2:
            hot = materialise(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select("mask", "key"), "hot-blocks")
            if hot.isEmpty():
                hot = None
            else:
                ready = keyed.join(hot, ["mask", "key"], "left_anti")
        lists = ready.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        found = lists.select("fps").mapInArrow(frugal(_link), "src bigint, dst bigint")
        out = found if out is None else out.unionByName(found)
        if hot is None:
            break
        finer = {m: _masks(m, 6) for m in masks}
        masks = sorted({x for own in finer.values() for x in own})
        table = F.create_map(*(c for m, own in finer.items() for c in (F.lit(_signed(m)), F.array(*(F.lit(_signed(x)) for x in own)))))
        keyed = keyed.join(hot, ["mask", "key"], "left_semi").select("fp", F.explode(F.try_element_at(table, F.col("mask"))).alias("mask")).distinct()
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, fp, component_id, class) per row; the component is the smallest identifier that links reach."""
    base = docs.select(F.col(doc_id).alias("_id"), held(list(keep)), F.col(text).alias("_t"))
    marked = materialise(fingerprints(base, ["_id", "_held"], "_t"), "simhash")
    distinct = materialise(marked.groupBy("fp").agg(F.min("_id").alias("least")), "simhash-distinct")
    edges = materialise(links(distinct.select("fp")).distinct(), "simhash-links")
    parts = star_components(edges)
    classes = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    classes = materialise(classes, "simhash-classes")
    smallest = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = classes.select("fp", "label").join(smallest, "label").select("fp", "component_id", F.col("label").alias("class"))
    return marked.join(materialise(of_fp, "simhash-components"), "fp").select(F.col("_id").alias(doc_id), *released(list(keep), ["fp", "component_id", "class"]))


def _vote_wide(size: int, words: int, key_bits: int):
    salts = mix(np.arange(1, words + 1, dtype=np.uint64))
    n_keys = BITS * words // key_bits
    place = 1 << np.arange(key_bits, dtype=np.int32)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = shingle_sets(batch.column("_t").to_pylist(), size)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                values = np.concatenate(sets)
                fp = np.stack([majority_bits(offsets, mix(values ^ salt)) for salt in salts], axis=1)
                bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")[:, : n_keys * key_bits]
                keys = (bits.reshape(len(sets), n_keys, key_bits) * place).sum(axis=2, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n_keys), pa.array(keys.ravel()))
                kept = [c for c in batch.schema.names if c != "_t"]
                sizes, prints = pa.array(np.diff(offsets)), pa.array([row.tobytes() for row in fp], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sizes, pa.array(set_names(sets)), prints, lists], names=[*kept, "n", "node", "fp", "keys"])

    return vote


def wide_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", size: int = SHINGLE, words: int = WORDS, key_bits: int = KEY_BITS) -> DataFrame:
    """The columns ``keep``, ``n`` and ``node`` (size and name of the set of shingles), ``fp`` (its SimHash of 64 * ``words`` bits) and ``keys`` (the blocks of that)."""
    plain = docs.select(*keep, F.col(text).alias("_t"))
    return plain.mapInArrow(frugal(_vote_wide(size, words, key_bits)), schema_with(docs, keep, "n bigint, node bigint, fp binary, keys array<int>"))


def bits_within(similarity: float, words: int = WORDS, sigmas: float = 2.33) -> int:
    """How many bits differ between fingerprints of sets of equal size and that Jaccard similarity, at most, in 99 of 100 pairs."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(BITS * words * p + sigmas * (BITS * words * p * (1 - p)) ** 0.5)


def _link_wide(words: int, most: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for members in batch.column("members"):
                rows = members.values
                nodes = rows.field("node").to_numpy()
                own = np.frombuffer(b"".join(rows.field("fp").to_pylist()), np.uint64).reshape(-1, words)
                left = np.arange(len(own))
                if len(own) <= 64:  # most buckets hold nothing alike: one look at all of it
                    near = np.bitwise_count(own[:, None] ^ own[None]).sum(axis=2, dtype=np.int64) <= most
                    left = np.flatnonzero(near.sum(axis=1) > 1)
                while len(left):
                    queue, left = [left[0]], left[1:]
                    while queue and len(left):
                        at = queue.pop()
                        near = np.bitwise_count(own[left] ^ own[at]).sum(axis=1, dtype=np.int64) <= most
                        found, left = left[near], left[~near]
                        src += [nodes[at]] * len(found)
                        dst += nodes[found].tolist()
                        queue += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return link


def wide_links(nodes: DataFrame, most: int, words: int = WORDS, bucket: int = BUCKET) -> DataFrame:
    """(src, dst): links that join all nodes of ``nodes`` (node, fp, keys) that share a block and differ in ``most`` bits at most.

    Buckets of more than ``bucket`` nodes are cut, and all pairs of their parts are compared, each by itself: the components are the
    same for any ``bucket``, in one round. A node is sent once per block, times the parts of its bucket.
    """
    return bucket_links(nodes.select("node", F.posexplode("keys").alias("k", "v")), nodes.select("node", "fp"), _link_wide(words, most), bucket)


def similar_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = 80, words: int = WORDS, key_bits: int = KEY_BITS, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row of each class of texts alike in their shingles: of the smallest identifier (null last), then of the least text hash.

    Texts are alike if their sets of shingles, A-Z lower-cased, have a Jaccard similarity of ``percent`` or more, or are equal; pairs to look at
    come from wide fingerprints. A text of fewer words than a shingle is one shingle; texts without words are equal.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_t"), F.xxhash64(text).alias("_x"), F.coalesce(F.length(text), F.lit(0)).alias("_l"))
    marked = materialise(wide_fingerprints(held, ["_id", "_x", "_l"], "_t", size, words, key_bits), "wide-simhash")
    nodes = marked.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min(F.struct(F.col("_x").alias("x"), F.col("_l").alias("x_len"))).alias("p"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = materialise(nodes.select("node", "n", "p.x", "p.x_len", "fp", "keys"), "wide-distinct")
    candidates = wide_links(nodes, bits_within(percent / 100, words), words, bucket)
    texts = held.select(F.col("_x").alias("x"), F.col("_l").alias("x_len"), "_t")
    parts = components_of(candidates, nodes.select("node", "n", "x", "x_len"), texts, size, percent).withColumnsRenamed({"node": "_n", "label": "class"})
    rows = marked.select("_id", "_x", "node").join(parts, F.col("node") == F.col("_n"), "left").select("_id", "_x", F.coalesce("class", "node").alias("class"))
    return _one_each(held, materialise(rows, "wide-rows")).select("_row.*")


def _one_each(held: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``held`` (_id, _x) that come first in their class of ``marked`` (_id, _x, class)."""
    least = marked.groupBy("class").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_x").alias("x"))).alias("m"))
    chosen = materialise(least.select(F.col("m.id").alias("_i"), F.col("m.x").alias("_y")), "simhash-chosen")
    both = held["_id"].eqNullSafe(chosen["_i"]) & (held["_x"] == chosen["_y"])
    kept = held.join(F.broadcast(chosen) if table_bytes(chosen) <= BROADCAST_BYTES else chosen, both, "left_semi")
    if not marked.groupBy("_id", "_x").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        kept = kept.dropDuplicates(["_id", "_x"])  # the same row several times
    return kept


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest identifier (null last), then of the least text hash."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_t"), F.xxhash64(text).alias("_x"))
    marked = materialise(near_duplicates(held, "_id", "_t", ("_x",)).select("_id", "_x", "class"), "simhash-rows")
    return _one_each(held, marked).select("_row.*")
