"""Substring dedup: merged count-min sketches first, exact groups of what they leave second.

Pass 1. Each task counts the sampled grams of its windows (see ``runs``) in a sketch of two rows and emits
it in slices of compressed slot lists. Slices are merged as streams; a slot that all tasks together hit
twice or more is set in a bitmap. Counts only overestimate, and a window is counted through a gram that it
contains, so a window that occurs twice always has its slots set: none is lost. The sketch has about eight
slots per expected gram, up to ``MAX_SLOTS`` per row; that bound is also the bound on what is broadcast.
On corpora beyond it the sketch passes more grams, and the exact pass sorts them out: a gram that passes
is a row of some forty bytes for about ten words.

Pass 2. Runs whose gram passes go to the exact stage. They are grouped by gram and by everything they
span: where that repeats, all windows of the run do. Only grams with several different spans are looked at
window by window, one text's run per different span, weighted by its number of copies. Both groupings are partial aggregates, so a passage that a third of all documents share
arrives as a few rows per task.

What a text loses depends on its content alone, so results are keyed by hash and length of the text;
copies count as often as they occur.

Defined cases: a null or empty text has no words, and the hash of no bytes. Texts shorter than a window
lose nothing. Repeated rows, with or without an identifier, count as occurrences of their own and get equal
results. A text of any length is hashed word by word and cut into blocks of windows. Columns asked for pass
through whatever their names are; only one that is named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.storage import join_checked, materialise
from sketchloom.functions.workers import frugal
from sketchloom.llm import runs
from sketchloom.llm.columns import held, released, schema_with

WINDOW = 35
GRAM = 18
SLICES = 64
MAX_SLOTS = 1 << 28
ROWS = 2


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order; words are cut at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").split()
    return runs.mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def _slots(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    shift = np.uint64(65 - slots.bit_length())
    return [grams >> shift, runs.mix(grams ^ np.uint64(runs.RADIX)) >> shift]


def _squeeze(slots: np.ndarray) -> bytes:
    gaps = np.diff(slots, prepend=np.int64(0)).astype("<u4")
    return zlib.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _expand(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def _text_runs(batches: Iterator[pa.RecordBatch], hasher: runs.Hasher):
    """(batch, found, part, offset, start): runs of each block; ``part`` and ``offset`` are per run."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            texts = batch.column("_t").slice(at, 512).to_pylist()
            parts = [word_hashes(t) if t else np.zeros(0, np.uint64) for t in texts]
            for values, bounds, which, offset in runs.blocks(parts, WINDOW):
                found = runs.find_runs(values, bounds, WINDOW, GRAM, hasher)
                piece = np.searchsorted(bounds, found.first, "right") - 1
                yield batch, found, which[piece] + at, offset[piece] - bounds[piece]


def _sketch(slots: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = [found.gram for _, found, _, _ in _text_runs(batches, runs.Hasher())]
        if not grams:
            return
        for row, own in enumerate(_slots(np.concatenate(grams), slots)):
            found, times = np.unique(own.astype(np.int64), return_counts=True)
            edges = np.searchsorted(found, np.arange(SLICES + 1) * (slots // SLICES))
            for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if a < b:
                    base, twice = found[a:b] - s * (slots // SLICES), times[a:b] > 1
                    yield pa.RecordBatch.from_pydict({"slice": [row * SLICES + s], "once": [_squeeze(base[~twice])], "twice": [_squeeze(base[twice])]}, schema=pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

    return sketch


def _merge(width: int):
    """Streams the slices of all tasks, ordered by slice, into one bitmap of repeated slots for each."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None
        schema = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])
        out = lambda: pa.RecordBatch.from_pydict({"slice": [at], "bits": [zlib.compress(np.packbits(twice).tobytes(), 1)]}, schema=schema)
        for batch in batches:
            for s, a, b in zip(*(batch.column(c).to_pylist() for c in ("slice", "once", "twice"))):
                if s != at:
                    if at is not None:
                        yield out()
                    at, once, twice = s, np.zeros(width, bool), np.zeros(width, bool)
                new = _expand(a)
                twice[new] |= once[new]
                once[new] = True
                new = _expand(b)
                once[new] = twice[new] = True
        if at is not None:
            yield out()

    return merge


def sketch_width(n_bytes: int) -> int:
    """Slots per row: about eight per expected gram, a power of two between 2^20 and ``MAX_SLOTS``."""
    return min(MAX_SLOTS, max(1 << 20, 1 << (n_bytes // 8).bit_length()))


def repeated_slots(texts: DataFrame) -> tuple[list[bytes], int]:
    """The merged sketch of ``texts`` (_t): a bitmap per row, of slots counted twice or more."""
    n_bytes = texts.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    slots = sketch_width(n_bytes)
    width = slots // SLICES
    pieces = texts.select("_t").mapInArrow(frugal(_sketch(slots)), "slice int, once binary, twice binary")
    merged = pieces.repartition(ROWS * SLICES, "slice").sortWithinPartitions("slice").mapInArrow(frugal(_merge(width)), "slice int, bits binary")
    found = dict(merged.collect())  # at most ROWS * MAX_SLOTS / 8 bytes
    empty = bytes(width // 8)
    return [b"".join(zlib.decompress(found[r * SLICES + s]) if r * SLICES + s in found else empty for s in range(SLICES)) for r in range(ROWS)], slots


def _candidates(shared, slots: int):
    """The runs whose gram the sketch has counted twice or more."""
    schema = pa.schema([("x", pa.int64()), ("x_len", pa.int32()), ("at", pa.int64()), ("n", pa.int32()), ("gram", pa.int64()), ("span", pa.int64())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps, hasher = [np.frombuffer(b, np.uint8) for b in shared.value], runs.Hasher()
        for batch, found, part, offset in _text_runs(batches, hasher):
            set_ = np.ones(len(found.gram), bool)
            for bitmap, own in zip(bitmaps, _slots(found.gram, slots)):
                set_ &= (bitmap[own >> np.uint64(3)] >> (np.uint64(7) - (own & np.uint64(7))).astype(np.uint8)) & 1 > 0
            first, last = found.first[set_], found.last[set_]
            if len(first):
                rows = pa.array(part[set_])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("x").take(rows), batch.column("x_len").take(rows), pa.array(first + offset[set_]), pa.array((last - first + 1).astype(np.int32)),
                        pa.array(found.gram[set_].view(np.int64)), pa.array(found.span[set_].view(np.int64)),
                    ],
                    schema=schema,
                )

    return candidates


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the wanted runs of each text, one row each."""
    hasher = runs.Hasher()
    for batch in batches:
        for text, wanted in zip(batch.column("_t"), batch.column("wanted")):
            prefix, own = hasher.prefix(word_hashes(text.as_py() or "")), wanted.values
            first, sizes = own.field("at").to_numpy(), own.field("n").to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            k = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            starts = np.repeat(first, sizes) + k
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            wins = hasher.spans(prefix, starts, starts + WINDOW).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(own.field(c).take(rows) for c in ("gram", "span", "copies")), pa.array(k.astype(np.int32)), pa.array(wins)], names=["gram", "span", "copies", "k", "win"])


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(x, x_len, starts): windows of each text that occur anywhere else too, as structs (at, n, ks).

    ``ks`` null: all n windows from ``at``; else those at ``at`` plus each of ``ks``. ``texts``: x, x_len, _t.
    """
    spark = texts.sparkSession
    bitmaps, slots = repeated_slots(texts)
    shared = spark.sparkContext.broadcast(bitmaps)
    found = materialise(texts.mapInArrow(frugal(_candidates(shared, slots)), "x long, x_len int, at long, n int, gram long, span long"), "candidate-runs")
    spans = materialise(found.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("copies")), "run-spans")
    kinds = spans.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("runs")).filter("runs > 1")
    kinds = spans.join(kinds, "gram")
    whole = materialise(kinds.filter("copies > 1").select("gram", "span"), "whole-runs")
    mixed = materialise(kinds.filter("kinds > 1").select("gram", "span", "copies"), "mixed-runs")

    # One text's run for each different run of a gram that has several, window by window.
    one_each = join_checked(found, mixed, ["gram", "span"]).groupBy("gram", "span", "copies").agg(F.min(F.struct("x", "x_len", "at", "n")).alias("p"))
    wanted = one_each.groupBy(F.col("p.x").alias("x"), F.col("p.x_len").alias("x_len")).agg(F.collect_list(F.struct("gram", "span", "copies", F.col("p.at").alias("at"), F.col("p.n").alias("n"))).alias("wanted"))
    once = texts.groupBy("x", "x_len").agg(F.first("_t").alias("_t"))  # copies meet within tasks first
    holders = once.join(materialise(wanted, "wanted-runs").hint("merge"), ["x", "x_len"]).select("_t", "wanted")
    windows = materialise(holders.mapInArrow(frugal(_windows), "gram long, span long, copies long, k int, win long"), "mixed-windows")
    again = windows.groupBy("gram", "win").agg(F.sum("copies").alias("n")).filter("n > 1").select("gram", "win")
    parts = windows.filter("copies = 1").join(again, ["gram", "win"]).groupBy("gram", "span").agg(F.collect_list("k").alias("ks"))
    parts = materialise(parts, "part-runs")

    full = join_checked(found, whole, ["gram", "span"])
    full = full.select("x", "x_len", "at", "n", F.lit(None).cast("array<int>").alias("ks"))
    some = join_checked(found, parts, ["gram", "span"]).select("x", "x_len", "at", "n", "ks")
    return full.unionByName(some).groupBy("x", "x_len").agg(F.collect_set(F.struct("at", "n", "ks")).alias("starts"))


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n positions the windows at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:n]) > 0


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, 512):
            batch = whole.slice(first, 512)
            words, removed, digests, texts = [], [], [], []
            for text, starts in zip(batch.column("_t"), batch.column("starts")):
                own = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                lost = np.zeros(len(own), bool)
                if starts.is_valid:
                    at = [np.arange(s["at"], s["at"] + s["n"]) if s["ks"] is None else s["at"] + np.array(s["ks"], np.int64) for s in starts.as_py()]
                    lost = covered(len(own), np.concatenate(at), WINDOW)
                kept = b" ".join([w for w, gone in zip(own, lost) if not gone] if lost.any() else own)
                words.append(len(own))
                removed.append(int(lost.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "surrogatepass"))
            names = [c for c in batch.schema.names if c not in ("_t", "starts")]
            arrays = [*(batch.column(c) for c in names), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "n_words", "n_removed", "kept_sha256", "kept_text"])


def dedup_windows(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(*keep, n_words, n_removed, kept_sha256, kept_text): texts without the words of repeated windows."""
    base = docs.select(held(keep), F.col(text).alias("_t"), F.xxhash64(text).alias("x"), F.coalesce(F.length(text), F.lit(-1)).alias("x_len"))
    marks = repeated_windows(base.select("x", "x_len", "_t").filter("_t is not null"))
    # From a written table Spark may split the copies of a very frequent text over tasks.
    joined = base.join(materialise(marks, "repeated-words").hint("merge"), ["x", "x_len"], "left").select("_held", "_t", "starts")
    pruned = joined.mapInArrow(frugal(_prune), schema_with(joined, ["_held"], "n_words long, n_removed long, kept_sha256 string, kept_text string"))
    return pruned.select(*released(keep, ["n_words", "n_removed", "kept_sha256", "kept_text"]))
