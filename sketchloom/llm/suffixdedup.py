"""Suffix-array dedup of byte windows, over shards that content deals out.

Equal windows must meet in one shard, so shards are dealt by content: consecutive windows that share a
sampled gram form a run (see ``runs``), and runs of equal grams go to one shard. Before that, runs that
span the same bytes are counted as one, with weight, so thousands of copies of a text are one row; a run
of a gram that occurs once in the corpus cannot hold a repeat and stays behind.

Each shard strings its runs together in a disk-backed text and builds suffix and longest-common-prefix
arrays by induced sorting (see ``induced``). Neighbours with ``length`` bytes in common form the classes
of equal windows; a class of more than one window, or of one of a run that occurs more than once, is a
repeat.

A gram with more than ``KINDS`` different runs would make one shard large for the sake of one passage.
Its runs are cut into spans of ``PART`` windows, which are dealt anew by all that their windows have in
common; what still has too many kinds is cut into single windows, which are counted as rows. That is exact
at every step and drops nothing.

Defined cases: a null or empty text has no bytes and loses none. Texts shorter than a window lose nothing.
Repeated rows, with or without an identifier, count as occurrences of their own and get equal results. A text
of any length is cut into blocks of half a million bytes for finding, and pruned as one array. Columns asked
for pass through whatever their names are; only one that is named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.storage import join_checked, materialise
from sketchloom.functions.workers import frugal
from sketchloom.llm import induced, runs
from sketchloom.llm.columns import held, released, schema_with
from sketchloom.llm.countmin import covered

LENGTH = 400
GRAM = 200
KINDS = 256
PART = 16
SHARD_BYTES = 2 << 20

_VALUE = runs.mix(np.arange(1, 257, dtype=np.uint64))


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _find(length: int, gram: int):
    """Every run of every text: where it is, what it spans and where its gram lies."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = runs.Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                parts = [_VALUE[np.frombuffer(encoded(t), np.uint8)] for t in batch.column("_t").slice(at, 256).to_pylist()]
                for values, bounds, which, offset in runs.blocks(parts, length):
                    found = runs.find_runs(values, bounds, length, gram, hasher)
                    piece = np.searchsorted(bounds, found.first, "right") - 1
                    rows = pa.array(which[piece] + at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("x").take(rows), batch.column("x_len").take(rows), pa.array(found.first + (offset - bounds[:-1])[piece]),
                            pa.array((found.last - found.first + 1).astype(np.int32)), pa.array(found.gram.view(np.int64)), pa.array(found.span.view(np.int64)), pa.array(found.lead.astype(np.int32)),
                        ],
                        names=["x", "x_len", "at", "n", "gram", "span", "lead"],
                    )

    return find


def _cut_runs(length: int):
    """The bytes that each wanted run of a text spans."""
    schema = pa.schema([("gram", pa.int64()), ("span", pa.int64()), ("copies", pa.int64()), ("kinds", pa.int64()), ("n", pa.int32()), ("lead", pa.int32()), ("bytes", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for text, wanted in zip(batch.column("_t"), batch.column("wanted")):
                own = encoded(text.as_py())
                for w in wanted.as_py():
                    part = own[w["at"] : w["at"] + w["n"] + length - 1]
                    rows.append((w["gram"], w["span"], w["copies"], w["kinds"], w["n"], w["lead"], part))
                    held += len(part)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return cut


def _classes(batches, length: int, starts: np.ndarray, counts: np.ndarray, copies: np.ndarray):
    """Yield (suffixes, which of them are windows whose class weighs over 1); classes may run over batches."""
    held, weight = [], 0  # of the class that the last batch ended in
    for suffixes, prefixes in batches:
        run = np.searchsorted(starts, suffixes, "right") - 1
        window = suffixes - starts[run] < counts[run]
        own = np.where(window, copies[run], 0)
        fresh = np.flatnonzero(prefixes < length)
        if len(fresh) == 0 or fresh[0] > 0:  # the batch goes on with that class
            head = int(fresh[0]) if len(fresh) else len(suffixes)
            held.append((suffixes[:head], window[:head]))
            weight += int(own[:head].sum())
        if len(fresh):
            for part in held:
                yield part[0], part[1] & (weight > 1)
            edges = np.r_[fresh, len(suffixes)]
            sums = np.add.reduceat(own, fresh)
            last = fresh[-1]
            done = slice(fresh[0], last)
            yield suffixes[done], window[done] & np.repeat(sums[:-1] > 1, np.diff(edges)[:-1])
            held, weight = [(suffixes[last:], window[last:])], int(sums[-1])
    for part in held:
        yield part[0], part[1] & (weight > 1)


def _shard(length: int):
    """Windows of the shard's runs that occur more than once: (group, span, ks). One shard per task."""
    schema = pa.schema([("grp", pa.int64()), ("span", pa.int64()), ("ks", pa.list_(pa.int32()))])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[tuple[int, int], None] = {}
        copies, counts, starts, size = [], [], [], 0
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("grp", "span", "copies", "n", "bytes"))
                for grp, span, weight, n, part in zip(*columns):
                    if (grp, span) in keys:
                        continue
                    keys[grp, span] = None
                    copies.append(weight)
                    counts.append(n)
                    starts.append(size)
                    own = np.zeros(len(part) + 1, np.uint16)  # a 0 ends each run; bytes are 1 to 256, the very end is 0 alone
                    own[:-1] = np.frombuffer(part, np.uint8).astype(np.uint16) + 2
                    own[-1] = 1
                    file.write(own.tobytes())
                    size += len(own)
            if not keys:
                return
            file.write(np.zeros(1, np.uint16).tobytes())
            file.flush()
            text = np.memmap(file, np.uint16, "r")
            starts, counts, copies = np.array(starts), np.array(counts), np.array(copies)
            hits = []
            for suffixes, weighed in _classes(induced.suffixes_with_prefixes(text, length), length, starts, counts, copies):
                hits.append(suffixes[weighed])
        hit = np.sort(np.concatenate(hits))
        owner = np.searchsorted(starts, hit, "right") - 1
        hit, owner = hit[copies[owner] == 1], owner[copies[owner] == 1]  # of the others all windows are repeats
        named = list(keys)
        edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(owner) else np.zeros(1, np.int64)
        who = owner[edges[:-1]]
        ks = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array((hit - starts[owner]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array([named[i][0] for i in who], pa.int64()), pa.array([named[i][1] for i in who], pa.int64()), ks], schema=schema)

    return shard


def _refine(length: int, part: int):
    """Cuts runs into parts of at most ``part`` windows, dealt by all that every window of such a part contains."""
    schema = pa.schema([("gram", pa.int64()), ("span", pa.int64()), ("k", pa.int32()), ("copies", pa.int64()), ("n", pa.int32()), ("lead", pa.int32()), ("core", pa.int64()), ("part", pa.int64()), ("bytes", pa.binary())])

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = runs.Hasher()
        for batch in batches:
            rows = []
            for gram, span, weight, n, lead, own in zip(*(batch.column(c).to_pylist() for c in ("gram", "span", "copies", "n", "lead", "bytes"))):
                prefix = hasher.prefix(_VALUE[np.frombuffer(own, np.uint8)])
                # Parts are numbered by the distance to the gram, so equal windows of different runs are in equal parts.
                number = (lead - np.arange(n)) // part
                first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
                end = np.r_[first[1:], n]
                number = number[first]
                salt = runs.mix(number.astype(np.uint64) + np.uint64(gram & (2**64 - 1)))
                core = runs.mix(hasher.spans(prefix, lead - number * part, np.minimum(lead - (number + 1) * part + 1 + length, len(own))) ^ salt)
                whole = runs.mix(hasher.spans(prefix, first, end - 1 + length) ^ runs.mix((lead - first).astype(np.uint64)))
                for a, b, c, w in zip(first.tolist(), end.tolist(), core.view(np.int64).tolist(), whole.view(np.int64).tolist()):
                    rows.append((gram, span, a, weight, b - a, lead - a, c, w, own[a : b - 1 + length]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return refine


def _in_shards(units: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(grp, span, ks): repeated windows of ``units`` (grp, span, copies, n, bytes)."""
    size = units.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    dealt = units.select("grp", "span", "copies", "n", "bytes").repartition(max(1, -(-size // shard_bytes)), "grp")
    return dealt.mapInArrow(frugal(_shard(length)), "grp long, span long, ks array<int>")


def _refined(segments: DataFrame, length: int, shard_bytes: int, kinds: int) -> DataFrame:
    """(gram, span, ks) for the runs of grams that have too many kinds for one shard."""
    cut = "gram long, span long, k int, copies long, n int, lead int, core long, part long, bytes binary"
    parts = materialise(segments.mapInArrow(frugal(_refine(length, PART)), cut), "run-parts")
    each = parts.groupBy("core", "part").agg(F.sum("copies").alias("copies"), F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("bytes").alias("bytes"))
    met = parts.select("core", "part").distinct().groupBy("core").agg(F.count(F.lit(1)).alias("kinds"))
    each = materialise(each.join(met, "core"), "part-kinds")
    whole = each.filter("copies > 1").select("core", "part", F.expr("sequence(0, n - 1)").alias("ks"))
    few = each.filter((F.col("kinds") > 1) & (F.col("kinds") <= kinds)).select(F.col("core").alias("grp"), F.col("part").alias("span"), "copies", "n", "bytes")
    out = whole.unionByName(_in_shards(few, length, shard_bytes).toDF("core", "part", "ks"))
    many = each.filter(F.col("kinds") > kinds).select(F.col("core").alias("gram"), F.col("part").alias("span"), "copies", "n", "lead", "bytes")
    single = materialise(many.mapInArrow(frugal(_refine(length, 1)), cut).select("gram", "span", "k", "copies", "core"), "single-windows")
    again = single.groupBy("core").agg(F.sum("copies").alias("total")).filter("total > 1").select("core")
    ones = single.filter("copies = 1").join(again, "core").groupBy("gram", "span").agg(F.collect_list("k").alias("ks")).toDF("core", "part", "ks")
    decided = materialise(out.unionByName(ones), "part-repeats")
    joined = join_checked(parts.select("gram", "span", "k", "core", "part"), decided, ["core", "part"])
    return joined.groupBy("gram", "span").agg(F.flatten(F.collect_list(F.transform("ks", lambda i: i + F.col("k")))).alias("ks"))


def repeated_windows(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, kinds: int = KINDS) -> DataFrame:
    """(x, x_len, starts): windows of each text that occur anywhere else too, as structs (at, n, ks).

    ``ks`` null: all n windows from ``at``; else those at ``at`` plus each of ``ks``. ``texts``: x, x_len, _t.
    """
    found = materialise(texts.mapInArrow(frugal(_find(length, gram)), "x long, x_len int, at long, n int, gram long, span long, lead int"), "byte-runs")
    spans = found.groupBy("gram", "span").agg(F.count(F.lit(1)).alias("copies"))
    spans = materialise(spans, "byte-spans")
    met = spans.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("runs")).filter("runs > 1").drop("runs")
    known = materialise(spans.join(met, "gram"), "byte-kinds")
    whole = known.filter("copies > 1").select("gram", "span")
    mixed = materialise(known.filter("kinds > 1"), "byte-mixed")

    place = F.min(F.struct("x", "x_len", "at", "n", "lead")).alias("p")
    one_each = join_checked(found, mixed, ["gram", "span"]).groupBy("gram", "span", "copies", "kinds").agg(place)
    wanted = one_each.groupBy(F.col("p.x").alias("x"), F.col("p.x_len").alias("x_len")).agg(F.collect_list(F.struct("gram", "span", "copies", "kinds", F.col("p.at").alias("at"), F.col("p.n").alias("n"), F.col("p.lead").alias("lead"))).alias("wanted"))
    once = texts.groupBy("x", "x_len").agg(F.first("_t").alias("_t"))  # copies meet within tasks first
    holders = once.join(materialise(wanted, "wanted-runs").hint("merge"), ["x", "x_len"]).select("_t", "wanted")
    segments = materialise(holders.mapInArrow(frugal(_cut_runs(length)), "gram long, span long, copies long, kinds long, n int, lead int, bytes binary"), "segments")

    cold = segments.filter(F.col("kinds") <= kinds).select(F.col("gram").alias("grp"), "span", "copies", "n", "bytes")
    parts = _in_shards(cold, length, shard_bytes).toDF("gram", "span", "ks")
    hot = segments.filter(F.col("kinds") > kinds)
    if not hot.isEmpty():
        parts = parts.unionByName(_refined(hot, length, shard_bytes, kinds))
    lone = materialise(parts, "repeats-in-parts").join(mixed.filter("copies = 1").select("gram", "span"), ["gram", "span"], "left_semi")
    lone = materialise(lone, "lone-repeats")
    full = join_checked(found, materialise(whole, "byte-whole"), ["gram", "span"]).select("x", "x_len", "at", "n", F.lit(None).cast("array<int>").alias("ks"))
    some = join_checked(found, lone, ["gram", "span"]).select("x", "x_len", "at", "n", "ks")
    return full.unionByName(some).groupBy("x", "x_len").agg(F.collect_set(F.struct("at", "n", "ks")).alias("starts"))


def _prune(length: int):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for text, starts in zip(batch.column("_t"), batch.column("starts")):
                own = np.frombuffer(encoded(text.as_py()), np.uint8)
                lost = np.zeros(len(own), bool)
                if starts.is_valid:
                    at = [np.arange(s["at"], s["at"] + s["n"]) if s["ks"] is None else s["at"] + np.array(s["ks"], np.int64) for s in starts.as_py()]
                    lost = covered(len(own), np.concatenate(at), length)
                kept = own[~lost].tobytes()
                out["n_bytes"].append(len(own))
                out["n_removed"].append(int(lost.sum()))
                out["n_spans"].append(int((lost & ~np.r_[False, lost[:-1]]).sum()) if len(lost) else 0)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
            names = [c for c in batch.schema.names if c not in ("_t", "starts")]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(v, t) for v, t in zip(out.values(), types))], names=[*names, *out])

    return prune


def dedup_bytes(docs: DataFrame, keep: list[str], text: str = "text", length: int = LENGTH, **params) -> DataFrame:
    """(*keep, n_bytes, n_removed, n_spans, kept_sha256, kept): UTF-8 texts without the bytes of repeated windows."""
    base = docs.select(held(keep), F.col(text).alias("_t"), F.xxhash64(text).alias("x"), F.coalesce(F.length(text), F.lit(-1)).alias("x_len"))
    marks = repeated_windows(base.select("x", "x_len", "_t").filter(F.octet_length("_t") >= length), length, **params)
    # From a written table Spark may split the copies of a very frequent text over tasks.
    joined = base.join(materialise(marks, "repeated-bytes").hint("merge"), ["x", "x_len"], "left").select("_held", "_t", "starts")
    pruned = joined.mapInArrow(frugal(_prune(length)), schema_with(joined, ["_held"], "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    return pruned.select(*released(keep, ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]))
