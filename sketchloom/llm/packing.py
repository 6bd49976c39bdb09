"""Best-fit packing of token sequences by exact-complement hashing.

Only lengths matter for packing, and there are at most ``capacity`` of them, so the plan is made on a
histogram: a table that does not grow with the corpus. Going down from the longest length, each bin's gap
is looked up among single lengths, then among sums of two, then of three available lengths, and a
combination that fills the gap exactly is taken as often as its availability counts allow; a gap without a
complement gets the longest length that fits (best fit) and is looked up again. The result is a list of
patterns (lengths of one sequence, how many such sequences).

Documents are tokenized once, into piece rows. Each piece gets its rank among the pieces of its length
from counts per partition and length, and rank and pattern give sequence and offset by binary search in the
broadcast pattern table, whose size depends on ``capacity`` alone. No group is gathered anywhere.

Tokenizing keeps a bounded cache of encoded words: the vocabulary never merges across words, so a text's
identifiers are those of its words in order.

Defined cases: a null or empty text is the closing identifier alone. Repeated rows are packed as often as
they occur, and rows with a null identifier like others. Pieces of one length are alike: which of them gets which
place depends on the partitions, the number of sequences doesn't. A text of any length is split word by word.
An empty table packs into nothing. Columns asked for with ``keep`` pass through
whatever their names are; only one that is named like a result is replaced.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchloom.functions.storage import materialise, shared_dir
from sketchloom.functions.workers import frugal
from sketchloom.llm.columns import held, released, schema_with

CAPACITY = 4096
END_ID = 1
#: Bytes of a worker's cache of words, and characters of the longest word that it keeps.
CACHE_BYTES, CACHED_WORD = 48 << 20, 64
#: Characters of a text that are split into words at once, or a few more: blocks end at white space, which no word has.
BLOCK = 1 << 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters beyond ASCII, and marks that are neither letters, numbers nor white space, that the fast path knows.
_LETTERS = "\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_MARKS = "\u00a1\u00a7\u00ab\u00b0\u00b7\u00bb\u00bf\u00d7\u00f7\u2013\u2014\u2018-\u201e\u2020-\u2022\u2026\u20ac"
#: The vocabulary's own split of a lower-case text into words.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[^ \t-\r0-9a-z{_LETTERS}]+")
#: What a vocabulary must do before its model for the fast path to be its own.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_SPACE = re.compile("[ \t-\r]")
_OTHER = re.compile(f"[^\x00-\x7f{_LETTERS}{_MARKS}]")


def _byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Known(dict):
    """Identifiers of words, spelt by the vocabulary's model when first asked for; kept within ``n_bytes``."""

    def __init__(self, model, n_bytes: int):
        super().__init__()
        self.model, self.left, self.characters = model, n_bytes, _byte_characters()

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()  # its bytes are their own characters
        spelt = word if plain else "".join([self.characters[b] for b in word.encode("utf-8", "replace")])
        ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        if self.left > 0 and len(word) <= CACHED_WORD:  # frequent words come early
            self[word] = ids
            self.left -= 300 + len(word) + len(ids)
        return ids


class WordCache:
    """Identifiers of texts as little-endian unsigned 32-bit bytes, by a cache of words of bounded size.

    Texts of Latin letters and common marks are split here and looked up word by word; any other text, one that
    spells a special token, and all texts under a vocabulary that normalises or splits otherwise, go to the
    tokenizer as a whole. Both ways give equal identifiers.
    """

    def __init__(self, path: str, n_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known(self.tokenizer.model, n_bytes)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        stages = [json.loads(x.__getstate__()) if x is not None else None for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.by_word = stages == [_NORMALIZER, _PRE_TOKENIZER] and self.tokenizer.post_processor is None and self.tokenizer.truncation is None and self.tokenizer.padding is None

    def encode(self, text: str) -> bytes:
        if not self.by_word or any(s in text for s in self.special):
            return self.whole(text)
        lowered = text if text.isascii() else unicodedata.normalize("NFC", text)
        lowered = lowered.lower()
        if not lowered.isascii() and _OTHER.search(lowered):
            return self.whole(text)
        out, at = [], 0
        while at < len(lowered):  # block by block: a long text's words are never all held
            space = _SPACE.search(lowered, at + BLOCK)
            end = space.start() if space else len(lowered)
            out.append(b"".join(map(self.known.__getitem__, _WORDS.findall(lowered, at, end))))
            at = end
        return b"".join(out)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _cut(path: str, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = WordCache(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("_t")):
                ids = cache.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            kept = [c for c in batch.schema.names if c != "_t"]
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in kept), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[*kept, "piece", "start", "length", "ids_crc32"],
            )

    return cut


def pieces(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(*keep, piece, start, length, ids_crc32): every document's identifiers, cut where they exceed ``capacity``."""
    rows = docs.select(held(keep), F.col(text).alias("_t"))
    cut = rows.mapInArrow(frugal(_cut(tokenizer or default_tokenizer(), capacity)), schema_with(rows, ["_held"], "piece int, start long, length long, ids_crc32 long"))
    return cut.select(*released(keep, ["piece", "start", "length", "ids_crc32"]))


class _Sums:
    """Which sums two available lengths make; rebuilt when the set of available lengths has changed."""

    def __init__(self, have: np.ndarray):
        self.have, self.capacity = have, len(have) - 1
        self.pairs, self.stale = np.zeros(self.capacity + 1, bool), True

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.have[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        a = np.arange((gap + 1) // 2, gap)
        fits = (self.have[a] > 0) & (self.have[gap - a] > (2 * a == gap))
        at = np.flatnonzero(fits)
        return (int(a[at[-1]]), gap - int(a[at[-1]])) if len(at) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        if self.stale:
            has = (self.have > 0).astype(np.float64)
            n = 2 * len(has)
            self.pairs = np.rint(np.fft.irfft(np.fft.rfft(has, n) ** 2, n))[: len(has)] > 0
            self.stale = False
        a = np.arange(gap - 2, 0, -1)
        for x in a[(self.have[a] > 0) & self.pairs[gap - a]]:
            self.have[x] -= 1
            rest = self.pair(gap - int(x))
            self.have[x] += 1
            if rest:
                return (int(x), *rest)
        return None

    def best(self, gap: int) -> tuple[int, ...] | None:
        at = np.flatnonzero(self.have[1 : gap + 1])
        return (int(at[-1]) + 1,) if len(at) else None


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """How to fill sequences: (lengths in order, number of sequences), together using every count up."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        have[length] += n
    sums, out = _Sums(have), []
    for longest in range(capacity, 0, -1):
        while have[longest]:
            chosen = [longest]
            have[longest] -= 1
            gap = capacity - longest
            while gap and (found := sums.single(gap) or sums.pair(gap) or sums.triple(gap) or sums.best(gap)):
                chosen += found
                for x in found:
                    have[x] -= 1
                gap -= sum(found)
            uses = np.bincount(chosen, minlength=capacity + 1)
            used = np.flatnonzero(uses)
            more = int((have[used] // uses[used]).min())
            have[used] -= more * uses[used]
            if (have[used] == 0).any():
                sums.stale = True
            out.append((tuple(chosen), more + 1))
    return out


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: cumulative capacity of its slots, and each slot's first sequence and offset."""
    table: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            table.setdefault(length, []).append((times, sequence, offset))
            offset += length
        sequence += times
    out = {}
    for length, rows in table.items():
        times, first, offset = (np.array(x, np.int64) for x in zip(*rows))
        out[length] = (np.concatenate([[0], np.cumsum(times)]), first, offset)
    return out


def _rank(capacity: int):
    """Adds the partition and each piece's rank among those of its length in that partition."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            length = batch.column("length").to_numpy()
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered, "left")
            ranks = np.empty(len(length), np.int64)
            ranks[order] = np.arange(len(length)) - first + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int64)), pa.array(ranks)], names=[*batch.schema.names, "part", "local_rank"])

    return rank


def _place(shared):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                ends, first, at = table[int(x)]
                slot = np.searchsorted(ends, rank[own], "right") - 1
                sequence[own] = first[slot] + rank[own] - ends[slot]
                offset[own] = at[slot]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return place


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (with a column length, 1 to ``capacity``) plus sequence_id and offset."""
    spark = found.sparkSession
    shared_dir(spark)
    rows = found.select(held(found.columns), "length")
    ranked = materialise(rows.mapInArrow(frugal(_rank(capacity)), schema_with(rows, ["_held", "length"], "part long, local_rank long")), "pieces")
    counts = ranked.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialise(counts.withColumn("before", before), "piece-counts")
    # At most ``capacity`` rows, however large the corpus is.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(slots(patterns(histogram, capacity)))
    placed = ranked.join(counts.drop("n"), ["part", "length"]).select("_held", "length", (F.col("local_rank") + F.col("before")).alias("rank"))
    sequenced = placed.mapInArrow(frugal(_place(shared)), schema_with(placed, ["_held", "length"], "sequence_id long, offset long"))
    return sequenced.select(*released(found.columns, ["sequence_id", "offset"]))
