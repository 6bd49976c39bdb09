"""Collocations: phrases whose words come together more often than their parts come apart.

1. Words of each language are counted exactly. 2. Each task counts the pairs of neighbouring words in a count-min
sketch; slices of the tasks' sketches are merged as streams, and what is kept of a slot is one bit: whether all tasks together
hit it ``least`` times. Counts only overestimate, so a phrase that is frequent enough always has its bits set. 3. Phrases of
three and more words are counted in a second sketch, where all their pairs have passed the first. 4. What passes is spelled
out, each phrase once, and dealt into packs of bounded bytes, by language; a pack is compiled into one automaton per language, in
which a word is three letters, so that its patterns match whole words only; words that no phrase has and ends of pieces are a
letter that no pattern has. Scanning a text once finds all phrases of a pack, overlapping ones too; tasks count, sums are
exact, and phrases below ``least`` go. 5. Scores, the test for containment in longer phrases and the ranks are joins and windows.

Scale: sketches have about eight slots per word up to ``MAX_SLOTS``; a bitmap per row is all that is broadcast, as is one pack
at a time. Beyond some 30 million words the sketch passes more and more phrases that are too rare; they cost
counting, never correctness, and a pack of phrases costs one more scan of the texts of its languages.

Defined cases: a null text is empty and adds nothing; a null language is ``und``. Texts without two neighbouring words have no
phrases. A long text is cut at delimiters into stretches of bounded size; a piece without any delimiter is held whole.
Repeated rows count as often as they are there. Equal scores are ordered by count and then by phrase, so ranks don't depend on
partitions. Empty tables give no rows. Columns besides the named ones aren't looked at, so no name can clash.
"""

from __future__ import annotations

import collections
import operator
import uuid
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sketchloom.functions.storage import materialise
from sketchloom.functions.workers import frugal
from sketchloom.llm.countmin import MAX_SLOTS, ROWS, SLICES, _expand, _slots, _squeeze, sketch_width
from sketchloom.llm.runs import RADIX, mix

LEAST, LONGEST, TOP = 30, 4, 2000
#: Of a longer phrase's occurrences in those of a part, percent from which the part goes.
INSIDE = 80
#: Bytes of phrases in one automaton pack, about; n-grams that a task counts before it emits; characters of a stretch.
#: Phrases counted as one row, and tasks that sum them up.
CHUNK, MERGES = 1 << 13, 64
PACK_BYTES, HELD, STRETCH = 16 << 20, 1 << 22, 1 << 20
GUARD = b"."
_DELIMITERS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", GUARD * 9 + b" ")


def guarded(text: str) -> bytes:
    """A text with A-Z lower-cased, whose pieces end at a guard, which no word contains; blanks come in any number."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_DELIMITERS).replace(GUARD, b" . ")


def tokens(text: str) -> list[bytes]:
    """Words and guards of a text."""
    return guarded(text).split()


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A text in stretches of about ``size`` characters that end at delimiters."""
    at = 0
    while len(text) - at > size:
        ends = [e for d in ".,;:!?\n\x0b\x0c\r" if (e := text.rfind(d, at, at + size)) >= 0] or [e for d in ".,;:!?\n\x0b\x0c\r" if (e := text.find(d, at + size)) >= 0]
        if not ends:
            break
        end = (max(ends) if max(ends) < at + size else min(ends)) + 1
        yield text[at:end]
        at = end
    yield text[at:]


def _stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, tokens) of some texts of one language at a time; a guard follows each text."""
    held: dict[str, list[bytes]] = collections.defaultdict(list)
    for batch in batches:
        for text, lang in zip(batch.column("_t"), batch.column("lang").to_pylist()):
            for part in stretches(text.as_py() or ""):
                own = held[lang]
                own += tokens(part)
                own.append(GUARD)
                if len(own) >= 1 << 19:
                    yield lang, held.pop(lang)
    yield from held.items()


_GUARD_HASH = np.uint64(xxhash.xxh3_64_intdigest(GUARD))


def _hashed(lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each token, salted with the language, and which tokens are guards."""
    plain = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return mix(plain ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))), plain == _GUARD_HASH


def _grams(values: np.ndarray, guards: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, hash of the n tokens from each position on, whether they are all words) for n from 2 on."""
    gram, words = values, ~guards
    for n in range(2, longest + 1):
        if len(values) < n:
            return
        gram = mix(gram[:-1] * np.uint64(RADIX) + values[n - 1 :] + np.uint64(n))
        words = words[:-1] & ~guards[n - 1 :]
        yield n, gram, words


class _Bitmaps:
    """Which grams a merged sketch has counted often enough."""

    def __init__(self, blobs: list[bytes], slots: int):
        self.rows, self.slots = [np.frombuffer(zlib.decompress(b), np.uint8) for b in blobs], slots

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones(len(grams), bool)
        for bits, own in zip(self.rows, _slots(grams, self.slots)):
            out &= (bits[own >> np.uint64(3)] >> (np.uint64(7) - (own & np.uint64(7))).astype(np.uint8)) & 1 > 0
        return out


_PARTS = pa.schema([("slice", pa.int32()), ("at", pa.binary()), ("times", pa.binary()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
_PARTS_DDL = "slice int, at binary, times binary, lang string, phrase string, n long"


def _phrases(lang: str, phrases: list[bytes] | pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    text = phrases if isinstance(phrases, pa.Array) else pa.array(phrases, pa.binary()).cast(pa.string(), safe=False)
    blank = [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays([*blank, pa.repeat(pa.scalar(lang, pa.string()), n), text, pa.array(counts, pa.int64())], schema=_PARTS)


def _sketched(grams: list[np.ndarray], slots: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slot counts of some grams, in slices; counts above ``most`` say no more than it."""
    for row, own in enumerate(_slots(np.concatenate(grams), slots)):
        found, times = np.unique(own.astype(np.int64), return_counts=True)
        edges = np.searchsorted(found, np.arange(SLICES + 1) * (slots // SLICES))
        for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a < b:
                often = zlib.compress(np.minimum(times[a:b], most).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
                blank = {"lang": [None], "phrase": [None], "n": [None]}
                yield pa.RecordBatch.from_pydict({"slice": [row * SLICES + s], "at": [_squeeze(found[a:b] - s * (slots // SLICES))], "times": [often]} | blank, schema=_PARTS)


def _first(slots: int, least: int):
    """Counts of words, and the sketch of pairs."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, collections.Counter] = collections.defaultdict(collections.Counter)
        grams, size = [], 0
        for lang, words in _stretched(batches):
            counts[lang].update(words)
            for _, gram, whole in _grams(*_hashed(lang, words), 2):
                grams.append(gram[whole])
                size += len(grams[-1])
            if size >= HELD:
                yield from _sketched(grams, slots, least)
                grams, size = [], 0
            if sum(map(len, counts.values())) > 1 << 20:
                yield from _counted(counts)
        if size:
            yield from _sketched(grams, slots, least)
        yield from _counted(counts)

    return first


def _counted(counts: dict[str, collections.Counter]) -> Iterator[pa.RecordBatch]:
    for lang, own in counts.items():
        own.pop(GUARD, None)
        yield _phrases(lang, list(own), list(own.values()))
    counts.clear()


class _Unseen:
    """Phrases that pass and that this task hasn't emitted yet; it may forget, repeats are merged later."""

    def __init__(self):
        self.seen: set[int] = set()

    def spelled(self, words: list[bytes], n: int, gram: np.ndarray, passing: np.ndarray) -> list[bytes]:
        at = np.flatnonzero(passing)
        kinds, first = np.unique(gram[at], return_index=True)
        out = []
        for kind, i in zip(kinds.tolist(), at[first].tolist()):
            if kind not in self.seen:
                self.seen.add(kind)
                out.append(b" ".join(words[i : i + n]))
        if len(self.seen) > 1 << 21:
            self.seen.clear()
        return out


def _second(pairs, pair_slots: int, slots: int, least: int, longest: int):
    """Pairs that pass, and the sketch of longer phrases all of whose pairs pass."""

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, unseen, grams, size = _Bitmaps(pairs.value, pair_slots), _Unseen(), [], 0
        for lang, words in _stretched(batches):
            passing = None
            for n, gram, whole in _grams(*_hashed(lang, words), longest):
                if n == 2:
                    ok = pair_ok = whole & often(gram)
                    passing = unseen.spelled(words, 2, gram, ok)
                else:
                    ok = ok[:-1] & pair_ok[n - 2 :]
                    grams.append(gram[ok])
                    size += len(grams[-1])
            if passing:
                yield _phrases(lang, passing, [0] * len(passing))
            if size >= HELD:
                yield from _sketched(grams, slots, least)
                grams, size = [], 0
        if size:
            yield from _sketched(grams, slots, least)

    return second


def _third(pairs, pair_slots: int, rest, slots: int, longest: int):
    """Longer phrases that pass both sketches."""

    def third(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, more, unseen = _Bitmaps(pairs.value, pair_slots), _Bitmaps(rest.value, slots), _Unseen()
        for lang, words in _stretched(batches):
            passing = []
            for n, gram, whole in _grams(*_hashed(lang, words), longest):
                if n == 2:
                    ok = pair_ok = whole & often(gram)
                else:
                    ok = ok[:-1] & pair_ok[n - 2 :]
                    ok[ok] = more(gram[ok])  # a phrase is no more frequent than its beginning
                    passing += unseen.spelled(words, n, gram, ok)
            if passing:
                yield _phrases(lang, passing, [0] * len(passing))

    return third


def _merge(width: int, least: int):
    """Streams the slices of all tasks, ordered by slice, into one bitmap of frequent slots for each."""
    schema = pa.schema([("slice", pa.int32()), ("bits", pa.binary())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        out = lambda: pa.RecordBatch.from_pydict({"slice": [at], "bits": [zlib.compress(np.packbits(total >= least).tobytes(), 1)]}, schema=schema)
        for batch in batches:
            for s, slots, times in zip(*(batch.column(c).to_pylist() for c in ("slice", "at", "times"))):
                if s != at:
                    if at is not None:
                        yield out()
                    at, total = s, np.zeros(width, np.int64)
                total[_expand(slots)] += np.ascontiguousarray(np.frombuffer(zlib.decompress(times), np.uint8).reshape(4, -1).T).view("<u4").ravel()
        if at is not None:
            yield out()

    return merge


def _frequent_slots(parts: DataFrame, slots: int, least: int) -> list[bytes]:
    """The merged sketch of ``parts``: a compressed bitmap per row, of slots counted ``least`` times or more."""
    width = slots // SLICES
    own = parts.filter("slice is not null").select("slice", "at", "times")
    merged = own.repartition(ROWS * SLICES, "slice").sortWithinPartitions("slice").mapInArrow(frugal(_merge(width, least)), "slice int, bits binary")
    found = dict(merged.collect())  # at most ROWS * MAX_SLOTS / 8 bytes
    empty = bytes(width // 8)
    return [zlib.compress(b"".join(zlib.decompress(found[r * SLICES + s]) if r * SLICES + s in found else empty for s in range(SLICES)), 1) for r in range(ROWS)]


_BREAK = "\0"

_compiled: dict[str, dict] = {}


def _spelled(words: list[bytes]) -> dict[bytes, str]:
    """Three letters for each word, of an alphabet for each place, so that no word begins or ends inside another one.

    Alphabets are as small as the number of words allows, as automata look for the next letter one by one.
    """
    base = 1
    while base**3 < len(words):
        base += 1
    return {w: chr(1 + i // base // base) + chr(1 + base + i // base % base) + chr(1 + 2 * base + i % base) for i, w in enumerate(words)}


def _listed(pack) -> dict[str, list[bytes]]:
    return {lang: [p for blob in blobs for p in zlib.decompress(blob).split(b"\n")] for lang, blobs in pack.value[1].items()}


def _automata(pack) -> dict[str, tuple[int, dict[bytes, str], ahocorasick.Automaton]]:
    """How many phrases of each language a pack has, their words' letters and their automaton, compiled once per worker."""
    uid, _ = pack.value
    if uid not in _compiled:
        _compiled.clear()
        own = {}
        for lang, phrases in _listed(pack).items():
            automaton, letters = ahocorasick.Automaton(ahocorasick.STORE_INTS), _spelled(list(dict.fromkeys(w for p in phrases for w in p.split(b" "))))
            for i, phrase in enumerate(phrases):
                automaton.add_word("".join([letters[w] for w in phrase.split(b" ")]), i)
            automaton.make_automaton()
            own[lang] = len(phrases), letters, automaton
        _compiled[uid] = own
    return _compiled[uid]


def _chunks(sizes: dict[str, int]) -> list[tuple[str, int]]:
    """(lang, first phrase) of the stretches of a pack's phrases that are counted as one row."""
    return [(lang, at) for lang in sorted(sizes) for at in range(0, sizes[lang], CHUNK)]


def _scan(pack):
    """How often each phrase of the pack occurs in the texts of a task, overlaps included: (chunk, compressed counts)."""
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(pack)
        counts = {lang: np.zeros(n, np.int64) for lang, (n, _, _) in automata.items()}
        for lang, words in _stretched(batches):
            if lang in automata:
                _, letters, automaton = automata[lang]
                found = automaton.iter("".join([letters.get(w, _BREAK) for w in words]))
                np.add.at(counts[lang], np.fromiter(map(operator.itemgetter(1), found), np.int64), 1)
        for k, (lang, at) in enumerate(_chunks({lang: len(own) for lang, own in counts.items()})):
            own = counts[lang][at : at + CHUNK]
            if own.any():
                planes = np.ascontiguousarray(own.astype("<i8").view(np.uint8).reshape(-1, 8).T)
                yield pa.RecordBatch.from_pydict({"chunk": [k], "counts": [zlib.compress(planes.tobytes(), 1)]}, schema=schema)

    return scan


def _summed(pack, least: int):
    """Streams the chunks of all tasks, ordered by chunk, into the phrases that occur ``least`` times or more."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, chunks, phrases = None, None, None, None

        def out() -> pa.RecordBatch:
            lang, first = chunks[at]
            met = np.flatnonzero(total >= least)
            return _phrases(lang, [phrases[lang][i] for i in (met + first).tolist()], total[met])

        for batch in batches:
            if phrases is None:
                phrases = _listed(pack)
                chunks = _chunks({lang: len(p) for lang, p in phrases.items()})
            for k, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "counts"))):
                own = np.ascontiguousarray(np.frombuffer(zlib.decompress(counts), np.uint8).reshape(8, -1).T).view("<i8").ravel()
                if k != at:
                    if at is not None:
                        yield out()
                    at, total = k, np.zeros(len(own), np.int64)
                total += own
        if at is not None:
            yield out()

    return summed


def _dealt(sizes: dict[str, int], pack_bytes: int) -> list[tuple[str, int, int]]:
    """(lang, first pack, number of packs): large languages have packs of their own, small ones share."""
    out, n, room = [], 0, 0
    for lang, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if size > room:
            own = -(-size // pack_bytes)
            out.append((lang, n, own))
            n, room = n + own, pack_bytes - size if own == 1 else 0
        else:
            out.append((lang, n - 1, 1))
            room -= size
    return out


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases (lang, phrase) as (lang, compressed lines, number)."""
    for batch in batches:
        own = collections.defaultdict(list)
        for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").cast(pa.binary()).to_pylist()):
            own[lang].append(phrase)
        for lang, phrases in own.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "lines": [zlib.compress(b"\n".join(phrases), 1)], "n": [len(phrases)]}, schema=pa.schema([("lang", pa.string()), ("lines", pa.binary()), ("n", pa.int64())]))


def _packs(candidates: DataFrame, pack_bytes: int) -> Iterator[tuple[dict[str, list[bytes]], int]]:
    """Candidates dealt by language and hash into packs of about ``pack_bytes``, and their number of chunks; one at a time is on the driver, compressed."""
    sizes = candidates.groupBy("lang").agg(F.sum(F.octet_length("phrase") + 1).alias("b"))  # one row a language
    dealt = _dealt(dict(sizes.collect()), pack_bytes)
    n = max((first + own for _, first, own in dealt), default=0)
    places = candidates.sparkSession.createDataFrame(dealt, "lang string, _first int, _own int")
    packed = candidates.join(F.broadcast(places), "lang").withColumn("_pack", F.col("_first") + F.pmod(F.xxhash64("phrase"), F.col("_own")).cast("int"))
    packed = materialise(packed.select("_pack", "lang", "phrase").repartition(n, "_pack"), "packs") if n > 1 else candidates
    for k in range(n):
        rows = (packed.filter(F.col("_pack") == k) if n > 1 else packed).select("lang", "phrase")
        found, sizes = collections.defaultdict(list), collections.Counter()
        for lang, lines, size in rows.mapInArrow(frugal(_zipped), "lang string, lines binary, n long").collect():
            found[lang].append(lines)
            sizes[lang] += size
        if found:
            yield dict(found), len(_chunks(sizes))


def phrase_counts(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, pack_bytes: int = PACK_BYTES, max_slots: int = MAX_SLOTS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all words, (lang, phrase, f) of phrases of 2 to ``longest`` words with f >= ``least``), of ``texts`` (_t, lang)."""
    spark = texts.sparkSession
    slots = min(max_slots, sketch_width(texts.agg(F.sum(F.octet_length("_t"))).first()[0] or 0))
    rows = texts.select("_t", "lang")
    first = materialise(rows.mapInArrow(frugal(_first(slots, least)), _PARTS_DDL), "words-and-pairs")
    words = materialise(first.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f")), "word-counts")
    pairs = spark.sparkContext.broadcast(_frequent_slots(first, slots, least))
    second = materialise(rows.mapInArrow(frugal(_second(pairs, slots, slots, least, longest)), _PARTS_DDL), "pairs-and-longer")
    found = second.filter("phrase is not null").select("lang", "phrase")
    if longest > 2:
        rest = spark.sparkContext.broadcast(_frequent_slots(second, slots, least))
        third = materialise(rows.mapInArrow(frugal(_third(pairs, slots, rest, slots, longest)), _PARTS_DDL), "longer")
        found = found.unionByName(third.select("lang", "phrase"))
    candidates = materialise(found.distinct(), "candidates")
    counted = None
    for pack, n_chunks in _packs(candidates, pack_bytes):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, pack))
        parts = rows.filter(F.col("lang").isin(*pack)).mapInArrow(frugal(_scan(shared)), "chunk int, counts binary")
        merged = parts.repartition(min(n_chunks, MERGES), "chunk").sortWithinPartitions("chunk").mapInArrow(frugal(_summed(shared, least)), _PARTS_DDL)
        scanned = materialise(merged.select("lang", "phrase", F.col("n").alias("f")), "scanned")
        counted = scanned if counted is None else counted.unionByName(scanned)
        shared.unpersist()
    if counted is None:
        counted = candidates.withColumn("f", F.lit(0).cast("long")).filter("f > 0")
    return words, materialise(counted, "phrase-counts")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = TOP, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by the score of their weakest cut."""
    texts = docs.select(F.col(text).alias("_t"), F.coalesce(F.col(lang), F.lit("und")).alias("lang")).filter("_t <> ''")
    words, phrases = phrase_counts(texts, least, longest, pack_bytes)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    listed = phrases.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # Parts of a phrase are at least as frequent, so all of them are known.
    known = words.filter(F.col("f") >= least).unionByName(phrases)
    cuts = listed.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    sides = F.array(F.struct(F.lit(True).alias("left"), F.slice("w", 1, F.col("k")).alias("p")), F.struct(F.lit(False).alias("left"), F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")).alias("p")))
    parts = cuts.select("lang", F.col("phrase").alias("whole"), "a", "k", F.explode(sides).alias("s")).select("lang", "whole", "a", "k", "s.left", F.array_join("s.p", " ").alias("phrase"))
    met = parts.join(known, ["lang", "phrase"]).groupBy("lang", "whole", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)")
    weakest = met.withColumn("score", score).groupBy("lang", "whole", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    # The most frequent longer phrase around each part of two words or more.
    windows = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    around = listed.filter(F.size("w") > 2).select("lang", "a", F.explode(windows).alias("whole")).groupBy("lang", "whole").agg(F.max("a").alias("around"))
    scored = weakest.join(around, ["lang", "whole"], "left").filter(f"around is null or cast(around as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {int(inside)}")
    order = Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("a"), "whole")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select(  # one row a language
        "lang", F.col("rank").cast("long").alias("rank"), F.col("whole").alias("phrase"), "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").cast("long").alias("score"),
    )
