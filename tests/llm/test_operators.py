"""Operators against brute force on a small corpus of awkward cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sketchloom.functions import storage
from sketchloom.llm import countmin, induced, langid, linedrain, packing, quality, runs, setlinks, simhash, suffixdedup, urlfilter, warc, winnow
from tests.llm.conftest import corpus

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASCII_WORDS = re.compile("[^\x20\x09-\x0d]+")
CORPUS = corpus()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# 2 ------------------------------------------------------------------------------------------------


def fingerprint(text):
    words = ASCII_WORDS.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[a : a + 3]) for a in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Smallest identifier that links of at most 3 bits reach, per row."""
    values = sorted(set(prints.values()))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(b)] = root(a)
    least = collections.defaultdict(lambda: 10**9)
    for i, v in prints.items():
        least[root(v)] = min(least[root(v)], i)
    return {i: least[root(v)] for i, v in prints.items()}


def test_simhash(documents):
    prints = {i: fingerprint(t) for i, t in CORPUS}
    expected = classes(prints)
    found = rows(simhash.near_duplicates(documents, keep=("x",)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id"))
    assert found == sorted(((i, f"{prints[i]:016x}", expected[i]) for i, _ in CORPUS), key=repr)


@pytest.mark.parametrize("bucket", [3, 1000])
def test_simhash_links_of_dense_groups(spark, bucket):
    draw = random.Random(3)
    centre = [draw.getrandbits(64) for _ in range(3)]
    values = {c ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 4))) & (2**64 - 1) for c in centre for _ in range(150)}
    signed = [v - 2**64 if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 3 for a, b in links)
    expected = classes(dict(enumerate(sorted(values))))
    order = {v: i for i, v in enumerate(sorted(values))}
    parent = list(range(len(order)))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        x, y = root(order[a & (2**64 - 1)]), root(order[b & (2**64 - 1)])
        parent[max(x, y)] = min(x, y)
    assert {i: root(i) for i in range(len(order))} == expected


def test_simhash_representatives(documents, no_documents):
    expected = sorted({(i, dict(CORPUS)[i]) for i in classes({i: fingerprint(t) for i, t in CORPUS}).values()})
    assert rows(simhash.representatives(documents.select("doc_id", "text"))) == sorted(expected, key=repr)
    assert simhash.representatives(no_documents).count() == 0


def test_simhash_without_identifiers(spark):
    found = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, None)], "doc_id long, text string"))
    assert rows(found.select("doc_id", "component_id")) == [(4, 4), (None, None), (None, None)]


def shingle_set(text, size):
    words = ASCII_WORDS.findall((text or "").translate(LOWER))
    return {" ".join(words[a : a + size]) for a in range(max(1, len(words) - size + 1))} if words else set()


def components_of_sets(docs, size, percent, empty_alike):
    """The smallest identifier that links reach, per identifier."""
    sets = {i: shingle_set(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if (100 * len(x & y) >= percent * len(x | y)) if x or y else empty_alike:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


def kept_of_similar(docs):
    """Identifiers that come first in their class."""
    return {i for i, first in components_of_sets(docs, 5, 80, True).items() if i == first}


def test_similar_representatives(documents, no_documents):
    texts = dict(CORPUS)
    found = simhash.similar_representatives(documents)
    assert found.columns == documents.columns
    assert rows(found.select("doc_id", "text", "fp")) == sorted(((i, texts[i], "q") for i in kept_of_similar(CORPUS)), key=repr)
    assert simhash.similar_representatives(no_documents).count() == 0


def test_similarity_of_0_8_is_reached(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    docs, near, apart = [], 0, 0
    for k in range(150):
        words = [word() for _ in range(300)]
        other = list(words)
        for at in draw.sample(range(300), 4 if k % 2 else 60):  # 20 or most of some 296 shingles change
            other[at] = word()
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    left = {r[0] for r in rows(simhash.similar_representatives(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id"))}
    near = sum(2 * k + 1 not in left for k in range(150) if k % 2)
    apart = sum(2 * k + 1 in left for k in range(150) if not k % 2)
    assert all(2 * k in left for k in range(150)) and near >= 0.95 * 75 and apart == 75


def crowded_prints(draw):
    """Fingerprints of 512 bits that all share their first block: far apart from each other but for 30 pairs of 60 to 77 bits."""
    first = draw.getrandbits(13)
    one = lambda: draw.getrandbits(512) >> 13 << 13 | first
    out = [one() for _ in range(90)]
    for k in range(30):
        a = one()
        out += [a, a ^ sum(1 << b for b in draw.sample(range(13, 512), 60 + k % 18))]
    return out


@pytest.mark.parametrize("bucket", [4, 16, 1000])
def test_wide_links_whatever_the_bucket(spark, bucket):
    prints = crowded_prints(random.Random(9))
    nodes = [(i, v.to_bytes(64, "little"), [v >> 13 * k & 0x1FFF for k in range(39)]) for i, v in enumerate(prints)]
    links = simhash.wide_links(spark.createDataFrame(nodes, "node long, fp binary, keys array<int>"), 77, bucket=bucket).collect()
    expected = {(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= 77}
    assert {tuple(sorted(x)) for x in links} == expected and len(expected) == 30


def test_wide_links_take_one_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(setlinks, "materialise", lambda df, label: made.append(label) or storage.materialise(df, label))
    nodes = [(i, v.to_bytes(64, "little"), [v >> 13 * k & 0x1FFF for k in range(39)]) for i, v in enumerate(crowded_prints(random.Random(3)))]
    simhash.wide_links(spark.createDataFrame(nodes, "node long, fp binary, keys array<int>"), 77, bucket=4)
    assert made == ["busy-keys", "busy-rows", "candidate-links"]


def test_fingerprint_blocks_cover_bits_once(spark):
    found = simhash.wide_fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string"), ["doc_id"]).first()
    value = int.from_bytes(found["fp"], "little")
    assert found["keys"] == [value >> 13 * k & 0x1FFF for k in range(39)] and found["n"] == 4


# 3 ------------------------------------------------------------------------------------------------

ITEM_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def contamination(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = ITEM_WORDS.findall((text or "").translate(LOWER))
        n = min(10, len(words))
        for a in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[a : a + n])].add(str(item))
    out = []
    for i, text in docs:
        words, hit, listed = ITEM_WORDS.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(w) for w in windows}:
            for a in range(len(words) - n + 1):
                if own := windows.get(tuple(words[a : a + n])):
                    listed |= own
                    hit.update(range(a, a + n))
        out.append((i, len(words), len(hit), len(listed), sorted(listed), bool(hit)))
    return sorted(out, key=repr)


def items():
    texts = dict(CORPUS)
    cut = lambda i, a, b: " ".join(texts[i].split(" ")[a:b])
    return [(1, cut(5, 3, 25)), (2, cut(6, 0, 10).upper()), (3, "One, TWO"), (4, cut(0, 4, 13)), (5, None), (6, "?!"), (7, cut(5, 3, 25)), (8, "zzz yyy xxx www vvv uuu ttt sss rrr qqq ppp"), (10, "tie tie"), (9, cut(9, 5, 14))]


def test_decontamination(spark, documents):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    found = winnow.decontaminate(documents, bench).select("doc_id", "n_words", "n_hit", "n_items", "item_list", "contaminated")
    assert rows(found) == contamination(CORPUS, items())
    dirty = {r[0] for r in contamination(CORPUS, items()) if r[-1]}
    kept = winnow.clean(documents.select("doc_id", "text"), bench)
    assert rows(kept) == sorted(((i, t) for i, t in CORPUS if i not in dirty), key=repr)


def test_decontamination_of_nothing(spark, documents, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not winnow.decontaminate(documents, none).filter("contaminated or n_items > 0").count()
    assert winnow.clean(documents, none).count() == len(CORPUS)
    assert winnow.decontaminate(no_documents, spark.createDataFrame(items(), "item_id long, text string")).count() == 0


# 4 ------------------------------------------------------------------------------------------------


def drained(docs, depth=3, min_docs=5, share=0.5, similar=0.7):
    """{doc_id: kept text}."""
    lines = []
    for i, text in docs:
        for at, line in enumerate((text or "").split("\n")):
            if tokens := ASCII_WORDS.findall(line):
                mask = ["<*>" if re.search("[0-9]", t) else t for t in tokens]
                lines.append((text, i, at, (len(mask), " ".join(mask[:depth])), tuple(mask)))
    texts = collections.defaultdict(set)
    for text, _, _, leaf, _ in lines:
        texts[leaf].add(text)
    lines = [x for x in lines if len(texts[x[3]]) >= min_docs]
    votes = collections.defaultdict(collections.Counter)
    for _, _, _, leaf, mask in lines:
        for p, token in enumerate(mask):
            votes[leaf, p][token] += 1
    template = {}
    for key, count in votes.items():
        top = max((n, t) for t, n in count.items())
        template[key] = top[1] if top[0] >= share * sum(count.values()) else "<*>"
    placed = []
    for text, i, at, leaf, mask in lines:
        same = sum(t == template[leaf, p] for p, t in enumerate(mask))
        placed.append((text, i, at, (leaf, None if same >= similar * len(mask) else mask)))
    of = collections.defaultdict(dict)
    for text, i, _, t in placed:
        of[t][text] = min(i, of[t].get(text, i))
    gone = {(text, at) for text, _, at, t in placed if len(of[t]) >= min_docs and text != min(of[t], key=of[t].get)}
    return {i: None if text is None else "\n".join(x for at, x in enumerate(text.split("\n")) if (text, at) not in gone) for i, text in docs}


def log_lines():
    draw = random.Random(5)
    docs = []
    for i in range(30):
        body = [f"request {draw.randint(0, 999)} served to user{draw.randint(0, 9)} in {draw.randint(1, 99)} ms", f"cookies are used on this site for {draw.choice(['ads', 'logins', 'fun'])} only", f"unique line {i} of {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10]}", "", "  "]
        draw.shuffle(body)
        docs.append((i, "\n".join(body[: draw.randint(1, 5)])))
    return docs + [docs[0], (31, None), (32, ""), (33, docs[2][1]), *((i + 40, t) for i, t in CORPUS)]


def test_line_dedup(spark, no_documents):
    docs = log_lines()
    found = linedrain.drop_recurring(spark.createDataFrame(docs, "doc_id long, text string"))
    expected = drained(docs)
    assert rows(found.select("doc_id", "text")) == sorted(((i, expected[i]) for i, _ in docs), key=repr)
    assert found.filter("n_dropped > 0").count() > 10
    assert linedrain.drop_recurring(no_documents).count() == 0


def test_further_templates_of_a_leaf(spark):
    names = [f"{a}{b}" for a in "abcdefgh" for b in "vwxyz"]
    same = ["Posted by the editor on Monday at noon"] * 60
    docs = list(enumerate(same + [f"Posted by the staff writer {x} for Globe" for x in names] + [f"Posted by the night desk {x} in Rome" for x in names[:30]]))
    docs = [(i, f"{line}\nstory {'abcdefghijklm'[i % 13]} {'nopqrstuvwxyz'[i // 13]}") for i, line in docs]
    found = rows(linedrain.drop_recurring(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_dropped"))
    assert found == sorted(((i, int(i not in (0, 60, 100))) for i, _ in docs), key=repr)


def test_triple_behind_many_false_candidates():
    have = np.zeros(1002, np.int64)
    have[600:740:2], have[335], have[333] = 1, 1, 2
    sums = packing._Sums(have)
    sums.pairs[:], sums.stale = True, False
    assert sums.triple(1001) == (335, 333, 333)


def test_no_text_is_too_long():
    assert {r.name: (r.low, r.high) for r in quality.RULES}["words"] == (50, None)


def test_long_lines_recur_from_two_texts(spark):
    long = "the terms of use of this site were last changed in {} by the board of trustees"
    docs = [(1, "one story\n" + long.format(2001)), (2, "another story\nshort line\n" + long.format(1999)), (3, "short line\nthird story"), (4, "third story told\n" + " ".join(f"w{i}" for i in range(20))), (5, "fourth\n" + " ".join(f"w{i}" for i in range(1, 21)))]
    found = dict(rows(linedrain.drop_recurring(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "text")))
    assert found == dict(docs) | {2: "another story\nshort line"}


# 5 ------------------------------------------------------------------------------------------------


def test_packing(documents, no_documents):
    tokenizer = packing.WordCache(packing.default_tokenizer()).tokenizer
    expected = collections.Counter()
    for i, text in CORPUS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            expected[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    found = packing.pack(packing.pieces(documents, ["doc_id"])).toPandas()
    assert collections.Counter(zip(found.doc_id, found.piece, found.start, found.length, found.ids_crc32)) == expected
    assert_packed(found)
    assert packing.pack(packing.pieces(no_documents, ["doc_id"])).count() == 0


def assert_packed(found, capacity=4096):
    found = found.sort_values(["sequence_id", "offset"])
    ends = found.groupby("sequence_id").length.cumsum()
    assert (found.offset == ends - found.length).all()
    assert ends.max() <= capacity
    total = found.length.sum()
    assert found.sequence_id.nunique() <= -(-total // capacity) * 1.02 + 1


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_all_lengths_up(seed):
    draw = np.random.default_rng(seed)
    histogram = collections.Counter(draw.integers(1, [65, 40, 20, 65][seed], 3000).tolist())
    plan = packing.patterns(dict(histogram), 64)
    used = collections.Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 64
        for length in lengths:
            used[length] += times
    assert used == histogram
    bins, floor = sum(t for _, t in plan), -(-sum(k * v for k, v in histogram.items()) // 64)
    big = sum(v for k, v in histogram.items() if k > 32)
    assert bins <= 1.03 * max(floor, big) + 2


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("n_bytes", [5000, packing.CACHE_BYTES])
def test_word_cache_equals_the_tokenizer(vocabulary, n_bytes):
    import public_tokenizers

    cache = packing.WordCache(public_tokenizers.path(vocabulary), n_bytes)
    assert cache.by_word == (vocabulary == "word_bpe_49k.json")
    draw = random.Random(2)
    odd = ["Hello, world's I'LL can't <|endoftext|> x", "½ ² ①2 中文 \x1c\x1d\x85\xa0 ok", "ΣΑΣ ẞ İ", "a'b''s 's'S don'T x_y_z 12a3", "“quoted”—dash…", "e\u0301 \u0345", "ǅ Ǆ ŉ ﬁ"]
    pool = "aB'sStTéÉ1²½ \n\t.,!<|>_-—’“Σßẞİ\u0301"
    odd += ["".join(draw.choice(pool) for _ in range(draw.randint(0, 40))) for _ in range(300)]
    for text in odd + [t or "" for _, t in CORPUS[:70]]:
        assert cache.encode(text) == np.array(cache.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("block", [1, 7])
def test_word_cache_splits_long_texts_in_blocks(monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK", block)
    cache = packing.WordCache(packing.default_tokenizer())
    for text in ["", " ", "\n\n a", "no\tspace\rat\x0ball", "unbroken" * 20, "Don't  'split 's here, 12 é—é " * 9]:
        assert cache.encode(text) == np.array(cache.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# 6 ------------------------------------------------------------------------------------------------


def without_repeats(texts, length):
    """Kept elements per text (sequences), where windows that start more than once lose all they cover."""
    seen = collections.Counter(tuple(t[a : a + length]) for t in texts for a in range(len(t) - length + 1))
    out = []
    for t in texts:
        lost = [False] * len(t)
        for a in range(len(t) - length + 1):
            if seen[tuple(t[a : a + length])] > 1:
                lost[a : a + length] = [True] * length
        out.append(lost)
    return out


@pytest.mark.parametrize("length,gram,kinds", [(400, 200, 256), (60, 30, 256), (60, 30, 2)])
def test_suffix_array_dedup(documents, length, gram, kinds):
    texts = [(t or "").encode() for _, t in CORPUS]
    expected = []
    for (i, _), own, lost in zip(CORPUS, texts, without_repeats(texts, length)):
        kept = bytes(b for b, gone in zip(own, lost) if not gone)
        expected.append((i, len(own), sum(lost), sum(gone and not (k and lost[k - 1]) for k, gone in enumerate(lost)), sha(kept)))
    found = suffixdedup.dedup_bytes(documents, ["doc_id"], length=length, gram=gram, kinds=kinds, shard_bytes=20_000).drop("kept")
    assert rows(found) == sorted(expected, key=repr)


def test_suffix_array_dedup_of_nothing(no_documents):
    assert suffixdedup.dedup_bytes(no_documents, ["doc_id"]).count() == 0


@pytest.mark.parametrize("memory", [1000, 1 << 20])
def test_induced_sorting(monkeypatch, memory):
    monkeypatch.setattr(induced, "SMALL", 8)
    draw = np.random.default_rng(1)
    for case in range(40):
        monkeypatch.setattr(induced, "DIRECT", 3 if case % 2 else 512)
        text = np.r_[draw.integers(1, draw.integers(2, 6), int(draw.integers(1, 200))), 0].astype(np.uint16)
        if case % 3 == 0:
            text = np.r_[np.tile(text[:-1][:7], 5), text].astype(np.uint16)
        plain, cap = bytes(text.astype(np.uint8)), int(draw.integers(1, 30))
        expected = sorted(range(len(plain)), key=lambda i: plain[i:])
        batches = list(induced.suffixes_with_prefixes(text, cap, memory))
        assert np.concatenate([s for s, _ in batches]).tolist() == expected
        prefixes = np.concatenate([p for _, p in batches]).tolist()
        for before, at, value in zip([None, *expected], expected, prefixes):
            common = 0
            while before is not None and common < cap and max(before, at) + common < len(plain) and plain[before + common] == plain[at + common]:
                common += 1
            assert value == common


def test_production_shards_spill_and_recurse(monkeypatch):
    draw = np.random.default_rng(4)
    base = draw.integers(2, 40, suffixdedup.SHARD_BYTES // 4).astype(np.uint16)
    text = np.r_[base, base[::-1], base[1000:], base[: len(base) // 2], 1, 0].astype(np.uint16)
    spills, sorted_names = [], []
    spill, names = induced.BucketQueue._spill, induced.sorted_suffixes
    monkeypatch.setattr(induced.BucketQueue, "_spill", lambda self: (spills.append(self.held), spill(self)))
    monkeypatch.setattr(induced, "sorted_suffixes", lambda *a: (sorted_names.append(len(a[0])), names(*a))[1])
    found = list(induced.suffixes_with_prefixes(text, 400))
    order = np.concatenate([s for s, _ in found])
    assert len(order) == len(text) and len(spills) > 0 and len(sorted_names) > 1
    assert (np.sort(order) == np.arange(len(text))).all()
    plain = text.astype(">u2").tobytes()
    for k in draw.integers(1, len(order), 300).tolist():
        assert plain[2 * order[k - 1] :] < plain[2 * order[k] :]


# 7 ------------------------------------------------------------------------------------------------


def test_substring_dedup(documents, no_documents):
    texts = [(t or "").encode().split() for _, t in CORPUS]
    expected = [(i, len(own), sum(lost), sha(b" ".join(w for w, gone in zip(own, lost) if not gone))) for (i, _), own, lost in zip(CORPUS, texts, without_repeats(texts, 35))]
    assert rows(countmin.dedup_windows(documents, ["doc_id"]).drop("kept_text")) == sorted(expected, key=repr)
    assert countmin.dedup_windows(no_documents, ["doc_id"]).count() == 0


def test_sketch_loses_no_repeat(documents):
    bitmaps, slots = countmin.repeated_slots(documents.select(F.col("text").alias("_t")))
    hasher, grams = runs.Hasher(), []
    for _, text in CORPUS:
        for values, bounds, _, _ in runs.blocks([countmin.word_hashes(text or "")], countmin.WINDOW):
            grams += runs.find_runs(values, bounds, countmin.WINDOW, countmin.GRAM, hasher).gram.tolist()
    twice = np.array([g for g, n in collections.Counter(grams).items() if n > 1], np.uint64)
    for bitmap, own in zip(bitmaps, countmin._slots(twice, slots)):
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8))
        assert bits[own.astype(np.int64)].all()


@pytest.mark.parametrize("block", [64, 1 << 19])
def test_runs_cover_every_window_once(block):
    values = runs.mix(np.random.default_rng(1).integers(0, 3, 500).astype(np.uint64))
    seen = []
    for own, bounds, which, offset in runs.blocks([values[:300], values[:0], values[300:]], 35, block):
        found = runs.find_runs(own, bounds, 35, 18, runs.Hasher())
        piece = np.searchsorted(bounds, found.first, "right") - 1
        for a, b, p in zip(found.first, found.last, piece):
            seen += [(which[p], int(k - bounds[p] + offset[p])) for k in range(a, b + 1)]
    assert sorted(seen) == [(0, k) for k in range(266)] + [(2, k) for k in range(166)]


def test_columns_named_like_results(spark):
    text = "so many words " * 40
    table = spark.createDataFrame([(1, text, 7, "q", 5, "r", 2.0, "w")], "doc_id long, text string, kept int, x string, n_removed int, n_lines string, _w double, starts string")
    keep = ["doc_id", "kept", "x", "n_removed", "_w", "starts"]
    bytes_ = suffixdedup.dedup_bytes(table, keep)
    assert bytes_.columns == ["doc_id", "x", "_w", "starts", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    assert tuple(bytes_.first()[:5]) == (1, "q", 2.0, "w", len(text))
    words = countmin.dedup_windows(table, keep)
    assert words.columns == ["doc_id", "kept", "x", "_w", "starts", "n_words", "n_removed", "kept_sha256", "kept_text"]
    assert tuple(words.first()[:6]) == (1, 7, "q", 2.0, "w", 120)
    lines = linedrain.drop_recurring(table)
    assert lines.columns == ["doc_id", "text", "kept", "x", "n_removed", "_w", "starts", "n_lines", "n_dropped"]
    assert tuple(lines.first()) == (1, text, 7, "q", 5, 2.0, "w", 1, 0)
    packed = packing.pack(packing.pieces(table.withColumn("part", F.lit("p")).withColumn("offset", F.lit("o")), ["doc_id", "part", "offset", "x"]))
    assert packed.columns == ["doc_id", "part", "x", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.first()["part"] == "p" and packed.first()["offset"] == 0
    marked = simhash.near_duplicates(table.withColumn("fp", F.lit("f")).withColumn("_t", F.lit("t")), keep=("fp", "_t", "x"))
    assert marked.columns == ["doc_id", "_t", "x", "fp", "component_id", "class"] and tuple(marked.first()[:3]) == (1, "t", "q")
    judged = quality.judge(table)
    assert [c for c in judged.columns if not c.startswith(("base", "_q", "kept"))] == ["doc_id", "text", "x", "n_removed", "n_lines", "_w", "starts"]
    assert judged.first()["_w"] == 2.0 and judged.first()["kept"] is False
    rules = (quality.Rule("words", "n_words", 1, None),)
    assert quality.keep(table.withColumn("text", F.lit(" ".join(map(str, range(60))))), rules=rules).columns == table.columns


# 8 ------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    same, draw = "é" * 60, random.Random(1)
    pages = [(5, "http://a/\r\nX: y", same), (2, "http://b/", same), (9, None, same), (3, "u", None), (4, "u", ""), (6, "u", "x" * 99), (7, "u", "x" * 99), (1, "u", "\r\n\r\nWARC/1.1\r\n\x00"), (8, "u", "".join(chr(draw.randrange(32, 3000)) for _ in range(50_000))), (2, "again", same), (None, "u", same)]
    folder = tmp_path.as_uri()
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(table, "page_id", "url", "html", folder, chunk_chars=700)
    chunks = warc.read_chunks(archives, folder, chunk_bytes=1000).cache()
    assert chunks.agg(F.max(F.octet_length("chunk"))).first()[0] <= 1000
    found = rows(warc.records(chunks).select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"))
    expected = []
    for i, _, html in pages:
        own = (html or "").encode()
        again = html == same and i not in (2, None)
        expected.append((None if i is None else str(i), len(own), sha(own), "revisit" if again else "response", "2" if again else None, True))
    assert found == sorted(expected, key=repr)
    long = chunks.filter("record_id = '8'").orderBy("chunk_no").collect()
    whole = b"".join(r.chunk for r in long)
    assert whole == pages[8][2].encode() and len(long) > 50
    for r in long:
        assert sha(whole[: r.bytes_so_far]) == r.digest_so_far
    none = warc.write_archives(table.limit(0), "page_id", "url", "html", folder)
    assert warc.read_chunks(none, folder).count() == 0


# 9 ------------------------------------------------------------------------------------------------


def measures(text):
    words = ASCII_WORDS.findall(text or "")
    seen = collections.Counter(tuple(words[a : a + 3]) for a in range(len(words) - 2))
    covered = {k for a in range(len(words) - 2) if seen[tuple(words[a : a + 3])] > 1 for k in (a, a + 1, a + 2)}
    lines = [x for x in (text or "").split("\n") if ASCII_WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, documents, no_documents):
    texts = [*CORPUS, (900, "a\nb c\na\n \n\na"), (901, "# * $%&|<> " * 30), (902, "a b c d a b c e a b c " * 9)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    judged = quality.judge(table).select("doc_id", *(f"_quality.{m}" for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")
    found = rows(judged)
    expected = []
    for i, t in texts:
        own = measures(t)
        expected.append((i, *own, own[0] < 50 or 100 * own[4] > 50 * own[0]))
    assert [r[:-1] for r in found] == sorted(expected, key=repr)
    assert not any(kept and failed for *_, failed, kept in found)
    kept = quality.keep(documents)
    assert kept.columns == documents.columns
    assert rows(kept.select("doc_id")) == rows(quality.judge(documents).filter("kept").select("doc_id"))
    assert quality.judge(no_documents).count() == 0


# 10 -----------------------------------------------------------------------------------------------


def test_explicit_rules(spark):
    cases = {
        "https://WWW.Example.COM/en/a?x#y": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "http://example.com/en/": ("example.com", "/en/", "example.com/en/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://a.net/es/b": ("a.net", "/es/b", "net/es/", "block"),
        "http://a.net?/es/": ("a.net", "", None, "allow"),
        "no address": ("", "", None, "allow"),
        "x://y://z/": ("y:", "//z/", None, "allow"),
        "http://com/": ("com", "/", "com/", "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    found = urlfilter.judge(pages, spark.createDataFrame([], "url string, bad boolean")).orderBy("page_id").select("host", "path", "rule", "verdict")
    assert [tuple(r) for r in found.collect()] == list(cases.values())


def test_mined_rules(spark):
    draw = random.Random(4)
    labelled = []
    for i in range(600):
        bad = i % 3 == 0
        host = draw.choice(["pills.org", "loans.org"]) if bad and draw.random() < 0.9 else draw.choice(["news.org", "wiki.org", "shop.org"])
        labelled.append((f"https://{host}/{draw.choice('abc')}/{i}", bad))
    table = spark.createDataFrame([*labelled, (None, True), ("https://news.org/a/1", None)], "url string, bad boolean")
    rules = urlfilter.mine(table)
    assert {p for r in rules.collect() for p in (r.pivot, *r.others)} >= {"host:pills.org", "host:loans.org"}
    assert rules.agg(F.min("confidence")).first()[0] >= 0.6
    pages = spark.createDataFrame([(1, "http://pills.org/z"), (2, "http://news.org/a/9"), (3, "http://pills.org/z"), (4, None)], "page_id long, url string")
    found = urlfilter.judge(pages, table).orderBy("page_id").collect()
    assert [r.verdict for r in found] == ["block", "allow", "block", "allow"]
    assert urlfilter.mine(table.limit(5)) is None


def url_tokens(url):
    host, _, rest = url.split("://")[1].partition("/")
    found = {"scheme:" + url.split("://")[0], "host:" + host, "domain:" + ".".join(host.split(".")[-2:])}
    found |= {"word:" + w for x in host.split(".")[:-1] for w in re.split("[-_0-9]+", x) if w}
    path, _, query = rest.partition("?")
    found |= {"segment:" + x for x in path.split("/") if x}
    return found | {"key:" + q.split("=")[0] for q in query.split("&") if q}


def test_mined_rules_are_all_rules(spark):
    draw = random.Random(12)
    labelled = {}
    for i in range(300):
        host = draw.choice(["free-bets.example.org", "m.free-bets.example.org", "news.example.org", "bets-news.example.net"])
        url = f"http://{host}/{draw.choice('ab')}/{draw.choice('cd')}{i}?" + draw.choice(["k1=1&k2=2&k3=3&k4=4", "page=1"])
        labelled[url] = draw.random() < (0.9 if "free" in host and "/a/" in url else 0.5 if "k1" in url else 0.1)
    table = spark.createDataFrame(list(labelled.items()), "url string, bad boolean")
    found = {frozenset({r.pivot, *r.others}): (r.confidence, r.support) for r in urlfilter.mine(table).collect()}
    baskets = {u: url_tokens(u) for u in labelled}
    where = collections.defaultdict(set)
    for u, own in baskets.items():
        for t in own:
            where[t].add(u)
    same = collections.defaultdict(list)
    for t, urls in where.items():
        if len(urls) >= 20:
            same[frozenset(urls)].append(t)
    tokens, bad = sorted(min(x, key=lambda t: (not t.startswith("host:"), t)) for x in same.values()), {u for u, b in labelled.items() if b}
    expected = {}
    for size in range(1, len(tokens) + 1):
        for chosen in itertools.combinations(tokens, size):
            urls = set.intersection(*(where[t] for t in chosen))
            hits = len(urls & bad)
            if hits >= 20 and hits / len(urls) >= 0.6 and hits / len(urls) >= 1.5 * len(bad) / len(labelled):
                expected[frozenset(chosen)] = (hits / len(urls), hits / len(labelled))
    assert set(found) == set(expected) and len(found) > 2
    assert all(abs(x - y) < 1e-9 for k in found for x, y in zip(found[k], expected[k]))
    pages = [(i, u, "h", 1.0) for i, u in enumerate(["http://x.free-bets.example.org/a/z", "http://x.free-bets.example.org/b/z", "http://free-bets.example.com/a/z"])]
    judged = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, host string, _tail double"), table)
    assert judged.columns == ["page_id", "url", "_tail", "host", "path", "rule", "verdict", "mined_rule", "confidence"]
    best = lambda u: max(((v, "\n".join(sorted(k))) for k, v in expected.items() if k <= url_tokens(u)), default=None)
    for r in judged.collect():
        mined = None if r.rule else best(r.url)
        assert r.verdict == ("allow" if r.rule or not mined else "block") and r.mined_rule == (mined and mined[1])


# 1 ------------------------------------------------------------------------------------------------


def test_language(spark, no_documents):
    draw = random.Random(6)
    stems = {"en": "the and ing tion er of in that with".split(), "de": "der und ung heit er sch ein mit ü".split(), "fr": "le et ment eau é de que avec ç".split()}
    text = lambda lang, n: " ".join("".join(draw.choice(stems[lang]) for _ in range(draw.randint(1, 3))) for _ in range(n))
    docs = [(i, text(lang, draw.randint(5, 200)), lang, f"src{lang}") for i, lang in enumerate(draw.choice(list(stems)) for _ in range(300))]
    held = docs[200:]
    table = spark.createDataFrame(docs[:200], "doc_id long, text string, lang string, source string")
    model = langid.train(table)
    assert model[0] == ["de", "en", "fr"]
    unseen = spark.createDataFrame(held, table.schema)
    found = {r.doc_id: r for r in langid.identify(langid.document_evidence(unseen), model, ["doc_id"]).collect()}
    assert sum(found[i].text_lang == lang for i, _, lang, _ in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None, None), (2, "", None), (3, "x", None)], "doc_id long, text string, source string")
    assert langid.identify(langid.document_evidence(odd), model, ["doc_id"]).filter("lang is not null").count() == 3
    assert langid.identify(langid.document_evidence(no_documents), model, ["doc_id"]).count() == 0
    assert langid.train(no_documents)[0] == []
    assert rows(langid.identify(langid.document_evidence(odd), langid.train(no_documents), ["doc_id"]).select("lang")) == [(None,)] * 3


def test_language_evidence_beyond_the_text(spark):
    draw = random.Random(7)
    docs = [(i, "the and of ing er " * 20 if i % 2 else "der und ung heit er " * 20, "en" if i % 2 else "de") for i in range(40)]
    model = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    pages = [(i, f"http://w{i % 3}.x.{'com' if i % 2 else 'de'}/p", f'<html lang="{"en" if i % 2 else "DE"}"><style>der der</style><p>{docs[i][1]}</p>') for i in range(40)]
    pages += [(100, "http://w1.x.de/q", "<html><p></p>"), (101, "http://new.x.com/q", None), (102, None, '<html lang=de>er'), (103, None, None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r for r in langid.identify(langid.page_evidence(table), model, ["page_id"]).collect()}
    assert [found[i].lang for i in (100, 101, 102)] == ["de", "en", "de"]
    assert all(found[i].lang == ("en" if i % 2 else "de") for i in range(40))
    assert all(0 < r.probability <= 1 for r in found.values())
    del draw


def fused(rows, langs, table, trusted=200.0, temper=4.0, strength=20.0):
    """{key: (lang, probability)} by the definition, for rows (key, text, declared, suffix, domain, host)."""
    says, loglik = [], []
    for _, text, *_ in rows:
        data = (text or "").lower().encode()
        grams = [data[a : a + 4] for a in range(len(data) - 3)]
        buckets = [int.from_bytes(g, "little") * 2654435761 % 2**32 >> 17 for g in grams]
        own = np.array([sum(float(np.float32(table[k][b])) for b in buckets) for k in range(len(langs))])
        own = own / (temper * max(1.0, len(grams) / trusted) ** 0.5)
        loglik.append(own)
        says.append(np.exp(own - own.max()) / np.exp(own - own.max()).sum())
    out = {}
    for i, (key, _, *place) in enumerate(rows):
        other = [j for j in range(len(rows)) if j != i]
        count = lambda test: sum((says[j] for j in other if test(rows[j][2:])), np.zeros(len(langs)))
        rest = count(lambda p: True)
        base = (rest + 1) / (rest.sum() + len(langs))
        domain = count(lambda p: p[2] == place[2])
        domain = (domain + strength * base) / (domain.sum() + strength)
        host = count(lambda p: list(p[2:]) == place[2:])
        score = loglik[i] + np.log((host + strength * domain) / (host.sum() + strength))
        for at in (0, 1):
            share = strength * sum(r[2 + at] == place[at] for r in rows) / len(rows)
            score = score + np.log((count(lambda p, at=at: p[at] == place[at]) + share) / (rest + strength))
        out[key] = langs[int(score.argmax())], float(1 / np.exp(score - score.max()).sum())
    return out


def test_fusion_by_its_definition(spark):
    draw = random.Random(11)
    stems = {"en": "the and ing tion", "de": "der und ung heit", "fr": "le et ment eau"}
    text = lambda lang, n: " ".join(draw.choice(stems[lang].split()) for _ in range(n))
    train = spark.createDataFrame([(text(lang, 40), lang) for lang in stems for _ in range(30)] + [("x", None)], "text string, lang string")
    langs, table = langid.train(train)
    rows = []
    for i in range(60):
        lang = draw.choice(list(stems))
        domain = draw.choice(["x.com", "y.de", "z.fr", None])
        words = text(lang, draw.choice([0, 1, 3, 200]))
        rows.append((i, draw.choice([words, words, None]) if i % 7 else "Ünïcode \0 " + words.upper(), draw.choice([lang, "en", None]), domain and domain[2:], domain, domain and draw.choice(["a.", "b."]) + domain))
    rows = [(k, None if t is None else t.replace("\0", " "), *p) for k, t, *p in rows]
    frame = spark.createDataFrame(rows, "k int, _t string, declared string, suffix string, domain string, host string")
    found = {r.k: (r.lang, r.probability) for r in langid.identify(frame, (langs, table), ["k"]).collect()}
    expected = fused(rows, langs, table)
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in expected.items()}
    assert all(abs(found[k][1] - expected[k][1]) < 1e-4 for k in found)


def test_rare_labels_are_not_learnt(spark):
    rows = [("the and ing", "en")] * 1000 + [("der und ung", "de")] * 1000 + [("x", f"junk{i}") for i in range(3)]
    assert langid.train(spark.createDataFrame(rows, "text string, lang string"))[0] == ["de", "en"]
