"""Collocations, SuperMinHash and importance resampling against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from sketchloom.llm import collocations, importance, setlinks, superminhash
from tests.llm.conftest import corpus
from tests.llm.test_operators import LOWER, components_of_sets, rows, shingle_set

CORPUS = corpus()

# 11 -----------------------------------------------------------------------------------------------


def counted_phrases(docs, longest):
    counts = collections.Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            counts.update((lang or "und", tuple(words[a : a + n])) for n in range(1, longest + 1) for a in range(len(words) - n + 1))
    return counts


def best_phrases(docs, least, longest=4, inside=80, top=2000):
    counts = counted_phrases(docs, longest)
    totals = collections.Counter()
    for (lang, words), k in counts.items():
        totals[lang] += k if len(words) == 1 else 0
    found = collections.defaultdict(list)
    often = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    covered = {
        (lang, words[i : i + n]) for (lang, words), f in often.items() for n in range(2, len(words)) for i in range(len(words) - n + 1) if 100 * f >= inside * counts[lang, words[i : i + n]]
    }
    for (lang, words), a in often.items():
        cuts = [(2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if (lang, words) not in covered:
            found[lang].append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, totals[lang], -s) for lang, own in found.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1))


def phrase_corpus():
    draw = random.Random(5)
    fixed = ["new york city", "New York", "the river Ärger", "a.b c", "x x x x x", "über den fluss hinaus", "\u3000wide \xa0space", "tie one", "tie two"]
    docs = []
    for i in range(300):
        parts = [draw.choice(fixed + ["the", "of river", "y", "city of"]) for _ in range(draw.randint(1, 30))]
        docs.append((draw.choice(["en", "de", None]), draw.choice([" ", "  ", "\t", ", ", ".\n"]).join(parts) + draw.choice(["", ".", "!?"])))
    return docs + [("en", None), ("en", ""), (None, " .. "), ("fr", "one"), ("en", "long " * 5000 + "end"), ("en", "new york city")] * 2


@pytest.mark.parametrize("pack_bytes", [60, 1 << 20])
def test_collocations(spark, pack_bytes):
    docs = phrase_corpus()
    df = spark.createDataFrame([(*d, 1, "p") for d in docs], "lang string, text string, rank int, phrase string").repartition(7)
    found = collocations.collocations(df, least=20, top=40, pack_bytes=pack_bytes)
    assert [tuple(r) for r in found.orderBy("lang", "rank").collect()] == best_phrases(docs, 20, top=40)


def test_collocations_of_two_words_and_of_nothing(spark):
    docs = phrase_corpus()
    df = spark.createDataFrame(docs, "lang string, text string")
    assert rows(collocations.collocations(df, least=25, longest=2)) == sorted(best_phrases(docs, 25, longest=2), key=repr)
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df, least=10**6).count() == 0


def test_a_full_sketch_loses_no_phrase(spark):
    docs = phrase_corpus()
    counts = counted_phrases(docs, 4)
    _, found = collocations.phrase_counts(spark.createDataFrame([((t or ""), lang or "und") for lang, t in docs], "_t string, lang string"), least=20, max_slots=64 * 8)
    assert rows(found) == sorted(((lang, " ".join(w), f) for (lang, w), f in counts.items() if len(w) > 1 and f >= 20), key=repr)


def test_a_language_is_scanned_for_its_own_packs_only(spark):
    """Scans grow with the phrases of a language, not with those of all languages."""
    made = [(lang, f"{lang} {i}") for lang, n in (("en", 400), ("de", 90), ("fr", 30), ("es", 20)) for i in range(n)]
    packs = list(collocations._packs(spark.createDataFrame(made, "lang string, phrase string"), 1000))
    assert sorted(sorted(pack) for pack, _ in packs) == [["de", "es", "fr"], ["en"], ["en"], ["en"]]
    found = [(lang, p.decode()) for pack, _ in packs for lang, own in collocations._listed(type("", (), {"value": ("", pack)})).items() for p in own]
    assert sorted(found) == sorted(made)


def test_words_are_few_letters_and_match_whole():
    draw = random.Random(8)
    words = [f"word{i:05}".encode() for i in range(3000)]
    phrases = list(dict.fromkeys(b" ".join(draw.choices(words[:40], k=draw.randint(2, 4))) for _ in range(500))) + [b" ".join(x) for x in zip(words, words[1:])]
    pack = type("", (), {"value": ("pack of a test", {"en": [zlib.compress(b"\n".join(phrases))]})})
    n, letters, automaton = collocations._automata(pack)["en"]
    assert n == len(phrases) and automaton.get_stats()["nodes_count"] < sum(map(len, phrases)) / 4
    text = draw.choices(words[:40] + [b"unknown", b"."], k=20_000) + words
    counts = collections.Counter(b" ".join(text[i : i + k]) for k in (2, 3, 4) for i in range(len(text) - k + 1))
    met = collections.Counter(phrases[i] for _, i in automaton.iter("".join(letters.get(w, collocations._BREAK) for w in text)))
    assert met == {p: counts[p] for p in phrases if counts[p]}


def test_stretches_join_to_the_text():
    draw = random.Random(2)
    for _ in range(200):
        text = "".join(draw.choice("ab .,\n") for _ in range(draw.randint(0, 300)))
        parts = list(collocations.stretches(text, 40))
        assert "".join(parts) == text and all(p[-1] in ".,\n" for p in parts[:-1])
        assert sum(len([w for w in collocations.tokens(p) if w != b"."]) for p in parts) == len([w for w in collocations.tokens(text) if w != b"."])


# 12 -----------------------------------------------------------------------------------------------


def expected_classes(docs, size=3, percent=85):
    first = components_of_sets(docs, size, percent, False)
    return sorted(((i, len(shingle_set(t, size)), first[i], first[i] == i) for i, t in docs), key=repr)


def test_minhash(documents, no_documents):
    found = superminhash.near_duplicates(documents, ["doc_id", "fp"])
    assert found.columns == ["doc_id", "fp", "n_shingles", "component_id", "kept"]
    assert rows(found.drop("fp")) == expected_classes(CORPUS)
    assert superminhash.near_duplicates(no_documents, ["doc_id"]).count() == 0


def near_family(seed, n, edits):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    out = []
    for i in range(n):
        words = list(base)
        for at in draw.sample(range(120), draw.randint(0, edits)):
            words[at] = f"e{draw.randrange(10**6)}"
        out.append((1000 * seed + i, " ".join(words)))
    return out


@pytest.mark.parametrize("bucket, weight", [(4, 500), (1024, 1 << 18)])
def test_minhash_of_families_at_the_limit(spark, monkeypatch, bucket, weight):
    """Families whose members are within and beyond the limit of each other, in blocks of any size."""
    monkeypatch.setattr(setlinks.confirmed, "__defaults__", (weight,))
    docs = near_family(1, 60, 5) + near_family(2, 40, 2) + near_family(3, 40, 9)
    found = superminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"], bucket=bucket)
    assert rows(found) == expected_classes(docs)


def test_minhash_without_identifiers(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "A b c d"), (None, None), (5, " ")], "doc_id long, text string")
    assert rows(superminhash.near_duplicates(df, ["doc_id"])) == sorted([(None, 2, 7, False), (None, 2, 7, False), (7, 2, 7, True), (None, 0, None, False), (5, 0, 5, True)], key=repr)


def test_signatures_estimate_with_less_variance():
    draw = np.random.default_rng(1)
    errors, m = [], 252
    for _ in range(150):
        values = draw.integers(0, 1 << 63, 60, dtype=np.uint64)
        a, b = values[:45], values[15:]  # 30 of 60
        x, y = superminhash.signatures([a, b], m)
        errors.append((x == y).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 0.9 * math.sqrt(0.25 / m)  # an independent MinHash has this


def test_signatures_in_parts_are_equal():
    draw = np.random.default_rng(2)
    sets = [draw.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 0, 700, 50, 3000)]
    assert (superminhash.signatures(sets, 60) == superminhash.signatures(sets, 60, part=64)).all()
    assert all(len(set((v >> np.uint64(32)).tolist())) == 60 for v in superminhash.signatures(sets[:1], 60))  # one shingle offers all ranks


# 13 -----------------------------------------------------------------------------------------------


def resampled(docs, target, buckets=10_000, orders=2, min_words=20, share=25):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def listed(text):
        words = word.findall((text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[a : a + n]).encode()) % buckets for n in range(1, orders + 1) for a in range(len(words) - n + 1)]

    own, s, t = [(i, *listed(x)) for i, x in docs], collections.Counter(), collections.Counter()
    for _, _, b in own:
        s.update(b)
    for x in target:
        t.update(listed(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, n, b in own:
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, b)) // len(b) if b else 0
        out.append([i, len(b), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= min_words and x[0] is not None), key=lambda x: (-x[3], x[0]))
    for k, x in enumerate(able[: len(able) * share // 100], 1):
        x[4] = k
    return sorted((tuple(x[:5]) for x in out), key=repr)


TARGET = ["table cloud seven river stone", None, "", "the of and to a in is that it for", "Ärger ÜBER niño 7 7 7"]


@pytest.mark.parametrize("orders, part", [(2, 1 << 14), (2, 7), (3, 50), (1, 9)])
def test_importance(spark, documents, monkeypatch, orders, part):
    monkeypatch.setattr(importance.positions, "__defaults__", (2, part))
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, b int")
    found = importance.resample(documents, target, orders=orders)
    assert rows(found.filter("rank is null").unionByName(found.filter("rank is not null"))) == resampled(CORPUS, TARGET, orders=orders)


def test_importance_of_nothing_and_of_unknown_identifiers(spark, no_documents):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert importance.resample(no_documents, target).count() == 0
    docs = [(None, "one two " * 20), (1, "three four " * 20), (2, None), (3, "x"), (4, "three four " * 20), (5, "a " * 20), (6, "b " * 19)]
    found = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), target.limit(0), share=50)
    assert rows(found) == resampled(docs, [], share=50)
