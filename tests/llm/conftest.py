"""A small corpus with copies, near copies, boilerplate, awkward texts, and brute-force versions' helpers."""

import random

import pytest

STEMS = "the of and to a in is that it for river stone Ärger über niño señal château forêt table cloud seven river2 lamp".split()


def prose(draw, n):
    return " ".join(draw.choice(STEMS) + draw.choice(["", "", "", "s", "ing", "ed", ".", ","]) + str(draw.choice(["", "", "", draw.randint(0, 99)])) for _ in range(n))


def corpus(seed=1):
    """[(doc_id, text)]: ids are unique but for repeated rows at the end."""
    draw = random.Random(seed)
    shared = [prose(draw, 60) for _ in range(3)]
    base = [prose(draw, draw.randint(20, 400)) for _ in range(40)]
    texts = list(base)
    texts += [base[0]] * 6 + [base[1]] * 3
    for k in range(8):
        words = base[2 + k % 3].split(" ")
        words[draw.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    texts += [prose(draw, 30) + "\n" + s + "\n" + prose(draw, 30) for s in shared for _ in range(7)]
    texts += [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "one two three", "tie tie tie tie", "ab " * 300, "x" * 3000, "\x00\x01 nul \x7f", "É À ß ẞ 日本語 テスト 💥 " * 30]
    texts += [prose(draw, 9000), shared[0], shared[0] + "  " + shared[0]]
    rows = list(enumerate(texts))
    return rows + [rows[3], rows[3], rows[40]]


@pytest.fixture(scope="session")
def documents(spark):
    """With an unknown identifier, and columns named as operators name their own."""
    rows = [(i, t, 1, "q", None, 2.0) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, x long, fp string, n_words string, h double").repartition(5).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
