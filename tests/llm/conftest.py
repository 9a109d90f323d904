import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (903, "one"), (904, "x" * 50_000), (905, " ".join(["again"] * 3000)), (None, "a null id with some words"), (None, None),
       (906, "日本語 テキスト \U0001f600 é <|endoftext|> a  b c \x1c d")]


@pytest.fixture(scope="session")
def texts():
    """Random texts with exact copies, near copies, shared passages and odd rows."""
    rnd = random.Random(7)
    vocabulary = ["w%d" % i for i in range(400)] + ["The", "of", "and"] * 40
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage = make(70)
    docs = []
    for i in range(120):
        w = make(rnd.choice([3, 8, 30, 60, 120, 300]))
        if i % 5 == 0:
            at = rnd.randint(0, len(w))
            w[at:at] = passage[rnd.randint(0, 10):]
        if i % 7 == 3 and docs:
            w = docs[rnd.randrange(len(docs))][1].split(" ")
            if i % 2:
                for _ in range(max(1, len(w) // 25)):
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        docs.append((i, " ".join(w)))
    rnd.shuffle(docs)
    return docs + ODD


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table with extra columns whose names clash with those of the operators."""
    rows = [(d, t, "en", None, 1, "x", 2, True, b"y") for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, n_words long, kept boolean, sha binary").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
