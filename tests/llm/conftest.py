import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make_docs(seed=0, n=60):
    """Prose with copies, near copies, shared passages, repeated lines, junk and very long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeoé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    word = lambda: rng.choice(vocabulary)
    line = lambda k=None: " ".join(word() for _ in range(k or rng.randint(3, 30))).capitalize() + "."
    passage, common = " ".join(word() for _ in range(60)) + ".", line(12)
    texts = []
    for i in range(n):
        kind = i % 8
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
        elif kind == 2 and texts:
            words = rng.choice(texts).split(" ")
            words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
        elif kind == 3:
            texts.append("\n".join([line(), passage, common, line()]))
        elif kind == 4:
            x = line(10)
            words = x.split(" ")
            words[5] = word()
            texts.append("\n".join([x, " ".join(words), common, " ".join(words[:4] + words[5:])]))
        elif kind == 5 and i == 5:
            texts.append(" ".join(word() for _ in range(6000)))
        else:
            texts.append("\n".join(line() for _ in range(rng.randint(1, 9))))
    return [(i, t, "en", f"src{rng.choice([0, 0, 0, 1, 2])}", len(t)) for i, t in enumerate(texts)]


#: Nulls, empties, blanks, repeated rows, odd white space.
ODD = [
    (1000, None, None, None, None), (1001, "", "en", "src0", 0), (1002, " \t\n \x0b", "en", "src1", 5),
    (1003, "a\r\nb\x0cc  d", "en", None, 9), (1003, "a\r\nb\x0cc  d", "en", None, 9), (1004, "ß" * 300, "de", "src2", 300),
    (None, "no id but words " * 12, "en", "src0", 100), (None, None, None, None, None), (1005, "x " * 400, "en", "src9", 800),
]


@pytest.fixture(scope="session")
def doc_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd_docs(spark, doc_rows):
    rows = doc_rows[:20] + ODD
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
