import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tk string, h int, spans string, row int, d double, score string, node int, size int, vertex int"


def words(seed: int, n: int) -> str:
    """Prose of invented words."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstuwé") for _ in range(r.randint(2, 7))) for _ in range(n))


def rows():
    base = words(1, 300)
    near = base.split()
    for i in (20, 150, 280):
        near[i] = "changed"
    shared = words(2, 70)
    texts = [
        (0, base), (1, base), (2, " ".join(near)), (3, words(3, 80) + " " + shared + " " + words(4, 60)), (4, words(5, 30) + "\n" + shared.upper() + "\n" + words(6, 90)),
        (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "one two"), (10, "Released under the MIT License.\n" + words(7, 120)), (11, "x" * 50_000), (12, " " * 5000 + "a\n" * 3000),
        (13, words(8, 20_000)), (14, "The <|endoftext|> mark ﷽ 漢字かな   éé don't 12345"), (None, words(9, 60)), (16, words(10, 70)), (16, words(10, 70)), (17, "same line here\n" * 80), (18, words(11, 55) + " ###***"),
    ]
    return [(i, t, None if i == 3 else "en", "s", 0, "clash", 1, "clash", 2, 0.5, "clash", 3, 4, 5) for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i not in (17, 18)), 0) for i in range(14)] + [(17, 0, 0), (18, 0, None), (99, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
