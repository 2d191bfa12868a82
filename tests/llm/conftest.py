import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows, copies, ties."""
    r = random.Random(5)
    base, long = prose(r, 120), prose(r, 30_000)
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (2, base, "en", "a", 5), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "en", None, 3),
        (None, base, "en", "a", 5), (6, long, "de", "a", 9), (7, "one", "en", "c", 3), (8, prose(r, 60) + "\n" + prose(r, 60), "fr", "a", 7), (9, "é😀 \x00 ▁ <s> <|endoftext|>", "en", "a", 9), (10, "#" * 300, "en", "b", 300),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns whose names operators use themselves."""
    rows = [(*row, 1, [2], "x", 3, True, "y") for row in odd_rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, spans array<int>, items string, key int, kept boolean, component_id string").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
