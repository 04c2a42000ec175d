import random

import pytest

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just those people take day good make how state use work".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", 1), (2, base, "en", 2), (2, base, "en", 2), (3, base.replace(" ", "\n", 1), None, 3), (4, None, "en", 4), (5, "", None, 5), (6, " \t\n ", "fr", 6),
        (None, "hello there", "fr", 7), (7, "12 34 !!", "fr", 8), (8, prose(2, 5000), "de", 9), (9, base + " tail", "en", 10), (10, "Été à Paris. Ça va?", "fr", 11), (11, "a", "en", 12), (12, None, None, 13),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long").withColumnRenamed("n", "count")


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return odd.limit(0)
