import random

import pytest

WORDS = "alpha beta gamma delta omega river stone cloud light shadow winter summer north south over under through with and the of in on at by to from".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(["", "", ",", ".", "\n"])) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, n int, rep string, cell string, set string, component_id string, sequence_id string"


@pytest.fixture(scope="session")
def rough(spark):
    """Nulls, empty and long texts, repeated rows and ids, columns whose names
    the operators use themselves."""
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, "word", "en", "b"), (5, "1234 !!", "fr", "b"),
        (6, prose(1, 9000), "en", "a"), (7, prose(2, 300), "en", None), (8, prose(2, 300), "fr", "a"), (9, prose(2, 299) + " extra", "fr", "a"),
        (10, "ünïcödé Straße 言葉 ΣΑΣ " * 20, "de", "c"), (10, "ünïcödé Straße 言葉 ΣΑΣ " * 20, "de", "c"), (None, prose(3, 50), "en", "a"), (None, None, None, None),
    ]
    rows += [(100 + i, prose(50 + i, 40 + i), ("en", "de")[i % 2], f"s{i % 4}") for i in range(60)]
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "x", 1, "r", "c", "s", "k", "q") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
