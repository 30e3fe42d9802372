import pytest

WORDS = [f"w{k}" for k in range(400)]


def prose(seed: int, n: int) -> str:
    import random

    return " ".join(random.Random(seed).choices(WORDS, k=n))


def documents() -> list[tuple]:
    """Rows with nulls, empty, blank, long and repeated texts, ties, and copies with a word changed."""
    base = prose(1, 120).split(" ")
    near = [*base]
    near[60] = "other"
    far = [*base[:50], *prose(2, 70).split(" ")]
    rows = [
        (1, " ".join(base), "en", "b"),
        (2, " ".join(base), "en", "b"),
        (3, " ".join(near), "en", "a"),
        (4, " ".join(far), None, "a"),
        (5, "", "en", None),
        (6, None, "en", "b"),
        (7, " \t\n ", "en", "b"),
        (8, "one two", "en", "c"),
        (9, "One TWO", "en", "c"),
        (10, prose(3, 30_000), "en", "c"),
        (11, "a" * 5000 + " " + "é" * 300, "en", "c"),
        (11, "a" * 5000 + " " + "é" * 300, "en", "c"),
        (None, " ".join(base), "en", "a"),
        (13, "mail joe [at] example [dot] com or a.b@c.org, 10.0.0.1, +1 (555) 555-0100", "en", "a"),
        (14, "x  y\n\nz <|endoftext|>   \U0001f600 \u0000", "en", "\U0001f600"),
    ]
    return rows + [(100 + k, prose(100 + k, 20 + 7 * k), "en", "abc"[k % 3]) for k in range(25)]


SCHEMA = "doc_id long, text string, lang string, source string"
#: Extra columns whose names are those of results and of steps on the way.
CLASHES = ("n_tokens", "component_id", "size", "id", "key", "digest", "kept", "rank", "n", "first")


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("extra") for c in CLASHES})


@pytest.fixture(scope="session")
def docs(spark):
    return with_clashes(spark.createDataFrame(documents(), SCHEMA))


@pytest.fixture(scope="session")
def no_docs(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))
