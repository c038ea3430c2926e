import random

import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use themselves.
CLASHES = ("score double, n_tokens bigint, n_lines bigint, pos int, line string, key string, bands string, spans string, "
           "dropped string, _text string, _h string, _id string, size string, `group` string")


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], f"{DOC_SCHEMA}, {CLASHES}")


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(400)]
    long_text = " ".join(rng.choice(words) for _ in range(30_000))
    prose = " ".join(rng.choice(words) for _ in range(80))
    return [
        (1, None), (2, ""), (3, " "), (4, "\n\n"), (5, prose), (6, prose), (6, prose), (7, prose + " tail"),
        (None, "no id here"), (None, None), (8, long_text), (9, "x" * 50_000), (10, "é日本😀\t\r\n ½ ٣"),
        (11, "a b c d e"), (12, "write to a.b@c.de or +1 (826) 555-4081 and 4111 1111 1111 1111 at 1.2.3.4"),
        (13, "one line\n" + "repeated boiler plate line 12\n" * 3 + "own"), (14, "repeated boiler plate line 13\nmine"),
        (15, "first thing\nrepeated boiler plate line 14"), (13, "same id, other text"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rows = [(i, t, None, "s" if n % 2 else None, None, 0.5, 7, 1, 2, "l", "k", "b", "s", "d", "t", "h", "i", "z", "g")
            for n, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, f"{DOC_SCHEMA}, {CLASHES}").repartition(3)
