import pytest

#: A null and an empty text, blanks, a long text, ties, repeated rows, null ids and columns that clash with results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, shard int, h long, place int, members long, copy long"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions under bright silver moons near quiet rivers".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i) % len(WORDS)] + str(seed % 3) * (i % 11 == 0) for i in range(n))


def row(doc_id, text):
    return (doc_id, text, None, "s", None, 0.5, "x", 1, 7, 3, 2, 9)


def edge_rows():
    rows = [row(i, sentence(i, 40 + i)) for i in range(20)]
    rows += [row(100, None), row(101, ""), row(102, " \t\n "), row(103, "word"), row(104, "two words"), row(105, sentence(3, 30_000))]
    rows += [row(3, sentence(3, 43)), row(3, sentence(3, 43)), row(3, "another text under the same id"), row(106, sentence(5, 45)), row(107, sentence(5, 45))]
    rows += [row(None, "a text without an id"), row(None, None), row(108, "ünïcödé ÀÉ İ ß 'll <|endoftext|> \U0001f600 \x1c x"), row(-5, "negative id")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
