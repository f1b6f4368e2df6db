import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _gone_id string, stem string"
WORDS = [f"w{k}" for k in range(400)]


def prose(a, n):
    return " ".join(WORDS[(a * 31 + k * (a % 7 + 1)) % 400] for k in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = prose(3, 30000)
    texts = [prose(1, 60), prose(1, 60).upper(), prose(1, 59) + " other", "", None, " \n\t", "Hi", "hi", long, long + " end", prose(2, 40), "Ünïcode ẞ 日本語 😀 <|endoftext|> é", prose(5, 4)]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, None, "x", "y") for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, prose(2, 40), "en", "s1", 1, None, None), (40, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
