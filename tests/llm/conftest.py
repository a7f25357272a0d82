import pytest

#: Texts that operators must take: null, empty, blank, short, repeated, odd characters, very long.
TEXTS = [
    None,
    "",
    " \t\n",
    "word",
    "one two three",
    "a b c d e f g h",
    "a b c d e f g h",
    "ÀÉ été straße 日本語 🎉🎉",
    "<|endoftext|> is text",
    "x  y\n z \r\n\n",
    "1.2.3.4 +1 (017) 555-7713 a.b@c.de 4111 1111 1111 1111",
    "the same line\n" * 40,
    "aaaaaaaaab" * 400,
    "lorem ipsum dolor sit amet consectetur " * 3000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """A table of odd texts, with null and repeated ids, null columns, repeated rows, and columns whose names might clash."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"src{i % 2}", len(t or ""), "x", 0.5) for i, t in enumerate(TEXTS)]
    rows += [(None, "a null id with some words", "fr", "src0", 25, "y", 0.1), rows[5], rows[5], (3, "another text of the same id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
