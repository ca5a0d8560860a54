import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, k=0):
    """A text of n distinct words."""
    return " ".join(f"w{k}x{i}" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs():
    """Nulls everywhere, empty and blank texts, a very long text, ties, repeated rows, copies and near copies."""
    passage = words(30, 7)
    long_text = " ".join(f"l{i % 997}y{i}" for i in range(20_000))
    near = words(300, 3)
    rows = [
        (None, "a b c", "en", "s1", 5),
        (1, None, None, None, None),
        (2, "", "en", "s1", 0),
        (3, " \n\t ", "fr", None, 4),
        (4, "one", "en", "s2", 3),
        (5, f"start {passage} end", "en", "s2", 100),
        (6, f"other {passage} tail", "fr", "s1", 100),
        (7, long_text, "en", "s1", len(long_text)),
        (8, near, "en", "s3", len(near)),
        (9, near + " extra", "en", "s3", len(near) + 6),
        (10, near, "en", "s3", len(near)),
        (10, near, "en", "s3", len(near)),
        (11, "Größe naïve café. The end! 'tis 42 日本 🙂\r\n\x1cx", "de", "s2", 40),
        (12, "SHOUT!! " * 60, "en", "s2", 480),
        (13, "same line\nsame line\n" * 20, "en", "s2", 400),
    ]
    return rows


@pytest.fixture()
def docs(spark, odd_docs):
    return spark.createDataFrame(odd_docs, SCHEMA)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
