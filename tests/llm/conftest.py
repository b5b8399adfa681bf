import pytest

TEXTS = [
    (1, "the cat sat on the mat"), (2, "the  cat sat\non the mat "), (3, None), (4, ""), (5, " \t\n"), (6, "a"),
    (6, "a"), (None, "the cat sat on the mat"), (None, "no id at all"), (None, "no id at all"),
    (7, "word " * 40_000), (8, "x" * 150_000), (9, "The CAT sat on the mat"), (10, "汉字 é 😀 text"),
    (11, "mail me at a.b@mail.example.com or +1 (456) 555-2186"), (11, "same id, other text of its own"),
    (12, "the quick brown fox jumps over the lazy dog and runs away from all the other dogs in town"),
    (20, "the quick brown fox jumps over the lazy dog and runs away from all the other dogs in town"),
    (40, "one two three four five six seven eight nine ten eleven twelve"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    rows = [(i, t, "en" if k % 2 else None, None if k % 3 == 0 else f"src{k % 2}", len(t or ""), k, "x", "y", k) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "key int, fp string, _id string, n int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
