"""Fixtures in code: awkward documents and vectors that every operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, fp string, removed string"


def awkward(spark, extra=()):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with names that operators
    use themselves."""
    rows = [
        (1, "The cat sat on the mat. It was a fine day for all of us here.", "en", "a", 10, "x", "y", "z"),
        (1, "The cat sat on the mat. It was a fine day for all of us here.", "en", "a", 10, "x", "y", "z"),
        (2, None, "en", "a", 0, None, None, None),
        (3, "", None, None, 0, None, None, None),
        (None, "nobody knows this one, a text without an id at all", "en", None, 5, None, None, None),
        (4, "word " * 30_000, "en", "b", 150_000, None, None, None),
        (5, " \n\t \n", "de", "b", 5, None, None, None),
        (6, "12345 !!! ???", None, "b", 5, None, None, None),
        (7, "日本語のテキスト é ß   \U0001f600", "de", "c", 5, None, None, None),
        (8, "x" * 5000, "en", "c", 5000, None, None, None),
        (9, "The cat sat on the mat. It was a fine day for all of us here.", "en", "c", 10, None, None, None),
        *extra,
    ]
    return spark.createDataFrame(rows, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def united(n, pairs):
    """Smallest index of each index's component."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
