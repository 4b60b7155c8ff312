import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty, long and repeated texts, ties, and extra columns with clashing names."""
    rng = random.Random(4)
    words = ["the", "and", "for", "mit", "und", "der", "les", "des", "une", "para"]
    plain = [" ".join(rng.choice(words) + str(i % 3) for i in range(rng.randrange(30, 90))) for _ in range(8)]
    near = plain[0].split()
    near[-1] = "changed"
    rows = [(i, t, "en" if i % 2 else "fr", "web") for i, t in enumerate(plain)]
    rows += [
        (8, plain[1], "en", "web"),
        (9, plain[1].upper(), None, None),
        (10, " ".join(near), "en", None),
        (11, None, "en", "web"),
        (12, "", None, "web"),
        (13, "  \n\t ", "fr", "web"),
        (13, "  \n\t ", "fr", "web"),
        (14, "é😀 " * 3000 + "x" * 20000, "fr", "web"),
        (15, "12345 67890 !!!", "en", "web"),
        (None, plain[2], "fr", None),
        (None, None, None, None),
        (16, "one two three", "en", "web"),
        (17, "one two three", "en", "web"),
        (3, plain[3], "en", "web"),
    ]
    extra = "key string, node string, hash string, bucket string, size string, kept string, n string, class string, grouped string"
    names = [c.split()[0] for c in extra.split(", ")]
    rows = [(*r, *["z" if i % 2 else None for i in range(len(names))]) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + extra)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
