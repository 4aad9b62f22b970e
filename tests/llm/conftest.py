import random

import pytest

SYLLABLES = "th er on an in ti es re ed at ha en st nd or nt ea ou to is it hi".split()


def words(rnd, n):
    return ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts and ids, repeats, a long text, clashing extra columns."""
    rnd = random.Random(7)
    base = " ".join(words(rnd, 80))
    long = " ".join(words(rnd, 30000))
    near = base.replace(" ", " ", 1) + " tail"
    rows = [
        (0, base, "en", "a", 5, "x"), (1, base, "en", "a", 5, "x"), (1, base, "en", "a", 5, "x"), (2, near, "de", "b", 5, None), (3, None, None, None, None, None),
        (4, "", "fr", "b", 0, "y"), (5, " \n\t ", "fr", None, 4, "y"), (6, "a b c", "es", "c", 5, "z"), (7, long, "en", "a", len(long), "w"), (None, "only one", "en", "c", 8, "q"),
        (8, "ÄÖÜ 数字 \U0001f600 end", "de", "c", 1, "k"), (9, "mail a.b@c.org or +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111", "en", "b", 1, "m"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
