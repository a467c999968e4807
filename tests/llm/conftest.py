import random

import pytest

WORDS = "ta li mo ren sa du kel var ost im pra nu".split()


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages, edge cases: (doc_id, text)."""
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))
    shared = prose(40)
    out = [(k, prose(rng.randint(5, 120))) for k in range(30)]
    out += [(100 + k, out[3][1]) for k in range(8)]
    base = prose(150).split()
    for k in range(12):
        w = list(base)
        w[rng.randrange(len(w))] = "changed"
        out.append((200 + k, " ".join(w)))
    out += [(300 + k, prose(10) + " " + shared + " " + prose(12)) for k in range(6)]
    out += [(400, None), (401, ""), (402, " "), (403, "one"), (404, "one two three"), (405, "ÀÉ ü 日本 \U0001f642 x" * 30), (406, "aaaa " * 200), (407, "A" * 400), (408, prose(3000))]
    out += [(409, "One TWO three"), (410, "one two three")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With a clashing extra column and rows out of order."""
    rows = [(i, t, "en", "src", len(t or ""), "extra") for i, t in texts]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, sig string").repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def pytest_configure():
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
