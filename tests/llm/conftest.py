import random

import pytest

ID_TEXT = "doc_id long, text string"


@pytest.fixture
def frame(spark):
    """docs from (doc_id, text) pairs, with extra columns whose names the operators use inside."""

    def make(rows, extra=True):
        if not extra:
            return spark.createDataFrame(rows, ID_TEXT)
        schema = ID_TEXT + ", " + ", ".join(f"{c} string" for c in CLASHING)
        return spark.createDataFrame([(*r, *(None if i % 2 else c for i, c in enumerate(CLASHING))) for r in rows], schema)

    return make


CLASHING = ("_id", "_key", "n", "digest", "row_no", "keys", "component", "did", "fp", "start", "held_out", "score", "y", "word")


def prose(seed, words, vocabulary=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(3 + r.randrange(vocabulary) % 5)) for _ in range(words))
