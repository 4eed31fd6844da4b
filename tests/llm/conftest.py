from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, words string, _at int, h string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents with columns whose names the operators might use themselves."""

    def make(rows):
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x", "y", 1, "z") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows, near copies and shared passages."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["été", "größe", "Ünïcode", "漢字", "ＡＢＣ", "and", "the"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(120), prose(90)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (2, base), (3, " ".join(near)), (4, base + " tail of it"), (None, base), (5, None), (6, ""), (7, "   \n\t "),
        (8, "one two three"), (9, "one two three"), (10, "One  TWO\tthree"), (11, prose(3000)), (12, "same " * 400), (13, "ab" * 900),
        (14, prose(40) + " " + passage + " " + prose(30)), (15, passage + " " + prose(10)), (16, prose(5) + "\n" + passage), (17, "!!! ??? ..."),
        (18, passage[:450]), (None, None), (19, "x"),
    ]
    rows += [(100 + i, prose(60)) for i in range(30)]
    return rows
