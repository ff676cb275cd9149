"""A table of awkward documents, and real ones at the smallest scale."""

from __future__ import annotations

import os

import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc long, value string, ids string, start string"


def awkward_rows() -> list[tuple]:
    prose = "The quick brown fox jumps over the lazy dog while seven wizards mix boxes of liquor in a very quiet jungle at night. "
    other = "Ein anderer Text über ganz andere Dinge, der mit dem ersten nichts gemein hat außer dem Alphabet. "
    texts = [
        None,
        "",
        "   \n\t ",
        "one two three",
        prose,
        prose,
        prose + other,
        other + prose,
        prose * 40,
        "a" * 500,
        "ab" * 400 + prose,
        "wörter mit ümlauten und 漢字の文 " * 20,
        " ".join(f"w{i}" for i in range(30_000)),
        "x\n" * 300,
        "Mail bob.smith@corp.example.com or +1 (017) 555-7713, card 4929348385146306, 10.2.3.4 twice 10.2.3.4, Mrs Smith and Mr Smith.",
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["src0", "src0", "src1", None][i % 4], 1, 7, "v", "i", "s") for i, t in enumerate(texts)]
    rows.append(rows[4])  # a repeated row
    rows.append((None, prose, "en", "src0", 1, 7, "v", "i", "s"))
    rows.append((None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test data here")
    return SMALL
