"""Benchmark decontamination against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from evoframe.llm import decontaminate


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs: list[tuple], items: list[tuple], width: int = 10) -> list[tuple]:
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = words_of(text)
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add("" if item is None else str(item))
    sizes, out = {len(w) for w in windows}, []
    for doc_id, text in docs:
        words, hit, named = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named |= windows[tuple(words[i : i + n])]
        out.append((doc_id, len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog while seven wizards mix boxes"),
    (2, "seven wizards mix boxes of liquor in a very quiet jungle at night. THE quick"),
    (10, "one two three"),
    (11, "one, two: three"),
    (3, None),
    (4, " .,; "),
    (5, "mit ümlauten und"),
    (6, "a a a a a a a a a a a a"),
    (None, "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17"),
    (2, "a second text of item two that stands nowhere at all in any document here"),
]


@pytest.mark.parametrize("most_words", [1 << 19, 10])
def test_awkward_documents(spark, awkward, nothing, most_words):
    items = spark.createDataFrame([(a, b, "x") for a, b in ITEMS], "item_id long, text string, doc_id string")
    docs = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(99, "a " * 50 + "b"), (98, "A" * 3 + " a" * 10)], "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    found = [tuple(r) for r in decontaminate.contamination_digest(docs, items, most_words=most_words).collect()]
    assert sorted(found, key=str) == brute(rows, ITEMS)
    assert decontaminate.contamination_digest(nothing, items, most_words=most_words).count() == 0
    clean = decontaminate.clean_documents(awkward, items, most_words=most_words)
    assert clean.columns == awkward.columns
    dirty = {r[0] for r in brute([tuple(r) for r in awkward.select("doc_id", "text").collect()], ITEMS) if r[5] and r[0] is not None}
    assert {r.doc_id for r in clean.collect()} - {None} == {r.doc_id for r in awkward.collect()} - {None} - dirty


def test_no_benchmark(spark, awkward, nothing):
    found = decontaminate.contamination_digest(awkward, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(found) == awkward.count() and not any(r.contaminated for r in found)


def test_random_words_of_few_kinds(spark):
    draw = np.random.default_rng(3)
    text = lambda n: " ".join("abc"[k] for k in draw.integers(0, 3, n))
    docs, items = [(d, text(int(draw.integers(0, 400)))) for d in range(60)], [(i, text(int(draw.integers(0, 14)))) for i in range(200)]
    found = decontaminate.contamination_digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def test_longest_verbatim_matches(spark):
    item = " ".join(f"v{i}" for i in range(40))
    words = [f"u{i}" for i in range(30)]
    doc = " ".join(words + item.split()[5:30] + ["gap"] + item.split()[0:12])
    docs, items = spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([("q", item)], "item_id string, text string")
    row = decontaminate.contamination(docs, items).first()
    assert [tuple(m) for m in row.matches] == [("q", 30, 5, 25)]
    assert [tuple(s) for s in row.spans] == [(30, 25), (56, 12)]


def test_suffix_array_finds_all_places():
    draw = np.random.default_rng(4)
    line = draw.integers(0, 4, 500)
    table = decontaminate.SuffixArray(line, 6)
    order = sorted(range(500), key=lambda i: tuple(line[i : i + 6]))
    assert [tuple(line[i : i + 6]) for i in table.order] == [tuple(line[i : i + 6]) for i in order]
    patterns = draw.integers(1, 4, (50, 6))
    which, where = table.find(patterns)
    expected = {(k, i) for k in range(50) for i in range(495) if (line[i : i + 6] == patterns[k]).all()}
    assert set(zip(which.tolist(), where.tolist())) == expected


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontaminate, "hash_spans", lambda raw, a, b, seed=0: ((b - a) + (seed > 0) * 10 * np.frombuffer(raw, np.uint8)[a]).astype(np.uint64))
    windows = decontaminate.Windows([("i", [[b"aa", b"bbb"]])], 10)
    n, spans, matches = decontaminate.search_shard(["aa bbb", "ab bbb", "aa bbb ab bbb aa bbb"], windows)
    assert [len(s) for s in spans] == [1, 0, 2] and [len(m) for m in matches] == [1, 0, 1]
