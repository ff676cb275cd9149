"""Phrases against brute force."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from evoframe.llm import collocations


def brute(rows: list[tuple], least: int, top: int) -> list[tuple]:
    counts, totals, out = {}, Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    for lang, f in counts.items():
        frequent = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        held = {}
        for g, a in frequent.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    held[g[i : i + n]] = max(held.get(g[i : i + n], 0), a)
        found = []
        for g, a in frequent.items():
            if held.get(g, -1) < a:
                score, k = min((1000 * a * totals[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                found.append((score, a, " ".join(g), f[g[:k]], f[g[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, l, r, totals[lang], s) for i, (s, a, p, l, r) in enumerate(found[:top], 1)]
    return sorted(out)


def found_in(docs, **options) -> list[tuple]:
    return sorted(map(tuple, collocations.collocations(docs, **options).collect()))


@pytest.mark.parametrize("least, top", [(2, 2000), (5, 3)])
def test_awkward_texts(spark, awkward, nothing, least, top):
    rows = [(r.text, r.lang) for r in awkward.collect()]
    assert found_in(awkward, least=least, top=top) == brute(rows, least, top)
    assert found_in(nothing) == [] and found_in(awkward, least=10**6) == []


@pytest.mark.parametrize("slices, shard", [(False, 500_000), (True, 40)])
def test_words_of_few_kinds(spark, monkeypatch, slices, shard):
    if slices:
        monkeypatch.setattr(collocations, "MOST_CELLS", 1 << 19)
    monkeypatch.setattr(collocations, "SHARD", shard)
    draw = np.random.default_rng(6)
    signs = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " - "]
    rows = [("".join("ABcdé漢"[draw.integers(0, 6)] * draw.integers(1, 3) + signs[draw.integers(0, 9)] for _ in range(draw.integers(0, 300))), ["en", "de", None][d % 3])
            for d in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert found_in(docs, least=7) == brute(rows, 7, 2000)


def test_ties_and_numbers_beyond_64_bits(spark):
    counts = [("x y", 2, 10**14), ("x", 1, 10**15), ("y", 1, 10**15), ("y x", 2, 10**14)]
    made = spark.createDataFrame([("en", *r) for r in counts], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 4 * 10**16)], "lang string, n long")
    whole = collocations.phrase_counts
    try:
        collocations.phrase_counts = lambda docs, least: (made, totals)
        assert [tuple(r)[1:] for r in collocations.collocations(None).orderBy("rank").collect()] == [
            (k, p, 10**14, 10**15, 10**15, 4 * 10**16, 4000) for k, p in ((1, "x y"), (2, "y x"))]
    finally:
        collocations.phrase_counts = whole


def test_codes_are_distinct_and_no_delimiters():
    codes = [collocations._code(n) for n in (*range(3000), 32**3 - 1, 32**3, 32**4 - 1, 32**4, 32**5)]
    assert len(set(codes)) == len(codes) and not {" ", "\n", "\x01"} & set("".join(codes))
