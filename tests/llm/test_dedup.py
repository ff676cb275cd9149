"""Near-duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from evoframe.llm import minhash, suffixdedup


def brute_near(rows: list[tuple]) -> dict:
    """Component of each doc_id by all pairs of shingle sets."""
    sets = {}
    for doc_id, text in rows:
        if doc_id is None:
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


@pytest.mark.parametrize("table", ["awkward", "small"])
def test_near_duplicates(spark, request, table):
    docs = request.getfixturevalue(table)
    docs = spark.read.parquet(f"{docs}/documents.parquet") if isinstance(docs, str) else docs
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    expected = brute_near(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == expected[r.doc_id]


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A large group whose members link only in part, beside some that share a passage alone."""
    draw = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(90):
        words = list(base)
        for at in draw.choice(120, draw.integers(0, 7), replace=False):
            words[at] = f"x{d}_{at}"
        rows.append((d, " ".join(words + [f"y{d}_{k}" for k in range(int(draw.integers(0, 40)))])))
    expected = brute_near(rows)
    assert 5 < len({c for _, c, _ in expected.values()}) < 80
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rows_, cols in ((128, 256), (3, 5)):
        monkeypatch.setattr(minhash, "ASIDE_BLOCK", rows_)
        monkeypatch.setattr(minhash, "BLOCK", cols)
        found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
        assert found == expected


def test_keep_one(spark, awkward):
    kept = minhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 not in ids and ids.count(4) == 2 and ids.count(None) == 2


def test_one_id_with_two_texts(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(100)) for w in "ab")
    rows = [(1, one), (1, two), (2, two + " x"), (3, one + " y"), (5, "c d e"), (5, two), (4, "c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [
        (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 1, False), (5, 4, False)]
    assert sorted(r.doc_id for r in minhash.keep_one(docs).collect()) == [1, 1, 4]
    clash = spark.createDataFrame([(7, one), (7, two), (8, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in minhash.keep_one(clash).collect()) == sorted([(7, one), (7, two)])


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    found = {r.id: r.component for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


def brute_repeats(rows: list[tuple], width: int) -> list[tuple]:
    seen: dict[bytes, tuple] = {}
    raws = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    for doc, raw in raws:
        for p in range(len(raw) - width + 1):
            w = raw[p : p + width]
            if w not in seen or (doc, p) < seen[w]:
                seen[w] = (doc, p)
    out = []
    for (doc_id, _), (doc, raw) in zip(rows, raws):
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - width + 1):
            if seen[raw[p : p + width]] < (doc, p):
                gone[p : p + width] = True
        gone = gone[: len(raw)]
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def key(row) -> tuple:
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("most_spans", [1, 256])
@pytest.mark.parametrize("table", ["awkward", "small"])
def test_repeated_passages(spark, request, table, most_spans):
    docs = request.getfixturevalue(table)
    docs = spark.read.parquet(f"{docs}/documents.parquet") if isinstance(docs, str) else docs
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = [tuple(r) for r in suffixdedup.repeats_digest(docs, most_spans=most_spans).collect()]
    assert sorted(found, key=key) == sorted(brute_repeats(rows, 100), key=key)


def test_repeated_passages_of_other_widths(spark):
    draw = np.random.default_rng(8)
    passage = "".join(map(chr, draw.integers(97, 123, 900)))
    rows = [(d, "".join(map(chr, draw.integers(97, 123, 200))) + passage[d * 10 :] + "x" * (d * 30)) for d in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (64, 400):
        found = [tuple(r) for r in suffixdedup.repeats_digest(docs, width=width).collect()]
        assert sorted(found) == sorted(brute_repeats(rows, width))


def test_no_documents(nothing):
    assert suffixdedup.repeats_digest(nothing).count() == 0
    assert minhash.near_duplicates(nothing).count() == 0


def test_long_text_is_read_in_blocks(monkeypatch):
    draw = np.random.default_rng(1)
    raw = draw.integers(97, 100, 5000).astype(np.uint8)
    whole = suffixdedup.spans_of(raw)
    monkeypatch.setattr(suffixdedup, "BLOCK", 512)
    parts = suffixdedup.spans_of(raw)
    for anchor, _, start, n in (whole, parts):
        assert int(n.sum()) == len(raw) - 99 and start[0] == 0 and (start[1:] == start[:-1] + n[:-1]).all()
    window = {int(s) + k: int(a) for a, _, s, c in zip(*whole) for k in range(c)}
    assert window == {int(s) + k: int(a) for a, _, s, c in zip(*parts) for k in range(c)}


def test_columnwise_transform_orders_all_suffixes():
    draw = np.random.default_rng(2)
    strings = [bytes(draw.integers(97, 100, draw.integers(0, 30)).astype(np.uint8)) for _ in range(40)]
    table = suffixdedup.ColumnwiseTransform(strings)
    suffixes = sorted(((s[k:] + b"\x00", i, k) for i, s in enumerate(strings) for k in range(len(s) + 1)), key=lambda x: (x[0], x[1]))
    assert [(int(a), int(b)) for a, b in zip(table.string, table.offset)] == [(i, k) for _, i, k in suffixes]
    for j, ((a, *_), (b, i, k)) in enumerate(zip(suffixes, suffixes[1:]), 1):
        n = 0
        while a[n] == b[n] != 0:
            n += 1
        assert table.common[j] == n
        assert table.bwt[j] == (strings[i][k - 1] + 1 if k else 0)
