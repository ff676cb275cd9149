"""Packing, token files and mixing."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from evoframe.llm import mixing, packing, tokenfile
from evoframe.llm._encode import tokenizer_path


def expected_ids(name: str, texts, end: int) -> list[list[int]]:
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


@pytest.mark.parametrize("table", ["awkward", "small"])
def test_packing(spark, request, table):
    docs = request.getfixturevalue(table)
    docs = spark.read.parquet(f"{docs}/documents.parquet") if isinstance(docs, str) else docs
    rows = docs.select("doc_id", "text").collect()
    whole = defaultdict(list)
    for r, ids in zip(rows, expected_ids(packing.TOKENIZER, [r.text for r in rows], packing.END_ID)):
        whole[r.doc_id].append(ids)
    found = packing.packing_digest(docs).collect()
    want, got = Counter(), Counter()
    for doc_id, versions in whole.items():
        for ids in versions:
            for k in range(0, len(ids), packing.WINDOW):
                part = np.array(ids[k : k + packing.WINDOW], "<u4").tobytes()
                want[doc_id, k, len(part) // 4, zlib.crc32(part), len(ids)] += 1
    got.update((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found)
    assert got == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    total = sum(r.length for r in found)
    assert len(sequences) <= -(-total // packing.WINDOW) * 1.1 + 1


def brute_best_fit(lengths: list[int], size: int) -> int:
    open_windows: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [c for c in open_windows if c >= n]
        if fits:
            open_windows.remove(min(fits))
            open_windows.append(min(fits) - n)
        else:
            open_windows.append(size - n)
    return len(open_windows)


def test_best_fit_decreasing_needs_as_many_windows_as_piece_by_piece():
    draw = random.Random(3)
    for size in (7, 32, 100):
        lengths = [draw.randint(1, size) for _ in range(300)]
        placed = packing.best_fit_decreasing(Counter(lengths), size)
        windows = {p.first + k // p.each for p in placed for k in range(p.count)}
        assert len(windows) == brute_best_fit(lengths, size)


def test_packing_nothing(nothing):
    assert packing.packing_digest(nothing).count() == 0


@pytest.mark.parametrize("table", ["awkward", "small"])
def test_token_files(spark, request, table):
    docs = request.getfixturevalue(table)
    docs = spark.read.parquet(f"{docs}/documents.parquet") if isinstance(docs, str) else docs
    rows = docs.select("doc_id", "text").collect()
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
    start, want = 0, []
    for r, ids in zip(order, expected_ids(tokenfile.TOKENIZER, [r.text for r in order], tokenfile.END_ID)):
        want.append((r.doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    found = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in tokenfile.token_files(docs).collect()]
    assert sorted(found, key=lambda r: r[1]) == want


def test_token_files_of_nothing(nothing):
    assert tokenfile.token_files(nothing).count() == 0


def test_ranks_round_trip():
    draw = np.random.default_rng(4)
    for top in (1, 255, 256, 70_000, 1 << 24, (1 << 32) - 1):
        ranks = draw.integers(0, top, 1003, endpoint=True).astype(np.uint32)
        control, data = tokenfile.encode_ranks(ranks)
        assert (tokenfile.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(ranks)) == ranks).all()


def test_every_source_has_its_share_to_less_than_one_block():
    draw = random.Random(5)
    hot = ([1000.0] + [1.0] * 60, [4000] + [3] * 60)
    for case in [hot] + [None] * 15:
        n = draw.randint(1, 30)
        aims, blocks = case or ([draw.random() + 0.01 for _ in range(n)], [draw.randint(0, 300) for _ in range(n)])
        weights = mixing.whole_weights(range(len(aims)), {}, dict(enumerate(aims)))
        slots = mixing.earliest_deadline_first(weights, blocks)
        assert [len(own) for own in slots] == blocks
        assert len({s for own in slots for s in own}) == sum(blocks)
        for a, own in zip(weights, slots):  # at each of its slots, before and after; in between only the share grows
            for had, t in enumerate(own):
                assert abs(had * sum(weights) - t * a) < sum(weights)
                assert abs((had + 1) * sum(weights) - (t + 1) * a) < sum(weights)


def test_the_schedule_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FINE", 64)
    docs = spark.range(4000).selectExpr("id AS doc_id", "if(id % 50 = 0, 'rare', 'often') AS source")
    found = mixing.mixing_digest(docs, block=2).collect()
    assert len({(r.slot, r.offset) for r in found}) == 4000 and max(r.offset for r in found) == 1
    assert all(r.release <= r.slot < r.deadline for r in found) and max(r.slot for r in found) > 10 * 64


def test_extreme_weights_and_very_many_sources(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "array('a', 'b', 'c')[int(id % 3)] AS source")
    found = mixing.mixing_digest(docs, weights={"a": 1e6, "b": 1e6, "c": 1.0}).collect()
    assert len({(r.slot, r.offset) for r in found}) == 900 and all(r.release <= r.slot < r.deadline for r in found)
    for aims, blocks in (([1e6, 1e6, 1.0], [10**7] * 3), ([1.0] * (2**20 + 1), [1] * (2**20 + 1))):
        weights = mixing.whole_weights(range(len(aims)), {}, dict(enumerate(aims)))
        slots = mixing.earliest_deadline_first(weights, blocks)
        assert [len(own) for own in slots] == [min(a, b) for a, b in zip(weights, blocks)]
    sizes = {i: 10**9 for i in range(40)} | {40: 1}
    weights = mixing.whole_weights(range(41), sizes, None)
    assert min(weights) >= 1 and sum(weights) <= mixing.FINE + 41


def test_mixing(spark, awkward, nothing):
    found = mixing.mixing_digest(awkward, block=2).collect()
    assert len(found) == awkward.count()
    places = Counter((r.slot, r.offset) for r in found)
    assert max(places.values()) == 1
    assert all(r.release <= r.slot < r.deadline for r in found)
    assert mixing.mixing_digest(nothing).count() == 0
    ordered = mixing.in_mixed_order(awkward, block=2)
    assert ordered.columns == awkward.columns
    assert sorted(map(str, ordered.collect())) == sorted(map(str, awkward.collect()))


def test_mixing_by_given_weights(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source")
    found = mixing.mixing_digest(docs, weights={"a": 3.0, "b": 1.0}, block=5).orderBy("slot", "offset").collect()
    firsts = Counter(r.source for r in found[:40])
    assert firsts == {"a": 30, "b": 10}
    with pytest.raises(ValueError):
        mixing.mixing_digest(docs, weights={"a": 0.0, "b": 1.0})
