"""The mixture as it takes effect in packing and in the pipeline."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from evoframe.llm import mixing, packing
from evoframe.llm._encode import tokenizer_path


def brute_packing(docs: list[tuple], size: int) -> Counter:
    """Best-fit decreasing of pieces ranked by place; ``docs``: place, doc_id, text. Sequences by their first piece."""
    tokenizer, lengths = Tokenizer.from_file(tokenizer_path(packing.TOKENIZER)), defaultdict(list)
    for place, doc_id, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            lengths[len(part)].append(((*place, k), (doc_id, k, len(part), zlib.crc32(part.tobytes()), len(ids))))
    held = defaultdict(list)
    for p in packing.best_fit_decreasing({n: len(x) for n, x in lengths.items()}, size):
        for k, (place, piece) in enumerate(sorted(lengths[p.length], key=lambda x: x[0])[p.rank : p.rank + p.count]):
            held[p.first + k // p.each].append((place, piece, p.offset + k % p.each * p.length))
    turn = sorted(held.values(), key=lambda x: min(place for place, _, _ in x))
    return Counter((*piece, number, at) for number, x in enumerate(turn) for _, piece, at in x)


@pytest.mark.parametrize("weights", [None, {"a": 8.0, "b": 1.0}, {"a": 1.0, "b": 8.0}])
def test_packing_follows_the_mixture(spark, weights):
    rows = [(i, "ab"[i % 3 > 0], f"word{i % 7} " * (1 + i % 40 * (i % 5))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    places = mixing.mixed(docs, weights=weights).select("mix_slot", "mix_offset", "doc_id", "text").collect()
    want = brute_packing([((r.mix_slot, r.mix_offset), r.doc_id, r.text) for r in places], 64)
    assert Counter(tuple(r) for r in packing.mixed_packing_digest(docs, 64, weights=weights).collect()) == want


def test_packing_by_mixture_of_awkward_and_no_rows(awkward, nothing):
    def pieces(found):
        return Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found.collect())

    assert pieces(packing.mixed_packing_digest(awkward)) == pieces(packing.packing_digest(awkward))
    assert packing.mixed_packing_digest(nothing).count() == 0


def test_weights_change_the_sequences_of_the_pipeline(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    sources = sorted(r.source for r in docs.select("source").distinct().collect())
    found = {}
    for first in (sources[0], sources[-1]):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", {s: 50.0 if s == first else 1.0 for s in sources})
        after = docs
        for name, stage in corpus_pipeline.STAGES[3:]:
            after = stage(spark, after, small)
        found[first] = after.join(docs.select("doc_id", "source"), "doc_id").collect()
    one, two = ({(r.doc_id, r.start): r.sequence_id for r in x} for x in found.values())
    assert one.keys() == two.keys() and one != two
    for first, rows in found.items():
        of_first = [r.sequence_id for r in rows if r.source == first]
        assert np.mean(of_first) < np.mean([r.sequence_id for r in rows if r.source != first])


def ids_in_order(docs, **options):
    return [(r.source, r.doc_id) for r in sorted(mixing.mixing_digest(docs, **options).collect(), key=lambda r: (r.slot, r.offset))]


def times_shuffled(rows, capsys) -> int:
    """Exchanges of the plan through which whole rows go."""
    capsys.readouterr()
    rows.explain("formatted")
    taken = re.findall(r"\) Exchange *\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert taken
    return sum("row#" in columns or "text#" in columns for columns in taken)


def test_whole_rows_are_shuffled_once_for_the_mixture(spark, small, capsys):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ordered = mixing.in_mixed_order(docs)
    assert times_shuffled(ordered, capsys) == 1
    rows = ordered.collect()
    assert [(r.source, r.doc_id) for r in rows] == ids_in_order(docs)
    assert sorted(map(str, rows)) == sorted(map(str, docs.collect()))


@pytest.fixture
def as_planned(spark):
    """Spark sends no table and merges no partitions by its own choice."""
    options = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in options}
    for key, value in options.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("most, stretches", [(None, ()), (-1, ()), (-1, ("MOST_STRETCHES",))])
def test_order_of_rows_that_share_their_id(spark, monkeypatch, as_planned, most, stretches):
    """Also where ranges of slots begin in the midst of them, and where no table is small enough to be sent."""
    for limit in ("MOST_BROADCAST", "MOST_GROUPS", *stretches) if most else ():
        monkeypatch.setattr(mixing, limit, most)
    rows = [(None if i % 11 == 0 else i * i % 97 if i % 2 else 1000 + i, ["a", "b", None, "b", "b"][i % 5], f"text {i % 400}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    keys = docs.select("doc_id", "source")
    assert mixing.stretches_of(mixing.Schedule(keys, block=2), keys, 4).where("mix_loose").count()
    found = mixing.in_mixed_order(docs, block=2).collect()
    assert [(r.source, r.doc_id) for r in found] == ids_in_order(docs, block=2)
    assert Counter(map(tuple, found)) == Counter(rows)
