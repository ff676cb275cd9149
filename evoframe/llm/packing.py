"""Packing tokenized documents into fixed windows by best-fit decreasing.

Overlong documents are first cut into full windows. The rest is placed by decreasing
length, each piece into the open window with the tightest sufficient space. Pieces of
one length are interchangeable, so best fit is decided on the histogram of lengths (at
most ``window`` rows, whatever the corpus), with a segment tree over remaining
capacities and runs of windows that stand at the same capacity. The decisions are
ranges of ranks within a length; each piece finds its own from its rank.

Defined results: a null or empty text is the single end id; a null ``doc_id`` is kept as
null; equal rows are packed each on its own; no rows give no rows; other columns are
ignored. ``mixed_packing_digest`` ranks the pieces of a length by their documents' place in
the mixture, and numbers sequences by the earliest place they hold.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evoframe.llm import mixing
from evoframe.llm._common import arrow_rows, documents_of, materialize, per_batch, per_slice, shuffle_partitions, text_of
from evoframe.llm._encode import encoder, tokenizer_path

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
SUMS = "doc_id long, source string, doc_tokens long, sums array<long>"


def tokenize_pieces(
    docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end_id: int = END_ID, word_ends: bool = True
) -> DataFrame:
    """Each document's ids (little-endian unsigned 32 bit) with the end id, cut into pieces of at most ``window``."""
    path = tokenizer_path(tokenizer)
    end = np.array([end_id], np.uint32)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, rows = encoder(path, word_ends), []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").to_pylist())):
            ids = np.append(ids, end).astype("<u4")
            n = len(ids)
            rows += [(doc_id, k, min(window, n - k), ids[k : k + window].tobytes(), n) for k in range(0, n, window)]
        return arrow_rows(rows, {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64()})

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(per_slice(cut), PIECES)


def tokenize_sums(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end_id: int = END_ID, word_ends: bool = True) -> DataFrame:
    """One row for each document: its source, its number of ids and the checksums of its pieces in turn."""
    path = tokenizer_path(tokenizer)
    end = np.array([end_id], np.uint32)

    def add_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, rows = encoder(path, word_ends), []
        for doc_id, source, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source")), coder.encode(batch.column("text").to_pylist())):
            ids = np.append(ids, end).astype("<u4")
            rows.append((doc_id, source, len(ids), [zlib.crc32(ids[k : k + window]) for k in range(0, len(ids), window)]))
        return arrow_rows(rows, {"doc_id": pa.int64(), "source": pa.string(), "doc_tokens": pa.int64(), "sums": pa.list_(pa.int64())})

    return docs.select("doc_id", F.col("source").cast("string").alias("source"), text_of().alias("text")).mapInArrow(per_slice(add_up), SUMS)


class CapacityTree:
    """A segment tree over capacities 0..size; finds the smallest non-empty one that suffices."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.full = [False] * (2 * self.width)

    def put(self, capacity: int, some: bool) -> None:
        node = capacity + self.width
        self.full[node] = some
        while node > 1:
            node //= 2
            self.full[node] = self.full[2 * node] or self.full[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        node = least + self.width
        if self.full[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.full[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.full[2 * node] else 2 * node + 1
                return node - self.width
            node //= 2
        return None


@dataclass(frozen=True)
class Placement:
    """``count`` pieces of one length, from rank ``rank`` on: ``each`` to a window, from window ``first`` on."""

    length: int
    rank: int
    count: int
    each: int
    first: int
    offset: int


def best_fit_decreasing(histogram: dict[int, int], size: int) -> list[Placement]:
    """Placements for ``{length: pieces}``; their number depends on ``size`` alone, not on the counts."""
    tree, runs, placed, windows = CapacityTree(size), defaultdict(list), [], 0

    def put(capacity: int, first: int, count: int) -> None:
        if capacity and count:
            runs[capacity].append((first, count))
            tree.put(capacity, True)

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, each = size, size // length
                first, count = windows, -(-left // each)
                windows += count
            else:
                each = capacity // length
                first, count = runs[capacity].pop()
                if not runs[capacity]:
                    tree.put(capacity, False)
            used = min(count, -(-left // each))
            put(capacity, first + used, count - used)
            now = min(left, used * each)
            placed.append(Placement(length, rank, now, each, first, size - capacity))
            whole, rest = divmod(now, each)
            put(capacity - each * length, first, whole)
            if rest:
                put(capacity - rest * length, first + whole, 1)
            rank, left = rank + now, left - now
    return placed


def cuts_of(rows: DataFrame, column: str, parts: int) -> list:
    """Values that cut the rows into about equal ranges of a column, at most ``parts - 1``."""
    found = rows.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)])).first()[0] if parts > 1 else None
    return sorted(set(found or ()))


def range_of(column: Column, cuts: list) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < column)).cast("long") if cuts else F.lit(0).cast("long")


def pack_pieces(pieces: DataFrame, window: int = WINDOW, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id``, ``start`` and ``length``.

    ``pieces`` is read three times, so it should be a written table. Ranks within a
    length come from ranks within (length, bucket) and the buckets' counts: a length
    that a third of all pieces share is spread over all buckets.

    With ``order``, columns that place a document before others, the first a number, the
    buckets are ranges of that number, so ranks within a length follow ``order`` over the
    whole table whatever the cuts; sequences are then numbered by the first piece they hold.
    """
    spark = pieces.sparkSession
    buckets = shuffle_partitions(spark)
    cuts = cuts_of(pieces, order[0], buckets) if order else []
    pieces = pieces.withColumn("bucket", range_of(F.col(order[0]), cuts) if order else F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = materialize(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `window` rows
    plan = sorted(best_fit_decreasing({r.length: r.n for r in totals}, window), key=lambda p: (p.length, p.rank))
    base = 1 << 40  # more pieces of one length than any corpus has
    keys = np.array([p.length * base + p.rank for p in plan], np.int64)
    rank, each, first, offset = (np.array([getattr(p, k) for p in plan], np.int64) for k in ("rank", "each", "first", "offset"))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy(*order, "doc_id", "start")
    ranked = (
        pieces.withColumn("own_rank", F.row_number().over(own) - 1)
        .join(bases, ["length", "bucket"])
        .withColumn("piece_rank", F.col("own_rank") + F.col("before"))
        .drop("bucket", "own_rank", "before")
    )

    def place(batch: pd.DataFrame) -> pd.DataFrame:
        length, at = batch.length.to_numpy(), batch.piece_rank.to_numpy()
        run = np.searchsorted(keys, length * base + at, side="right") - 1
        behind = at - rank[run]
        out = batch.drop(columns="piece_rank")
        out["sequence_id"] = first[run] + behind // each[run]
        out["offset"] = offset[run] + behind % each[run] * length
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("piece_rank").schema.fields)
    placed = ranked.mapInPandas(per_batch(place), f"{schema}, sequence_id long, offset long")
    return numbered_by(materialize(placed), order, cuts) if order else placed


def numbered_by(placed: DataFrame, order: tuple[str, ...], cuts: list) -> DataFrame:
    """``placed`` with sequences numbered from 0 by the least ``order`` and ``start`` among their pieces."""
    heads = placed.groupBy("sequence_id").agg(F.min(F.struct(*order, "start")).alias("head"))
    heads = materialize(heads.withColumn("bucket", range_of(F.col(f"head.{order[0]}"), cuts)))
    counts = heads.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each range
    before, bases = 0, []
    for r in sorted(counts, key=lambda r: r.bucket):
        bases.append((r.bucket, before))
        before += r.n
    bases = placed.sparkSession.createDataFrame(bases, "bucket long, before long")
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("head", "sequence_id")) - 1
    numbers = heads.withColumn("nth", nth).join(F.broadcast(bases), "bucket")
    numbers = numbers.select("sequence_id", (F.col("before") + F.col("nth")).cast("long").alias("number"))
    named = placed.join(numbers, "sequence_id")
    return named.select(*[(F.col("number") if c == "sequence_id" else F.col(f"`{c}`")).alias(c) for c in placed.columns])


def pack_documents(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """The packed corpus: every piece with its ids, window and place there."""
    return pack_pieces(materialize(tokenize_pieces(documents_of(docs, "doc_id", "text"), window, tokenizer, end_id)), window)


def packing_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """As ``pack_documents``, with a checksum of the ids in their place."""
    pieces = tokenize_pieces(documents_of(docs, "doc_id", "text"), window)
    digests = materialize(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    packed = pack_pieces(digests, window)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def mixed_packing_digest(docs: DataFrame, window: int = WINDOW, **mixture) -> DataFrame:
    """As ``packing_digest``, with the mixture of ``mixing.mixed`` as the order of packing.

    Places are worked out on one small row for each document, so no text is shuffled.
    """
    sums = materialize(tokenize_sums(documents_of(docs, "doc_id", "source", "text"), window))
    order = ("mix_slot", "mix_offset")
    pieces = mixing.mixed(sums, **mixture).select("doc_id", "doc_tokens", *order, F.posexplode("sums").alias("nth", "ids_crc32"))
    pieces = pieces.withColumn("start", F.col("nth").cast("long") * window)
    pieces = pieces.withColumn("length", F.least(F.lit(window).cast("long"), F.col("doc_tokens") - F.col("start"))).drop("nth")
    packed = pack_pieces(materialize(pieces), window, order)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
