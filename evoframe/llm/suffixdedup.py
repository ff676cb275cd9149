"""Repeated passages by a multi-document suffix order that is built column by column.

A byte goes if a string of ``width`` bytes that covers it also starts earlier, in a
document of smaller ``doc_id`` or before it in the same one.

1. Each window of ``width`` bytes has an anchor, the ``gram`` bytes in it of least hash.
   Equal windows have equal anchors, so windows meet by their anchor. Neighbouring
   windows of one anchor make up a span.
2. Spans equal to an earlier one are removed whole. A task does so for its own documents
   first, so a passage that very many share is sent once by each task; then tasks that
   each hold a range of anchors do it for the corpus.
3. Anchors that still have several spans give collections of short strings. For these the
   Burrows-Wheeler transform and the common prefixes are built column-wise: each round
   inserts one symbol of every string, from its end on. Runs of common prefixes of
   ``width`` or more are equal windows, and all but the first of them are removed.
4. An anchor with more than ``most_spans`` of them would be too large for one task; its
   windows are told apart one by one instead, first in each task and then by ranges of
   their hashes.

A collection is bounded, so the columns that the published method writes to sequential
files stay in the task's memory here; no local file is written.

Anchors are found by 64-bit hashes, spans told apart by two of them and their length.

Defined results: null and empty texts have no bytes and the digest of nothing; rows with
equal ``doc_id`` count as one document of which each row is judged by its own text, so
equal rows give equal results; a null ``doc_id`` comes before all others; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.llm._common import documents_of, materialize, per_batch, text_of
from evoframe.llm._words import mixed

WIDTH = 100
GRAM = 32
MOST_SPANS = 256
BATCH = 500_000
BYTES_PER_BUCKET = 16 << 20
STRINGS_PER_GROUP = 1000
HOT_SPANS_PER_BUCKET = 2000
BLOCK = 1 << 19

NO_ID = -(1 << 63)  # stands for a null doc_id
_GONE, _SPAN, _HOT = 0, 1, 2
_FIELDS = (("anchor", "<u8"), ("span", "<u8"), ("doc", "<i8"), ("check", "<i4"), ("start", "<i4"), ("n", "<u2"))

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240607).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of the multiplier and of its inverse, as many as a block needs."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
            for name, factor in (("up", _MULTIPLIER), ("down", inverse)):
                all_factors = np.full(size, factor, np.uint64)
                all_factors[0] = 1
                setattr(cls, name, np.multiply.accumulate(all_factors))
        return cls.up, cls.down


def spans_of(raw: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``anchor, span, start, n`` for the spans of one text: n windows from ``start`` on share an anchor."""
    parts = []
    for at in range(0, max(0, len(raw) - width + 1), BLOCK):
        part = raw[at : at + BLOCK + width - 1]
        letters = _BYTES[part]
        grams, reach = letters, 1
        up, down = _Powers.reach(len(part) + 1)
        while reach < gram:  # gram is a power of two
            grams = grams[: len(grams) - reach] * up[reach] + grams[reach:]
            reach *= 2
        grams = mixed(grams)
        places = np.arange(len(grams), dtype=np.uint64)
        low = (grams & np.uint64(0xFFFFFFFFFFF00000)) | places
        inside, reach = width - gram + 1, 1
        while 2 * reach <= inside:
            low = np.minimum(low[: len(low) - reach], low[reach:])
            reach *= 2
        if reach < inside:
            low = np.minimum(low[: len(low) - (inside - reach)], low[inside - reach :])
        own = (low & np.uint64(0xFFFFF)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        n = np.diff(np.append(cuts, len(own)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * down[: len(part)])])
        ends = cuts + n + width - 1
        span = mixed((sums[ends] - sums[cuts]) * up[cuts] + n.astype(np.uint64))
        parts.append((grams[own[cuts]], span, cuts + at, n))
    if not parts:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(column) for column in zip(*parts))


def _first_of_each(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table sorted by (anchor, span, doc, start), and whether a row is its span's first."""
    table = table[np.lexsort((table["start"], table["doc"], table["n"], table["span"], table["anchor"]))]
    same = np.zeros(len(table), bool)
    if len(table):
        same[1:] = (table["anchor"][1:] == table["anchor"][:-1]) & (table["span"][1:] == table["span"][:-1]) & (table["n"][1:] == table["n"][:-1])
    # rows of one doc_id and start are the same place, so a repeated row is as early as its twin
    first = ~same
    if same.any():
        group = np.cumsum(first) - 1
        heads = np.flatnonzero(first)[group]
        first |= (table["doc"] == table["doc"][heads]) & (table["start"] == table["start"][heads])
    return table, first


def _packed(table: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(table[name]).tobytes() for name, _ in _FIELDS)


def _unpacked(payload: bytes, n: int) -> np.ndarray:
    table, at = np.empty(n, list(_FIELDS)), 0
    for name, kind in _FIELDS:
        table[name] = np.frombuffer(payload, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return table


def _check() -> Column:
    """Tells rows of one ``doc_id`` with different texts apart."""
    return F.hash("text")


def _anchored(rows: DataFrame, buckets: int, width: int, gram: int) -> DataFrame:
    """``bucket, kind, n, payload``: the first of each span of a task's documents, by ranges of anchors; and what went."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n_held, turn = [], 0, 0

        def settle() -> pd.DataFrame:
            nonlocal turn
            table, first = _first_of_each(np.concatenate(held))
            gone, sent = table[~first], table[first]
            bucket = (sent["anchor"] >> np.uint64(32)).astype(np.int64) % buckets
            sent = sent[np.argsort(bucket, kind="stable")]
            edges = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            out = [(int(b), _SPAN, int(edges[b + 1] - edges[b]), _packed(sent[edges[b] : edges[b + 1]])) for b in some]
            for k in range(0, len(gone), 20_000):
                turn += 7919
                out.append((turn % buckets, _GONE, len(gone[k : k + 20_000]), _packed(gone[k : k + 20_000])))
            held.clear()
            return pd.DataFrame(out, columns=["bucket", "kind", "n", "payload"])

        for batch in batches:
            for doc, check, text in zip(batch.doc, batch.check, batch.text):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                anchor, span, start, n = spans_of(raw, width, gram)
                own = np.empty(len(anchor), list(_FIELDS))
                for name, value in zip((f[0] for f in _FIELDS), (anchor, span, doc, check, start, n)):
                    own[name] = value
                held.append(own)
                n_held += len(own)
                if n_held >= BATCH:
                    yield settle()
                    n_held = 0
        if n_held:
            yield settle()

    return rows.mapInPandas(run, "bucket int, kind int, n long, payload binary")


_PLACES = "kind int, doc long, check int, start int, n int, anchor long"


def _matched(anchored: DataFrame, most_spans: int) -> DataFrame:
    """For each range of anchors: spans that go, and firsts of anchors that have several spans."""

    def match(batch: pd.DataFrame) -> pd.DataFrame:
        tables = [(kind, _unpacked(p, n)) for kind, n, p in zip(batch.kind, batch.n, batch.payload)]
        empty = np.empty(0, list(_FIELDS))
        gone = [t for kind, t in tables if kind == _GONE]
        table = np.concatenate([empty, *[t for kind, t in tables if kind == _SPAN]])
        table, first = _first_of_each(table)
        gone.append(table[~first])
        firsts = table[first]
        head = np.concatenate([[True], firsts["anchor"][1:] != firsts["anchor"][:-1]]) if len(firsts) else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        counts = np.bincount(group) if len(firsts) else np.zeros(0, np.int64)
        several = firsts[counts[group] > 1] if len(firsts) else firsts
        hot = (counts[group] > most_spans)[counts[group] > 1] if len(firsts) else np.zeros(0, bool)
        out = [(np.full(len(t), _GONE), t) for t in gone] + [(np.where(hot, _HOT, _SPAN), several)]
        whole = np.concatenate([t for _, t in out])
        return pd.DataFrame(
            {"kind": np.concatenate([k for k, _ in out]).astype(np.int32), "doc": whole["doc"].astype(np.int64), "check": whole["check"].astype(np.int32),
             "start": whole["start"].astype(np.int32), "n": whole["n"].astype(np.int32), "anchor": whole["anchor"].astype(np.uint64).view(np.int64)}
        )

    return anchored.groupBy("bucket").applyInPandas(match, _PLACES)


def _runs(table: np.ndarray, kind: int = _GONE) -> pd.DataFrame:
    """Single windows of a table put together to runs of neighbours."""
    table = np.sort(table[["doc", "check", "start"]], order=["doc", "check", "start"])
    doc, check, start = table["doc"].astype(np.int64), table["check"].astype(np.int32), table["start"].astype(np.int64)
    cut = np.ones(len(table), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (check[1:] != check[:-1]) | (start[1:] > start[:-1] + 1)
    cuts = np.flatnonzero(cut)
    ends = np.append(cuts[1:], len(table))[: len(cuts)] - 1
    return pd.DataFrame({"kind": kind, "doc": doc[cuts], "check": check[cuts], "start": start[cuts], "n": start[ends] - start[cuts] + 1})


def _strings(places: DataFrame, rows: DataFrame, width: int, hot_buckets: int) -> DataFrame:
    """The bytes of spans; for hot anchors the first of each window in a task, by ranges of hashes, and what went."""
    import xxhash

    by_doc = places.where(F.col("kind") != _GONE).groupBy("doc", "check").agg(F.collect_list(F.struct("kind", "start", "n", "anchor")).alias("found"))
    wanted = rows.join(by_doc, ["doc", "check"]).dropDuplicates(["doc", "check"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["kind", "anchor", "doc", "check", "start", "n", "string"]
        out, hot = [], []

        def settle() -> pd.DataFrame:
            table, first = _first_of_each(np.array(hot, list(_FIELDS)))
            gone, sent = _runs(table[~first]), table[first]
            bucket = (sent["anchor"] >> np.uint64(32)).astype(np.int64) % hot_buckets
            packs = [(_HOT, int(b), 0, 0, 0, int((bucket == b).sum()), _packed(sent[bucket == b])) for b in np.unique(bucket)]
            hot.clear()
            return pd.concat([pd.DataFrame(packs, columns=names), gone.assign(anchor=0, string=None)[names]])

        for batch in batches:
            for doc, check, text, found in zip(batch.doc, batch.check, batch.text, batch.found):
                raw = text.encode("utf-8", "surrogatepass")
                for f in found:
                    start, n = f["start"], f["n"]
                    if f["kind"] == _SPAN:
                        out.append((_SPAN, f["anchor"], doc, check, start, n, raw[start : start + n + width - 1]))
                        continue
                    for k in range(start, start + n):
                        digest = xxhash.xxh3_128_intdigest(raw[k : k + width])
                        hot.append((digest >> 64, digest & 0xFFFFFFFFFFFFFFFF, doc, check, k, 1))
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
                if len(hot) >= BATCH:
                    yield settle()
        if out:
            yield pd.DataFrame(out, columns=names)
        if hot:
            yield settle()

    schema = "kind int, anchor long, doc long, check int, start int, n int, string binary"
    return wanted.select("doc", "check", "text", "found").mapInPandas(cut, schema)


class ColumnwiseTransform:
    """Burrows-Wheeler transform and common prefixes of a collection, one column a round.

    Symbols are bytes plus one, and 0 before a string's first byte (0xFF is not in UTF-8).
    After round t all suffixes of at most t bytes stand in order; ends of strings come
    first and by the strings' numbers. A suffix that a symbol is put before moves to where
    that symbol's occurrences up to it say. Only the new rows and those after them get a
    new common prefix: one more than the least between the two rows that they come from.
    """

    def __init__(self, strings: list[bytes]):
        m = len(strings)
        lengths = np.array([len(s) for s in strings], np.int64)
        symbols = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
        begins = np.cumsum(lengths) - lengths
        self.bwt = np.where(lengths > 0, symbols[np.maximum(begins + lengths - 1, 0)] if len(symbols) else 0, 0).astype(np.uint8)
        self.common = np.zeros(m, np.int32)
        self.string, self.offset = np.arange(m, dtype=np.int32), lengths.astype(np.int32)
        row = np.arange(m)  # where each string's latest suffix stands
        active = np.flatnonzero(lengths > 0)
        left = lengths.copy()  # the latest suffix starts here in its string
        while len(active):
            order = np.argsort(self.bwt, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ended = int(np.count_nonzero(self.bwt == 0))
            old = row[active]
            place = rank[old]
            new = m + place - ended
            prefix = self._prefix(order, place - 1, place)
            following = self._prefix(order, place, place + 1)
            left[active] -= 1
            before = np.where(left[active] > 0, symbols[begins[active] + np.maximum(left[active] - 1, 0)], 0)
            size = len(self.bwt) + len(active)
            stays = np.ones(size, bool)
            stays[new] = False
            for name, values in (("bwt", before), ("common", prefix), ("string", active), ("offset", left[active])):
                held = getattr(self, name)
                grown = np.empty(size, held.dtype)
                grown[stays], grown[new] = held, values
                setattr(self, name, grown)
            after = new + 1
            old_after = (after < size) & stays[np.minimum(after, size - 1)]
            self.common[after[old_after]] = following[old_after]
            row[active] = new
            active = active[left[active] > 0]

    def _prefix(self, order: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """1 + the least common prefix between the rows at two ranks, 0 where their symbols differ."""
        out = np.zeros(len(lower), np.int32)
        inside = (upper >= 0) & (lower < len(order))
        a, b = order[np.maximum(upper, 0)], order[np.minimum(lower, len(order) - 1)]
        some = np.flatnonzero(inside & (self.bwt[a] == self.bwt[b]) & (self.bwt[b] != 0))
        if len(some):
            first, counts = a[some] + 1, b[some] - a[some]
            begins = np.cumsum(counts) - counts
            flat = np.arange(int(counts.sum())) + np.repeat(first - begins, counts)
            out[some] = 1 + np.minimum.reduceat(self.common[flat], begins)
        return out


def _compared(strings: DataFrame, groups: int, width: int) -> DataFrame:
    """``doc, check, start, n`` of windows with an equal one before them in the collection of their anchors."""

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        table = ColumnwiseTransform(list(batch.string))
        windows = batch.n.to_numpy()[table.string] > table.offset
        group = np.cumsum(table.common < width)[windows]
        string, offset = table.string[windows], table.offset[windows].astype(np.int64)
        doc, place = batch.doc.to_numpy(np.int64)[string], batch.start.to_numpy(np.int64)[string] + offset
        order = np.lexsort((place, doc, group))
        group, string, doc, place = group[order], string[order], doc[order], place[order]
        head = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        heads = np.flatnonzero(head)[np.cumsum(head) - 1] if len(group) else np.zeros(0, np.int64)
        gone = (doc != doc[heads]) | (place != place[heads])
        string, doc, place = string[gone], doc[gone], place[gone]
        order = np.lexsort((place, string))
        string, doc, place = string[order], doc[order], place[order]
        cuts = np.flatnonzero(np.concatenate([[True], (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1)])) if len(place) else np.zeros(0, np.int64)
        n = np.diff(np.append(cuts, len(place)))
        return pd.DataFrame({"doc": doc[cuts], "check": batch.check.to_numpy(np.int32)[string[cuts]], "start": place[cuts].astype(np.int32), "n": n.astype(np.int32)})

    grouped = strings.where(F.col("kind") == _SPAN).groupBy(F.pmod("anchor", F.lit(groups)).alias("group"))
    return grouped.applyInPandas(compare, "doc long, check int, start int, n int")


def _told_apart(strings: DataFrame) -> DataFrame:
    """The same for windows of hot anchors, for each range of their hashes."""

    def match(batch: pd.DataFrame) -> pd.DataFrame:
        table, first = _first_of_each(np.concatenate([_unpacked(p, n) for p, n in zip(batch.string, batch.n)]))
        return _runs(table[~first]).drop(columns="kind")

    ranges = strings.where(F.col("kind") == _HOT).select("anchor", "n", "string")
    local = strings.where(F.col("kind") == _GONE).select("doc", "check", "start", "n")
    return local.unionByName(ranges.groupBy("anchor").applyInPandas(match, "doc long, check int, start int, n int"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most_spans: int = MOST_SPANS) -> tuple[DataFrame, DataFrame]:
    """The rows as ``doc, check, text``, and ``doc, check, start, n``: n windows from ``start`` on also start earlier."""
    if not gram <= width < 1 << 16:
        raise ValueError("a width from gram to 65535")
    rows = documents_of(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_of().alias("text"))
    rows = rows.withColumn("check", _check())
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(256, -(-n_bytes // BYTES_PER_BUCKET))
    places = materialize(_matched(_anchored(rows, buckets, width, gram), most_spans))
    hot_buckets = max(256, places.where(F.col("kind") == _HOT).count() // HOT_SPANS_PER_BUCKET)
    strings = materialize(_strings(places, rows, width, hot_buckets))
    groups = max(64, -(-strings.where(F.col("kind") == _SPAN).count() // STRINGS_PER_GROUP))
    gone = places.where(F.col("kind") == _GONE).select("doc", "check", "start", "n")
    return rows, gone.unionByName(_compared(strings, groups, width)).unionByName(_told_apart(strings))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, most_spans: int = MOST_SPANS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that are left) for each row."""
    rows, gone = repeated_spans(docs, width, gram, most_spans)
    by_doc = gone.groupBy("doc", "check").agg(F.collect_list(F.struct("start", "n")).alias("gone"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, found in zip(batch.doc, batch.text, batch.gone):
                raw = text.encode("utf-8", "surrogatepass")
                runs: list[list[int]] = []
                for start, n in sorted((f["start"], f["n"]) for f in (found if found is not None else ())):
                    end = start + n + width - 1
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                edges = [0, *[x for run in runs for x in run], len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((None if doc == NO_ID else doc, len(raw), len(raw) - len(kept), len(runs), kept))
            made = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
            yield made.astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return rows.join(by_doc, ["doc", "check"], "left").select("doc", "text", "gone").mapInPandas(remove, schema)


def repeats_digest(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row."""
    return remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
