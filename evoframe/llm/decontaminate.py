"""Benchmark decontamination: suffix arrays of the corpus, searched for every suffix of the benchmark.

1. The words of a few MB of documents make up a shard. Its suffix array sorts all places
   of the shard by the words from there on, by doubling the sorted depth until it covers a
   window. Documents are kept apart by a word that no item has.
2. Every suffix of a benchmark item, cut to a window of ``width`` words (the whole item, if
   it is shorter), is looked up by binary search, all suffixes at once, one word deeper each
   time. The places found are compared byte by byte, as the order is that of hashes.
3. Places that follow one another in a document and in an item join to the longest verbatim
   match of the two; places that overlap join to spans of hit words.

The benchmark is sent to the tasks in blocks of about ``MOST_WORDS`` words, whole items in
each. There is one pass over the corpus for each block, mostly one in all; between passes
the rows are written, so no task holds more than one block. Nothing is shuffled.

Defined results: null and empty texts have no words; an item without words hits nothing;
rows of one ``item_id`` are one item, and a null ``item_id`` is named by the empty string;
in a window that an item repeats, its first place counts as the match's place there; a
null ``doc_id`` and repeated rows are handled row by row; very long texts are shards of
their own, read whole; no rows give no rows; ``clean_documents`` passes on all columns,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.llm._common import in_slices, materialize, packed, text_of, unpacked
from evoframe.llm._words import hash_spans

WIDTH = 10
#: Words of the benchmark that a task holds at most (but for one item's own): some 100 MB.
MOST_WORDS = 1 << 19
SHARD_BYTES = 8 << 20

_SPANS = "array<struct<start: long, length: long>>"
_MATCHES = "array<struct<item_id: string, doc_start: long, item_start: long, length: long>>"
_ARROW_SPANS = pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64()}))
_ARROW_MATCHES = pa.list_(pa.struct({"item_id": pa.string(), "doc_start": pa.int64(), "item_start": pa.int64(), "length": pa.int64()}))

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of lower-cased bytes starts and ends."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IN_WORD[np.frombuffer(raw, np.uint8)]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


class Windows:
    """The distinct windows of some items and where they stand in them."""

    def __init__(self, items: list[tuple[str, list[list[bytes]]]], width: int):
        self.items, numbers, found = [], {}, {}
        for item, (name, texts) in enumerate(sorted(items)):
            self.items.append(name)
            base = 0
            for words in texts:
                ids = [numbers.setdefault(w, len(numbers)) for w in words]
                n = min(width, len(ids))
                for i in range(len(ids) - n + 1 if n else 0):
                    found.setdefault(tuple(ids[i : i + n]), {}).setdefault(item, base + i)
                base += len(ids) + 1
        self.words, self.seed = list(numbers), 0
        while True:  # no two words of the benchmark share a hash
            hashes = self.hashed(self.words)
            order = np.argsort(hashes)
            self.hashes, self.number = hashes[order], order
            if not (self.hashes[1:] == self.hashes[:-1]).any():
                break
            self.seed += 1
        self.lengths: dict[int, tuple] = {}  # length: windows, their places' bounds, items, places
        for n in sorted({len(k) for k in found}):
            some = {k: v for k, v in found.items() if len(k) == n}
            counts = np.array([len(v) for v in some.values()], np.int64)
            places = [p for v in some.values() for p in v.items()]
            item, start = (np.array(x, np.int64) for x in zip(*places))
            self.lengths[n] = np.array(list(some), np.int64), np.append(0, np.cumsum(counts)), item, start

    def hashed(self, words: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        return hash_spans(b"".join(words), ends - [len(w) for w in words], ends, self.seed) if words else np.zeros(0, np.uint64)


class SuffixArray:
    """All places of a sequence of ranks above 0, by the first ``depth`` ranks from there on; 0 stands between documents."""

    def __init__(self, ranks: np.ndarray, depth: int):
        self.ranks = np.append(ranks, np.zeros(depth, ranks.dtype))
        now, reach = ranks.astype(np.int64), 1
        self.order = np.argsort(now, kind="stable")
        while reach < depth and len(now):
            later = np.append(now[reach:], np.zeros(min(reach, len(now)), np.int64))
            key = now * (int(now.max()) + 1) + later
            self.order = np.argsort(key, kind="stable")
            steps = np.diff(key[self.order], prepend=-1) != 0
            now = np.empty_like(now)
            now[self.order] = np.cumsum(steps)
            reach *= 2

    def _bound(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, deep: int, after: bool) -> np.ndarray:
        """The first place from low to high whose rank at ``deep`` is not below (``after``: is above) the wanted one."""
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            rank = self.ranks[self.order[np.minimum(middle, len(self.order) - 1)] + deep]
            below = open_ & (rank <= wanted if after else rank < wanted)
            low = np.where(below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return low

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pattern numbers and places where they stand."""
        which, low = np.arange(len(patterns)), np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.order), np.int64)
        for deep in range(patterns.shape[1]):
            wanted = patterns[which, deep]
            first = self._bound(low, high, wanted, deep, False)
            high = self._bound(first, high, wanted, deep, True)
            left = first < high
            which, low, high = which[left], first[left], high[left]
        counts = high - low
        inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(which, counts), self.order[np.repeat(low, counts) + inner]


def _expanded(bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of a ragged table: which of ``which`` each entry belongs to, and where it stands."""
    counts = bounds[which + 1] - bounds[which]
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(np.arange(len(which)), counts), np.repeat(bounds[which], counts) + inner


def search_shard(texts: list[str | None], windows: Windows) -> tuple[np.ndarray, list[list[dict]], list[list[dict]]]:
    """For each text: its words, the spans of hit words, and the longest match with each item."""
    raws = [(t or "").encode().translate(_LOWER) for t in texts]
    raw = b"\n".join(raws)
    starts, ends = words_of(raw)
    edges = np.cumsum([0] + [len(r) + 1 for r in raws])
    before = np.searchsorted(starts, edges)  # words in front of each text
    n_words = np.diff(before)
    spans, matches = [[] for _ in texts], [[] for _ in texts]
    if not len(starts) or not windows.lengths:
        return n_words, spans, matches

    hashes = hash_spans(raw, starts, ends, windows.seed)
    known, ranks = np.unique(hashes, return_inverse=True)
    # a word of rank 0 stands behind each text
    place = np.arange(len(starts)) + np.repeat(np.arange(len(texts)), n_words)
    line = np.zeros(len(starts) + len(texts), np.int64)
    line[place] = ranks + 1
    text_at = before[:-1] + np.arange(len(texts))  # where each text begins in the line
    suffixes = SuffixArray(line, max(windows.lengths))
    at = np.minimum(np.searchsorted(known, windows.hashes), len(known) - 1)
    rank_of = np.full(len(windows.words), -1, np.int64)
    rank_of[windows.number] = np.where(known[at] == windows.hashes, at + 1, -1)

    covered, rows = np.zeros(len(line) + 1, np.int64), []
    word_at = np.full(len(line), -1, np.int64)
    word_at[place] = np.arange(len(starts))
    for n, (table, bounds, items, item_starts) in windows.lengths.items():
        patterns = rank_of[table]
        there = np.flatnonzero((patterns > 0).all(axis=1))
        which, where = suffixes.find(patterns[there])
        which = there[which]
        # the bytes of every word found must be the word's own
        words = np.unique((where[:, None] + np.arange(n)).ravel())
        words = word_at[words]
        number = windows.number[np.minimum(np.searchsorted(windows.hashes, hashes[words]), len(windows.words) - 1)]
        wrong = [raw[a:b] != windows.words[v] for a, b, v in zip(starts[words].tolist(), ends[words].tolist(), number.tolist())]
        if any(wrong):
            bad = np.zeros(len(line) + n, np.int64)
            bad[place[words[np.array(wrong)]]] = 1
            total = np.append(0, np.cumsum(bad))
            good = total[where + n] == total[where]
            which, where = which[good], where[good]
        np.add.at(covered, where, 1)
        np.add.at(covered, where + n, -1)
        own, entry = _expanded(bounds, which)
        rows.append(np.stack([items[entry], where[own], item_starts[entry], np.full(len(own), n)]))

    hit = np.cumsum(covered)[: len(line)] > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
        text = int(np.searchsorted(text_at, a, "right")) - 1
        spans[text].append({"start": a - int(text_at[text]), "length": b - a})

    item, where, item_start, n = np.concatenate(rows, axis=1)
    text = np.searchsorted(text_at, where, "right") - 1
    order = np.lexsort((where, item_start - where, n, item, text))
    item, where, item_start, n, text = (x[order] for x in (item, where, item_start, n, text))
    if len(item):
        same = (np.diff(item) == 0) & (np.diff(text) == 0) & (np.diff(n) == 0) & (np.diff(item_start - where) == 0) & (np.diff(where) == 1)
        first = np.flatnonzero(np.append(True, ~same))
        length = np.diff(np.append(first, len(item))) - 1 + n[first]
        best: dict[tuple[int, int], tuple] = {}
        for t, i, size, w, s in zip(text[first].tolist(), item[first].tolist(), length.tolist(), where[first].tolist(), item_start[first].tolist()):
            best[t, i] = min(best.get((t, i), (0,)), (-size, w, s))
        for (t, i), (size, w, s) in sorted(best.items()):
            matches[t].append({"item_id": windows.items[i], "doc_start": w - int(text_at[t]), "item_start": s, "length": -size})
    return n_words, spans, matches


def _joined(a: list[dict] | None, b: list[dict]) -> list[dict]:
    """Spans that overlap or touch made one."""
    if not a:
        return b
    out: list[dict] = []
    for s in sorted(a + b, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["start"] + out[-1]["length"]:
            out[-1]["length"] = max(out[-1]["length"], s["start"] + s["length"] - out[-1]["start"])
        else:
            out.append(dict(s))
    return out


def _blocks(benchmark: DataFrame, width: int, most_words: int) -> Iterator[Windows]:
    """The benchmark in blocks of whole items, read bit by bit; one without items if there are none."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_of().alias("text"))
    items, held = [], 0
    for row in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        raw = row.text.encode().translate(_LOWER)
        words = [raw[a:b] for a, b in zip(*(x.tolist() for x in words_of(raw)))]
        if not items or items[-1][0] != row.item_id:
            if held >= most_words:
                yield Windows(items, width)
                items, held = [], 0
            items.append((row.item_id, []))
        items[-1][1].append(words)
        held += len(words)
    yield Windows(items, width)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most_words: int = MOST_WORDS) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_words``, ``spans`` of hit words and ``matches``, the longest with each item, by ``item_id``."""
    found = packed(docs).withColumns({
        "text": text_of("row.text"), "n_words": F.lit(0).cast("long"), "spans": F.array().cast(_SPANS), "matches": F.array().cast(_MATCHES),
    })
    names, schema = found.columns, found.schema

    def step(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_slices(batches, "text", SHARD_BYTES):
                n_words, spans, matches = search_shard(batch.column("text").to_pylist(), sent.value)
                spans = [_joined(a, b) for a, b in zip(batch.column("spans").to_pylist(), spans)]
                matches = [(a or []) + b for a, b in zip(batch.column("matches").to_pylist(), matches)]
                new = [pa.array(n_words, pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array(matches, _ARROW_MATCHES)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *new], names)

        return run

    for number, windows in enumerate(_blocks(benchmark, width, most_words)):
        found = (materialize(found) if number else found).mapInArrow(step(docs.sparkSession.sparkContext.broadcast(windows)), schema)
    return found.drop("text")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a hit word, with the columns they have."""
    return unpacked(contamination(docs, benchmark, **options).where(F.size("spans") == 0), docs.columns)


def contamination_digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``."""
    found = contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.length)
    names = F.array_sort(F.transform("matches", lambda m: m.item_id))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("matches").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def oracle(width: int = WIDTH) -> str:
    """The same in DuckDB's SQL, by all windows as strings."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def words(text: str) -> str:
        return rf"regexp_extract_all(translate(coalesce({text}, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    return f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {words("text")} AS w FROM documents),
b AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item_id, {words("text")} AS w FROM benchmark),
sized AS (SELECT item_id, w, least({width}, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
places AS (SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n),
grams AS (SELECT row_no, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM places),
found AS (SELECT row_no, item_id, i, n FROM grams JOIN windows USING (n, g)),
hit AS (SELECT row_no, count(DISTINCT k) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS k FROM found) GROUP BY row_no),
items AS (
  SELECT row_no, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS named
  FROM (SELECT DISTINCT row_no, item_id FROM found) GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row_no) LEFT JOIN items USING (row_no)"""
