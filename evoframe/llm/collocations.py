"""Phrases whose words keep company more than chance would have it.

1. A sketch: one pass hashes every phrase of one to five words of every text to a cell and
   counts the cells. A cell's count bounds the counts of its phrases from above, so only
   phrases of cells that reach ``least`` can be frequent. What goes on is which cells do.
2. Candidates: the distinct longest phrases of such cells are collected, where a
   phrase also needs that its shorter parts are left; every part of them is a candidate.
   A small part of the texts goes first, as most frequent phrases stand there already.
3. Automata: candidates are compiled into Aho-Corasick automata with a delimiter at both
   ends of every word, words written as numbers, common ones short. Each task scans its texts and
   counts all matches, overlapping ones too. The sums are exact counts.
4. Thresholds, scores and ranks are joins and windows on the counted phrases.

Automata hold ``SHARD`` phrases at most; more candidates take further scans. Sketches have a
cell for every ``CELL_BYTES`` bytes of text; where that is more than ``MOST_CELLS``,
phrases are dealt by their first word into slices with a sketch each, and candidates are
collected slice by slice. So what a task holds is bounded, whatever the corpus.

Phrases are told apart by 64-bit hashes where one task would send one twice, and by their
words everywhere else.

Defined results: null and empty texts have no words; a null ``lang`` counts as ``und``;
a null ``doc_id`` and repeated rows count row by row; very long texts are read whole, and
texts without a frequent phrase give nothing; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evoframe.llm._common import in_slices, materialize, text_of
from evoframe.llm._words import hash_spans, mixed

LEAST = 100
LONGEST = 5
TOP = 2000
CELL_BYTES = 16
#: Cells of one sketch; a task holds a bit for each.
MOST_CELLS = 1 << 30
RANGE = 1 << 18
#: Hashes that a task gathers before it sends them on.
GATHERED = 1 << 22
#: Of this many parts of the texts, those that are searched for candidates first, and next.
PARTS, ROUNDS = 128, (1, 9)
#: Candidates that are known to all tasks in the next round; others may be sent again.
MOST_KNOWN = 1 << 22
#: Phrases in one automaton.
SHARD = 500_000
#: Counts in one vector that leaves a task.
VECTOR = 1 << 14
#: Kinds of digits of a word's number.
BASE = 32

_KIND = bytes(32 if b == 0x09 else 10 if b in b".,;:!?" or 0x0A <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_UNKNOWN = "\x01"


def plain(text: str) -> bytes:
    """A-Z in lower case, a space between words and a line end between pieces."""
    return text.encode().translate(_KIND)


class Phrases:
    """Hashes of the phrases of some texts; a phrase is where its first word stands and how many it has."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.raw = b"\n".join(map(plain, texts))
        data = np.frombuffer(self.raw, np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = (data != 0x20) & (data != 0x0A)
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = turns[::2], turns[1::2]
        self.piece = np.cumsum(data == 0x0A)[self.starts]
        edges = np.cumsum([len(t.encode()) + 1 for t in texts])
        self.text = np.searchsorted(edges, self.starts, "right")
        names = [x.encode() for x in langs]
        at = np.cumsum([len(x) for x in names])
        seeds = hash_spans(b"".join(names), at - [len(x) for x in names], at, 11)
        self.word = hash_spans(self.raw, self.starts, self.ends)
        self.first = mixed(self.word + seeds[self.text])

    def each(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, hashes of all phrases of it, and which of them lie in one piece."""
        now = self.first
        for n in range(1, LONGEST + 1):
            if n > 1:
                now = mixed(now[: len(now) - 1] + self.word[n - 1 :] * np.uint64(0x9E3779B97F4A7C15))
            if not len(now):
                return
            yield n, now, self.piece[: len(now)] == self.piece[n - 1 :]

    def words(self, at: int, n: int) -> str:
        return b" ".join(self.raw[a:b] for a, b in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist())).decode()


def _ranged(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Counted cells by range: steps and counts, counts up to 255 as more makes no difference."""
    cells.sort()
    new = np.flatnonzero(np.diff(cells, prepend=-1))
    counts = np.minimum(np.diff(np.append(new, len(cells))), 255).astype(np.uint8)
    cells = cells[new]
    numbers = cells // RANGE
    first = np.flatnonzero(np.diff(numbers, prepend=-1))
    for a, b in zip(first.tolist(), np.append(first[1:], len(cells)).tolist()):
        steps = np.diff(cells[a:b], prepend=numbers[a] * RANGE).astype("<u4")
        yield int(numbers[a]), zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts[a:b].tobytes(), 1)


def _unranged(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zlib.decompress(data), np.uint8)
    n = len(flat) // 5
    return np.cumsum(np.ascontiguousarray(flat[: 4 * n].reshape(4, n).T).view("<u4").ravel()), flat[4 * n :]


def _texts(docs: DataFrame) -> DataFrame:
    names = [F.col(c) for c in ("doc_id", "text") if c in docs.columns]  # copies of a text lie in different parts
    part = F.pmod(F.xxhash64(*names), F.lit(PARTS)).alias("part")
    return docs.select(text_of().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), part)


def _own(phrases: Phrases, slice_bits: int, number: int) -> np.ndarray:
    """Where phrases begin that belong to a slice: by the low bits of their first word, as cells are by the high ones."""
    return (phrases.first & np.uint64((1 << slice_bits) - 1)) == np.uint64(number)


def _sketch(texts: DataFrame, bits: int, slice_bits: int, number: int, least: int) -> DataFrame:
    """``range, cells``: for each range of cells of a slice those that are counted ``least`` times or more, as steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(parts: list[np.ndarray]) -> pa.RecordBatch:
            rows = list(_ranged(np.concatenate(parts)))
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], ["range", "data"])

        parts, held = [], 0
        for batch in in_slices(batches):
            phrases = Phrases(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
            own = _own(phrases, slice_bits, number)
            for _, hashes, whole in phrases.each():
                parts.append((hashes[whole & own[: len(hashes)]] >> np.uint64(64 - bits)).astype(np.int64))
                held += len(parts[-1])
            if held > GATHERED:
                yield send(parts)
                parts, held = [], 0
        if held:
            yield send(parts)

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(RANGE, np.int64)
        for data in group.column("data"):
            cells, counts = _unranged(data.as_py())
            total[cells] += counts
        found = np.flatnonzero(total >= least)
        packed = zlib.compress(np.diff(found, prepend=0).astype("<u4").tobytes())
        return pa.table({"range": group.column("range")[:1].cast(pa.int64()), "cells": pa.array([packed], pa.binary())}) if len(found) else pa.table(
            {"range": pa.array([], pa.int64()), "cells": pa.array([], pa.binary())})

    return texts.select("text", "lang").mapInArrow(count, "range long, data binary").groupBy("range").applyInArrow(add, "range long, cells binary")


class Cells:
    """The frequent cells of one slice as bits, unpacked by a worker once."""

    def __init__(self, ranges: list[tuple[int, bytes]], bits: int, slice_bits: int, number: int):
        self.ranges, self.bits, self.slice_bits, self.number, self._set = ranges, bits, slice_bits, number, None

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self._set is None:
            self._set = np.zeros((1 << self.bits) // 8 + 1, np.uint8)
            for at, data in self.ranges:
                cells = at * RANGE + np.cumsum(np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64))
                np.bitwise_or.at(self._set, cells >> 3, (1 << (cells & 7)).astype(np.uint8))
        cells = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self._set[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def longest_phrases(phrases: Phrases, cells: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and hashes of the longest phrases of two words or more that may be frequent."""
    own = _own(phrases, cells.slice_bits, cells.number)
    length, last = np.zeros(len(own), np.int64), np.zeros(len(own), np.uint64)
    before = None
    for n, hashes, whole in phrases.each():
        here = own[: len(hashes)] & whole
        if before is not None:  # both parts must be left; those of other slices are not known here
            here &= before[: len(hashes)] & (before[1 : len(hashes) + 1] | ~own[1 : len(hashes) + 1])
        at = np.flatnonzero(here)
        at = at[cells.has(hashes[at])]
        before = np.zeros(len(hashes), bool)
        before[at] = True
        length[at], last[at] = n, hashes[at]
    at = np.flatnonzero(length > 1)
    at = at[length[at] > np.where(at > 0, length[at - 1] - 1, 0)]
    return at, length[at], last[at]


def _candidates(texts: DataFrame, cells: Cells, known: np.ndarray) -> DataFrame:
    """``lang, phrase, hash``: the longest phrases that may be frequent and are not known, mostly distinct."""
    sent = texts.sparkSession.sparkContext.broadcast((cells, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, known = sent.value
        seen = np.zeros(0, np.uint64)
        for batch in in_slices(batches):
            langs = batch.column("lang").to_pylist()
            phrases = Phrases(batch.column("text").to_pylist(), langs)
            at, n, hashes = longest_phrases(phrases, cells)
            _, first = np.unique(hashes, return_index=True)
            for old in (known, seen):
                if len(old):
                    place = np.minimum(np.searchsorted(old, hashes[first]), len(old) - 1)
                    first = first[old[place] != hashes[first]]
            seen = hashes[first] if len(seen) > GATHERED else np.concatenate([seen, hashes[first]])
            seen.sort()
            made = [phrases.words(a, k) for a, k in zip(at[first].tolist(), n[first].tolist())]
            found = [pa.array([langs[t] for t in phrases.text[at[first]].tolist()], pa.string()), pa.array(made, pa.string()), pa.array(hashes[first].view(np.int64))]
            yield pa.RecordBatch.from_arrays(found, ["lang", "phrase", "hash"])

    return texts.select("text", "lang").mapInArrow(run, "lang string, phrase string, hash long")


def _all_candidates(texts: DataFrame, cells: Cells) -> DataFrame:
    """``lang, phrase``: the distinct longest phrases that may be frequent.

    Every text is read in one of a few rounds, each larger than the one before. What a round
    finds is known in the next, so a phrase that all tasks meet is not sent by all of them.
    """
    known, found, low = np.zeros(0, np.uint64), None, 0
    for high in (*ROUNDS, PARTS):
        some = texts.where((F.col("part") >= low) & (F.col("part") < high))
        new = materialize(_candidates(some, cells, known).distinct())
        found, low = new if found is None else found.unionByName(new), high
        if high < PARTS:
            hashes = new.select("hash").limit(max(0, MOST_KNOWN - len(known))).toArrow().column("hash").to_numpy().view(np.uint64)
            known = np.unique(np.concatenate([known, hashes]))
    return found.select("lang", "phrase").distinct()


def _code(number: int) -> str:
    """A word's number as digits, none of them a delimiter; few kinds of them, as the automaton tries the ways out of a state one by one."""
    signs = chr(0x30 + number % BASE)
    while number := number // BASE:
        signs += chr(0x30 + number % BASE)
    return signs


class Automaton:
    """Phrases compiled by a worker once; counts their places in texts of their language."""

    def __init__(self, table: pa.Table):
        self.table, self._made = table, None

    def _make(self) -> None:
        import ahocorasick

        rows = list(zip(self.table.column("lang").to_pylist(), [p.split(" ") for p in self.table.column("phrase").to_pylist()]))
        common = Counter((lang, word) for lang, words in rows for word in words).most_common()
        self._codes: dict[str, dict[str, str]] = {}
        for n, ((lang, word), _) in enumerate(common):  # numbers of words differ by language, so its phrases do
            self._codes.setdefault(lang, {"\n": "\n"})[word] = _code(n)
        self._made = ahocorasick.Automaton()
        for k, (lang, words) in enumerate(rows):
            self._made.add_word(f" {' '.join([self._codes[lang][w] for w in words])} ", k)
        self._made.make_automaton()

    def count(self, texts: list[str], langs: list[str]) -> tuple[np.ndarray, dict[str, int]]:
        """How often each phrase stands in the texts, and the words of each language."""
        if self._made is None:
            self._make()
        found, totals, pick = [], {}, itemgetter(1)
        for text, lang in zip(texts, langs):
            words = [w for w in plain(text).replace(b"\n", b" \n ").decode().split(" ") if w]
            totals[lang] = totals.get(lang, 0) + len(words) - words.count("\n")
            codes = self._codes.get(lang)
            if codes:
                line = f" {' '.join([codes.get(w, _UNKNOWN) for w in words])} "
                found.append(np.fromiter(map(pick, self._made.iter(line)), np.int64))
        return np.bincount(np.concatenate(found), minlength=self.table.num_rows) if found else np.zeros(self.table.num_rows, np.int64), totals


def _scanned(texts: DataFrame, table: pa.Table) -> DataFrame:
    """``pid, lang, n``: places of each phrase; without a ``pid``, all words of the language.

    A task's counts leave it as vectors over ranges of the automaton's phrases, which are then added up range by range.
    """
    context = texts.sparkSession.sparkContext
    sent, sent_ids = context.broadcast(Automaton(table)), context.broadcast(table.column("pid").to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(0, np.int64), {}
        for batch in in_slices(batches):
            some, words = sent.value.count(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
            counts = counts + some if len(counts) else some
            for lang, n in words.items():
                totals[lang] = totals.get(lang, 0) + n
        parts = [(at // VECTOR, None, None, zlib.compress(counts[at : at + VECTOR].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)) for at in range(0, len(counts), VECTOR)]
        parts += [(-1 - zlib.crc32(lang.encode()) % 64, lang, n, None) for lang, n in totals.items()]
        columns = list(zip(*parts)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.binary()))], ["part", "lang", "n", "data"])

    def add(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        if part < 0:  # words of a few languages
            totals: dict[str, int] = {}
            for lang, n in zip(group.column("lang").to_pylist(), group.column("n").to_pylist()):
                totals[lang] = totals.get(lang, 0) + n
            return pa.table({"pid": pa.array([None] * len(totals), pa.int64()), "lang": pa.array(list(totals), pa.string()), "n": pa.array(list(totals.values()), pa.int64())})
        counts = 0
        for data in group.column("data"):
            counts = counts + np.ascontiguousarray(np.frombuffer(zlib.decompress(data.as_py()), np.uint8).reshape(8, -1).T).view("<i8").ravel()
        at = np.flatnonzero(counts)
        ids = sent_ids.value[part * VECTOR + at]
        return pa.table({"pid": pa.array(ids, pa.int64()), "lang": pa.array([None] * len(at), pa.string()), "n": pa.array(counts[at], pa.int64())})

    parts = texts.select("text", "lang").mapInArrow(run, "part long, lang string, n long, data binary")
    return parts.groupBy("part").applyInArrow(add, "pid long, lang string, n long")


def _parts(words, least: int, most):
    """All runs of ``least`` words or more of an array of words, up to ``most``, as phrases."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words)), lambda a: F.transform(
        F.filter(F.sequence(F.lit(1), F.size(words)), lambda n: (n >= least) & (n <= most) & (a + n - 1 <= F.size(words))),
        lambda n: F.array_join(F.slice(words, a, n), " ")))
    return F.flatten(runs)


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of every phrase of one to five words that may stand in one counted ``least`` times, and ``lang, n``."""
    texts = _texts(docs)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(20, int(size // CELL_BYTES).bit_length())
    slice_bits = max(0, bits - MOST_CELLS.bit_length() + 1)
    found = None
    bits -= slice_bits
    for number in range(1 << slice_bits):
        ranges = _sketch(texts, bits, slice_bits, number, least)
        cells = Cells([(r.range, bytes(r.cells)) for r in ranges.collect()], bits, slice_bits, number)
        some = _all_candidates(texts, cells)
        found = some if found is None else found.unionByName(some)
    parts = found.select("lang", F.explode(_parts(F.split("phrase", " "), 1, LONGEST)).alias("phrase")).distinct()
    phrases = materialize(parts.withColumn("pid", F.monotonically_increasing_id()))
    shards = -(-phrases.count() // SHARD)
    scans = []
    for number in range(shards):
        one = phrases.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(shards)) == number)
        scan = _scanned(texts, one.toArrow())
        scans.append(scan if not number else scan.where("pid IS NOT NULL"))
    if not scans:
        none = docs.sparkSession.createDataFrame([], "lang string, phrase string, size int, f long")
        return none, docs.sparkSession.createDataFrame([], "lang string, n long")
    counted = scans[0]
    for scan in scans[1:]:
        counted = counted.unionByName(scan)
    counted = materialize(counted)
    counts = phrases.join(counted.where("pid IS NOT NULL").select("pid", F.col("n").alias("f")), "pid")
    counts = materialize(counts.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f"))
    return counts, counted.where("pid IS NULL").select("lang", "n")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of each language."""
    counts, totals = phrase_counts(docs, least)
    frequent = counts.where((F.col("size") > 1) & (F.col("f") >= least))

    # phrases that a longer one holds as often as they stand at all
    longer = frequent.where("size > 2")
    held = longer.select("lang", F.col("f").alias("most"), F.explode(_parts(F.split("phrase", " "), 2, F.col("size") - 1)).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    own = frequent.join(held, ["lang", "phrase"], "left").where("most IS NULL OR most < f").select("lang", "phrase", "size", F.col("f").alias("a"))

    words = F.split("phrase", " ")
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"head": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    left, right = (counts.select("lang", F.col("phrase").alias(c), F.col("f").alias(x)) for c, x in (("head", "l"), ("rest", "r")))
    scored = cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"]).join(totals, "lang")
    # products of 64-bit numbers, whole in 38 digits
    score = F.expr("(CAST(1000 * CAST(a AS DECIMAL(19, 0)) AS DECIMAL(23, 0)) * CAST(n AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    scored = scored.withColumn("score", score.cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m")).select("lang", "phrase", "m.*")

    # first within parts of a language, so that none is one task's
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, top: int = TOP) -> str:
    """The same in DuckDB's SQL, by all phrases."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
lines AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lines GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lines),
grams AS (SELECT lang, w[i:i + k - 1] AS g FROM spots, range(1, {LONGEST + 1}) t(k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g),
frequent AS (SELECT lang, g, f FROM counts WHERE len(g) > 1 AND f >= {least}),
held AS (
  SELECT lang, g[a:b] AS g, max(f) AS most FROM frequent, range(1, {LONGEST + 1}) x(a), range(1, {LONGEST + 1}) y(b)
  WHERE a < b AND b <= len(g) AND b - a + 1 < len(g) GROUP BY ALL),
own AS (SELECT f.lang, f.g, f.f FROM frequent f LEFT JOIN held h ON f.lang = h.lang AND f.g = h.g WHERE h.most IS NULL OR 100 * h.most < 100 * f.f),
cuts AS (SELECT lang, g, f, k FROM own, range(1, {LONGEST}) t(k) WHERE k < len(g)),
scored AS (
  SELECT c.lang, c.g, c.f AS a, c.k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {top}"""
