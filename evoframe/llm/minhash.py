"""Near-duplicate documents: MinHash with banding, exact verification, connected components.

1. Each text becomes the set of its 5-word shingles (64-bit hashes). Texts with equal
   sets are one class, so a group of copies costs one row from here on.
2. 200 universal hash minima per class, in 40 bands of 5. At similarity 0.75 a link is
   missed with probability 2e-5, at 0.8 with 1e-7. Of each minimum 16 bits are kept.
3. Members of a band bucket are compared with two members of it, the smallest and the
   largest id. Links are kept if the sets themselves reach the threshold.
4. Each linked class gets a label that only its own component has. Where a bucket of
   three or more still holds several labels, the members outside its commonest one are
   compared with all of another on the minima, in blocks of bounded size. What may be
   linked with a component is then compared with all its members on the whole sets, in
   blocks again. No pair leaves a block but one link for each class and component found
   linked, so no link between different texts is lost to a group's size.
5. Large-star and small-star rounds join all links to components.

Classes without a partner, buckets of one and texts that need no check are the bulk of a
corpus. A filter of bits (``likely_in``) keeps them out of every shuffle but the two that
find classes and buckets.

Classes have numbers of their own, so rows of one ``doc_id`` with different texts stay
different nodes; a component is named after the smallest ``doc_id`` of its rows.

Defined results: null, empty or blank texts have an empty set and link with nothing;
rows with a null ``doc_id`` stand for themselves (component null, kept); equal rows give
equal result rows; very long texts are read whole, a few at a time; no rows give no rows;
other columns are ignored, and ``keep_one`` passes them on, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evoframe.llm._common import documents_of, in_slices, likely_in, materialize, packed, per_batch, text_of, unpacked
from evoframe.llm._words import mixed, words_of_each

WIDTH = 5
BANDS = 40
ROWS = 5
SHARED, OF = 75, 100  # linked: OF * intersection >= SHARED * union
#: The chance that the shared minima of two texts at the threshold are too few to compare their sets.
MISSED = 1e-7
#: Rows of either side that are compared in one block.
ASIDE_BLOCK, BLOCK = 128, 256

_LINE = "doc_id long, text_hash long, n_shingles long, set_hash binary, minima binary"


def least_minima(n: int) -> int:
    """How many of ``n`` minima a pair must share before its sets are compared: at the threshold, fewer has a chance of ``MISSED`` at most."""
    p, below = SHARED / OF, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > MISSED:
            return k
    return n


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    total = np.full(n, len(words) if len(words) < width else 0, np.uint64)
    for k in range(min(width, len(words))):
        total = mixed(total + words[k : k + n])
    return np.unique(total)


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles."""
    return [_shingles(words, width) for words in words_of_each([t.encode("utf-8", "surrogatepass").lower() for t in texts])]


def minima(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """16 bits of the minima of ``bands * rows`` multiply-add hashes for each non-empty set."""
    draw = np.random.default_rng(20240607)
    factors = draw.integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    addends = draw.integers(1 << 63, size=bands * rows, dtype=np.uint64)
    out = np.empty((len(sets), bands * rows), np.uint16)
    at = 0
    while at < len(sets):  # a few ten thousand shingles at a time stay in cache
        end, n = at, 0
        while end < len(sets) and (end == at or n + len(sets[end]) <= 32_768):
            n += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        starts = np.cumsum([0] + [len(x) for x in sets[at : end - 1]])
        for k in range(bands * rows):
            out[at:end, k] = np.minimum.reduceat(flat * factors[k] + addends[k], starts) >> np.uint64(32)
        at = end
    return out


def _texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text``; the hash tells the texts of one ``doc_id`` apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_hash, minima`` for each row; the last two null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in in_slices(batches):
            sets = shingle_sets(batch.column("text").to_pylist())
            found = iter(minima([s for s in sets if len(s)], bands, rows))
            hashes = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
            lows = [next(found).tobytes() if len(s) else None for s in sets]
            values = [batch.column("doc_id"), batch.column("text_hash"), pa.array(map(len, sets), pa.int64()), pa.array(hashes, pa.binary()), pa.array(lows, pa.binary())]
            yield pa.RecordBatch.from_arrays(values, ["doc_id", "text_hash", "n_shingles", "set_hash", "minima"])

    return _texts(docs).mapInArrow(sign, _LINE)


def _bands(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """One row for each class and band: ``bucket, id``."""
    width = 2 * rows
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.substring(F.col("minima"), k * width + 1, F.lit(width)))
    )
    return classes.select("id", F.explode(keys).alias("bucket"))


def _alike(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Those of the pairs ``a < b`` whose sizes and shared minima allow a link; needs no text."""
    light = classes.select("id", "n_shingles", "minima")
    left = light.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("minima").alias("m_a"))
    right = light.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("minima").alias("m_b"))
    sized = (F.col("n_a") * OF >= F.col("n_b") * SHARED) & (F.col("n_b") * OF >= F.col("n_a") * SHARED)

    def alike(batch: pd.DataFrame) -> pd.DataFrame:
        a = np.frombuffer(b"".join(batch.m_a), np.uint16).reshape(len(batch), -1)
        b = np.frombuffer(b"".join(batch.m_b), np.uint16).reshape(len(batch), -1)
        return batch.loc[((a == b).sum(axis=1) >= least), ["a", "b"]]

    near = pairs.join(left, "a").join(right, "b").where(sized).select("a", "b", "m_a", "m_b")
    return near.mapInPandas(per_batch(alike), "a long, b long")


def _sets(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, shingles``: the whole shingle set of each of the distinct ``ids``, made from the text of the class's first row."""
    heads = materialize(likely_in(classes, "id", ids, "id").join(ids, "id").select("id", "doc_id", "text_hash"))
    texts = likely_in(_texts(docs).where("doc_id IS NOT NULL"), "doc_id", heads, "doc_id")
    texts = texts.join(heads, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return materialize(texts.select("id", "text").mapInArrow(make, "id long, shingles binary"), "lz4")


def _confirmed(near: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``a < b`` whose whole shingle sets reach the threshold."""
    sets = _sets(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), classes, docs)

    def link(batch: pd.DataFrame) -> pd.DataFrame:
        keep, last, last_set = [], None, None
        for a, x, y in zip(batch.a, batch.s_a, batch.s_b):
            if a != last:
                last, last_set = a, np.frombuffer(x, np.uint64)
            other = np.frombuffer(y, np.uint64)
            at = np.searchsorted(last_set, other)
            at[at == len(last_set)] = 0
            shared = int((last_set[at] == other).sum())
            keep.append(OF * shared >= SHARED * (len(last_set) + len(other) - shared))
        return batch.loc[keep, ["a", "b"]]

    return (
        near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("s_b")), "b")
        .mapInPandas(per_batch(link), "a long, b long")
    )


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets of three or more that hold several components.

    ``main`` is the bucket's largest component, ``aside`` how many members are outside it.
    """
    rest = members.where("n > 2").select("bucket", "n", "id").join(found, "id", "left")
    rest = rest.select("bucket", "n", "id", F.coalesce("component", "id").alias("component"))
    parts = rest.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    split = parts.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("parts"))
    split = split.where("parts > 1").select("bucket", F.col("top.component").alias("main"), (F.col("all") - F.col("top.size")).alias("aside"))
    return materialize(rest.join(split, "bucket"))


def _in_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with ``row, col, first``: blocks that bring each row of ``left`` together with each of ``right`` of its key.

    Both have ``id`` and the same further columns, and ``lefts`` and ``rights``, the rows of
    their key. A block holds about ``ASIDE_BLOCK`` rows of ``left`` (``first`` is true) and ``BLOCK`` of ``right``.
    """
    rows, cols = F.ceil(F.col("lefts") / ASIDE_BLOCK), F.ceil(F.col("rights") / BLOCK)
    one = left.withColumns({"row": F.pmod(F.xxhash64("id"), rows), "col": F.explode(F.sequence(F.lit(0).cast("long"), cols - 1)), "first": F.lit(True)})
    two = right.withColumns({"row": F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)), "col": F.pmod(F.xxhash64("id", F.lit(1)), cols), "first": F.lit(False)})
    return one.unionByName(two).drop("lefts", "rights")


def _candidates(apart: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """``id, component`` where the class may be linked with a class of that other component.

    By sizes and shared minima, within the buckets of ``apart``; the pairs themselves stay in their block.
    """
    many = apart.join(classes.select("id", "n_shingles", "minima"), "id")
    many = many.withColumns({"lefts": F.col("aside"), "rights": F.col("n"), "in_main": F.col("component") == F.col("main")}).drop("main", "aside", "n")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        lows = np.frombuffer(b"".join(block.minima), np.uint16).reshape(len(block), -1)
        ids, component, size, main, first = (block[c].to_numpy() for c in ("id", "component", "n_shingles", "in_main", "first"))
        other = np.flatnonzero(~first)
        o_lows, o_component, o_size, o_main = lows[other], component[other], size[other], main[other]
        found_id, found = [], []
        for i in np.flatnonzero(first):
            facing = (o_component != component[i]) & (o_main | (o_component < component[i]))  # of two asides, one looks at the other
            facing &= (o_size * OF >= size[i] * SHARED) & (size[i] * OF >= o_size * SHARED)
            facing = np.flatnonzero(facing)
            reached = np.unique(o_component[facing[(o_lows[facing] == lows[i]).sum(axis=1) >= least]])
            found_id += [ids[i]] * len(reached)
            found += reached.tolist()
        return pd.DataFrame({"id": np.array(found_id, np.int64), "component": np.array(found, np.int64)})

    blocks = _in_blocks(many.where("NOT in_main"), many)
    return blocks.groupBy("bucket", "row", "col").applyInPandas(compare, "id long, component long").distinct()


def _reached(candidates: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``a < b`` of each candidate whose whole set reaches the threshold with that of a member of the component.

    One link to the component's label stands for all links into it.
    """
    targets = candidates.groupBy("component").agg(F.count("*").alias("lefts"))
    members = labels.select("id", "component").unionByName(targets.select(F.col("component").alias("id"), "component")).distinct()
    sizes = members.join(targets, "component").groupBy("component").agg(F.first("lefts").alias("lefts"), F.count("*").alias("rights"))
    sizes = materialize(sizes)
    left, right = (t.join(sizes, "component").select("component", "id", "lefts", "rights") for t in (candidates, members))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, np.uint64) for x in block.shingles]
        size, first = np.array([len(x) for x in sets]), block["first"].to_numpy()
        other = np.flatnonzero(~first)
        hit = []
        for i in np.flatnonzero(first):
            sized = other[(size[other] * OF >= size[i] * SHARED) & (size[i] * OF >= size[other] * SHARED)]
            if not len(sized):
                continue
            theirs = np.concatenate([sets[j] for j in sized])
            at = np.searchsorted(sets[i], theirs)
            at[at == size[i]] = 0
            shared = np.add.reduceat((sets[i][at] == theirs).astype(np.int64), np.cumsum(size[sized]) - size[sized])
            if (OF * shared >= SHARED * (size[i] + size[sized] - shared)).any():
                hit.append(i)
        ids, component = block.id.to_numpy()[hit], block.component.to_numpy()[hit]
        return pd.DataFrame({"a": np.minimum(ids, component), "b": np.maximum(ids, component)})

    blocks = materialize(_in_blocks(left, right))
    sets = _sets(blocks.select("id").distinct(), classes, docs)
    return blocks.join(sets, "id").groupBy("component", "row", "col").applyInPandas(compare, "a long, b long").distinct()


def _labels(links: DataFrame) -> DataFrame:
    """``id, component`` for every id of the links ``a, b``: some id that is reachable.

    The smallest neighbour's smallest neighbour: equal labels prove one component, different
    ones may still lie in one. Minima are aggregated before the shuffle.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    next_low = low.select(F.col("u").alias("m"), F.col("m").alias("component"))
    return low.join(next_low, "m").select(F.col("u").alias("id"), "component")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id of the links ``a, b``: the smallest id reachable.

    Alternates large-star (each neighbour that is larger is linked to the smallest
    neighbour) and small-star (each neighbour that is not larger is) until nothing
    changes, in rounds that follow the logarithm of the links. Minima are aggregated
    before the shuffle and joined back, so a node with very many neighbours is never one
    task's.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = None
    while before != (before := state(edges)):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", "m")).where("u <> v").distinct()
        edges = materialize(small)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def keep_one(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they have, whatever their names; of equal rows each.

    Rows with a null ``doc_id`` stay; rows of one ``doc_id`` are judged by their own texts.
    """
    gone = _judged(docs, bands, rows).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    marked = packed(docs, "doc_id").withColumn("text_hash", F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))))
    same = (F.col("doc_id") == F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash"))
    return unpacked(marked.join(gone, same, "left_anti"), docs.columns)


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``."""
    return _judged(docs, bands, rows).drop("text_hash")


def _judged(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """As ``near_duplicates``, with ``text_hash``."""
    docs, least = documents_of(docs, "doc_id", "text"), least_minima(bands * rows)
    signed = materialize(signatures(docs, bands, rows))
    real = signed.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    head = F.min_by(F.struct("doc_id", "text_hash", "n_shingles", "minima"), "doc_id").alias("head")
    classes = real.groupBy("set_hash").agg(head).select("set_hash", "head.*")
    # numbers in the order of doc_id: stars then have a group's first document in their middle, which later ones are often copied from
    classes = classes.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "set_hash")
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()))  # written, so they stay as they are

    banded = _bands(classes, bands, rows)
    buckets = banded.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("n > 1")
    buckets = materialize(buckets)
    members = materialize(likely_in(banded, "bucket", buckets, "bucket").join(buckets, "bucket").select("bucket", "id", "low", "high", "n"))
    stars = members.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("id").alias("b")),
                                             F.struct(F.col("id").alias("a"), F.col("high").alias("b")))).alias("p"))
    pairs = materialize(stars.select("p.*").where("a < b").distinct())
    met = materialize(likely_in(classes, "id", members, "id").select("id", "n_shingles", "minima"))
    links = materialize(_confirmed(materialize(_alike(pairs, met, least)), classes, docs))

    labels = materialize(_labels(links))
    candidates = materialize(_candidates(_apart(members, labels), met, least))
    links = links.unionByName(_reached(candidates, labels, classes, docs))
    found = materialize(components(links).join(classes.select("id", "doc_id"), "id"))
    names = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = materialize(found.join(names, "component").select("id", "component_id"))

    heads = classes.select("set_hash", "id", F.col("doc_id").alias("own_id"))
    classed = signed.drop("minima").join(heads, "set_hash", "left").join(found, "id", "left")
    component = F.coalesce("component_id", "own_id", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return classed.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), kept.alias("kept"))
