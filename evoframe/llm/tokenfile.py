"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

One file holds whole documents, in ascending ``doc_id`` order within and across files::

    magic 8 bytes | documents u64 | ids u64 | table u32 | table: ids by rank u32[]
    document ids i64[] | null flags u8[] | ids per document u64[] | control | data

Ranks are by falling frequency in the file (ties: smaller id). A rank takes one to four
bytes, least byte first; control bytes stand apart and hold four 2-bit lengths each.
Decoding looks up a control byte's lengths in a table and gathers the bytes with numpy.

Defined results: a null or empty text is the end id alone; rows with a null ``doc_id``
come first; equal rows are written each on its own, by text; no rows give no files.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evoframe.llm._common import documents_of, in_slices, materialize, shared_dir, text_of
from evoframe.llm._encode import encoder, tokenizer_path

MAGIC = b"EVOIDS01"
HEAD = struct.Struct("<8sQQI")
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
IDS_PER_FILE = 1 << 22

#: For each control byte: the four lengths.
LENGTHS = (1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)).astype(np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    lengths = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int, step: int = 1 << 18) -> np.ndarray:
    """The ``n`` ranks of ``encode_ranks``, ``step`` (a multiple of four) at a time."""
    out, begin = np.empty(n, np.uint32), 0
    for k in range(0, n, step):
        lengths = LENGTHS[control[k // 4 : (k + step) // 4]].reshape(-1)[: n - k]
        ends = begin + np.cumsum(lengths, dtype=np.int64)
        at, begin = ends - lengths, int(ends[-1])
        ranks = data[at].astype(np.uint32)
        for j in (1, 2, 3):
            longer = np.flatnonzero(lengths > j)
            ranks[longer] |= data[at[longer] + j].astype(np.uint32) << np.uint32(8 * j)
        out[k : k + step] = ranks
    return out


def encode_file(doc_ids: list[int | None], ids: list[np.ndarray], step: int = 1 << 18) -> bytes:
    flat = np.concatenate(ids)
    counts = np.zeros(int(flat.max(initial=0)) + 1, np.int64)
    for k in range(0, len(flat), step):
        counts += np.bincount(flat[k : k + step], minlength=len(counts))
    table = np.flatnonzero(counts)
    table = table[np.lexsort((table, -counts[table]))].astype("<u4")
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[table] = np.arange(len(table), dtype=np.uint32)
    step -= step % 4
    parts = [encode_ranks(rank_of[flat[k : k + step]]) for k in range(0, len(flat), step)]
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join(
        [HEAD.pack(MAGIC, len(doc_ids), len(flat), len(table)), table.tobytes()]
        + [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes()]
        + [np.array([len(x) for x in ids], "<u8").tobytes(), *[c for c, _ in parts], *[d for _, d in parts]]
    )


def decode_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids."""
    magic, docs, n, table_size = HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, count, at)
        at += out.nbytes
        return out

    table, doc_ids, null, lengths = take("<u4", table_size), take("<i8", docs), take("u1", docs), take("<u8", docs)
    control = take("u1", -(-n // 4))
    ranks = decode_ranks(control, take("u1", len(content) - at), n)
    return [None if x else int(d) for d, x in zip(doc_ids, null)], lengths.astype(np.int64), table[ranks]


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, ids_per_file: int = IDS_PER_FILE
) -> DataFrame:
    """Write the files to ``folder`` (any address that pyarrow opens) and return one row for each: name, part, number, docs, ids.

    A task writes a file under a name of its own and then renames it, so a task that
    is run again only replaces its files by equal ones.
    """
    path = tokenizer_path(tokenizer)
    end = np.array([end_id], np.uint32)
    columns = ["name", "part", "number", "docs", "ids"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, number, doc_ids, ids, held, coder = TaskContext.get().partitionId(), 0, [], [], 0, encoder(path, False)

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:06d}.ids"
            own = f"{root}/_{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(encode_file(doc_ids, ids))
            store.move(own, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, part, number, len(doc_ids), held)], columns)

        for batch in in_slices(batches):
            doc_ids += batch.column("doc_id").to_pylist()
            for own in coder.encode(batch.column("text").to_pylist()):
                ids.append(np.append(own, end))
                held += len(own) + 1
            if held >= ids_per_file:
                yield flush()
                number, doc_ids, ids, held = number + 1, [], [], 0
        if doc_ids:
            yield flush()

    ordered = docs.select("doc_id", text_of().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(write, "name string, part long, number long, docs long, ids long"))


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids`` (little-endian unsigned 32 bit)."""

    columns = ["doc_id", "name", "own_start", "n_tokens", "ids"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "content"):
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                doc_ids, lengths, ids = decode_file(content)
                ends = np.cumsum(lengths)
                for k in range(0, len(doc_ids), 1000):
                    a, b = (ends - lengths)[k : k + 1000], ends[k : k + 1000]
                    data = ids[a[0] : b[-1]].astype("<u4").tobytes()
                    held = [data[x:y] for x, y in zip((4 * (a - a[0])).tolist(), (4 * (b - a[0])).tolist())]
                    values = [pa.array(doc_ids[k : k + 1000], pa.int64()), pa.array([name] * len(a)), pa.array(a), pa.array(b - a), pa.array(held, pa.binary())]
                    yield pa.RecordBatch.from_arrays(values, columns)

    ahead = (Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids"))  # one row for a partition, whatever the number of files
    parts = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(*ahead)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(*ahead)), F.lit(0))
    bases = files.withColumn("own", own).join(F.broadcast(parts), "part").select("name", (F.col("own") + F.col("base")).alias("base"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    named = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = named.mapInArrow(decode, "doc_id long, name string, own_start long, n_tokens long, ids binary")
    return rows.join(bases, "name").select("doc_id", (F.col("own_start") + F.col("base")).alias("start"), "n_tokens", "ids")


def token_files(docs: DataFrame) -> DataFrame:
    """Write the corpus to token-id files in the shared folder and read them back."""
    spark, folder = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/ids"
    files = write_token_files(documents_of(docs, "doc_id", "text"), folder)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    return read_token_files(spark, folder, files)
