"""Token ids in binary files with shuffled planes.

The documents are dealt out by ranges of their ids; each range, of about ``FILE_BYTES`` of text at most,
is a part with a file of its own, so no file outgrows a task.  A file is a row of segments.  A segment
holds whole documents: its head, an index of its documents (id, null mark, number of ids), an index of
its chunks and the chunks.  A chunk is a block of at most
``BLOCK`` ids, transposed into 32 bit planes or 4 byte planes, each compressed by zstandard; planes
of zeros take no space.  Beside the files of segments a small table holds the number of ids of each
part, so that readers know where a part begins without a look at the others.  Files are written by Spark's own writer and committed by it, so a lost
executor leaves no half file, and any store that Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.common import quoted, shared_path, text_slices
from pairloom.llm.tokens import default_path, encoder
from pairloom.session import exists

#: Ids of a block, and of a segment before it is closed.
BLOCK, SEGMENT_IDS = 1 << 16, 1 << 20
#: Bytes of text whose ids make a file.
FILE_BYTES = 128 << 20
MAGIC = b"PLNS"
#: magic, part, ids of the part before this segment, documents, ids, bytes of the document index, chunks, planes (4 or 32), bytes of all
HEAD = struct.Struct("<4sIQIQIIIQ")


def shuffle(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block, lowest first."""
    columns = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    if not bits:
        return [c.tobytes() for c in columns]
    return [np.packbits(columns[b // 8] >> (b % 8) & 1).tobytes() for b in range(32)]


def unshuffle(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids of a block; an empty plane holds zeros."""
    columns = np.zeros((4, n), np.uint8)
    for k, plane in enumerate(planes):
        if plane and bits:
            columns[k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << (k % 8)
        elif plane:
            columns[k] = np.frombuffer(plane, np.uint8)
    return np.ascontiguousarray(columns.T).view("<u4").ravel()


def segment(part: int, first: int, doc_ids: list, counts: list[int], ids: np.ndarray, bits: bool = False) -> bytes:
    """The bytes of a segment."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(counts, "<i8").tobytes() + known.tobytes()
    docs, sizes, chunks = squeeze(docs), [], []
    for k in range(0, len(ids), BLOCK):
        for plane in shuffle(ids[k : k + BLOCK], bits):
            chunks.append(squeeze(plane) if any(plane) else b"")
            sizes.append(len(chunks[-1]))
    body = docs + np.array(sizes, "<u4").tobytes() + b"".join(chunks)
    head = HEAD.pack(MAGIC, part, first, len(doc_ids), len(ids), len(docs), -(-len(ids) // BLOCK), 32 if bits else 4, len(body))
    return head + body


def segments(data: bytes) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """(part, ids of the part before, document ids, counts, ids) of each segment of a file."""
    expand, at = zstandard.ZstdDecompressor().decompress, 0
    while at < len(data):
        magic, part, first, n_docs, n_ids, n_index, n_chunks, planes, size = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no segment begins at byte {at}")
        at += HEAD.size
        index = expand(data[at : at + n_index])
        docs, counts = np.frombuffer(index, "<i8", 2 * n_docs).reshape(2, -1)
        known = np.frombuffer(index, np.uint8, offset=16 * n_docs)
        sizes = np.frombuffer(data, "<u4", n_chunks * planes, at + n_index)
        ends = at + n_index + sizes.nbytes + np.cumsum(sizes, dtype=np.int64)
        blocks = []
        for c in range(n_chunks):
            own = range(c * planes, (c + 1) * planes)
            raw = [expand(data[ends[k] - sizes[k] : ends[k]]) if sizes[k] else b"" for k in own]
            blocks.append(unshuffle(raw, min(BLOCK, n_ids - c * BLOCK), planes == 32))
        yield part, first, [int(d) if k else None for d, k in zip(docs, known, strict=True)], counts, np.concatenate([np.zeros(0, "<u4"), *blocks])
        at += size + 1  # Spark's writer ends each segment with a line end


def write_tokens(
    docs: DataFrame, out: str, path: str | None = None, end_id: int = 0, bits: bool = False, text: str = "text", file_bytes: int = FILE_BYTES
) -> None:
    """Encode all documents and write their ids, in ascending order of doc_id (nulls first, ties by text).

    The table is dealt out by ranges of doc_id, and each range becomes a file; rows of one doc_id may
    be in several files.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_run, part = encoder(path or default_path()), TaskContext.get().partitionId()
        doc_ids: list = []
        counts: list[int] = []
        ids: list[np.ndarray] = []
        held = done = 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, end, flat, at in text_slices(batch.column(1)):
                found, n = encode_run.encode(flat, at)
                doc_ids += names[row:end]
                counts += (n + 1).tolist()
                ids.append(np.insert(found, np.cumsum(n), end_id))
                held += len(ids[-1])
                if held >= SEGMENT_IDS:
                    yield line("segments", segment(part, done, doc_ids, counts, np.concatenate(ids), bits))
                    done += held
                    doc_ids, counts, ids, held = [], [], [], 0
        if doc_ids:
            yield line("segments", segment(part, done, doc_ids, counts, np.concatenate(ids), bits))
        if done + held:
            yield line("parts", f"{part} {done + held}".encode())

    def line(kind: str, value: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([value], pa.binary())], ["kind", "value"])

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), quoted(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(-(-total // file_bytes), spark.sparkContext.defaultParallelism)
    # the last key deals out rows that are equal in all else
    keyed = rows.withColumns({"__h": F.xxhash64("text"), "__r": F.rand(7)})
    ranges = keyed.repartitionByRange(files, "doc_id", "__h", "__r").sortWithinPartitions("doc_id", "__h", "text").select("doc_id", "text")
    lines = ranges.mapInArrow(encode, "kind string, value binary").select("kind", F.col("value").cast("string").alias("value"))
    lines.write.mode("overwrite").option("compression", "none").partitionBy("kind").text(out)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the files of ``write_tokens``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for part, first, docs, counts, found in segments(memoryview(data.as_buffer())):
                    ends = np.cumsum(counts)
                    raw = [found[b - n : b].tobytes() for b, n in zip(ends, counts, strict=True)]
                    columns = [
                        pa.array(np.full(len(docs), part, np.int32)),
                        pa.array(docs, pa.int64()),
                        pa.array(first + ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.array(raw, pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)

    names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    if not exists(spark, f"{path}/kind=parts"):  # no documents
        return spark.createDataFrame([], schema).drop("part")
    rows = spark.read.format("binaryFile").load(f"{path}/kind=segments").select("content").mapInArrow(decode, schema)
    fields = F.split("value", " ")
    sizes = spark.read.text(f"{path}/kind=parts").select(fields[0].cast("int").alias("part"), fields[1].cast("long").alias("n"))  # one row for each file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = rows.join(F.broadcast(bases), "part")
    return out.select("doc_id", (F.col("start") + F.col("base")).alias("start"), *names[3:])


def token_file_digests(docs: DataFrame) -> DataFrame:
    """Write the ids of all documents to files, read these back and digest each document's ids.

    A null or empty text is the end id alone; repeated rows stay; an empty table gives no rows.
    """
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return read_tokens(docs.sparkSession, path)
