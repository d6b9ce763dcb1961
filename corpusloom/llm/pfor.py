"""Token-id files in patched frame-of-reference blocks.

A file holds segments of whole documents in ascending doc_id order. A segment is

    magic "PFR1", uint32 block size, uint64 documents, uint64 ids, uint64 blocks
    int64 doc_id[documents], uint8 doc_id is null[documents]
    uint64 first id of each document[documents + 1]
    uint64 first byte of each block[blocks + 1]     (the index)
    blocks: uint32 minimum, uint8 width, uint8 0, uint16 exceptions,
            the ids less the minimum, width bits each, in little-endian 64-bit words,
            uint16 place[exceptions], uint32 id less the minimum[exceptions]

all little-endian. A block's width is the one that holds the given percentile of
its values; larger ones are exceptions. Segments are rows (part, segment, ids,
payload) of a Parquet folder, so any store that Spark writes can hold them and a
lost task is written again as a whole.

Defined cases: a null or empty text is the end id alone; null doc_ids come
first; rows that repeat a doc_id are kept each, ordered by text; an empty table
writes files without segments. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import _arrays as A
from corpusloom.llm._store import bounded_batches
from corpusloom.llm._tokens import tokens

MAGIC = b"PFR1"
BLOCK = 512
PERCENTILE = 90
END = 2
CHUNK = 4 << 20
SEGMENT_IDS = 1 << 20
SEGMENTS = "part int, segment int, ids long, payload binary"
_HEAD = struct.Struct("<4sIQQQ")


def _width(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """rows x 64k values to rows x (8 * width * k) bytes."""
    groups = values.reshape(len(values), -1, 64)
    out = np.zeros((len(values), groups.shape[1], width), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, :, word] |= groups[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= groups[:, :, i] >> np.uint64(64 - shift)
    return out.astype("<u8").reshape(len(values), -1).view(np.uint8)


def _unpack(raw: np.ndarray, width: int, block: int) -> np.ndarray:
    words = raw.view("<u8").reshape(len(raw), block // 64, width)
    out = np.empty((len(raw), block // 64, 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        x = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, i] = x & mask
    return out.reshape(len(raw), block)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the blocks, first byte of each block) of 32-bit ids."""
    n = -(-len(ids) // block)
    grid = np.empty(n * block, np.uint64)
    grid[: len(ids)] = ids
    grid[len(ids) :] = ids[-1] if len(ids) else 0
    grid = grid.reshape(n, block)
    low = grid.min(axis=1) if n else np.zeros(0, np.uint64)
    grid = grid - low[:, None]
    at = max(0, -(-block * percentile // 100) - 1)
    width = _width(np.partition(grid, at, axis=1)[:, at]) if n else np.zeros(0, np.int64)
    over = grid >> width.astype(np.uint64)[:, None] != 0
    exceptions = over.sum(axis=1)
    size = 8 + block // 8 * width + 6 * exceptions
    index = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.zeros(index[-1], np.uint8)
    head = np.zeros((n, 8), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 4] = width
    head[:, 6:] = exceptions.astype("<u2").view(np.uint8).reshape(n, 2)
    out[index[:-1, None] + np.arange(8)] = head
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = _pack(grid[rows] & np.uint64((1 << w) - 1), w)
        out[(index[rows] + 8)[:, None] + np.arange(packed.shape[1])] = packed
    row, col = np.nonzero(over)
    if len(row):
        order = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(exceptions)[:-1]]), exceptions)
        place = (index[:-1] + 8 + block // 8 * width)[row] + 2 * order
        out[place[:, None] + np.arange(2)] = col.astype("<u2").view(np.uint8).reshape(-1, 2)
        place = (index[:-1] + 8 + block // 8 * width + 2 * exceptions)[row] + 4 * order
        out[place[:, None] + np.arange(4)] = grid[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, index


def decode_blocks(raw: np.ndarray, index: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The ids of whole blocks; index: the first byte of each, and the end."""
    n = len(index) - 1
    head = raw[index[:-1, None] + np.arange(8)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0].astype(np.uint64)
    width = head[:, 4].astype(np.int64)
    exceptions = np.ascontiguousarray(head[:, 6:]).view("<u2")[:, 0].astype(np.int64)
    grid = np.zeros((n, block), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        grid[rows] = _unpack(raw[(index[rows] + 8)[:, None] + np.arange(block // 8 * w)], w, block)
    if exceptions.any():
        row = np.repeat(np.arange(n), exceptions)
        order = A.ragged(np.zeros(n, np.int64), exceptions)
        body = index[:-1] + 8 + block // 8 * width
        col = raw[(body[row] + 2 * order)[:, None] + np.arange(2)].view("<u2")[:, 0]
        grid[row, col] = raw[((body + 2 * exceptions)[row] + 4 * order)[:, None] + np.arange(4)].view("<u4")[:, 0]
    return (grid + low[:, None]).reshape(-1)[:n_ids].astype(np.uint32)


def encode_segment(doc_ids: np.ndarray, nulls: np.ndarray, offsets: np.ndarray, ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> bytes:
    body, index = encode_blocks(ids, block, percentile)
    head = _HEAD.pack(MAGIC, block, len(doc_ids), len(ids), len(index) - 1)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), offsets.astype("<u8").tobytes(), index.astype("<u8").tobytes(), body.tobytes()])


def decode_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, which are null, offsets, ids); ValueError if it isn't a segment."""
    magic, block, docs, n_ids, blocks = _HEAD.unpack_from(payload) if len(payload) >= _HEAD.size else (b"",) * 5
    if magic != MAGIC:
        raise ValueError("not a PFR1 segment")
    raw, at = np.frombuffer(payload, np.uint8), _HEAD.size

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(dtype).itemsize * n
        if at + size > len(raw):
            raise ValueError("a PFR1 segment is cut short")
        at += size
        return np.frombuffer(payload, dtype, n, at - size)

    doc_ids, nulls = take("<i8", docs), take("u1", docs).astype(bool)
    offsets, index = take("<u8", docs + 1).astype(np.int64), take("<u8", blocks + 1).astype(np.int64)
    if at + index[-1] > len(raw):
        raise ValueError("a PFR1 segment is cut short")
    return doc_ids, nulls, offsets, decode_blocks(raw[at:], index, n_ids, block)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encode every whole text, close it by the end id and write segments in ascending doc_id order to path.

    The texts are range-partitioned by doc_id; a task holds one segment at a time.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = tokens(tokenizer, end), TaskContext.get().partitionId(), 0
        doc_ids, nulls, sizes, ids, n = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            payload = encode_segment(np.concatenate(doc_ids), np.concatenate(nulls), offsets, np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([n]), pa.array([payload], pa.binary())], ["part", "segment", "ids", "payload"])

        for batch in A.slices(batches, "text", CHUNK):
            got, off = encoder.encode(*A.utf8(batch.column("text")))
            column = batch.column("doc_id")
            nulls.append(column.is_null().to_numpy(zero_copy_only=False))
            doc_ids.append(column.fill_null(0).to_numpy())
            sizes.append(np.diff(off))
            ids.append(got)
            n += len(got)
            if n >= SEGMENT_IDS:
                yield close()
                doc_ids, nulls, sizes, ids, n, number = [], [], [], [], 0, number + 1
        if ids:
            yield close()

    sorted_rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    sorted_rows.mapInArrow(segments, SEGMENTS).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids before it), n_tokens, ids (little-endian unsigned 32-bit).

    Starts come from the ids of each part (one number a part to the driver) and
    a running sum over a part's segments.
    """
    found = spark.read.schema(SEGMENTS).parquet(path)
    sizes = found.groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for r in sizes:
        before[r["part"]] = total
        total += r["n"]
    running = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = found.select("part", "segment", "ids").select("part", "segment", running.alias("within"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, within, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "within", "payload")), strict=True):
                doc_ids, nulls, offsets, ids = decode_segment(payload)
                raw = pa.Array.from_buffers(pa.large_binary(), len(doc_ids), [None, pa.py_buffer((4 * offsets).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                for a in range(0, len(doc_ids), 1024):
                    to = min(a + 1024, len(doc_ids))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[a:to], pa.int64(), mask=nulls[a:to]), pa.array(before[part] + within + offsets[a:to]), pa.array(np.diff(offsets)[a:to]), raw[a:to].cast(pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return found.drop("ids").join(starts, ["part", "segment"]).select("part", "within", "payload").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def digest(ids: bytes) -> int:
    """What Spark's crc32 gives for a document's ids."""
    return zlib.crc32(ids)
