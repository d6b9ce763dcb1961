"""Substring dedup by relative Lempel-Ziv parsing against every indexed reference block.

The corpus in doc_id order is cut into blocks; a block is the reference text of
its words and is indexed by the 64-bit hashes of its windows of ``window`` words.
The indexes of all blocks are exchanged by ranges of the hash (a block sends each
of its distinct windows once, so a passage that a third of all documents hold
costs one entry a block), and each window learns the earliest block and place
that hold it. A document is then factored greedily: from a position whose window
occurs earlier, the factor follows that reference as long as it matches; a factor
ends where the reference stops matching, and the windows across that boundary
are looked up in all blocks as well, so the next factor may start inside the
last one. Factors, at least a window long, are the duplicate spans.

Defined cases: a null text has no words; texts shorter than a window have no
duplicates; rows are ordered by doc_id (nulls last), then by a hash of the text;
rows equal in doc_id and text are one document; an empty table gives an empty
result. Only the columns asked for are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _arrays as A
from corpusloom.llm._store import bounded_batches

WINDOW = 20
CHUNK = 4 << 20
BLOCK_WORDS = 1 << 20
LAST = np.iinfo(np.int64).max
_EXCHANGE = "shard int, block long, low long, kind int, payload binary"
_FACTORS = "doc_id long, key long, start array<int>, length array<int>, ref_block array<long>, ref_start array<int>"


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<I", len(arrays))]
    for x in arrays:
        name = x.dtype.newbyteorder("<").str.encode()
        parts += [struct.pack("<4sQ", name.ljust(4), x.size), np.ascontiguousarray(x).tobytes()]
    return b"".join(parts)


def _unpack(raw: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        name, size = struct.unpack_from("<4sQ", raw, at)
        at += 12
        x = np.frombuffer(raw, name.decode().strip(), size, at)
        at += x.nbytes
        out.append(x)
    return out


def _pack_index(hashes: np.ndarray, places: np.ndarray, base: int) -> bytes:
    """Ascending hashes of one range and their places, about nine bytes an entry."""
    gaps = np.diff(hashes, prepend=np.uint64(base))
    if int(gaps.max()) >> 48 or int(places.max()) >> 24:
        return _pack(gaps, places.astype(np.uint32))
    return _pack((gaps & np.uint64(0xFFFFFFFF)).astype(np.uint32), (gaps >> np.uint64(32)).astype(np.uint16), (places & 0xFFFF).astype(np.uint16), (places >> 16).astype(np.uint8))


def _unpack_index(raw: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
    parts = _unpack(raw)
    if len(parts) == 2:
        gaps, places = parts
    else:
        gaps = parts[0].astype(np.uint64) | parts[1].astype(np.uint64) << np.uint64(32)
        places = parts[2].astype(np.uint32) | parts[3].astype(np.uint32) << np.uint32(16)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base), places


def _index(window: int, shard_bits: int):
    """Blocks of a partition: their index entries by range of the hash, and one row of their documents and inner repeats."""
    shift = np.uint64(64 - shard_bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, last = TaskContext.get().partitionId(), 0, None
        ids, keys, counts, words, n = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            block = part << 24 | number
            sizes, flat = np.concatenate(counts), np.concatenate(words)
            at, _ = A.windows(sizes, window)
            h = A.ngram_hash(flat, window)[at] if len(at) else np.zeros(0, A.U64)
            order = np.argsort(h)
            h, at = h[order], at[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            begin = np.flatnonzero(new)
            first = np.minimum.reduceat(at, begin) if len(at) else at
            source = np.repeat(first, np.diff(np.append(begin, len(h))))
            again = at != source
            doc_ids, distinct = np.concatenate(ids), h[begin]
            low = int(doc_ids[0])
            documents = _pack(doc_ids, np.concatenate(keys), sizes.astype(np.uint32), at[again].astype(np.uint32), source[again].astype(np.uint32))
            out = [(block % (1 << shard_bits), 0, documents)]
            shards = (distinct >> shift).astype(np.int64)
            cuts = np.flatnonzero(np.diff(shards, prepend=-1))
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(shards)).tolist(), strict=True):
                s = int(shards[a])
                out.append((s, 1, _pack_index(distinct[a:b], first[a:b], s << int(shift))))
            k = len(out)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([block] * k), pa.array([low] * k), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())],
                ["shard", "block", "low", "kind", "payload"],
            )

        for batch in A.slices(batches, "text", CHUNK):
            doc_id = batch.column("doc_id").fill_null(LAST).to_numpy()
            key = batch.column("key").to_numpy()
            fresh = np.ones(len(key), bool)
            fresh[1:] = (doc_id[1:] != doc_id[:-1]) | (key[1:] != key[:-1])
            fresh[0] = (doc_id[0], key[0]) != last
            last = doc_id[-1], key[-1]
            if not fresh.all():
                batch = batch.filter(pa.array(fresh))
                doc_id, key = doc_id[fresh], key[fresh]
            if not len(key):
                continue
            data, off = A.utf8(batch.column("text"))
            starts, ends = A.spans(data, off)
            words.append(A.span_hash(data, starts, ends))
            counts.append(np.diff(np.searchsorted(starts, off)))
            ids.append(doc_id)
            keys.append(key)
            n += len(words[-1])
            if n >= BLOCK_WORDS:
                yield close()
                ids, keys, counts, words, n, number = [], [], [], [], 0, number + 1
        if ids:
            yield close()

    return rows


def _match(shard_bits: int):
    """One range of the hash: the entries of all blocks in corpus order; all but the first of a window go back with the first's place."""

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        base = int(key[0].as_py()) << (64 - shard_bits)
        out, entries = [], []
        for block, low, kind, payload in zip(*(table.column(c).to_pylist() for c in ("block", "low", "kind", "payload")), strict=True):
            if kind == 0:
                out.append((block, 0, payload))
            else:
                entries.append((low, block, payload))
        if len(entries) > 1:
            entries.sort(key=lambda x: x[:2])
            blocks = np.array([x[1] for x in entries], np.int64)
            parts = [_unpack_index(x[2], base) for x in entries]
            h = np.concatenate([x[0] for x in parts])
            place = np.concatenate([x[1] for x in parts])
            of = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(x[0]) for x in parts])
            order = np.argsort(h, kind="stable")
            h = h[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))[~new]]
            again = order[~new]
            for b in np.unique(of[again]).tolist():
                mine = of[again] == b
                refs, ref = np.unique(of[first[mine]], return_inverse=True)
                out.append((int(blocks[b]), 1, _pack(place[again[mine]].astype(np.uint32), blocks[refs], ref.astype(np.uint16 if len(refs) < 65536 else np.uint32), place[first[mine]].astype(np.uint32))))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "kind": pa.array([x[1] for x in out], pa.int32()), "payload": pa.array([x[2] for x in out], pa.binary())})

    return shard


def _factor(window: int):
    """One block: the greedy factors of its documents."""

    def block(key: tuple, table: pa.Table) -> pa.Table:
        me = int(key[0].as_py())
        docs, at, ref_block, ref_at = None, [], [], []
        for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
            got = _unpack(payload)
            if kind == 0:
                docs = got[:3]
                at.append(got[3].astype(np.int64))
                ref_block.append(np.full(len(got[3]), me, np.int64))
                ref_at.append(got[4].astype(np.int64))
            else:
                at.append(got[0].astype(np.int64))
                ref_block.append(got[1][got[2]])
                ref_at.append(got[3].astype(np.int64))
        place = np.concatenate(at)
        order = np.argsort(place)
        place, source, begin = place[order], np.concatenate(ref_block)[order], np.concatenate(ref_at)[order]
        doc_ids, keys, sizes = docs
        off = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) != 1) | (np.diff(source) != 0) | (np.diff(begin) != 1)
        cut = np.flatnonzero(new)
        length = np.diff(np.append(cut, len(place))) + window - 1
        doc = np.searchsorted(off, place[cut], "right") - 1
        bounds = np.searchsorted(doc, np.arange(len(sizes) + 1))
        has = np.flatnonzero(np.diff(bounds))
        lists = pa.array(np.append(bounds[has], len(cut)), pa.int32())
        return pa.table(
            {
                "doc_id": pa.array(doc_ids[has], pa.int64(), mask=doc_ids[has] == LAST),
                "key": pa.array(keys[has], pa.int64()),
                "start": pa.ListArray.from_arrays(lists, pa.array(place[cut] - off[doc], pa.int32())),
                "length": pa.ListArray.from_arrays(lists, pa.array(length, pa.int32())),
                "ref_block": pa.ListArray.from_arrays(lists, pa.array(source[cut], pa.int64())),
                "ref_start": pa.ListArray.from_arrays(lists, pa.array(begin[cut], pa.int32())),
            }
        )

    return block


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rest = [F.col(c) for c in columns if c not in ("doc_id", "text")]
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), text.alias("text"), *rest)


def factors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The factors of every document that has any: doc_id, key, and arrays start, length (words), ref_block, ref_start.

    A block is named by its partition and number; ref_start counts its words.
    Texts are shuffled only where doc_id ranges of the partitions overlap.
    """
    bounded_batches(docs.sparkSession)
    rows = _keyed(docs)
    order = [F.col("doc_id").asc_nulls_last(), "key"]
    ranges = rows.groupBy(F.spark_partition_id().alias("part")).agg(
        F.min(F.coalesce("doc_id", F.lit(int(LAST)))).alias("low"), F.max(F.coalesce("doc_id", F.lit(int(LAST)))).alias("high"), F.sum(F.octet_length("text")).alias("size")
    )
    found = sorted((r["low"], r["high"], r["size"] or 0) for r in ranges.collect())
    if any(a[1] >= b[0] for a, b in zip(found, found[1:], strict=False)):
        rows = rows.repartitionByRange(*order)
    shard_bits = max(6, (sum(x[2] for x in found) // 6 // BLOCK_WORDS).bit_length())
    entries = rows.sortWithinPartitions(*order).mapInArrow(_index(window, shard_bits), _EXCHANGE)
    back = entries.groupBy("shard").applyInArrow(_match(shard_bits), "block long, kind int, payload binary")
    return back.groupBy("block").applyInArrow(_factor(window), _FACTORS)


def _cutter(layout: bool):
    def cut(texts: pa.Array, starts: pa.Array, lengths: pa.Array) -> pa.Array:
        out = pa.concat_arrays([_cut(texts.slice(a, b - a), starts.slice(a, b - a), lengths.slice(a, b - a), layout) for a, b in _pieces(texts)])
        A.release()
        return out

    return cut


def _pieces(texts: pa.Array) -> list[tuple[int, int]]:
    _, off = A.utf8(texts)
    at, out = 0, []
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK, "right")) - 1)
        out.append((at, to))
        at = to
    return out or [(0, 0)]


def _cut(texts: pa.Array, starts: pa.Array, lengths: pa.Array, layout: bool) -> pa.Array:
    data, off = A.utf8(texts)
    begin, end = A.spans(data, off)
    first = np.searchsorted(begin, off)
    per = starts.value_lengths().fill_null(0).to_numpy()
    base = np.repeat(first[:-1], per)
    step = np.zeros(len(begin) + 1, np.int64)
    s, n = starts.flatten().to_numpy(), lengths.flatten().to_numpy()
    np.add.at(step, base + s, 1)
    np.add.at(step, base + s + n, -1)
    kept = np.cumsum(step[:-1]) == 0
    n_kept = A.totals(kept, first)
    word = np.zeros(len(data) + 1, np.int8)
    if layout:  # a removed word goes with what stands between it and the next word
        following = np.append(begin[1:], len(data))
        following = np.minimum(following, off[np.searchsorted(off, begin, "right")]) if len(begin) else following
        np.add.at(word, begin[~kept], 1)
        np.add.at(word, following[~kept], -1)
        mask = np.cumsum(word[:-1], dtype=np.int8) == 0
        out, sizes = data[mask], A.totals(mask, off)
    else:
        b, e = begin[kept], end[kept]
        np.add.at(word, b, 1)
        np.add.at(word, e, -1)
        mask = np.cumsum(word[:-1], dtype=np.int8) != 0
        last = np.cumsum(e - b + 1) - 1
        out = np.full(int(last[-1]) + 1 if len(last) else 0, 0x20, np.uint8)
        body = np.ones(len(out), bool)
        body[last] = False
        out[body] = data[mask]
        final = np.cumsum(n_kept)[n_kept > 0] - 1
        body[:] = True
        body[last[final]] = False
        out = out[body]
        chars = np.concatenate([[0], np.cumsum(e - b)])
        ends = np.cumsum(n_kept)
        sizes = chars[ends] - chars[ends - n_kept] + np.maximum(n_kept - 1, 0)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    text = pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(out)))
    return pa.StructArray.from_arrays([pa.array(np.diff(first)), pa.array(np.diff(first) - n_kept), text], ["n_words", "n_removed", "text"])


def remove_duplicates(docs: DataFrame, window: int = WINDOW, layout: bool = False, columns: tuple[str, ...] = ()) -> DataFrame:
    """Every document without the words of its factors: doc_id, the columns asked for, text, n_words, n_removed.

    text: the kept words joined by one space, or with layout the kept words and
    what stands after each of them.
    """
    # as nondeterministic it runs once, whatever filters stand on its fields
    cut = F.arrow_udf(_cutter(layout), "struct<n_words: long, n_removed: long, text: string>").asNondeterministic()
    found = factors(docs, window).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("start").alias("_start"), F.col("length").alias("_length"))
    rows = _keyed(docs, *columns)
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["key"] == found["_key"]), "left")
    return joined.withColumn("_cut", cut("text", "_start", "_length")).select("doc_id", *(c for c in columns if c not in ("doc_id", "text")), F.col("_cut.text").alias("text"), F.col("_cut.n_words").alias("n_words"), F.col("_cut.n_removed").alias("n_removed"))
