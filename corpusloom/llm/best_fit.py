"""Best-fit packing of tokenised documents into sequences, bulk-synchronously.

Documents (ids of the text, then an end id) longer than a sequence are cut;
all pieces are range-sorted by length. Rounds go from the longest length to the
shortest: the pieces of a round sweep the gaps upwards from their own length
(best fit), conflicts are resolved by rank (the r-th piece takes the r-th bin
of the sweep), and the gaps are updated for the next round. Gaps are kept as
runs of bins of one size, of which there are at most as many as tokens in a
sequence, so a round costs the same however many documents there are; each
partition then looks up its own ranks.

Defined cases: a null or empty text is the end id alone; equal lengths are
ranked by doc_id (nulls first), then piece; rows that repeat a doc_id are
packed each; an empty table packs into nothing. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _arrays as A
from corpusloom.llm._store import bounded_batches, keep
from corpusloom.llm._tokens import tokens

CAPACITY = 2048
END = 0
CHUNK = 4 << 20


def _cut(path: str, end: int, capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(path, end)
        for batch in A.slices(batches, "text", CHUNK):
            ids, off = encoder.encode(*A.utf8(batch.column("text")))
            size = np.diff(off)
            per = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), per)
            piece = A.ragged(np.zeros(len(per), np.int64), per)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            raw = memoryview(ids.astype("<u4").tobytes())
            at = 4 * (off[row] + start)
            crc = [zlib.crc32(raw[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return pieces


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the rank among its pieces of the same length; the rows come sorted by length."""
    part, last, seen = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        length = batch.column("length").to_numpy()
        if not len(length):
            continue
        new = np.concatenate([[True], length[1:] != length[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(length)), 0))
        rank = np.arange(len(length)) - begin
        if length[0] == last:
            rank[length == last] += seen
        last, seen = length[-1], rank[-1] + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part), pa.int32()), pa.array(rank, pa.int64())], [*batch.schema.names, "part", "rank"])


def best_fit_runs(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """The packing of counts[length] pieces: rows (length, first rank, pieces, first bin, offset), and the number of bins.

    The pieces rank, rank + 1, ... of a row go to the bins bin, bin + 1, ... at
    the same offset.
    """
    gaps: list[int] = []
    bins: dict[int, list[tuple[int, int]]] = {}
    runs, opened = [], 0

    def free(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in bins:
                insort(gaps, gap)
                bins[gap] = []
            bins[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank, made = counts[length], 0, []

        def fill(gap: int, first: int, n: int, each: int) -> None:
            nonlocal rank, left
            for k in range(each):
                runs.append((length, rank, n, first, capacity - gap + k * length))
                rank += n
            left -= n * each
            made.append((gap - each * length, first, n))

        at = bisect_left(gaps, length)
        while left and at < len(gaps):
            gap = gaps[at]
            most = gap // length
            while left and bins[gap]:
                first, n = bins[gap].pop(0)
                whole = min(n, left // most)
                if whole:
                    fill(gap, first, whole, most)
                if whole < n and left and left < most:
                    fill(gap, first + whole, 1, left)
                    whole += 1
                if whole < n:
                    bins[gap].insert(0, (first + whole, n - whole))
            if bins[gap]:
                break
            del bins[gap], gaps[at]
        most = capacity // length
        if left:
            whole, rest = divmod(left, most)
            if whole:
                fill(capacity, opened, whole, most)
                opened += whole
            if rest:
                fill(capacity, opened, 1, rest)
                opened += 1
        for gap, first, n in made:
            free(gap, first, n)
    return np.array(runs, np.int64).reshape(-1, 5), opened


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The texts are read once and not shuffled. What comes to the driver is the
    number of pieces by length (capacity rows at most) and by partition and
    length (rows: the partitions plus capacity at most).
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = keep(rows.mapInArrow(_cut(tokenizer, end, capacity), cut), "pieces")
    ranked = pieces.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece", "start")
    ranked = keep(ranked.mapInArrow(_number, cut + ", part int, rank long"), "ranked")
    table = sorted((r["length"], r["part"], r["n"]) for r in ranked.groupBy("length", "part").agg(F.count("*").alias("n")).collect())
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for length, part, n in table:
        before[part, length] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    runs, _ = best_fit_runs(counts, capacity)
    span = max([0, *counts.values()]) + 1
    keys = runs[:, 0] * span + runs[:, 1]
    order = np.argsort(keys)
    keys, runs = keys[order], runs[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length, part = batch.column("length").to_numpy(), batch.column("part").to_numpy()
            both = part.astype(np.int64) * (capacity + 1) + length
            seen, inverse = np.unique(both, return_inverse=True)
            base = np.array([before[int(x) // (capacity + 1), int(x) % (capacity + 1)] for x in seen], np.int64)
            rank = base[inverse] + batch.column("rank").to_numpy()
            run = np.searchsorted(keys, length * span + rank, "right") - 1
            columns = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"]).columns
            sequence = runs[run, 3] + rank - runs[run, 1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(runs[run, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, cut + ", sequence_id long, offset long")
