"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

A document's shingles are its runs of five words (a shorter document is one
shingle), weighted by their count times ln(1 + N / max(df, share * N)), df being
the number of documents that hold the shingle. With a ``share`` of 0, as the
queries use it, every df is counted: blocks of documents send each of their
distinct shingles once to its range of the hash, where the blocks' counts are
added, and the sums go back to the blocks, which sign their documents and write
each document's dfs beside its samples. With a greater share, df below that share
doesn't change a weight, so only shingles that at least that share holds have to
be known, of which there are at most the mean number of shingles divided by
share. They are found exactly in two passes: one of them has that share in at
least one block of documents, and every block then counts those candidates. Each
document is sampled ``BANDS * ROWS`` times; documents that agree in all samples of
a band are compared by exact weighted Jaccard similarity, and distributed
union-find joins those at or above the threshold.

Defined cases: documents with the same words are one class whatever their white
space; a text without words (null too) is near no other and is kept; a cluster
is named by, and keeps, its first document by doc_id (nulls last), then by a hash
of the text; rows equal in doc_id and text are one document; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _arrays as A
from corpusloom.llm._store import Scope, attach, bounded_batches, components, hot, in_set, keep, linked
from corpusloom.llm.rlz import _pack, _unpack

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 10
ROWS = 3
SHARE = 0.05
CHUNK = 4 << 20
BLOCK_BYTES = 4 << 20  # text of a block whose shingles are counted together
SHARD_WORDS = 1 << 21
_BITS = 53  # of a shingle's hash
_DOCS = 2048  # documents of a block: their number fits in the low 11 bits beside a 53-bit shingle
_WORDS = 1 << 21
_PAGE = 1 << 23  # bits of the candidates' bitmap
_BINS = 512  # sums of weights that bound a pair's similarity
_FULL = 65535  # a bin that holds more than its unit can tell


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """The quantiles of the Gamma(2, 1) distribution at (i + 1/2) / n."""
    x = np.concatenate([np.geomspace(1e-4, 1, 20_000, endpoint=False), np.linspace(1, 30, 80_000)])
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


def shingles(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle, each document's first shingle, words of each document, hash of its word sequence)."""
    starts, ends = A.spans(data, off)
    words = A.span_hash(data, starts, ends)
    first = np.searchsorted(starts, off)
    counts = np.diff(first)
    whole = A.run_hash(words, first[:-1], first[1:])
    at, per = A.windows(counts, n)
    short = (counts > 0) & (per == 0)
    size = per + short
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(offsets[-1], A.U64)
    body = np.ones(len(out), bool)
    body[offsets[:-1][short]] = False
    out[body] = A.ngram_hash(words, n)[at] if len(at) else np.zeros(0, A.U64)
    out[~body] = whole[short]
    return out, offsets, counts, whole


def _profile(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 53-bit shingle, count) of the distinct shingles of up to 2048 documents, by document and shingle."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=A.U64), np.diff(offsets))
    both = np.sort(doc << A.U64(53) | hashes >> A.U64(11))
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(both)))
    both = both[new]
    return (both >> A.U64(53)).astype(np.int64), both & A.U64((1 << 53) - 1), count


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in A.slices(batches, "text", CHUNK):
        for a in range(0, batch.num_rows, _DOCS):
            yield batch.slice(a, min(_DOCS, batch.num_rows - a))


def _document_counts(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a block and the number of its documents that hold each."""
    h = np.sort(_profile(hashes, offsets)[1])
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[new], np.diff(np.append(new, len(h)))


def _candidates(share: float):
    """Shingles that at least share of a block's documents hold. Blocks have about a thousand documents, the last one of a
    partition goes with the one before: in a block of a few documents every shingle would be a candidate."""

    def found(block: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.concatenate([np.diff(x[1]) for x in block])
        h, n = _document_counts(np.concatenate([x[0] for x in block]), np.concatenate([[0], np.cumsum(sizes)]))
        return pa.RecordBatch.from_arrays([pa.array(h[n >= share * len(sizes)].view(np.int64))], ["h"])

    def documents(block: list[tuple[np.ndarray, np.ndarray]]) -> int:
        return sum(len(x[1]) - 1 for x in block)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, block = [], []
        for batch in _blocks(batches):
            for a in range(0, batch.num_rows, _DOCS // 4):
                block.append(shingles(*A.utf8(batch.column("text").slice(a, _DOCS // 4)))[:2])
                if documents(block) >= _DOCS // 4 or sum(len(x[0]) for x in block) >= _WORDS:
                    if before:
                        yield found(before)
                    before, block = block, []
        if before and documents(before) + documents(block) <= _DOCS:
            before, block = before + block, []
        for b in (before, block):
            if b:
                yield found(b)

    return rows


def _counts(bitmap: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            hashes, offsets, _, _ = shingles(*A.utf8(batch.column("text")))
            h, n = _document_counts(hashes, offsets)
            at = (h % A.U64(_PAGE)).astype(np.int64)
            hit = bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pa.array(n[hit])], ["h", "n"])

    return rows


def frequent_shingles(rows: DataFrame, share: float = SHARE) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingles that at least share of the documents hold, ascending; their document frequencies; the number of documents)."""
    total = rows.count()
    text = rows.select("text")
    found = text.mapInArrow(_candidates(share), "h long").select(F.expr(f"h % {_PAGE}L").alias("at"))
    pages = found.groupBy(F.expr("bitmap_bucket_number(at)").alias("page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits")).collect()
    bitmap = np.zeros(_PAGE // 8, np.uint8)
    for r in pages:
        bitmap[(r["page"] - 1) * 4096 : r["page"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    counted = text.mapInArrow(_counts(bitmap), "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))
    often = sorted((r["h"], r["df"]) for r in counted.where(F.col("df") >= share * total).collect())
    return np.array([x[0] for x in often], np.int64).astype(A.U64), np.array([x[1] for x in often], np.float64), total


def _weights(shingle: np.ndarray, count: np.ndarray, often: tuple[np.ndarray, np.ndarray, int], share: float) -> np.ndarray:
    h, df, total = often
    held = np.full(len(shingle), share * total)
    if len(h):
        at = np.minimum(np.searchsorted(h, shingle), len(h) - 1)
        held = np.where(h[at] == shingle, df[at], held)
    return _weigh(count, held, total)


def _weigh(count: np.ndarray, df: np.ndarray, total: int) -> np.ndarray:
    return count * np.log1p(total / np.maximum(df, 1e-9))


def _samples(shingle: np.ndarray, weight: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of each non-empty document: documents x n."""
    quantile = _gamma_quantiles()
    log_quantile = np.log(quantile)
    log_weight = np.log(weight).astype(np.float32)
    index = np.arange(len(shingle), dtype=A.U64)
    out = np.empty((len(bounds), n), A.U64)
    for k, seed in enumerate(A.constants(83, n)):
        z = A.mix(shingle ^ seed)
        r = quantile[z & A.U64(0xFFFF)]
        c = log_quantile[z >> A.U64(16) & A.U64(0xFFFF)]
        beta = (z >> A.U64(32) & A.U64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_weight / r + beta)
        a = (c - r * (t - beta + np.float32(1))).astype(np.float32)
        bits = a.view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        least = np.minimum.reduceat(bits.astype(A.U64) << A.U64(32) | index, bounds) & A.U64(0xFFFFFFFF)
        least = least.astype(np.int64)
        out[:, k] = A.mix(shingle[least] * A.U64(0x9E3779B97F4A7C15) + t[least].astype(np.int64).view(A.U64))
    return out


def _samples_of(batch: pa.RecordBatch, counts: np.ndarray, whole: np.ndarray, profile: tuple[np.ndarray, np.ndarray], weight: np.ndarray, bands: int, rows_: int) -> list[pa.Array]:
    """doc_id, key, n_words, class and bands of documents; profile: (document, shingle), weight that of each."""
    doc, shingle = profile
    has = np.flatnonzero(counts)
    keys = np.zeros((len(has), bands), A.U64)
    if len(has):
        drawn = _samples(shingle, weight, np.searchsorted(doc, has), bands * rows_)
        for b in range(bands):
            x = np.full(len(has), b + 1, A.U64)
            for k in range(rows_):
                x = A.mix(x ^ drawn[:, b * rows_ + k])
            keys[:, b] = x
    lists = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))])
    return [batch.column("doc_id"), batch.column("key"), pa.array(counts), pa.array(whole.view(np.int64)), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))]


def _sign(often: tuple[np.ndarray, np.ndarray, int], share: float, bands: int, rows_: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            hashes, offsets, counts, whole = shingles(*A.utf8(batch.column("text")))
            doc, shingle, count = _profile(hashes, offsets)
            columns = _samples_of(batch, counts, whole, (doc, shingle), _weights(shingle, count, often, share), bands, rows_)
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_words", "class", "bands"])

    return rows


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes each as hold the largest."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _entries(shard_bits: int):
    """A block's distinct shingles with the number of its documents that hold each, by range of the hash."""
    shift = _BITS - shard_bits

    def block(key: tuple, table: pa.Table) -> pa.Table:
        found = [_profile(*shingles(*A.utf8(batch.column("text")))[:2])[1] for batch in _blocks(table.to_batches())]
        h = np.sort(np.concatenate([np.zeros(0, A.U64), *found]))
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        h, n = h[new], np.diff(np.append(new, len(h)))
        shards = (h >> A.U64(shift)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(shards, prepend=-1))
        payload = []
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(h)).tolist(), strict=True):
            gaps = np.diff(h[a:b], prepend=A.U64(int(shards[a]) << shift))
            parts = (gaps,) if int(gaps.max()) >> 40 else (gaps.astype(np.uint32), (gaps >> A.U64(32)).astype(np.uint8))
            payload.append(_pack(_narrow(n[a:b]), *parts))
        return pa.table({"shard": pa.array(shards[cuts], pa.int64()), "block": pa.array([key[0].as_py()] * len(cuts), pa.int64()), "payload": pa.array(payload, pa.binary())})

    return block


def _add(shard_bits: int):
    """One range of the hash: for the entries of each block, in their order, the number of all documents that hold them."""

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        base, h, n = A.U64(int(key[0].as_py()) << (_BITS - shard_bits)), [], []
        for raw in table.column("payload"):
            count, low, *high = _unpack(raw.as_buffer())
            gaps = low.astype(A.U64) | high[0].astype(A.U64) << A.U64(32) if high else low
            h.append(np.cumsum(gaps, dtype=A.U64) + base)
            n.append(count.astype(np.int64))
        ends = np.cumsum([len(x) for x in h])
        h, n = np.concatenate(h), np.concatenate(n)
        order = np.argsort(h)
        h = h[order]
        begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        df = np.empty(len(h), np.int64)
        df[order] = np.repeat(np.add.reduceat(n[order], begin), np.diff(np.append(begin, len(h))))
        payload = [_pack(_narrow(x)) for x in np.split(df, ends[:-1])]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "payload": pa.array(payload, pa.binary())})

    return shard


def _sign_counted(total: int, bands: int, rows_: int):
    """A block's documents with their samples and the df of each shingle, ascending by shingle."""

    def block(texts: pa.Table, sums: pa.Table) -> pa.Table:
        parts = sorted(zip(sums.column("shard").to_pylist(), sums.column("payload"), strict=True), key=lambda x: x[0])
        df = np.concatenate([np.zeros(0, np.uint32), *(_unpack(x.as_buffer())[0].astype(np.uint32) for _, x in parts)])
        found = []
        for batch in _blocks(texts.to_batches()):
            hashes, offsets, counts, whole = shingles(*A.utf8(batch.column("text")))
            found.append((batch, counts, whole, *_profile(hashes, offsets)))
        h = np.sort(np.concatenate([np.zeros(0, A.U64), *(x[4] for x in found)]))
        h = h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
        if len(h) != len(df):
            raise ValueError(f"a block of {len(h)} shingles got {len(df)} frequencies")
        out = []
        for batch, counts, whole, doc, shingle, count in found:
            own = df[np.searchsorted(h, shingle)]
            columns = _samples_of(batch, counts, whole, (doc, shingle), _weigh(count, own, total), bands, rows_)
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)) * 4
            columns.append(_binary(bounds, own.astype("<u4")))
            out.append(pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_words", "class", "bands", "dfs"]))
        return pa.Table.from_batches(out)

    return block


_COUNTED = "doc_id long, key long, n_words long, class long, bands array<long>, dfs binary"


def counted_samples(rows: DataFrame, total: int, size: int, bands: int = BANDS, rows_: int = ROWS) -> DataFrame:
    """doc_id, key, n_words, class, bands and dfs of rows (doc_id, key, text), which are distinct: total of them, of size bytes.

    dfs has 32 bits a distinct shingle, in ascending order of the shingles: how many of the rows hold it.
    """
    blocks = -(-max(size, 1) // BLOCK_BYTES)
    shard_bits = max(4, (size // 6 // SHARD_WORDS).bit_length())
    dealt = rows.withColumn("block", F.expr(f"pmod(key, {blocks}L)"))
    entries = dealt.select("block", "text").groupBy("block").applyInArrow(_entries(shard_bits), "shard long, block long, payload binary")
    sums = entries.groupBy("shard").applyInArrow(_add(shard_bits), "block long, shard long, payload binary")
    return dealt.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_sign_counted(total, bands, rows_), _COUNTED)


def _binary(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """The bytes of values cut at bounds."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _vectors(batch: pa.RecordBatch, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)) * 8
    return pa.RecordBatch.from_arrays([batch.column("id"), _binary(bounds, shingle), _binary(bounds, weight)], ["id", "shingles", "weights"])


def _vector(often: tuple[np.ndarray, np.ndarray, int], share: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            hashes, offsets, _, _ = shingles(*A.utf8(batch.column("text")))
            doc, shingle, count = _profile(hashes, offsets)
            yield _vectors(batch, doc, shingle, _weights(shingle, count, often, share))

    return rows


def _vector_counted(total: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            hashes, offsets, _, _ = shingles(*A.utf8(batch.column("text")))
            doc, shingle, count = _profile(hashes, offsets)
            df = np.frombuffer(A.utf8(batch.column("dfs"))[0].tobytes(), "<u4")
            yield _vectors(batch, doc, shingle, _weigh(count, df, total))

    return rows


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (ascending shingles, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    low = np.minimum(a[1][hit], b[1][at[hit]]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 0.0


def _holds(threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch.column(c) for c in ("sa", "wa", "sb", "wb")]
            similar = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                sa, wa, sb, wb = (np.frombuffer(p[i].as_buffer(), t) for p, t in zip(parts, ("<u8", "<f8") * 2, strict=True))
                similar[i] = weighted_jaccard((sa, wa), (sb, wb))
            good = pa.array(similar >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    return rows


def _unit(share: float, total: int) -> float:
    """A part of the greatest weight of a shingle: a sixteenth, or less where weights differ more."""
    return float(np.log1p(1 / share)) / 16 if share > 0 else float(np.log1p(max(total, 1))) / 64


def _sketch(unit: float):
    """(id, total, bins): the sum of all weights, and of the shingles of each of _BINS classes in units, rounded up."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            shingle, weight = (A.utf8(batch.column(c)) for c in ("shingles", "weights"))
            row = np.repeat(np.arange(n), np.diff(shingle[1]) // 8)
            shingle, weight = np.frombuffer(shingle[0].tobytes(), "<u8"), np.frombuffer(weight[0].tobytes(), "<f8")
            place = row * _BINS + (A.mix(shingle) % A.U64(_BINS)).astype(np.int64)
            bins = np.bincount(place, weight, n * _BINS) / unit
            bins = np.minimum(np.ceil(bins - 1e-6), _FULL).astype("<u2").reshape(n, _BINS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.bincount(row, weight, n)), pa.array([x.tobytes() for x in bins], pa.binary())], ["id", "total", "bins"])

    return rows


def _cells(threshold: float, unit: float):
    """Pairs of a cell's left and right members that may reach the threshold: no two texts share more weight than the sum of the
    lesser of their bins. A pair is made in the first bucket of its common ones only. Rows come sorted by cell and side; a cell
    has about BLOCK members of each side."""

    def possible(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side, ids, component, total, outside = (cell.column(c).to_numpy() for c in ("side", "id", "component", "total", "outside"))
        n, bucket = int((side == 0).sum()), cell.column("bucket")[0].as_py()
        bins = np.frombuffer(A.utf8(cell.column("bins"))[0].tobytes(), "<u2").reshape(-1, _BINS)
        bands = np.array(cell.column("bands").to_pylist(), np.int64).reshape(len(ids), -1)
        full = (bins == _FULL).any(1)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, n, 16):
            to = min(n, at + 16)
            shared = np.minimum(bins[at:to, None, :], bins[None, n:, :]).sum(2, dtype=np.uint32) * unit
            good = shared * (1 + threshold) >= threshold * (total[at:to, None] + total[None, n:]) * (1 - 1e-4)
            good |= full[at:to, None] & full[None, n:]
            good &= component[at:to, None] != component[None, n:]
            good &= (ids[at:to, None] < ids[None, n:]) | ~outside[None, n:]
            x, y = np.nonzero(good)
            x, y = at + x, n + y
            common = bands[x] == bands[y]
            first = bands[x, common.argmax(1)] == bucket
            out_a.append(ids[x[first]])
            out_b.append(ids[y[first]])
        return np.concatenate(out_a), np.concatenate(out_b)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None or not held.num_rows:
                continue
            keys = np.stack([held.column(c).to_numpy() for c in ("bucket", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            ends = cuts if batch is not None else np.append(cuts, held.num_rows)
            found, at = [], 0
            for end in ends.tolist():
                found.append(possible(held.slice(at, end - at)))
                at = end
            held = held.slice(at).combine_chunks()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    return rows


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """One row per row of docs: doc_id, key (hash of doc_id and text), cluster_id (doc_id of the cluster's first document), kept.

    share: df below that share of the documents counts as that share; 0 counts every df.
    """
    bounded_batches(docs.sparkSession)
    with Scope(docs.sparkSession) as scope:
        return scope.result(_clusters(docs, threshold, share), "near-duplicates")


def _clusters(docs: DataFrame, threshold: float, share: float) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), text.alias("text"))
    repeats = None
    if share > 0:
        often = frequent_shingles(rows, share)
        total = often[2]
        signed = keep(rows.mapInArrow(_sign(often, share, BANDS, ROWS), "doc_id long, key long, n_words long, class long, bands array<long>"), "samples")
    else:
        sizes = keep(rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")), "sizes")
        total, size, most = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.max("n")).first()
        repeats = sizes.where("n > 1").select("key", "n") if total and most > 1 else None
        signed = keep(counted_samples(rows if repeats is None else rows.dropDuplicates(["key"]), total, size), "samples", "zstd")
    worded = signed.where("n_words > 0")
    # rows of one class have the same words; its first document stands for it
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    classes = keep(worded.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands")), "classes")
    buckets = worded.select(F.explode("bands").alias("bucket"), F.col("class").alias("id")).distinct()
    shared = keep(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    heavy = hot(shared, "bucket")
    members = keep(attach(in_set(buckets, "bucket", shared, "bucket"), shared, "bucket", heavy), "buckets")
    wanted = members.select(F.col("id").alias("class")).distinct().join(classes, "class").select(F.col("class").alias("id"), F.col("first.key").alias("key"))
    wanted = keep(wanted, "wanted")
    texts = in_set(rows.select("key", "text"), "key", wanted, "key").join(wanted, "key")
    if share > 0:
        texts, vector = texts.select("id", "text"), _vector(often, share)
    else:
        dfs = in_set(signed.select("key", "dfs"), "key", wanted, "key")
        texts, vector = texts.join(dfs, "key").select("id", "text", "dfs"), _vector_counted(total)
    vectors = keep(texts.mapInArrow(vector, "id long, shingles binary, weights binary"), "vectors").dropDuplicates(["id"])
    vectors = keep(vectors, "distinct-vectors")

    def verify(pairs: DataFrame) -> DataFrame:
        busy = {end: hot(pairs.groupBy(end).agg(F.count("*").alias("n")), end) for end in ("a", "b")}
        for end in ("a", "b"):
            pairs = attach(pairs, vectors.select(F.col("id").alias(end), F.col("shingles").alias(f"s{end}"), F.col("weights").alias(f"w{end}")), end, busy[end])
        return pairs.select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(_holds(threshold), "a long, b long")

    unit = _unit(share, total)

    def sketches(ids: DataFrame) -> DataFrame:
        drawn = vectors.join(ids, "id").mapInArrow(_sketch(unit), "id long, total double, bins binary")
        return drawn.join(classes.select(F.col("class").alias("id"), "bands"), "id")

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        columns = ("bucket", "i", "j", "side", "id", "component", "outside", "total", "bins", "bands")
        both = left.withColumns({"side": F.lit(0), "outside": F.lit(True)}).select(*columns).unionByName(right.withColumn("side", F.lit(1)).select(*columns))
        dealt = both.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
        return dealt.mapInArrow(_cells(threshold, unit), "a long, b long").withColumn("score", F.lit(0))

    found = components(linked(members, heavy, verify, sketches, meet)).withColumnRenamed("node", "class")
    placed = keep(classes.drop("bands").join(found, "class", "left").withColumn("component", F.coalesce("component", "class")), "placed")
    first = placed.groupBy("component").agg(F.min("first").alias("head"))
    large = hot(placed.groupBy("component").agg(F.count("*").alias("n")), "component")
    heads = attach(placed.select("class", "component"), first, "component", large).select("class", F.col("head.doc_id").alias("cluster_id"), F.col("head.key").alias("head"))
    named = attach(worded.select("class", "doc_id", "key"), keep(heads, "heads"), "class", hot(classes.select("class", "n"), "class"))
    named = named.select("doc_id", "key", "cluster_id", (F.col("key") == F.col("head")).alias("kept"))
    # a text without words is a cluster of its own
    found = named.unionByName(signed.where("n_words = 0").select("doc_id", "key", F.col("doc_id").alias("cluster_id"), F.lit(True).alias("kept")))
    if repeats is None:
        return found
    return found.join(repeats, "key", "left").withColumn("n", F.expr("explode(sequence(1L, coalesce(n, 1L)))")).select("doc_id", "key", "cluster_id", "kept")
