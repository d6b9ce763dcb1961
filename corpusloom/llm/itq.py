"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learnt on a bounded sample so that the signs
of the rotated vectors are balanced, close codes. Every vector is put in
``tables`` hash tables, each keyed by its label and a subset of the code's bits;
the number of tables follows from the bits of a key, so that two vectors at the
threshold meet in at least one with probability ``recall``. Vectors that meet
are reranked by cosine in double precision of the original vectors; each pair is
counted in the first table it meets in. Large buckets are cut into blocks that
are compared pair by pair of blocks, so no task holds more than two blocks.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite
component, or whose label is null, links with nothing; vectors of different
dimensions don't link; equal vectors of one label are one class in the tables
and count each; rows that repeat a vec_id are vectors each; a null vec_id is no
component's name unless it is alone; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _arrays as A
from corpusloom.llm._store import bounded_batches, components, in_set, keep

THRESHOLD = 0.98
RECALL = 0.9999
SAMPLE = 10_000
BLOCK = 1024
_SIGNED = "row long, vec_id long, class long, dim int, vector binary, keys array<long>"


def vectors(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat components, offsets, which rows are usable) of a list column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = col.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat = col.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    off = np.concatenate([[0], np.cumsum(size)])
    good = (A.totals(bad | ~np.isfinite(x), off) == 0) & (A.totals(x != 0, off) > 0)
    return x, off, good


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no finite vector over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 50, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes x bits): principal axes, rotated so that signs lose least."""
    mean = x.mean(axis=0)
    x = x - mean
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    low = x @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
        turn = (u @ v).T
    return mean, axes @ turn


class Model:
    """Codes and table keys; a dimension that the sample lacks gets the axes of a seeded random rotation."""

    def __init__(self, sample: list[np.ndarray], most: int, threshold: float = THRESHOLD, recall: float = RECALL):
        self.axes = {}
        by_dim: dict[int, list[np.ndarray]] = {}
        for v in sample:
            by_dim.setdefault(len(v), []).append(v)
        for dim, rows in by_dim.items():
            if len(rows) > 2 * dim:
                self.axes[dim] = learn_rotation(unit(np.array(rows)), min(dim, 64))
        #: about eight table entries a vector of the largest label
        self.bits = min(24, max(8, math.ceil(math.log2(max(most, 2))) + 3))
        same = 1 - math.acos(threshold) / math.pi
        self.tables = math.ceil(math.log(1 - recall) / math.log(1 - same**self.bits))
        self.most_bits = 64

    def rotation(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        if dim not in self.axes:
            turn, _ = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
            self.axes[dim] = np.zeros(dim), turn[:, : min(dim, 64)]
        return self.axes[dim]

    def subsets(self, bits: int) -> list[np.ndarray]:
        """The bits of each table: disjoint while they last, then anew in another order."""
        draw, out, pool = np.random.default_rng(11), [], np.zeros(0, np.int64)
        take = min(self.bits, bits)
        for _ in range(self.tables):
            if len(pool) < take:
                pool = draw.permutation(bits)
            out.append(pool[:take])
            pool = pool[take:]
        return out

    def keys(self, x: np.ndarray) -> np.ndarray:
        """rows x tables, of unit vectors of one dimension."""
        mean, axes = self.rotation(x.shape[1])
        code = (x - mean) @ axes >= 0
        out = np.empty((len(x), self.tables), A.U64)
        for t, at in enumerate(self.subsets(code.shape[1])):
            value = code[:, at] @ (1 << np.arange(len(at), dtype=np.int64))
            out[:, t] = A.mix(value.astype(A.U64) * A.U64(64) + A.U64(t) + A.U64(x.shape[1] << 40))
        return out


def _sign(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, off, good = vectors(batch.column("embedding"))
            label = batch.column("label")
            good &= ~label.is_null().to_numpy(zero_copy_only=False)
            salt = A.mix(label.fill_null(0).to_numpy().astype(np.int64).view(A.U64) + A.U64(1))
            dim = np.diff(off)
            n = batch.num_rows
            klass, keys = np.zeros(n, A.U64), np.zeros((n, model.tables), A.U64)
            x = x + 0.0  # one zero
            for d in np.unique(dim[good]).tolist():
                at = np.flatnonzero(good & (dim == d))
                v = x[A.ragged(off[at], dim[at])].reshape(-1, d)
                raw = np.ascontiguousarray(v).view(np.uint8).reshape(-1)
                bounds = np.arange(len(at) + 1) * (8 * d)
                klass[at] = A.span_hash(raw, bounds[:-1], bounds[1:]) ^ salt[at]
                keys[at] = A.mix(model.keys(unit(v)) ^ salt[at][:, None])
            raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((8 * off).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
            lists = np.concatenate([[0], np.cumsum(np.where(good, model.tables, 0))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), pa.array(klass.view(np.int64), mask=~good), pa.array(dim, pa.int32()), raw, pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(keys[good].reshape(-1).view(np.int64)))],
                ["row", "vec_id", "class", "dim", "vector", "keys"],
            )

    return rows


def _compare(threshold: float):
    def bucket(table: pa.Table) -> pa.Table:
        ids = table.column("class").to_numpy()
        times = table.column("times").to_numpy()
        x = unit(np.array([np.frombuffer(v, np.float64) for v in table.column("vector").to_pylist()]))
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        side, t = table.column("block").to_numpy(), table.column("turn")[0].as_py()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        a, b = np.flatnonzero(side == low), np.flatnonzero(side == high)
        near = x[a] @ x[b].T >= threshold
        if low == high:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        first = np.empty(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            first[k : k + (1 << 16)] = (keys[i[k : k + (1 << 16)]] == keys[j[k : k + (1 << 16)]]).argmax(axis=1) == t
        i, j = i[first], j[first]
        links = np.bincount(i, times[j], len(ids)) + np.bincount(j, times[i], len(ids))
        root = np.arange(len(ids))
        while len(i):  # the smallest index that each can reach
            least = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, root[i], least)
            np.minimum.at(root, root[j], least)
            root = root[root]
            if (root == before).all():
                break
        has = np.flatnonzero(links)
        return pa.table({"class": ids[has], "root": ids[root[has]], "n": links[has].astype(np.int64)})

    return bucket


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """One row per row of table (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    sample bounds the vectors that the rotation is learnt on (the first by a hash
    of vec_id); every vector is indexed.
    """
    bounded_batches(table.sparkSession)
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    most = rows.where("label is not null").groupBy("label").count().agg(F.max("count").alias("n")).first()["n"] or 0
    usable = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    drawn = rows.where(usable).select("embedding", F.xxhash64("vec_id", "embedding").alias("h")).orderBy("h").limit(sample).collect()
    model = Model([np.array(r["embedding"]) for r in drawn], most, threshold, recall)
    signed = keep(rows.mapInArrow(_sign(model), _SIGNED), "codes")
    classes = keep(signed.where("class is not null").groupBy("class").agg(F.count("*").alias("times"), F.min("row").alias("row")), "classes")
    one = classes.join(signed.select("row", "vector", "keys"), "row").select("class", "times", "vector", "keys")
    places = signed.where("class is not null").select("class", F.posexplode("keys").alias("turn", "key")).distinct()
    shared = keep(places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    met = keep(in_set(places, "key", shared.select("key"), "key").join(shared, "key"), "met")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
    met = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class", "key"), "blocks"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    met = met.select("class", "turn", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    found = met.join(one, "class").groupBy("key", "low", "high").applyInArrow(_compare(threshold), "class long, root long, n long")
    found = keep(found, "found")
    links = found.groupBy("class").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = signed.select("row", "vec_id", "class").join(classes.select("class", "times"), "class", "left").join(links, "class", "left")
    named = named.join(joined.select(F.col("node").alias("class"), "component"), "class", "left")
    named = keep(named.select("row", "vec_id", F.coalesce("component", "class").alias("component"), (F.coalesce("n", F.lit(0)) + F.coalesce("times", F.lit(1)) - 1).cast("long").alias("n_links")), "named")
    first = named.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("first"))
    return named.join(first, "component", "left").select("vec_id", "n_links", F.coalesce("first", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
