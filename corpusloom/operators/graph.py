"""The symbol graph: nodes (id, metadata) and directed edges (src, dst, kind, weight), both plain tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGES = "src string, dst string, kind string, weight double"
THRESHOLD = 0.7
TOP_K = 5


def _edges(pairs: DataFrame, kind: str, nodes: DataFrame) -> DataFrame:
    """Pairs whose two ends are nodes, repeats kept."""
    ids = nodes.select("id")
    pairs = pairs.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return pairs.select("src", "dst", F.lit(kind).alias("kind"), F.lit(None).cast("double").alias("weight"))


def calls_edges(symbols: DataFrame, nodes: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """An edge for each call whose name is a node's id; resolved (src, dst) adds calls resolved by name."""
    found = _edges(symbols.select(F.col("symbol_id").alias("src"), F.explode("calls").alias("dst")), "calls", nodes)
    return found if resolved is None else found.unionByName(_edges(resolved.select("src", "dst"), "calls", nodes))


def imports_edges(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """An edge for each imported item that is a node's id."""
    return _edges(symbols.select(F.col("symbol_id").alias("src"), F.explode("imports").alias("dst")), "imports", nodes)


def related_edges(vectors: DataFrame, threshold: float = THRESHOLD, top_k: int = TOP_K, block: int = 2048) -> DataFrame:
    """For each vector (id, vector) its top_k others by cosine above threshold; ties by id.

    Every vector is compared with all others, block by block: a task holds two
    blocks, multiplies them, and keeps top_k a source, so what is shuffled grows
    with the number of blocks and not with the pairs. Null vectors have no
    edges; a zero vector's cosine is 0.
    """
    kind = dict(vectors.dtypes)["id"]
    rows = vectors.where("vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    n = max(1, -(-rows.count() // block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.select("id", "vector", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def pairs(table: pa.Table) -> pa.Table:
        ids, side = table.column("id").to_pylist(), table.column("block").to_numpy()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        x = np.array(table.column("vector").to_pylist(), np.float64)
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
        out: list[tuple] = []
        for a, b in {(low, high), (high, low)}:
            i, j = np.flatnonzero(side == a), np.flatnonzero(side == b)
            if not len(i) or not len(j):
                continue
            near = x[i] @ x[j].T
            near[i[:, None] == j[None, :]] = -2
            for row, source in zip(near, i.tolist(), strict=True):
                good = np.flatnonzero(row > threshold)
                if len(good) > top_k:
                    good = good[row[good] >= np.partition(row[good], -top_k)[-top_k]]
                out += [(ids[source], ids[j[k]], float(row[k])) for k in good.tolist()]
        names, fields = ("src", "dst", "weight"), list(zip(*out, strict=True)) or [[], [], []]
        return pa.table(dict(zip(names, (pa.array(f, t) for f, t in zip(fields, (table.schema.field("id").type,) * 2 + (pa.float64(),), strict=True)), strict=True)))

    found = rows.groupBy("low", "high").applyInArrow(pairs, f"src {kind}, dst {kind}, weight double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("weight", 12)), "dst"))
    top = found.withColumn("_rank", rank).where(F.col("_rank") <= top_k)
    return top.select("src", "dst", F.lit("related").alias("kind"), "weight")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) of every node, over all edges of all kinds."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    rows = nodes.select("id").join(sums, "id", "left").na.fill(0, ["in_degree", "out_degree"])
    return rows.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """degrees() with centrality = degree / (n - 1), 0 in a graph of one node, and the share capped at 1."""
    n = nodes.select(F.count("*").alias("n"))
    rows = degrees(nodes, edges).join(F.broadcast(n))  # one row
    central = F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return rows.withColumn("centrality", central).withColumn("centrality_capped", F.least("centrality", F.lit(1.0))).drop("n")


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, density = e / (n (n - 1)), avg_degree = 2 e / n."""
    both = nodes.select(F.count("*").alias("n_nodes")).join(F.broadcast(edges.select(F.count("*").alias("n_edges"))))  # one row each
    n, e = F.col("n_nodes"), F.col("n_edges")
    both = both.withColumn("density", F.when(n > 1, e / (n * (n - 1))).otherwise(F.lit(0.0)))
    return both.withColumn("avg_degree", F.when(n > 0, 2 * e / n).otherwise(F.lit(0.0)))


def edge_kind_counts(edges: DataFrame) -> DataFrame:
    """One row: calls, imports, related."""
    return edges.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("calls", "imports", "related")))
