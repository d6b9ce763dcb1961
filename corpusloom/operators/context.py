"""What is known of each symbol: neighbours, cluster, centrality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.graph import degree_centrality

MOST_CALLS = 10
MOST_IMPORTS = 10
MOST_RELATED = 3


def _first(rows: DataFrame, key: str, value: Column, order: list[Column], most: int, name: str) -> DataFrame:
    """The first values of each key; ranks are cut below the shuffle, so a key of any size sends few rows."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    top = rows.withColumn("_rank", rank).where(F.col("_rank") <= most)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("_rank", value.alias("_v")))), lambda s: s["_v"])
    return top.groupBy(key).agg(lists.alias(name))


def symbol_vectors(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, vector) of symbols that have an embedded chunk: the last of theirs in the order of chunks (chunk_id, vector, ord)."""
    rows = symbols.select(F.col("symbol_id").alias("id"), F.explode("chunk_ids").alias("chunk_id")).distinct()
    return rows.join(chunks, "chunk_id").groupBy("id").agg(F.max_by("vector", "ord").alias("vector"))


def embedded_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks that have a vector; of several vectors (chunk_id, vector, ord) the last."""
    return chunks.join(vectors.groupBy("chunk_id").agg(F.max_by("vector", "ord").alias("vector")), "chunk_id")


def cluster_members(symbols: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, symbol_id), each once: a symbol is in every cluster that has one of its chunks; assigned: (chunk_id, cluster)."""
    return symbols.select("symbol_id", F.explode("chunk_ids").alias("chunk_id")).join(assigned, "chunk_id").select("cluster", "symbol_id").distinct()


def node_clusters(symbols: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """(symbol_id, cluster_id, cluster_label): the lowest cluster or "unclustered", and the label of the highest."""
    named = members.join(labels.select("cluster", "label"), "cluster", "left")
    both = named.groupBy("symbol_id").agg(F.min("cluster").alias("_low"), F.max_by("label", "cluster").alias("cluster_label"))
    name = F.coalesce(F.concat(F.lit("cluster_"), F.col("_low").cast("string")), F.lit("unclustered"))
    return symbols.select("symbol_id").join(both, "symbol_id", "left").select("symbol_id", name.alias("cluster_id"), "cluster_label")


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, calls, called_by, related): names; edges need a total order in ord."""
    names = nodes.select("id", "name")
    to = edges.join(names.select(F.col("id").alias("dst"), F.col("name").alias("other")), "dst")
    fro = edges.join(names.select(F.col("id").alias("src"), F.col("name").alias("other")), "src")
    calls = _first(to.where("kind = 'calls'").withColumnRenamed("src", "id"), "id", F.col("other"), [F.col("ord")], MOST_CALLS, "calls")
    called = _first(fro.where("kind = 'calls'").withColumnRenamed("dst", "id"), "id", F.col("other"), [F.col("ord")], MOST_CALLS, "called_by")
    columns = ("id", "other", "weight", "ord")
    ends = to.where("kind = 'related'").withColumnRenamed("src", "id").select(*columns).unionByName(fro.where("kind = 'related' and src <> dst").withColumnRenamed("dst", "id").select(*columns))
    related = _first(ends, "id", F.col("other"), [F.desc("weight"), F.col("other"), F.col("ord")], MOST_RELATED, "related")
    rows = nodes.select("id").join(calls, "id", "left").join(called, "id", "left").join(related, "id", "left")
    empty = F.array().cast("array<string>")
    return rows.select("id", *(F.coalesce(c, empty).alias(c) for c in ("calls", "called_by", "related")))


def symbol_contexts(symbols: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per symbol (symbol_id, name, kind, language, file_path, signature, imports): neighbours, label and centrality."""
    nodes = symbols.select(F.col("symbol_id").alias("id"), "name")
    near = neighbours(nodes, edges).withColumnRenamed("id", "symbol_id")
    central = degree_centrality(nodes, edges).select(F.col("id").alias("symbol_id"), "centrality")
    rows = symbols.join(near.withColumnRenamed("calls", "_calls"), "symbol_id", "left").join(clusters.select("symbol_id", "cluster_id", "cluster_label"), "symbol_id", "left").join(central, "symbol_id", "left")
    empty = F.array().cast("array<string>")
    return rows.select(
        "symbol_id", "name", "kind", F.coalesce("language", F.lit("")).alias("language"), "file_path", "signature",
        F.coalesce("_calls", empty).alias("calls"), F.coalesce("called_by", empty).alias("called_by"),
        F.slice(F.coalesce("imports", empty), 1, MOST_IMPORTS).alias("imports"), F.coalesce("related", empty).alias("related"),
        "cluster_id", "cluster_label", F.coalesce("centrality", F.lit(0.0)).alias("centrality"),
    )
