"""Cluster labels by term frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import label, label_terms


def term_frequency(members: DataFrame, cluster: str = "cluster", text: str = "text") -> DataFrame:
    """(cluster, term, n): occurrences of each term that may label a cluster."""
    return members.select(cluster, F.explode(label_terms(F.col(text))).alias("term")).groupBy(cluster, "term").agg(F.count("*").alias("n"))


def top_terms(frequency: DataFrame, cluster: str = "cluster", most: int = 2) -> DataFrame:
    """The most frequent terms of each cluster with their rank; ties by term."""
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), "term"))
    return frequency.withColumn("rank", rank).where(F.col("rank") <= most)


def cluster_labels(members: DataFrame, cluster: str = "cluster", text: str = "text") -> DataFrame:
    """(cluster, label, member_count) for every cluster that has a row; a row with a null text is no member."""
    top = top_terms(term_frequency(members, cluster, text), cluster)
    two = top.groupBy(cluster).agg(
        F.max(F.when(F.col("rank") == 1, F.col("term"))).alias("a"), F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("na"),
        F.max(F.when(F.col("rank") == 2, F.col("term"))).alias("b"), F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("nb"),
    )
    sizes = members.groupBy(cluster).agg(F.count(text).alias("member_count"))
    named = label(F.col("a"), F.col("na"), F.col("b"), F.col("nb"), F.col("member_count"))
    return sizes.join(two, cluster, "left").select(cluster, named.alias("label"), "member_count")
