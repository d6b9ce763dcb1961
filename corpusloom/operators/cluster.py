"""K-means clusters of chunk vectors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.vectors import distance
from corpusloom.schemas import InvalidInput


def optimal_k(n: int) -> int:
    """ceil(sqrt(n / 2)), at least 2."""
    root = 0
    while 2 * root * root < n:
        root += 1
    return max(root, 2)


def cluster_count(n: int) -> int:
    """The number of clusters of an assembly: optimal_k between 2 and 20, and no more than rows."""
    return min(max(min(optimal_k(n), 20), 2), n)


def fit_clusters(vectors: DataFrame, k: int, max_iterations: int = 300, tolerance: float = 1e-4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((id, cluster), (cluster, centroid, size)) of vectors (id, vector)."""
    rows = vectors.where("vector is not null").select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features")).orderBy("id")
    n = rows.count()
    if n == 0:
        raise InvalidInput("no vectors to cluster")
    if k > n or k < 1:
        raise InvalidInput(f"{k} clusters of {n} vectors")
    if k == 1:
        assigned = rows.select("id", F.lit(0).alias("cluster"))
    else:
        model = KMeans(k=k, maxIter=max_iterations, tol=tolerance, seed=seed).fit(rows)
        assigned = model.transform(rows).select("id", F.col("prediction").alias("cluster"))
    joined = assigned.join(vectors.select("id", "vector"), "id")
    return assigned, centroids(joined, "cluster")


def centroids(rows: DataFrame, cluster: str) -> DataFrame:
    """(cluster, centroid, size): means of rows (cluster, vector)."""
    each = rows.select(cluster, F.posexplode(F.col("vector").cast("array<double>")).alias("_at", "_x"))
    means = each.groupBy(cluster, "_at").agg(F.avg("_x").alias("_mean"))
    lists = means.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_mean"))), lambda s: s["_mean"]).alias("centroid"))
    return lists.join(rows.groupBy(cluster).agg(F.count("*").alias("size")), cluster)


def nearest_centroid(vectors: DataFrame, centers: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(id, cluster, distance): the nearest of the given centres, ties to the lowest. The centres, at most a few dozen, are
    gathered into one broadcast row."""
    few = centers.agg(F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("c"), "centroid"))).alias("_centers"))
    rows = vectors.join(F.broadcast(few))
    best = F.array_min(F.transform("_centers", lambda c: F.struct(F.round(distance(F.col("vector"), c["centroid"]), 9).alias("d"), c["c"].alias("c"))))
    return rows.select("id", best.alias("_b")).select("id", F.col("_b.c").alias(cluster), F.col("_b.d").alias("distance"))


def cluster_sizes(labels: DataFrame, assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, member_count) for every label, 0 where nothing is assigned."""
    sizes = assigned.groupBy(cluster).agg(F.count("*").alias("member_count"))
    return labels.select(cluster).join(sizes, cluster, "left").na.fill(0, ["member_count"])


def kmeans_step(vectors: DataFrame, centers: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, centroid, size) after one assignment; a cluster that gets nothing has the zero vector."""
    moved = centroids(nearest_centroid(vectors, centers, cluster).join(vectors, "id"), cluster)
    zero = F.transform("_old", lambda x: F.lit(0.0))
    old = centers.select(cluster, F.col("centroid").alias("_old"))
    return old.join(moved, cluster, "left").select(cluster, F.coalesce("centroid", zero).alias("centroid"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))


__all__ = ["centroids", "cluster_count", "cluster_sizes", "fit_clusters", "kmeans_step", "nearest_centroid", "optimal_k", "vector_to_array"]
