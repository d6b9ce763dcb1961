import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cluster as K
from corpusloom.operators import context as X
from corpusloom.operators import graph as G
from corpusloom.operators.search import catalogue, search_catalogue, search_symbols
from corpusloom.schemas import InvalidInput


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "calls", None) for a, b in pairs], G.EDGES)


def test_star_and_path(spark):
    star = edges(spark, [("a", "b"), ("a", "c"), ("a", "d")])
    got = {r["id"]: r["centrality"] for r in G.degree_centrality(nodes(spark, "abcd"), star).collect()}
    assert got == {"a": 1.0, "b": pytest.approx(1 / 3), "c": pytest.approx(1 / 3), "d": pytest.approx(1 / 3)}
    assert G.graph_metrics(nodes(spark, "abc"), edges(spark, [("a", "b"), ("b", "c")])).first()["density"] == pytest.approx(1 / 3)
    assert G.graph_metrics(nodes(spark, "a"), edges(spark, [])).first()["density"] == 0
    got = {r["id"]: (r["in_degree"], r["out_degree"]) for r in G.degrees(nodes(spark, "abcz"), edges(spark, [("a", "b"), ("c", "b"), ("b", "b")])).collect()}
    assert got == {"a": (0, 1), "b": (3, 1), "c": (0, 1), "z": (0, 0)}


def test_related_edges(spark):
    rows = [("a", [1.0, 0.0, 0.0]), ("b", [0.95, 0.1, 0.0]), ("c", [0.7, 0.5, 0.0]), ("d", [0.0, 0.0, 1.0]), ("z", [0.0, 0.0, 0.0]), ("n", None)]
    table = spark.createDataFrame(rows, "id string, vector array<double>")
    whole = sorted((r["src"], r["dst"], round(r["weight"], 9)) for r in G.related_edges(table, 0.7, 2).collect())
    assert {(a, b) for a, b, _ in whole} == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("b", "c"), ("c", "b")} and all(0.7 < w <= 1 for *_, w in whole)
    assert whole == sorted((r["src"], r["dst"], round(r["weight"], 9)) for r in G.related_edges(table, 0.7, 2, block=2).collect())
    assert G.related_edges(table, 0.7, 1).count() == 3


def test_contexts(spark):
    symbols = spark.createDataFrame([(f"s{i}", f"n{i}", "function", None if i else "rust", "f", "sig", [f"i{k}" for k in range(15)], []) for i in range(16)], "symbol_id string, name string, kind string, language string, file_path string, signature string, imports array<string>, chunk_ids array<string>")
    rows = [("s0", f"s{i}", "calls", None, i) for i in range(1, 16)] + [("s1", f"s{i}", "related", w, 100 + i) for i, w in ((2, 0.8), (3, 0.7), (4, 0.6), (5, 0.5))]
    e = spark.createDataFrame(rows, "src string, dst string, kind string, weight double, ord int")
    clusters = spark.createDataFrame([("s0", "cluster_1", "x")], "symbol_id string, cluster_id string, cluster_label string")
    got = {r["symbol_id"]: r for r in X.symbol_contexts(symbols, e, clusters).collect()}
    assert got["s0"]["calls"] == [f"n{i}" for i in range(1, 11)] and len(got["s0"]["imports"]) == 10 and got["s0"]["cluster_label"] == "x"
    assert got["s3"]["called_by"] == ["n0"] and got["s1"]["related"] == ["n2", "n3", "n4"] and got["s2"]["related"] == ["n1"] and got["s2"]["language"] == ""


def test_clusters(spark):
    rows = [(i, [float(i % 3) * 10 + i / 1000, 1.0]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "id int, vector array<double>")
    assigned, centers = K.fit_clusters(vectors, 3)
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r["cluster"], set()).add(r["id"] % 3)
    assert sorted(map(tuple, groups.values())) == [(0,), (1,), (2,)] and sorted(r["size"] for r in centers.collect()) == [10, 10, 10]
    with pytest.raises(InvalidInput):
        K.fit_clusters(vectors.limit(2), 3)
    with pytest.raises(InvalidInput):
        K.fit_clusters(vectors.limit(0), 1)
    assert [K.cluster_count(n) for n in (1, 2, 3, 50, 100, 5000)] == [1, 2, 2, 5, 8, 20]
    far = centers.select("cluster", "centroid").unionByName(spark.createDataFrame([(9, [500.0, 500.0])], "cluster int, centroid array<double>"))
    step = {r["cluster"]: (r["centroid"], r["size"]) for r in K.kmeans_step(vectors, far).collect()}
    assert step[9] == ([0.0, 0.0], 0)


def test_search(spark):
    rows = spark.createDataFrame([("Foo", "fn", "a.rs", ["bar"]), ("baz", None, "b.rs", None)], "name string, kind string, file_path string, calls array<string>")
    assert [r["name"] for r in search_symbols(rows, "BAR").collect()] == ["Foo"]
    assert search_symbols(rows, "", "fn").count() == 1 and search_symbols(rows).count() == 2
    files = spark.createDataFrame([("s3://x/root/o/r.pack", 5, "2024-01-01"), ("s3://x/root/o/q.pack", 6, "2024-02-01"), ("s3://x/root/deep/o/q.pack", 6, "2024-02-01"), ("s3://x/root/o/q.txt", 6, "2024-02-01")], "path string, length long, modificationTime string")
    found = catalogue(files, ".pack", "root")
    assert [(r["owner"], r["repo"]) for r in found.collect()] == [("o", "q"), ("o", "r")] and search_catalogue(found, "R").count() == 1 and search_catalogue(found, " ").count() == 2
    assert found.select(F.sum("size")).first()[0] == 11
