"""Searching and grouping symbols, and the catalogue of bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _holds(column: Column, query: str) -> Column:
    return F.contains(F.lower(column), F.lit(query.lower()))


def search_symbols(symbols: DataFrame, query: str = "", kind: str = "all") -> DataFrame:
    """Symbols whose name, signature, path, or any call or import contains the query; case doesn't matter."""
    tests = [_holds(F.col(c), query) for c in ("name", "signature", "file_path") if c in symbols.columns]
    tests += [F.exists(c, lambda x: _holds(x, query)) for c in ("calls", "imports") if c in symbols.columns]
    hit = F.lit(False)
    for t in tests:
        hit = hit | F.coalesce(t, F.lit(False))
    rows = symbols if query == "" else symbols.where(hit)
    return rows if kind == "all" else rows.where(F.col("kind") == kind)


def symbols_by_file(symbols: DataFrame, order: str = "name") -> DataFrame:
    """(file_path, symbols): arrays by name, or by falling centrality, then name; files by path."""
    key = F.col("name") if order == "name" else -F.col(order)
    lists = F.array_sort(F.collect_list(F.struct(key.alias("key"), "name", "kind")))
    rows = symbols.groupBy("file_path").agg(F.transform(lists, lambda s: F.struct(s["name"], s["kind"])).alias("symbols"))
    return rows.orderBy("file_path")


def kinds(symbols: DataFrame) -> DataFrame:
    return symbols.select("kind").distinct().orderBy("kind")


def distinct_files(symbols: DataFrame) -> DataFrame:
    return symbols.agg(F.count_distinct("file_path").alias("n_files"))


def file_tree(chunks: DataFrame, detected: DataFrame) -> DataFrame:
    """(file_path, language, chunks): of detected files, their chunks by place; chunks of other files are dropped."""
    lists = F.array_sort(F.collect_list(F.struct("ord", "chunk_id")))
    grouped = chunks.groupBy("file_path").agg(F.transform(lists, lambda c: c["chunk_id"]).alias("chunks"))
    rows = detected.join(grouped, "file_path", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<string>")))
    return rows.orderBy("file_path")


def catalogue(files: DataFrame, suffix: str, root: str = "") -> DataFrame:
    """(key, owner, repo, size, modified) of a listing (path, length, modificationTime) whose keys are owner/repo + suffix;
    newest first."""
    key = F.regexp_replace("path", rf"^.*?{root.strip('/')}/", "") if root else F.col("path")
    rows = files.withColumn("key", key).withColumn("_p", F.split("key", "/")).where(F.col("key").endswith(suffix) & (F.size("_p") == 2))
    repo = F.expr(f"left(_p[1], char_length(_p[1]) - {len(suffix)})")
    return rows.select("key", F.col("_p")[0].alias("owner"), repo.alias("repo"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "key")


def search_catalogue(rows: DataFrame, query: str = "") -> DataFrame:
    """Entries whose owner or repo contains the query; a blank query matches all."""
    return rows if not query.strip() else rows.where(_holds(F.col("owner"), query) | _holds(F.col("repo"), query))
