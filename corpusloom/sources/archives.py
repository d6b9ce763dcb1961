"""Repositories as landed zip archives or directories."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import is_commit, without_archive_root
from corpusloom.operators.skip import MAX_ARCHIVE_SIZE
from corpusloom.schemas import FILES


def _safe(name: str) -> bool:
    """A relative path that stays below its root."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ":" not in parts[0] and ".." not in parts and "\x00" not in name


def unzip(raw: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(path, size, content) of the files of an archive; entries with unsafe names, directories and damaged entries are left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        for entry in archive.infolist():
            if not entry.is_dir() and _safe(entry.filename):
                try:
                    content = archive.read(entry)
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError):
                    continue
                yield entry.filename, len(content), content


def read_archives(spark: SparkSession, path: str, max_size: int = MAX_ARCHIVE_SIZE) -> DataFrame:
    """(archive, path, size, content) of the zip files at path that are within max_size; the size is tested on the listing."""
    return unpack(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).where(F.col("length") <= max_size))


def unpack(listed: DataFrame) -> DataFrame:
    """(archive, path, size, content) of the entries of archives (path, content); an archive that can't be read has none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, raw in zip(b["path"], b["content"], strict=True):
                try:
                    for name, size, content in unzip(raw):
                        yield pd.DataFrame([(archive, name, size, content)], columns=["archive", "path", "size", "content"])
                except zipfile.BadZipFile:
                    continue

    found = listed.select("path", "content").mapInPandas(rows, "archive string, " + FILES)
    return found.withColumn("path", without_archive_root(F.col("path")))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, content) of all files below a directory; a plan that needs no content reads none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), "content", "modificationTime")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime): what a catalogue needs."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def resolve_refs(wanted: DataFrame, refs: DataFrame) -> DataFrame:
    """wanted (repo, ref) with commit and kind: a full hash is itself, else a branch, else a tag, else not_found; refs:
    (repo, name, kind, commit)."""
    best = refs.groupBy("repo", F.col("name").alias("ref")).agg(F.min_by(F.struct("commit", "kind"), F.when(F.col("kind") == "branch", 0).otherwise(1)).alias("_r"))
    rows = wanted.join(best, ["repo", "ref"], "left")
    commit = F.when(is_commit(F.col("ref")), F.col("ref")).otherwise(F.col("_r.commit"))
    kind = F.when(is_commit(F.col("ref")), "commit").otherwise(F.coalesce("_r.kind", F.lit("not_found")))
    return rows.select("repo", "ref", commit.alias("commit"), kind.alias("kind"))


def rate_limit(headers: Column, ok: Column) -> Column:
    """struct(limit, remaining, reset, exceeded) of a map of response headers; exceeded only where the call failed as well."""

    def value(name: str) -> Column:
        return F.try_element_at(headers, F.lit(name)).try_cast("bigint")

    left = value("x-ratelimit-remaining")
    return F.struct(value("x-ratelimit-limit").alias("limit"), left.alias("remaining"), value("x-ratelimit-reset").alias("reset"), F.coalesce((left == 0) & ~ok, F.lit(False)).alias("exceeded"))


def repository_status(code: Column, remaining: Column) -> Column:
    """What the answer to a look-up of a repository means."""
    return F.when(code == 200, "exists").when(code == 404, "not_found").when((code == 403) & (remaining == 0), "rate_limited").when(code == 403, "private").otherwise("error")
