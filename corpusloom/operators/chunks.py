"""Content-addressed chunks of files and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import chunk_id, utf8_slice
from corpusloom.schemas import archive_key

MAX_BYTES = 4096
OVERLAP = 256


def split_ranges(rows: DataFrame, size: str = "size", max_bytes: int = MAX_BYTES, overlap: int = OVERLAP) -> DataFrame:
    """A row for each piece: piece_start, piece_end (bytes from the row's start), split_index, split_total (null: not split)."""
    step = max_bytes - overlap
    n = F.when(F.col(size) <= max_bytes, F.lit(1)).otherwise(F.ceil(F.col(size) / F.lit(float(step)))).cast("bigint")
    rows = rows.withColumn("_n", n).withColumn("_i", F.explode(F.expr("sequence(0L, _n - 1)")))
    end = F.when(F.col("_n") == 1, F.col(size)).otherwise(F.least(F.col("_i") * step + max_bytes, F.col(size)))
    rows = rows.withColumn("piece_start", F.col("_i") * step).withColumn("piece_end", end)
    split = F.col("_n") > 1
    return rows.withColumn("split_index", F.when(split, F.col("_i"))).withColumn("split_total", F.when(split, F.col("_n"))).drop("_n", "_i")


def file_chunks(files: DataFrame, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of whole files (path, content string): chunk_id, path, start, end, content, split_index, split_total."""
    rows = files.select("path", F.encode("content", "UTF-8").alias("_raw")).withColumn("_size", F.octet_length("_raw").cast("bigint"))
    rows = split_ranges(rows, "_size", max_bytes, overlap)
    rows = rows.withColumn("_piece", utf8_slice(F.col("_raw"), F.col("piece_start"), F.col("piece_end")))
    rows = rows.select("path", "_piece.start", "_piece.end", "_piece.content", "split_index", "split_total")
    return rows.withColumn("chunk_id", chunk_id(F.col("path"), F.col("start"), F.col("end"), F.encode("content", "UTF-8")))


def symbol_chunks(files: DataFrame, symbols: DataFrame, max_bytes: int = MAX_BYTES, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of files (path, language, content): one or more for each symbol, of the whole file where it has none.

    Columns: chunk_id, path, language, start, end, content, and metadata struct(symbol_kind, symbol_name,
    symbol_signature, is_split, split_index, split_total). Files of several archives (a column archive of both tables) are
    told apart by it, and it comes first.
    """
    own = archive_key(files)
    raw = files.select(*own, "path", "language", F.encode("content", "UTF-8").alias("_raw"))
    found = symbols.select(*(F.col(c).alias(f"_{c}") for c in own), F.col("file_path").alias("_path"), F.col("start").alias("_from"), F.col("end").alias("_to"), "kind", "name", "signature")
    same = F.col("path") == F.col("_path")
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = raw.join(found, same, "left").withColumn("_from", F.coalesce("_from", F.lit(0))).withColumn("_to", F.coalesce("_to", F.octet_length("_raw").cast("bigint")))
    rows = split_ranges(rows.withColumn("_size", F.col("_to") - F.col("_from")), "_size", max_bytes, overlap)
    rows = rows.withColumn("_piece", utf8_slice(F.col("_raw"), F.col("_from") + F.col("piece_start"), F.col("_from") + F.col("piece_end")))
    meta = F.struct(
        F.col("kind").alias("symbol_kind"), F.col("name").alias("symbol_name"), F.col("signature").alias("symbol_signature"),
        F.col("split_total").isNotNull().alias("is_split"), "split_index", "split_total",
    )
    rows = rows.select(*own, "path", "language", "_piece.start", "_piece.end", "_piece.content", meta.alias("metadata"))
    return rows.withColumn("chunk_id", chunk_id(F.col("path"), F.col("start"), F.col("end"), F.encode("content", "UTF-8")))
