"""Calls resolved against the symbols of their repository: of their archive, where the tables name it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import symbol_id
from corpusloom.schemas import archive_key


def symbol_table(symbols: DataFrame) -> DataFrame:
    """(name, symbol_id): the last symbol of each name by file and place in it."""
    own = archive_key(symbols)
    rows = symbols.select(*own, "name", symbol_id(F.col("file_path"), F.col("name")).alias("id"), F.struct("file_path", "ordinal").alias("_order"))
    return rows.groupBy(*own, "name").agg(F.max_by("id", "_order").alias("symbol_id"))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls with symbol_id and is_resolved: by the whole name, else by what follows the last ".", else the last "::".

    One join on the candidate names with their priority; no call is lost or doubled.
    """
    names = F.array(F.col("name"), F.when(F.col("name").contains("."), F.substring_index("name", ".", -1)), F.when(F.col("name").contains("::"), F.substring_index("name", "::", -1)))
    own = archive_key(calls)
    keyed = calls.withColumn("_key", F.struct(*own, "file_path", "ordinal"))
    tries = keyed.select("_key", *own, F.posexplode(names).alias("_try", "_name")).where("_name is not null")
    table = symbol_table(symbols).withColumnRenamed("name", "_name")
    found = tries.join(table, [*own, "_name"]).groupBy("_key").agg(F.min_by("symbol_id", "_try").alias("symbol_id"))
    return keyed.join(found, "_key", "left").drop("_key").withColumn("is_resolved", F.col("symbol_id").isNotNull())


def call_pairs(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) for each resolved call inside a symbol: the innermost symbol around it, and the one it resolves to."""
    own = archive_key(calls)
    inside = symbols.select(*own, "file_path", symbol_id(F.col("file_path"), F.col("name")).alias("src"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    rows = resolve_calls(calls, symbols).where("is_resolved").join(inside, [*own, "file_path"]).where("_s <= start and end <= _e")
    return rows.groupBy(*own, "file_path", "ordinal", F.col("symbol_id").alias("dst")).agg(F.min_by("src", F.col("_e") - F.col("_s")).alias("src")).select(*own, "src", "dst")
