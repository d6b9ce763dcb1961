"""Symbols, calls and imports of source files, as tables."""

from __future__ import annotations

from collections.abc import Iterator
from types import ModuleType

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.languages import EXTRACTORS
from corpusloom.schemas import CALLS, IMPORTS, SYMBOLS, archive_key


def _found(extractor: ModuleType, what: str, content: str) -> list[dict]:
    """What the extractor finds; nothing in a text nested deeper than it can follow."""
    try:
        return getattr(extractor, what)(content.encode("utf-8", "replace"))
    except (RecursionError, MemoryError):
        return []


def _extract(files: DataFrame, what: str, schema: str, columns: list[str]) -> DataFrame:
    """A row for each thing found, numbered within its file; a file whose text an extractor can't take has none. An archive column is carried."""
    own = archive_key(files)
    names = [*own, "file_path", "language", "ordinal", *columns]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for *archive, path, language, content in zip(*(batch[c] for c in (*own, "path", "language", "content")), strict=True):
                extractor = EXTRACTORS.get(language)
                found = _found(extractor, what, content) if extractor and isinstance(content, str) else []
                out += [(*archive, path, language, i, *(row[c] for c in columns)) for i, row in enumerate(found)]
            yield pd.DataFrame(out, columns=names)

    read = files.select(*(F.col(c).cast("string") for c in own), "path", "language", F.col("content").cast("string").alias("content"))
    return read.mapInPandas(rows, ", ".join([*(f"{c} string" for c in own), schema]))


def extract_symbols(files: DataFrame) -> DataFrame:
    """Of files (path, language, content)."""
    return _extract(files, "symbols", SYMBOLS, ["kind", "name", "start", "end", "name_start", "name_end", "signature", "visibility", "is_async"])


def extract_calls(files: DataFrame) -> DataFrame:
    return _extract(files, "calls", CALLS, ["name", "start", "end", "kind"])


def extract_imports(files: DataFrame) -> DataFrame:
    return _extract(files, "imports", IMPORTS, ["module_path", "items", "alias", "start", "end", "is_wildcard"])
