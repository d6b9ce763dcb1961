"""Quality rules by cross-document line frequency.

Each document gets the counts of the base rules. Its lines are normalised (words
joined by one space, ASCII letters in lower case, ASCII digits as 0) and hashed;
a line that more than ``max_documents`` distinct documents of one host hold is
removed; a document that keeps less than ``min_share`` of its words is rejected.

Defined cases: a null text has no words, so it fails the base rules; a null host
is a host of its own; rows that repeat a doc_id count once in a line's
documents, rows whose doc_id is null count each; a line without a word has no
frequency; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import _arrays as A
from corpusloom.llm._store import bounded_batches, in_set, keep

MAX_DOCUMENTS = 50
MIN_SHARE = 0.3
CHUNK = 4 << 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[ord("A") : ord("Z") + 1] += 32
_NORMAL[ord("0") : ord("9") + 1] = ord("0")

SCHEMA = (
    "row long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<h:long,n:int>>"
)


def _measure(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The five counts by document; hash, words and document offsets of its distinct normalised lines."""
    n_docs = len(off) - 1
    starts, ends = A.spans(data, off)
    first = np.searchsorted(starts, off)
    n_words = np.diff(first)

    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    chars = A.totals(inside & ((data & 0xC0) != 0x80), off)
    symbols = A.totals(_SYMBOL[data], off)

    line_start, line_end, first_line = A.line_spans(data, off)
    from_word, to_word = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    has_word = to_word > from_word
    doc_of_line = np.repeat(np.arange(n_docs), np.diff(first_line))
    salt = A.mix(np.arange(1, n_docs + 1, dtype=A.U64))
    raw = A.span_hash(data, line_start, line_end) ^ salt[doc_of_line]
    again = np.zeros(len(raw), bool)
    again[has_word] = pd.Series(raw[has_word]).duplicated().to_numpy()
    dup_lines = A.totals(again, first_line)

    words = A.span_hash(data, starts, ends)
    at, per = A.windows(n_words, 3)
    doc_of = np.repeat(np.arange(n_docs), per)
    twice = at[A.repeated(A.ngram_hash(words, 3)[at] ^ salt[doc_of])] if len(at) else at
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[twice + k] = True
    repeats = A.totals(covered, first)

    h = A.run_hash(A.span_hash(_NORMAL[data], starts, ends), from_word, to_word).view(np.int64)
    lines = pd.DataFrame({"d": doc_of_line[has_word], "h": h[has_word], "n": (to_word - from_word)[has_word]})
    lines = lines.groupby(["d", "h"], sort=False, as_index=False)["n"].sum().sort_values("d", kind="stable")
    bounds = np.searchsorted(lines["d"].to_numpy(), np.arange(n_docs + 1))
    return [n_words, chars, symbols, dup_lines, repeats], lines["h"].to_numpy(), lines["n"].to_numpy(np.int32), bounds


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in A.slices(batches, "text", CHUNK):
        counts, h, n, bounds = _measure(*A.utf8(batch.column("text")))
        lines = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(h), pa.array(n)], ["h", "n"]))
        columns = [batch.column("row"), batch.column("doc_id"), batch.column("host"), *(pa.array(x, pa.int64()) for x in counts), lines]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def line_frequency_rules(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per row of docs (doc_id, text, host column): the counts, n_frequent_words, base_failed and kept.

    The texts are read once; all later steps work on counts and line hashes.
    Lines are counted with map-side sums, and a line that a third of all
    documents hold is joined as a skewed key, which adaptive execution splits.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    base = keep(rows.mapInArrow(_rows, SCHEMA), "line-rules")
    lines = base.select(
        "row",
        F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.col("doc_id")).alias("doc"),
        F.col("doc_id").isNull().alias("no_id"),
        F.xxhash64("host").alias("host"),
        F.explode("lines").alias("line"),
    ).select("row", "doc", "no_id", F.xxhash64("host", "line.h").alias("k"), F.col("line.n").alias("n"))
    often = keep(lines.select("k", "doc", "no_id").distinct().groupBy("k").count().where(F.col("count") > max_documents).select("k"), "frequent")
    gone = in_set(lines.select("row", "k", "n"), "k", often, "k").join(often, "k").groupBy("row").agg(F.sum("n").alias("n_frequent_words"))
    failed = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"
    return (
        base.drop("lines", "host")
        .join(gone, "row", "left")
        .withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", F.expr(failed))
        .withColumn("kept", F.expr(f"not base_failed and n_words - n_frequent_words >= {float(min_share)}D * n_words"))
        .drop("row")
    )
