"""Symbol documentation by a pluggable summariser, with its tokens and cost."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.prompts import cost, count_message_tokens, count_tokens, messages, prompt

FAILED = "[Documentation generation failed: "
Summarizer = Callable[[str], str]


def stub_summarizer(text: str) -> str:
    """A sentence made of the prompt's own lines; the default where no model is at hand."""
    lines = dict(line.split(": ", 1) for line in text.split("\n") if ": " in line)
    return f"{lines.get('Symbol', '')} is a {lines.get('Kind', 'symbol')} in {lines.get('File', 'the codebase')}."


def document(contexts: DataFrame, summarizer: Summarizer = stub_summarizer, retries: int = 3) -> DataFrame:
    """(symbol_id, prompt, summary, input_tokens, output_tokens, tokens_used, warning) of symbol contexts.

    A symbol whose generation fails has a placeholder of the error's first 100 characters, no tokens and a warning.
    """

    @F.pandas_udf("struct<summary: string, failed: boolean>")
    def summaries(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            for turn in range(retries):
                try:
                    out.append((summarizer(text), False))
                    break
                except Exception as error:  # whatever a model's client raises
                    if turn == retries - 1:
                        out.append((f"{FAILED}{str(error)[:100]}]", True))
        return pd.DataFrame(out, columns=["summary", "failed"])

    c = {n: F.col(n) for n in ("language", "name", "kind", "file_path", "signature", "calls", "called_by", "cluster_label", "centrality")}
    text = prompt(c["language"], c["name"], c["kind"], c["file_path"], F.coalesce("signature", F.lit("")), c["calls"], c["called_by"], c["cluster_label"], c["centrality"])
    rows = contexts.select("symbol_id", text.alias("prompt")).withColumn("_s", summaries("prompt"))
    tokens_in = F.when(F.col("_s.failed"), F.lit(0)).otherwise(count_message_tokens(messages(F.col("prompt"))))
    tokens_out = F.when(F.col("_s.failed"), F.lit(0)).otherwise(count_tokens(F.col("_s.summary")))
    rows = rows.select("symbol_id", "prompt", F.col("_s.summary").alias("summary"), tokens_in.cast("bigint").alias("input_tokens"), tokens_out.cast("bigint").alias("output_tokens"), F.when(F.col("_s.failed"), F.concat(F.lit("failed: "), F.col("symbol_id"))).alias("warning"))
    return rows.withColumn("tokens_used", F.col("input_tokens") + F.col("output_tokens"))


def totals(documented: DataFrame) -> DataFrame:
    """One row: symbols, total_tokens, total_cost, n_warnings, warnings."""
    return documented.agg(
        F.count("*").alias("symbols"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("total_tokens"),
        cost(F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0))).alias("total_cost"),
        F.count("warning").alias("n_warnings"), F.array_sort(F.collect_list("warning")).alias("warnings"),
    )


def estimated_tokens(signature: Column, name: Column) -> Column:
    """What a request is expected to need, before any prompt is made."""
    return count_tokens(F.concat_ws(" ", signature, name))
