"""Prompts, token counts and costs.

The tokenizer is pluggable: by default runs of letters, digits, and single other
characters count as tokens, in the JVM and in Python alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]"
MAX_TOKENS = 2000
INPUT_PRICE, OUTPUT_PRICE = 0.15, 0.60  # dollars for a million tokens
SYSTEM = "You are a technical documentation expert. Generate concise, accurate documentation for code symbols."
_ASK = ("Write 1-2 sentences describing what this symbol does.", "Be concise and precise. Focus on purpose, not implementation.")


def count_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))).cast("bigint")


def count_message_tokens(messages: Column) -> Column:
    """3 a message, 3 for the reply, and the tokens of role and content; messages: array of struct(role, content)."""
    each = F.transform(messages, lambda m: F.lit(3) + count_tokens(m["role"]) + count_tokens(m["content"]))
    return F.aggregate(each, F.lit(3).cast("bigint"), lambda s, x: s + x)


def cost(input_tokens: Column, output_tokens: Column, input_price: float = INPUT_PRICE, output_price: float = OUTPUT_PRICE) -> Column:
    return input_tokens / 1e6 * F.lit(input_price) + output_tokens / 1e6 * F.lit(output_price)


def _lines(language: Column, name: Column, kind: Column, file_path: Column, signature: Column | None, calls: Column, called_by: Column, cluster: Column, importance: Column, most: int) -> list[Column]:
    def listed(title: str, names: Column) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(title), F.array_join(F.slice(names, 1, most), ", ")))

    return [
        F.concat(F.lit("You are documenting a "), language, F.lit(" codebase.")),
        F.lit(""),
        F.concat(F.lit("Symbol: "), name),
        F.concat(F.lit("Kind: "), kind),
        F.concat(F.lit("File: "), file_path),
        *([] if signature is None else [F.concat(F.lit("Signature: "), signature)]),
        listed("Calls: ", calls),
        listed("Called by: ", called_by),
        F.when(cluster != "", F.concat(F.lit("Related to: "), cluster)),
        importance,
        F.lit(""),
        *(F.lit(x) for x in _ASK),
    ]


def prompt(language: Column, name: Column, kind: Column, file_path: Column, signature: Column, calls: Column, called_by: Column, cluster: Column, centrality: Column) -> Column:
    """The whole prompt; lines of empty lists and of a missing label are left out."""
    share = F.format_string("Importance: %.2f (0-1 scale)", centrality)
    return F.concat_ws("\n", *_lines(language, name, kind, file_path, signature, calls, called_by, cluster, share, 10))


def regex_tokens(text: str) -> list[str]:
    """Tokens with the white space before them, so that their concatenation is the text's beginning."""
    return re.findall(rf"\s*(?:{TOKEN})", text)


def truncate(text: str, most: int, suffix: str = "...", tokens: Callable[[str], list[str]] = regex_tokens) -> str:
    found = tokens(text)
    if len(found) <= most:
        return text
    left = most - len(tokens(suffix))
    return "".join(found[:left]) + suffix if left > 0 else suffix


def short_prompt(language: Column, name: Column, kind: Column, file_path: Column, signature: Column, calls: Column, called_by: Column, cluster: Column, centrality: Column, most: int = MAX_TOKENS, tokens: Callable[[str], list[str]] = regex_tokens) -> Column:
    """The prompt with lists of five and the signature cut to what the limit leaves."""
    share = F.format_string("Importance: %.2f", centrality)
    lines = _lines(language, name, kind, file_path, None, calls, called_by, cluster, share, 5)
    base = F.concat_ws("\n", *lines)
    head, tail = F.concat_ws("\n", *lines[:5]), F.concat_ws("\n", *lines[5:])

    @F.pandas_udf("string")
    def cut(whole: pd.Series, sign: pd.Series) -> pd.Series:
        spare = [most - len(tokens(b)) - len(tokens("Signature: ")) - 10 for b in whole]
        return pd.Series([truncate(s or "", n, tokens=tokens) if n > 0 else "..." for s, n in zip(sign, spare, strict=True)])

    return F.concat_ws("\n", head, F.concat(F.lit("Signature: "), cut(base, signature)), tail)


def messages(text: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content")))
