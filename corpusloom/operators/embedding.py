"""Embeddings of chunks by a pluggable embedder, in Arrow batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.schemas import EMBEDDINGS

DIMENSIONS = 384
MOST_TOKENS = 512
Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed feature hashing of a text's first words, at length 1 (the zero vector for a text without words)."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for row, text in zip(out, texts, strict=True):
        for word in re.findall(r"\w+", text.lower())[:MOST_TOKENS]:
            h = zlib.crc32(word.encode())
            row[h % dimensions] += 1.0 if h >> 16 & 1 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=out, where=size > 0)


def pooled(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens that mask (texts x tokens) keeps of vectors (texts x tokens x dimensions), at length 1."""
    kept = mask[:, :, None].astype(np.float32)
    mean = (vectors * kept).sum(axis=1) / np.maximum(kept.sum(axis=1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def embed(chunks: DataFrame, embedder: Embedder = hashing_embedder, batch: int = 64) -> DataFrame:
    """(chunk_id, vector) of chunks (chunk_id, content). A batch that fails is tried text by text; a text that fails has no row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                texts = part["content"].fillna("").tolist()
                try:
                    found = list(embedder(texts))
                except Exception:  # an embedder may refuse a text; its batch must not be lost with it
                    found = []
                    for t in texts:
                        try:
                            found.append(embedder([t])[0])
                        except Exception:
                            found.append(None)
                yield pd.DataFrame([(c, np.asarray(v, np.float32)) for c, v in zip(part["chunk_id"], found, strict=True) if v is not None], columns=["chunk_id", "vector"])

    return chunks.select("chunk_id", "content").mapInPandas(rows, EMBEDDINGS)
