"""The bounded sample of labelled documents that the two classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._store import bounded_batches


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where crc32 of the doc_id as text is 1 modulo 3; a null doc_id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(label, text) of up to per_class documents of either class, the first by a hash of doc_id, in that order's hash h.

    Only rows that aren't held out; a null label, a label other than 0 or 1, and
    a doc_id with both labels teach nothing. The drawn ids, 2 * per_class rows at
    most, are broadcast.
    """
    bounded_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    marks = marks.where("doc_id is not null and label in (0, 1)").where(~held_out())
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    marks = marks.select("doc_id", "label", F.xxhash64("doc_id").alias("h"))
    drawn = marks.where("label = 0").orderBy("h").limit(per_class).unionByName(marks.where("label = 1").orderBy("h").limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").select("label", "h", F.coalesce("text", F.lit("")).alias("text"))


def label_shares(labels: DataFrame, label: str) -> dict[int, int]:
    """Rows of each class among the labels that may be learnt from."""
    rows = labels.where(~held_out()).groupBy(F.col(label).cast("int").alias("label")).count().collect()
    return {r["label"]: r["count"] for r in rows if r["label"] in (0, 1)}
