"""A corpus in five stages: quality, line dedup, near-dedup, substring dedup, packing.

Each stage reads what its predecessor wrote; run() writes every stage's result as
Parquet in the shared folder and deletes its predecessor's then. It touches no
tables but its own.

Defined cases: a null or empty text is scored like any other and goes on, unless
the classifier rejects it; null doc_ids come last wherever documents are ordered;
rows equal in doc_id and text are one document, which the near-dedup stage
returns once; a document that loses all its words goes; without labels every
score is 0.5, so every document stays; an empty table gives an empty result of
the same columns. Columns but those of documents are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._store import Scope
from corpusloom.llm.best_fit import best_fit_pack
from corpusloom.llm.crf_quality import quality_score, train_quality
from corpusloom.llm.line_dedup import duplicate_lines, remove_lines
from corpusloom.llm.rlz import remove_duplicates
from corpusloom.llm.weighted_minhash import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_WORD = r"[^\x20\x09-\x0D]"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality 0.5 or more."""
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(*COLUMNS).where(quality_score(model) >= 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line is similar to."""
    left = remove_lines(docs, duplicate_lines(docs), COLUMNS).where((F.col("n_removed") == 0) | F.col("text").rlike(_WORD))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each cluster."""
    kept = near_duplicates(docs, share=0).where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("_n"))
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    found = docs.select(*COLUMNS).join(kept, doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(doc_id, text) == F.col("_key")))
    return found.where("_n = 1").select(*COLUMNS).unionByName(found.where("_n > 1").dropDuplicates(["_id", "_key"]).select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that an earlier text holds."""
    left = remove_duplicates(docs, layout=True, columns=COLUMNS).where("n_removed = 0 or n_removed < n_words")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # a classifier, MinHash and a tokenizer are beyond SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the stages keep of documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with Scope(spark) as scope:
            if before is not None:
                scope.take(before)
            docs = scope.result(stage(spark, docs, sf_dir), name)
        before = scope
    return docs
