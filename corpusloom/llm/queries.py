"""One query for each operator over its whole table, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._labels import held_out
from corpusloom.llm.best_fit import best_fit_pack
from corpusloom.llm.cnn_toxicity import CUT, toxicity_score, train_toxicity
from corpusloom.llm.crf_quality import quality_score, train_quality
from corpusloom.llm.itq import near_vectors
from corpusloom.llm.line_dedup import duplicate_lines
from corpusloom.llm.line_frequency import line_frequency_rules
from corpusloom.llm.pfor import read_token_files, write_token_files
from corpusloom.llm.rlz import remove_duplicates
from corpusloom.llm.sampled_pieces import sample_pieces
from corpusloom.llm.weighted_minhash import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(train_quality(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency_rules(_table(spark, sf_dir, "documents"))


def op3_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity_score(train_toxicity(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(_table(spark, sf_dir, "documents")).drop("key")


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sample_pieces(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    pieces = (F.octet_length("ids") / 4).cast("long")
    return found.select("doc_id", "sample", pieces.alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "log_prob", "perturbed", "inclusion")


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_duplicates(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), share=0).drop("key")


def op9_pfor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm._store import new_path

    path = new_path(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_crf_quality, op2_line_frequency, op3_cnn_toxicity, op4_line_dedup, op5_sampled_pieces, op6_best_fit, op7_rlz, op8_weighted_minhash, op9_pfor, op10_itq]
    return {f.__name__: f for f in found}


_WORD = r"[^\x20\x09-\x0D]+"

OP2_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents
), w as (
  select *, regexp_extract_all(text, '{_WORD}') as words, string_split(text, chr(10)) as lines from d
), pos as (
  select r, words, unnest(range(1, len(words) - 1)) as i from w where len(words) > 2
), win as (
  select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g from pos
), twice as (
  select r, i from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1
), rep as (
  select r, count(distinct i + k) as n_repeat_words from twice, (values (0), (1), (2)) as t(k) group by r
), line as (
  select r, doc_id, source, unnest(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}'))) as line from w
), dup as (
  select r, count(*) - count(distinct line) as n_dup_lines from line group by r
), norm as (
  select r, doc_id, source, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '{_WORD}') as ws from line
), often as (
  select source, ws from norm group by source, ws having count(distinct doc_id) > 50
), gone as (
  select r, sum(len(norm.ws)) as n_frequent_words from norm join often on norm.ws = often.ws and norm.source is not distinct from often.source group by r
), base as (
  select w.r, w.doc_id, len(words)::bigint as n_words, coalesce(length(array_to_string(words, '')), 0)::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_frequent_words, 0)::bigint as n_frequent_words
  from w left join dup on w.r = dup.r left join rep on w.r = rep.r left join gone on w.r = gone.r
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  (not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - n_frequent_words >= 0.3::double * n_words) as kept
from base
"""

OP7_SQL = rf"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as words from documents
), pos as (
  select doc_id, words, unnest(range(1, len(words) - 18)) as i from d where len(words) >= 20
), win as (
  select doc_id, i, row_number() over (partition by sha256(array_to_string(words[i:i + 19], ' ')) order by doc_id, i) as n from pos
), gone as (
  select doc_id, list(distinct i + k) as places from win, range(0, 20) as t(k) where n > 1 group by doc_id
), kept as (
  select d.doc_id, words, case when places is null then words else list_filter(words, lambda x, i: not list_contains(places, i)) end as left_words
  from d left join gone on d.doc_id = gone.doc_id
)
select doc_id, len(words)::bigint as n_words, (len(words) - len(left_words))::bigint as n_removed,
  sha256(coalesce(array_to_string(left_words, ' '), '')) as kept_sha256
from kept
"""

OP10_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98
), reach(x, y) as (
  select x, y from link union select reach.x, link.y from reach join link on reach.y = link.x
), n as (select x, count(*) as n_links from link group by x), c as (select x, min(y) as low from reach group by x)
select e.vec_id, coalesce(n_links, 0)::bigint as n_links, least(e.vec_id, coalesce(low, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) as kept
from embeddings e left join n on e.vec_id = n.x left join c on e.vec_id = c.x
"""


def oracle_sql() -> dict[str, str]:
    """The other queries' methods learn, sample or tokenise; their tests compare them with brute force."""
    return {"op2_line_frequency": OP2_SQL, "op7_rlz": OP7_SQL, "op10_itq": OP10_SQL}
