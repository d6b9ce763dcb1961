"""The event log: envelopes, checks, sequences, statistics, and what a viewer groups from it.

Events are rows (event_id, event_type, timestamp, sequence, context, meta, payload, status); payload is a JSON object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import EVENT_TYPES, derived_id, is_terminal

# Payload fields that each event type must have, and the statuses of terminal ones.
REQUIRED = {
    "job.created.v1": "estimated_cost estimated_duration_ms",
    "job.validated.v1": "file_count size_bytes languages",
    "job.started.v1": "worker_assignments",
    "job.completed.v1": "warnings",
    "ingest.started.v1": "",
    "ingest.file_detected.v1": "file_path size_bytes",
    "ingest.file_skipped.v1": "file_path reason",
    "ingest.chunk_created.v1": "chunk_id file_path language content_hash byte_range",
    "ingest.completed.v1": "total_files total_chunks languages warnings",
    "embedding.started.v1": "total_chunks",
    "embedding.batch_started.v1": "batch_id chunk_ids batch_size",
    "embedding.chunk_vector.v1": "chunk_id vector_hash dimensions",
    "embedding.batch_completed.v1": "batch_id vector_count duration_ms warnings",
    "embedding.completed.v1": "total_vectors duration_ms warnings",
    "assembly.started.v1": "total_embeddings total_symbols",
    "assembly.cluster_created.v1": "cluster_id label member_count",
    "assembly.graph_completed.v1": "node_count edge_count",
    "assembly.completed.v1": "clusters metrics warnings",
    "generation.started.v1": "symbol_count estimated_tokens",
    "generation.symbol_documented.v1": "symbol_id token_count",
    "generation.completed.v1": "total_tokens total_cost duration_ms warnings",
    "pack.started.v1": "artifact_count",
    "pack.completed.v1": "size_bytes checksum schema_version skipped_files warnings",
}
STATUSES = {
    "job.completed.v1": "success failed cancelled",
    "ingest.completed.v1": "success failed",
    "embedding.batch_completed.v1": "success failed",
    "embedding.completed.v1": "success failed",
    "assembly.completed.v1": "success failed",
    "generation.completed.v1": "success failed",
    "pack.completed.v1": "success failed partial",
}


def field(name: str, payload: str = "payload") -> Column:
    return F.get_json_object(payload, f"$.{name}")


def envelope(event_type: Column, payload: Column, job_id: Column, repo_url: Column, timestamp: Column, ordinal: Column, status: Column | None = None, producer: str = "corpusloom/1") -> list[Column]:
    """The columns of an event; its id follows from job, type and ordinal, so a second run makes the same events."""
    none = F.lit(None).cast("string")
    key = derived_id("", job_id, event_type, ordinal)
    return [
        derived_id("evt_", job_id, event_type, ordinal).alias("event_id"),
        event_type.alias("event_type"),
        timestamp.alias("timestamp"),
        F.struct(job_id.alias("job_id"), repo_url.alias("repo_url"), none.alias("git_ref"), none.alias("user_id")).alias("context"),
        F.struct(F.lit(producer).alias("producer_version"), none.alias("trace_id"), none.alias("parent_event_id"), key.alias("idempotency_key"), F.array().cast("array<string>").alias("tags")).alias("meta"),
        payload.alias("payload"),
        (none if status is None else status).alias("status"),
    ]


def validation_error(event_id: Column, event_type: Column, repo_url: Column, status: Column) -> Column:
    """The first check that fails, or null."""
    return (
        F.when(~F.coalesce(event_id.startswith("evt_"), F.lit(False)), "invalid_event_id")
        .when(~F.coalesce(event_type.isin(*EVENT_TYPES), F.lit(False)), "invalid_event_type")
        .when(F.coalesce(repo_url, F.lit("")) == "", "empty_repo_url")
        .when(is_terminal(event_type) & status.isNull(), "missing_status")
        .when(~is_terminal(event_type) & status.isNotNull(), "unexpected_status")
    )


def request_error(repo_url: Column, job_id: Column) -> Column:
    """Why a request to ingest is refused, or null."""
    from corpusloom.functions.paths import parse_repo_url
    from corpusloom.functions.text import valid_id

    return (
        F.when(F.coalesce(repo_url, F.lit("")) == "", "empty_repo_url")
        .when(parse_repo_url(repo_url).isNull(), "invalid_repo_url")
        .when(F.coalesce(job_id, F.lit("")) == "", "empty_job_id")
        .when(~valid_id(job_id, "job"), "invalid_job_id")
    )


def payload_errors(events: DataFrame) -> DataFrame:
    """(event_id, event_type, problem): required fields that a payload lacks, statuses its type doesn't have."""
    needed = F.create_map(*(x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*(F.lit(f) for f in v.split())).cast("array<string>"))))
    allowed = F.create_map(*(x for k, v in STATUSES.items() for x in (F.lit(k), F.array(*(F.lit(f) for f in v.split())))))
    keys = F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>"))
    missing = F.array_except(F.coalesce(F.try_element_at(needed, F.col("event_type")), F.array().cast("array<string>")), keys)
    named = F.transform(missing, lambda f: F.concat(F.lit("missing "), f))
    statuses = F.try_element_at(allowed, F.col("event_type"))
    wrong = F.when(statuses.isNotNull() & F.col("status").isNotNull() & ~F.array_contains(statuses, F.col("status")), F.array(F.concat(F.lit("status "), F.col("status"))))
    problems = F.concat(named, F.coalesce(wrong, F.array().cast("array<string>")))
    return events.select("event_id", "event_type", F.explode(problems).alias("problem"))


def with_sequence(events: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """events with sequence 0, 1, ... of their job."""
    return events.withColumn("sequence", (F.row_number().over(Window.partitionBy(job).orderBy(*order)) - 1).cast("bigint"))


def sequence_breaks(events: DataFrame, job: str = "job_id", order: str = "timestamp") -> DataFrame:
    """Events whose sequence isn't above that of the event before, in the order of arrival."""
    before = F.lag("sequence").over(Window.partitionBy(job).orderBy(order, "event_id"))
    return events.withColumn("previous", before).where("previous is not null and sequence <= previous")


def event_class(event_type: Column) -> Column:
    return (
        F.when(event_type.contains("file_detected"), "detected")
        .when(event_type.contains("file_skipped"), "skipped")
        .when(event_type.contains("chunk_created"), "chunks")
        .when(event_type.contains("completed"), "completed")
        .when(event_type.contains("started"), "started")
    )


def run_statistics(events: DataFrame, job: str = "job_id") -> DataFrame:
    """One row per job: counts by class, replaced by those of its last completed event where that has them; status and duration."""
    kind = event_class(F.col("event_type"))
    last = F.struct("sequence", "payload", "status")
    rows = events.groupBy(job).agg(
        F.count_if(kind == "detected").alias("_detected"), F.count_if(kind == "skipped").alias("_skipped"), F.count_if(kind == "chunks").alias("_chunks"),
        F.max(F.when(kind == "completed", last)).alias("_last"),
    )
    payload = F.col("_last.payload")

    def final(*names: str) -> Column:
        return F.coalesce(*(F.get_json_object(payload, f"$.{n}").cast("bigint") for n in names))

    return rows.select(
        job,
        F.coalesce(final("files_processed", "files_detected"), "_detected").alias("files_detected"),
        F.coalesce(final("files_skipped"), "_skipped").alias("files_skipped"),
        F.coalesce(final("chunks_created"), "_chunks").alias("chunks_created"),
        F.when(F.col("_last").isNull(), "running").otherwise(F.coalesce("_last.status", F.lit("completed"))).alias("status"),
        final("duration_ms").alias("duration_ms"),
    )


def counts_by(events: DataFrame, event_type: str, name: str, default: str = "unknown") -> DataFrame:
    """(value, n) of a payload field over events of a type, most frequent first, then by value."""
    value = F.coalesce(field(name), F.lit(default)).alias(name)
    return events.where(F.col("event_type") == event_type).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def language_breakdown(chunks: DataFrame) -> DataFrame:
    """(language, file_count, chunk_count) of chunks (path, language)."""
    return chunks.groupBy("language").agg(F.count_distinct("path").alias("file_count"), F.count("*").alias("chunk_count"))


def terminal_status(events: DataFrame, job: str = "job_id") -> DataFrame:
    """(job, status) of the last terminal event; "running" where there is none."""
    done = F.when(is_terminal(F.col("event_type")), F.struct("sequence", F.coalesce("status", F.lit("success")).alias("status")))
    return events.groupBy(job).agg(F.max(done).alias("_d")).select(job, F.coalesce("_d.status", F.lit("running")).alias("status"))


def with_detected_language(events: DataFrame, job: str = "job_id", keep_undetected: bool = True) -> DataFrame:
    """chunk_created events with the language of the last file_detected event of their path before them ("unknown" without
    one, or dropped): a running last value over the job's path, not a join of pairs."""
    path, found = field("file_path"), F.col("event_type") == "ingest.file_detected.v1"
    rows = events.where(found | (F.col("event_type") == "ingest.chunk_created.v1")).withColumn("file_path", path)
    last = F.last(F.when(found, F.coalesce(field("language"), F.lit("unknown"))), ignorenulls=True).over(Window.partitionBy(job, "file_path").orderBy("sequence"))
    rows = rows.withColumn("language", last).where(~found)
    return rows.na.fill("unknown", ["language"]) if keep_undetected else rows.where("language is not null")


def dedupe_events(events: DataFrame, job: str = "job_id") -> DataFrame:
    """The first event of each idempotency key; events without a key stay."""
    keyed = events.where("idempotency_key is not null")
    first = F.row_number().over(Window.partitionBy(job, "idempotency_key").orderBy("sequence"))
    return keyed.withColumn("_n", first).where("_n = 1").drop("_n").unionByName(events.where("idempotency_key is null"))


def ingest_totals(files: DataFrame) -> DataFrame:
    """One row: files_processed, files_skipped of classified files."""
    return files.agg(F.count_if(F.col("skip_reason").isNull()).alias("files_processed"), F.count_if(F.col("skip_reason").isNotNull()).alias("files_skipped"))


def chunk_rate(chunks: Column, duration_ms: Column) -> Column:
    return F.when(duration_ms > 0, chunks * 1000.0 / duration_ms).otherwise(F.lit(0.0))
