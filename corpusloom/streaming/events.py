"""Event streams: reading, running statistics, deduplication, and jobs that end.

Every function takes and gives streaming DataFrames; a query ends by its trigger
(availableNow) or stop(), and goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.events import event_class
from corpusloom.schemas import EVENTS

TRIGGER = "500 milliseconds"


def read_event_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Events of "data: {...}" lines in files that arrive in a folder; a line that isn't JSON is kept in corrupt."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).where(F.col("value").startswith("data: "))
    body = F.substring("value", 7, 1 << 30)
    parsed = F.from_json(body, EVENTS)
    good = F.try_parse_json(body).isNotNull() & parsed.isNotNull() & F.get_json_object(body, "$.event_type").isNotNull()
    rows = lines.select(F.when(good, parsed).alias("e"), F.when(~good, body).alias("corrupt"), F.when(good, F.get_json_object(body, "$.payload")).alias("_payload"))
    return rows.select("e.*", "corrupt", "_payload").withColumn("payload", F.col("_payload")).drop("_payload")


def read_event_table(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_statistics(events: DataFrame, job: str = "job_id") -> DataFrame:
    """Counts by job and class so far; for update mode."""
    return events.groupBy(job, event_class(F.col("event_type")).alias("class")).agg(F.count("*").alias("n"))


def unique_events(events: DataFrame, time: str = "timestamp", delay: str = "10 minutes", keys: tuple[str, ...] = ("job_id", "idempotency_key")) -> DataFrame:
    """Each event once within the delay, whatever the retries."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "1 hour", delay: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts by tumbling window, closed when the watermark has passed them."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    return rows.groupBy(F.window("_t", size).alias("window"), by).agg(F.count("*").alias("n"))


def session_counts(events: DataFrame, time: str = "ts", gap: str = "30 minutes", delay: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """Events by session, which ends after a gap."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    return rows.groupBy(F.session_window("_t", gap).alias("session"), by).agg(F.count("*").alias("n"))


def finished_jobs(events: DataFrame) -> DataFrame:
    """(job_id, status, events) once for each job, when its terminal event comes; the job's state is then a single flag.

    events: (job_id, event_type, status).
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, done = state.get if state.exists else (0, False)
        out = []
        for b in batches:
            seen += len(b)
            ended = b[b["event_type"].str.endswith("assembly.completed.v1") | b["event_type"].str.endswith("ingest.completed.v1")]
            if len(ended) and not done:
                done = True
                out.append(ended["status"].iloc[-1] or "success")
        state.update((seen, done))
        if out:
            yield pd.DataFrame({"job_id": [key[0]], "status": [out[-1]], "events": [seen]})

    return events.select("job_id", "event_type", "status").groupBy("job_id").applyInPandasWithState(update, "job_id string, status string, events long", "seen long, done boolean", "append", GroupStateTimeout.NoTimeout)


def start(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", until_empty: bool = False) -> StreamingQuery:
    """Write every batch; with until_empty the query ends when it has read what is there."""
    query = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if until_empty else query.trigger(processingTime=TRIGGER)).start()
