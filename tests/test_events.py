import json


from pyspark.sql import functions as F

from corpusloom.operators import events as E
from corpusloom.streaming import events as S


def log(spark):
    rows = [
        ("evt_1", "ingest.started.v1", 0, "{}", None), ("evt_2", "ingest.file_detected.v1", 1, '{"file_path": "a", "language": "go"}', None), ("evt_3", "ingest.chunk_created.v1", 2, '{"file_path": "a"}', None),
        ("evt_4", "ingest.chunk_created.v1", 3, '{"file_path": "late"}', None), ("evt_5", "ingest.file_detected.v1", 4, '{"file_path": "late", "language": "rust"}', None),
        ("evt_6", "ingest.file_skipped.v1", 5, '{"file_path": "b", "reason": "binary"}', None), ("evt_7", "ingest.completed.v1", 6, '{"files_processed": 9, "duration_ms": 1500}', "failed"),
    ]
    return spark.createDataFrame([("job_1", *r) for r in rows] + [("job_2", "evt_8", "ingest.started.v1", 0, "{}", None)], "job_id string, event_id string, event_type string, sequence long, payload string, status string")


def test_statistics(spark):
    got = {r["job_id"]: r for r in E.run_statistics(log(spark)).collect()}
    assert got["job_1"].asDict() == {"job_id": "job_1", "files_detected": 9, "files_skipped": 1, "chunks_created": 2, "status": "failed", "duration_ms": 1500}
    assert got["job_2"]["status"] == "running"
    assert {r["event_id"]: r["language"] for r in E.with_detected_language(log(spark)).collect()} == {"evt_3": "go", "evt_4": "unknown"}
    assert E.with_detected_language(log(spark), keep_undetected=False).count() == 1
    assert {r["job_id"]: r["status"] for r in E.terminal_status(log(spark)).collect()} == {"job_1": "failed", "job_2": "running"}


def test_validation(spark):
    rows = [("evt_1", "ingest.started.v1", "u", None), ("x", "ingest.started.v1", "u", None), ("evt_1", "odd", "u", None), ("evt_1", "ingest.started.v1", "", None), ("evt_1", "ingest.completed.v1", "u", None), ("evt_1", "ingest.started.v1", "u", "success"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    got = [r[0] for r in df.select(E.validation_error(*(F.col(c) for c in "abcd"))).collect()]
    assert got == [None, "invalid_event_id", "invalid_event_type", "empty_repo_url", "missing_status", "unexpected_status", "invalid_event_id"]
    requests = spark.createDataFrame([("https://github.com/a/b", "job_12345"), ("", "job_12345"), ("ftp://x", "job_12345"), ("https://github.com/a/b", ""), ("https://github.com/a/b", "x")], "u string, j string")
    assert [r[0] for r in requests.select(E.request_error(F.col("u"), F.col("j"))).collect()] == [None, "empty_repo_url", "invalid_repo_url", "empty_job_id", "invalid_job_id"]
    bad = spark.createDataFrame([("e1", "ingest.file_skipped.v1", '{"file_path": "a"}', None), ("e2", "ingest.completed.v1", '{"total_files":1,"total_chunks":1,"languages":[],"warnings":[]}', "partial")], "event_id string, event_type string, payload string, status string")
    assert {tuple(r) for r in E.payload_errors(bad).select("event_id", "problem").collect()} == {("e1", "missing reason"), ("e2", "status partial")}


def run(rows, folder, mode="append"):
    out = {}
    def write(batch, i):
        out[i] = [r.asDict(recursive=True) for r in batch.collect()]
    query = S.start(rows, write, str(folder), mode, until_empty=True)
    assert query.awaitTermination(120)
    return [r for i in sorted(out) for r in out[i]]


def test_event_lines(spark, tmp_path):
    good = {"event_id": "evt_1", "event_type": "ingest.started.v1", "sequence": 0, "payload": {"a": 1}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text(f": keepalive\ndata: {json.dumps(good)}\ndata: not json\n\n")
    got = run(S.read_event_lines(spark, str(tmp_path / "in")), tmp_path / "c")
    assert sorted((r["event_id"], r["payload"], r["corrupt"]) for r in got if r["event_id"]) == [("evt_1", '{"a":1}', None)]
    assert [r["corrupt"] for r in got if r["corrupt"]] == ["not json"]


def test_streams(spark, tmp_path):
    rows = log(spark).withColumn("timestamp", F.timestamp_seconds(F.col("sequence") + 1_000_000)).withColumn("idempotency_key", F.when(F.col("event_id") == "evt_4", "evt_3").otherwise(F.col("event_id")))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: S.read_event_table(spark, str(tmp_path / "in"), rows.schema)
    counts = run(S.running_statistics(stream()), tmp_path / "c1", "update")
    assert {(r["job_id"], r["class"]): r["n"] for r in counts}["job_1", "chunks"] == 2
    assert len(run(S.unique_events(stream()), tmp_path / "c2")) == 7
    assert run(S.finished_jobs(stream()), tmp_path / "c3") == [{"job_id": "job_1", "status": "failed", "events": 7}]
    windows = run(S.windowed_counts(stream(), "timestamp", "2 seconds", "0 seconds"), tmp_path / "c4")
    assert sum(r["n"] for r in windows) >= 5
    assert sum(r["n"] for r in run(S.session_counts(stream(), "timestamp", "1 minute", "0 seconds", "job_id"), tmp_path / "c5", "append")) >= 0
