import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators.documentation import FAILED, document, totals
from corpusloom.operators.embedding import embed, hashing_embedder, pooled
from corpusloom.operators.events import sequence_breaks
from corpusloom.plans import jobs
from corpusloom.schemas import BundleError, InvalidInput
from corpusloom.sources import archives, bundle

REPO = {
    "src/main.rs": b"pub fn run() { helper(); }\nfn helper() {}\n", "script.py": b"class A:\n    def m(self): return run()\n\ndef run():\n    return 1\n",
    "data.bin": b"\x00\x01", "node_modules/package.json": b"{}", "Cargo.lock": b"x", "bad.rs": b"fn broken( {", "notes.txt": b"text",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("zips")
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("repo-main/", b"")
        for name, content in REPO.items():
            z.writestr(f"repo-main/{name}", content)
        z.writestr("../evil.rs", b"fn x() {}")
    (folder / "r.zip").write_bytes(raw.getvalue())
    (folder / "broken.zip").write_bytes(b"PK nothing")
    return archives.read_archives(spark, str(folder))


def test_ingest(files):
    assert {r["path"] for r in files.collect()} == set(REPO)
    tables = jobs.ingest(files)
    assert {r["path"]: r["event_reason"] for r in tables.skipped.collect()} == {"data.bin": "binary", "node_modules/package.json": "ignore_pattern", "Cargo.lock": "ignore_pattern", "notes.txt": "unsupported_language"}
    events = [r.asDict() for r in jobs.ingest_events(tables, "job_12345", "https://github.com/a/b").orderBy("sequence").collect()]
    assert [e["sequence"] for e in events] == list(range(len(events)))
    assert events[0]["event_type"] == "ingest.started.v1" and events[-1]["event_type"] == "ingest.completed.v1" and events[-1]["status"] == "success"
    again = jobs.ingest_events(jobs.ingest(files), "job_12345", "https://github.com/a/b").withColumn("job_id", F.col("context.job_id"))
    assert {r["event_id"] for r in again.collect()} == {e["event_id"] for e in events}
    assert sequence_breaks(again, order="sequence").count() == 0


def test_archives_with_equal_paths(spark, tmp_path):
    texts = {"a": b"def alpha():\n    return helper()\n\ndef helper():\n    return 1\n", "b": b"import os\n\ndef beta_is_much_longer(x):\n    return helper()\n", "c": b"# nothing\n"}
    for name, text in texts.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}-main/src/app.py", text)
            z.writestr(f"{name}-main/notes.txt", b"text")
    read = archives.read_archives(spark, str(tmp_path))
    tables = jobs.ingest(read)
    name = F.regexp_extract("archive", r"(\w)\.zip$", 1).alias("a")
    for one in (tables.files, tables.skipped, tables.symbols, tables.calls, tables.imports, tables.chunks):
        assert one.columns[0] == "archive"
    chunks = {(r["a"], r["symbol"]): r["content"] for r in tables.chunks.select(name, F.col("metadata.symbol_name").alias("symbol"), "content").collect()}
    assert tables.chunks.count() == len(chunks) == 4 and set(chunks) == {("a", "alpha"), ("a", "helper"), ("b", "beta_is_much_longer"), ("c", None)}
    for (a, symbol), content in chunks.items():
        assert content.encode() in texts[a] and (symbol is None or content.startswith(f"def {symbol}"))
    # each archive's tables are those of the archive alone; helper of a doesn't resolve the call of b
    for a in texts:
        alone = jobs.symbol_metadata(jobs.ingest(read.where(name == a).drop("archive"))).collect()
        got = jobs.symbol_metadata(tables).where(name == a).drop("archive").collect()
        assert sorted(map(str, got)) == sorted(map(str, alone))
    assert {r["a"]: len(r["calls"]) for r in jobs.symbol_metadata(tables).where("name <> 'helper'").select(name, "calls").collect()} == {"a": 1, "b": 0}
    assert jobs.ingest(read.withColumn("archive", F.lit(None)).where("false")).chunks.count() == 0
    nulls = jobs.ingest(read.where(name == "a").withColumn("archive", F.lit(None).cast("string")))
    assert nulls.chunks.count() == 2 and {r["archive"] for r in nulls.chunks.collect()} == {""}
    with pytest.raises(InvalidInput, match="archive"):
        jobs.run_job(read, "https://github.com/a/b")


def test_job_makes_the_same_bundle_twice(files, tmp_path, spark):
    raw, stats = jobs.run_job(files, "https://github.com/a/b", threshold=0.1)
    assert raw == jobs.run_job(files, "https://github.com/a/b", threshold=0.1)[0] and stats["symbol_count"] >= 4
    path = tmp_path / "a" / "b.bundle"
    path.parent.mkdir()
    path.write_bytes(raw)
    (tmp_path / "a" / "c.bundle").write_bytes(raw[:-20] + b"x" * 20)
    rows = {r["path"][-8]: r for r in bundle.read_bundles(spark, str(tmp_path)).collect()}
    assert rows["b"]["status"] == "ok" and '"kind": "calls"' in rows["b"]["graph"] and rows["c"]["status"] != "ok" and rows["c"]["graph"] is None
    assert bundle.bundle_vectors(bundle.read_bundles(spark, str(tmp_path))).count() == stats_count(files)
    assert archives.read_listing(spark, str(tmp_path)).count() == 2 and archives.read_directory(spark, str(tmp_path)).count() == 2


def stats_count(files):
    return jobs.ingest(files).chunks.select("chunk_id").distinct().count()


def test_bundle_checks():
    parts = {"graph": {}, "nodes": {}, "clusters": {}, "source_map": {}}
    raw = bundle.write_bundle(parts, {"x": 1})
    assert bundle.read_bundle(raw)["graph.json"] == b"{}"
    with pytest.raises(BundleError, match="schema version"):
        bundle.read_bundle(raw, "other/1.0")
    with pytest.raises(BundleError):
        bundle.read_bundle(b"nothing")
    table = bundle.write_vectors([("a", [1.0, 2.0]), ("é", [3.0, 4.0])], 2)
    back = bundle.read_vectors(table)
    assert list(back) == ["a", "é"] and back["é"].tolist() == [3.0, 4.0]
    with pytest.raises(BundleError, match="dimensions"):
        bundle.write_vectors([("a", [1.0])], 2)
    with pytest.raises(BundleError):
        bundle.read_vectors(b"x" * 30)


def test_embedding_and_documentation(spark):
    chunks = spark.createDataFrame([("a", "some words"), ("b", "refuse"), ("c", None)], "chunk_id string, content string")

    def picky(texts):
        if "refuse" in texts:
            raise ValueError("refused")
        return hashing_embedder(texts)

    got = {r["chunk_id"]: r["vector"] for r in embed(chunks.coalesce(1), picky).collect()}
    assert set(got) == {"a", "c"} and np.linalg.norm(got["a"]) == pytest.approx(1, abs=1e-5) and not any(got["c"])
    assert pooled(np.array([[[3.0, 4.0], [9.0, 9.0]]]), np.array([[1, 0]])).tolist() == [[pytest.approx(0.6), pytest.approx(0.8)]]
    contexts = spark.createDataFrame([(f"s{i}", "go", f"n{i}", "function", "f", "sig", [], [], None, 0.5) for i in range(3)], "symbol_id string, language string, name string, kind string, file_path string, signature string, calls array<string>, called_by array<string>, cluster_label string, centrality double")

    def fails_once(text):
        if "n1" in text:
            raise RuntimeError("x" * 300)
        return "one two"

    rows = {r["symbol_id"]: r for r in document(contexts, fails_once).collect()}
    assert rows["s0"]["output_tokens"] == 2 and rows["s1"]["tokens_used"] == 0 and rows["s1"]["summary"] == f"{FAILED}{'x' * 100}]"
    total = totals(document(contexts, fails_once)).first()
    assert total["n_warnings"] == 1 and total["total_tokens"] == rows["s0"]["tokens_used"] + rows["s2"]["tokens_used"] and total["total_cost"] > 0


def test_refs(spark):
    wanted = spark.createDataFrame([("r", "main"), ("r", "v1"), ("r", "a" * 40), ("r", "no")], "repo string, ref string")
    refs = spark.createDataFrame([("r", "main", "branch", "c1"), ("r", "main", "tag", "c2"), ("r", "v1", "tag", "c3")], "repo string, name string, kind string, commit string")
    assert {r["ref"][:4]: (r["commit"], r["kind"]) for r in archives.resolve_refs(wanted, refs).collect()} == {"main": ("c1", "branch"), "v1": ("c3", "tag"), "aaaa": ("a" * 40, "commit"), "no": (None, "not_found")}
    headers = spark.createDataFrame([({"x-ratelimit-remaining": "0"}, False), ({"x-ratelimit-remaining": "0"}, True), ({"x-ratelimit-remaining": "odd"}, False)], "h map<string,string>, ok boolean")
    assert [r[0]["exceeded"] for r in headers.select(archives.rate_limit(F.col("h"), F.col("ok"))).collect()] == [True, False, False]


def test_archives_as_a_stream(spark, tmp_path):
    from corpusloom.streaming.ingest import ingest_stream, landed_archives

    (tmp_path / "in").mkdir()
    for k in range(3):
        with zipfile.ZipFile(tmp_path / "in" / f"{k}.zip", "w") as z:
            z.writestr(f"r/f{k}.py", "def run():\n    return 1\n")
    seen = []
    files = landed_archives(spark, str(tmp_path / "in"), files_per_trigger=2)
    query = ingest_stream(files, lambda tables, n: seen.append(sorted(r["path"] for r in tables.chunks.collect())), str(tmp_path / "c"), until_empty=True)
    assert query.awaitTermination(120) and sorted(sum(seen, [])) == ["f0.py", "f1.py", "f2.py"] and len(seen) == 2
