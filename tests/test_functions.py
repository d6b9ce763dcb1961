import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.functions import prompts as R
from corpusloom.functions import text as T
from corpusloom.functions.vectors import cosine
from corpusloom.operators.chunks import file_chunks, split_ranges
from corpusloom.operators.skip import classify


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(column).collect()]


def test_repo_urls(spark):
    urls = ["https://github.com/a/b.git", "github.com/a/b/tree/x/y", "http://github.com/a/b/commit/abc", "https://gitlab.com/a/b", "https://github.com/a", "a/b", "https://github.com/a/b/tree", None]
    got = values(spark, urls, P.parse_repo_url(F.col("x")))
    assert [r and tuple(r) for r in got] == [("a", "b", None), ("a", "b", "x/y"), ("a", "b", "abc"), None, None, None, ("a", "b", None), None]


def test_languages(spark):
    rows = [("a/b.RS", ""), ("x.tsx", ""), ("run", "#!/usr/bin/env python3\n"), ("run", "#!/usr/local/bin/node --x\n"), ("run", "#! /bin/sh"), ("a.txt", ""), ("x.py", "#!/bin/node"), ("dir.py/run", None)]
    got = values(spark, rows, P.detect_language(F.col("p"), F.col("t")), "p string, t string")
    assert got == ["rust", "typescript", "python", "javascript", None, None, "python", None]
    assert values(spark, ["r-b/a/c", "r-b/", "only"], P.without_archive_root(F.col("x"))) == ["a/c", "r-b/", "only"]


def test_skip_cascade(spark):
    rows = [
        ("src/main.rs", b"fn main() {}", None, "rust"), ("src/node_modules/p/index.js", b"x", "ignore_pattern", None), ("Cargo.lock", b"x", "lock_file", None), ("Cargo.toml", b"x", "unsupported_language", None),
        ("a.swp", b"x", "ignore_pattern", None), ("src/layout.rs", b"x", "ignore_pattern", None), ("data.go", b"a\x00b", "binary", None), ("bad.py", b"\xff\xfe", "binary", None), ("big.py", b"x" * 200, "too_large", None),
        ("empty.py", b"", None, "python"), ("late.go", b"a" * 50 + b"\xc3\xa9", None, "go"),
    ]
    files = spark.createDataFrame([(p, len(c), c) for p, c, *_ in rows], "path string, size long, content binary")
    got = {r["path"]: (r["skip_reason"], r["language"]) for r in classify(files, max_size=100).collect()}
    assert got == {p: (reason, language) for p, _, reason, language in rows}
    strict = {r["path"]: r["skip_reason"] for r in classify(files, max_size=100, strict=True, skip_hidden=True).collect()}
    assert strict["src/layout.rs"] is None and strict["src/node_modules/p/index.js"] == "ignore_pattern"


def test_chunks_cover_and_are_addressed(spark):
    text = "é" * 3000 + "x" * 4000 + "😀" * 500
    rows = sorted(file_chunks(spark.createDataFrame([("f", text), ("g", "short"), ("e", "")], "path string, content string")).collect(), key=lambda r: (r["path"], r["start"]))
    raw = text.encode()
    mine = [r for r in rows if r["path"] == "f"]
    assert mine[0]["start"] == 0 and mine[-1]["end"] == len(raw) and all(a["end"] >= b["start"] for a, b in zip(mine, mine[1:]))
    for r in mine:
        part = raw[r["start"] : r["end"]]
        assert part.decode() == r["content"]
        assert r["chunk_id"] == "chunk_" + hashlib.sha256(b"f" + r["start"].to_bytes(8, "little") + r["end"].to_bytes(8, "little") + part).hexdigest()[:16]
        assert r["split_total"] == len(mine)
    assert [(r["start"], r["end"], r["split_total"]) for r in rows if r["path"] != "f"] == [(0, 0, None), (0, 5, None)]
    sizes = spark.createDataFrame([(4096,), (4097,), (7680,), (7900,)], "size long")
    assert sorted((r["size"], r["piece_start"], r["piece_end"]) for r in split_ranges(sizes).collect() if r["size"] > 4097) == [(7680, 0, 4096), (7680, 3840, 7680), (7900, 0, 4096), (7900, 3840, 7900), (7900, 7680, 7900)]


def test_terms_and_labels(spark):
    assert values(spark, ["fetchUserData HTTPRequest x_1"], T.terms(F.col("x"))) == [["fetch", "user", "data", "httprequest", "x", "1"]]
    assert values(spark, ["the fetch of éa ab self"], T.label_terms(F.col("x"))) == [["fetch", "éa"]]
    pairs = [("fetch", "fetcher"), ("handler", "handle"), ("processor", "process"), ("abc", "abd"), ("data", "date")]
    assert values(spark, pairs, T.related_terms(F.col("a"), F.col("b")), "a string, b string") == [True, True, True, False, False]
    rows = [("x", 4, "y", 2, 1), ("x", 3, "y", 2, 1), (None, None, None, None, 1), (None, None, None, None, 0), ("x", 1, None, None, 1)]
    assert values(spark, rows, T.label(*(F.col(c) for c in ("a", "na", "b", "nb", "m"))), "a string, na int, b string, nb int, m int") == ["x", "x-y", "misc", "empty", "x"]


def test_display_and_ids(spark):
    assert values(spark, [0, 1023, 1024, 1536, 1048576, 5 * 1024**4], T.format_bytes(F.col("x")), "x long") == ["0 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "5120 GB"]
    assert values(spark, [999, 1500], T.format_duration(F.col("x")), "x long") == ["999ms", "1.50s"]
    assert values(spark, ["too_large"], T.reason_title(F.col("x"))) == ["Too Large"]
    assert values(spark, ["job_1234", "job_1", "job_" + "x" * 61, "job_a-bcd"], T.valid_id(F.col("x"), "job")) == [True, False, False, False]
    assert values(spark, [(0, 5, 2, 9), (0, 5, 5, 6), (0, 9, 0, 9)], T.range_overlaps(*(F.col(c) for c in "abcd")), "a int, b int, c int, d int") == [True, False, True]
    events = [("ingest.completed.v1", '{"files_processed": 3, "chunks_created": 7}'), ("ingest.file_detected.v1", "{}")]
    assert values(spark, events, T.event_summary(F.col("a"), F.col("b")), "a string, b string") == ["Completed (3 files, 7 chunks, 0 skipped)", "Detected: unknown (unknown)"]


@pytest.mark.parametrize("a, b, want", [([1.0, 0.0], [2.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 3.0], 0.0), ([1.0, 1.0], [-1.0, -1.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0)])
def test_cosine(spark, a, b, want):
    assert values(spark, [(a, b)], cosine(F.col("a"), F.col("b")), "a array<double>, b array<double>") == [pytest.approx(want)]


def test_prompts(spark):
    row = spark.createDataFrame([("rust", "f", "function", "a.rs", "f(" + "x " * 300 + ")", [f"c{i}" for i in range(12)], [], None, 0.256)], "l string, n string, k string, p string, s string, c array<string>, b array<string>, g string, z double")
    columns = [F.col(c) for c in ("l", "n", "k", "p", "s", "c", "b", "g", "z")]
    text = row.select(R.prompt(*columns)).first()[0]
    assert "Calls: c0, c1, c2, c3, c4, c5, c6, c7, c8, c9\n" in text and "Called by" not in text and "Importance: 0.26 (0-1 scale)" in text
    short = row.select(R.short_prompt(*columns, most=120)).first()[0]
    assert len(R.regex_tokens(short)) <= 120 and "..." in short and "Calls: c0, c1, c2, c3, c4\n" in short
    assert row.select(R.cost(F.lit(1_000_000), F.lit(2_000_000))).first()[0] == pytest.approx(1.35)
    assert row.select(R.count_message_tokens(R.messages(F.lit("a b")))).first()[0] == 3 + 3 + 1 + len(R.regex_tokens(R.SYSTEM)) + 3 + 1 + 2
    assert R.truncate("a b c d", 3) == "..." and R.truncate("a b c d e f", 5) == "a b..."
