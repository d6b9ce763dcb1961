"""The cascade that decides which files are read, and as which language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import basename, detect_language

MAX_FILE_SIZE = 1024 * 1024
MAX_ARCHIVE_SIZE = 100 * 1024 * 1024
BINARY_PROBE = 8192
# Names of lock files; ordered patterns of ignored paths ("*x": a component that ends with x).
LOCK_FILES = ("Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Gemfile.lock", "poetry.lock", "Pipfile.lock", "composer.lock", "go.sum", "flake.lock", "mix.lock")
IGNORED = (
    ".git", ".svn", ".hg", "node_modules", "vendor", "bower_components", "target", "dist", "build", "out", "_build", ".next", ".nuxt",
    "__pycache__", ".venv", "venv", ".tox", ".eggs", "*.egg-info", ".pytest_cache", ".mypy_cache", ".idea", ".vscode", ".vs", "*.swp", "*.swo",
    ".DS_Store", "Thumbs.db", "coverage", ".coverage", ".nyc_output", "htmlcov", ".cache", ".parcel-cache", "*.log", "logs",
)
#: What an event says for each reason of the cascade.
EVENT_REASON = {"too_large": "too_large", "hidden": "ignore_pattern", "lock_file": "ignore_pattern", "ignore_pattern": "ignore_pattern", "binary": "binary", "unsupported_language": "unsupported_language"}


def is_hidden(path: Column) -> Column:
    return basename(path).startswith(".")


def is_lock_file(path: Column) -> Column:
    return basename(path).isin(*LOCK_FILES)


def ignore_pattern(path: Column, extra: tuple[str, ...] = (), strict: bool = False) -> Column:
    """The first pattern that matches, or null: a component equal to it, a component that ends as "*..." says, or, unless
    strict, the pattern anywhere in the path."""
    parts = F.split(path, "/")

    def ends(suffix: str) -> Column:
        return F.exists(parts, lambda c: c.endswith(suffix))

    tests = []
    for p in (*IGNORED, *extra):
        hit = ends(p[1:]) if p.startswith("*") else F.array_contains(parts, p)
        tests.append(F.when(hit if strict else hit | path.contains(p), F.lit(p)))
    return F.coalesce(*tests)


def is_binary(content: Column) -> Column:
    """A NUL among the first bytes."""
    return F.position(F.unhex(F.lit("00")), F.substring(content, 1, BINARY_PROBE)) > 0


def path_reason(path: Column, size: Column, max_size: int = MAX_FILE_SIZE, skip_hidden: bool = False, extra: tuple[str, ...] = (), strict: bool = False) -> Column:
    """Why a path is skipped before its content is read, or null."""
    return F.coalesce(
        F.when(size > max_size, "too_large"),
        F.when(is_hidden(path), "hidden") if skip_hidden else F.lit(None).cast("string"),
        F.when(is_lock_file(path), "lock_file"),
        F.when(ignore_pattern(path, extra, strict).isNotNull(), "ignore_pattern"),
    )


def content_reason(path: Column, content: Column) -> Column:
    """Why a file is skipped once its content is known, or null."""
    text = content.cast("string")
    return F.coalesce(
        F.when(is_binary(content), "binary"),
        F.when(~F.is_valid_utf8(text), "binary"),
        F.when(detect_language(path, text).isNull(), "unsupported_language"),
    )


def classify(files: DataFrame, **options) -> DataFrame:
    """files (path, size, content) with skip_reason (null: read it), event_reason and language."""
    path, content = F.col("path"), F.col("content")
    reason = F.coalesce(path_reason(path, F.col("size"), **options), content_reason(path, content))
    rows = files.withColumn("skip_reason", reason)
    pairs = F.create_map(*(F.lit(x) for kv in EVENT_REASON.items() for x in kv))
    rows = rows.withColumn("event_reason", F.try_element_at(pairs, F.col("skip_reason")))
    return rows.withColumn("language", F.when(F.col("skip_reason").isNull(), detect_language(path, content.cast("string"))))


def accepted_paths(listing: DataFrame, **options) -> DataFrame:
    """A listing (path, size) without the paths that are skipped unread: its plan needs no content column."""
    return listing.where(path_reason(F.col("path"), F.col("size"), **options).isNull())
