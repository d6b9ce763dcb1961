"""Explicit schemas of the tables that operators exchange."""

from __future__ import annotations

RANGE = "struct<start:bigint,end:bigint>"
FILES = "path string, size bigint, content binary"
SYMBOLS = (
    "file_path string, language string, ordinal int, kind string, name string, start bigint, end bigint, "
    "name_start bigint, name_end bigint, signature string, visibility string, is_async boolean"
)
CALLS = "file_path string, language string, ordinal int, name string, start bigint, end bigint, kind string"
IMPORTS = (
    "file_path string, language string, ordinal int, module_path string, items array<string>, alias string, "
    "start bigint, end bigint, is_wildcard boolean"
)
EMBEDDINGS = "chunk_id string, vector array<float>"
EVENTS = (
    "event_id string, event_type string, timestamp timestamp, sequence bigint, "
    "context struct<job_id:string,repo_url:string,git_ref:string,user_id:string>, "
    "meta struct<producer_version:string,trace_id:string,parent_event_id:string,idempotency_key:string,tags:array<string>>, "
    "payload string, status string"
)
BUNDLE = "path string, status string, manifest string, graph string, nodes string, clusters string, source_map string, embeddings binary, symbol_contexts string"

LANGUAGES = ("rust", "python", "typescript", "javascript", "go")
SYMBOL_KINDS = ("function", "class", "module", "struct", "trait", "enum", "method", "const", "static", "interface", "type_alias", "impl", "macro")
CALL_KINDS = ("function", "method", "associated", "constructor")
SKIP_REASONS = ("binary", "too_large", "unsupported_language", "ignore_pattern", "parse_error")
EDGE_KINDS = ("calls", "imports", "related")


def archive_key(df) -> list[str]:
    """["archive"] where a table names the archive of each row. A path is a file's key in its archive only, so tables that are
    made of such a table carry the column and are joined on it too; without it a table is of one repository."""
    return ["archive"] if "archive" in df.columns else []


class PipelineError(Exception):
    """Base of the errors that operators raise on the driver."""


class InvalidInput(PipelineError):
    """A parameter or a request that no plan can be made for."""


class BundleError(PipelineError):
    """A bundle that lacks a file, has another checksum, or another schema version."""
