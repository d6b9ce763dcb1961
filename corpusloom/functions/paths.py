"""Repository addresses, archive paths and languages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and script interpreters by language.
EXTENSIONS = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go"}
INTERPRETERS = {"python": "python", "python2": "python", "python3": "python", "node": "javascript", "nodejs": "javascript", "deno": "typescript", "ts-node": "typescript"}
CANONICAL = {"rust": "rs", "python": "py", "typescript": "ts", "javascript": "js", "go": "go"}
DISPLAY = {"rust": "Rust", "python": "Python", "typescript": "TypeScript", "javascript": "JavaScript", "go": "Go"}
SHORT_KINDS = {"function": "fn", "module": "mod", "type_alias": "type"}


def lookup(values: dict[str, str], key: Column) -> Column:
    """A literal map's value; null where the key is absent."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parse_repo_url(url: Column) -> Column:
    """struct(owner, repo, git_ref) of a repository address on the code host, null for any other text."""
    full = F.when(F.lower(url).rlike("^https?://"), url).when(F.lower(url).startswith("github.com"), F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(full, "^[a-zA-Z]+://([^/?#]*)", 1))
    parts = F.filter(F.split(F.regexp_extract(full, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    repo = F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    ref = F.when((F.size(parts) >= 4) & F.get(parts, F.lit(2)).isin("tree", "commit", "blob"), F.array_join(F.slice(parts, 4, 1000), "/"))
    good = (host == "github.com") & (F.size(parts) >= 2) & (repo != "")
    return F.when(good, F.struct(F.get(parts, F.lit(0)).alias("owner"), repo.alias("repo"), ref.alias("git_ref")))


def archive_url(owner: Column, repo: Column, ref: Column) -> Column:
    return F.format_string("https://github.com/%s/%s/archive/%s.zip", owner, repo, F.coalesce(ref, F.lit("HEAD")))


def api_url(owner: Column, repo: Column) -> Column:
    return F.format_string("https://api.github.com/repos/%s/%s", owner, repo)


def canonical_url(owner: Column, repo: Column) -> Column:
    return F.format_string("https://github.com/%s/%s", owner, repo)


def is_commit(ref: Column) -> Column:
    """A full commit hash, which needs no lookup among branches and tags."""
    return ref.rlike("^[0-9a-fA-F]{40}$")


def without_archive_root(path: Column) -> Column:
    """The path below its first component; the path itself where nothing remains."""
    rest = F.array_join(F.slice(F.split(path, "/"), 2, 100_000), "/")
    return F.coalesce(F.nullif(rest, F.lit("")), path)


def language_of_path(path: Column) -> Column:
    return lookup(EXTENSIONS, F.lower(F.regexp_extract(basename(path), r"[^.]*.*\.([^.]+)$", 1)))


def language_of_script(text: Column) -> Column:
    """By the interpreter that the first line names."""
    line = F.element_at(F.split(text, "\n", 2), 1)
    words = F.filter(F.split(F.substring(line, 3, 100_000), r"\s+"), lambda w: w != "")
    named = F.get(F.filter(F.split(F.element_at(F.split(line, "/"), -1), r"\s+"), lambda w: w != ""), F.lit(0))
    program = F.when(line.contains("env "), F.get(words, F.lit(1))).otherwise(named)
    return F.when(line.startswith("#!"), lookup(INTERPRETERS, program))


def detect_language(path: Column, text: Column | None = None) -> Column:
    by_path = language_of_path(path)
    return by_path if text is None else F.coalesce(by_path, language_of_script(text))
