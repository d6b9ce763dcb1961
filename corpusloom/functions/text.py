"""Terms, labels, byte pieces, ids and display texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never label a cluster.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is are was were be been being have has had "
    "do does did will would could should may might can this that these those it its if then else when where why "
    "how all each every some any no not "
    "fn def class struct impl trait enum type let var const static pub mod use import return self new get set add mut ref"
).split()
# Id prefixes, shortest and longest length, and the characters after the prefix.
ID_RULES = {"job": ("job_", 8, 64), "chunk": ("chunk_", 10, 64), "sym": ("sym_", 8, 64), "evt": ("evt_", 8, None), "trace": ("trace_", 10, None)}
TERMINAL_EVENTS = ("ingest.completed.v1", "assembly.completed.v1")
EVENT_TYPES = (
    "ingest.started.v1", "ingest.file_detected.v1", "ingest.file_skipped.v1", "ingest.chunk_created.v1", "ingest.completed.v1",
    "assembly.started.v1", "assembly.cluster_created.v1", "assembly.graph_completed.v1", "assembly.completed.v1",
)


def terms(text: Column) -> Column:
    """Runs of letters and digits, cut before a capital that follows a small letter, in lower case."""
    cut = F.regexp_replace(text, r"(?<=\p{IsLowercase})(?=\p{IsUppercase})", " ")
    return F.filter(F.transform(F.split(cut, r"[^\p{IsAlphabetic}\p{N}]+"), F.lower), lambda t: t != "")


def label_terms(text: Column) -> Column:
    """terms() without stop words and without those under three bytes."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.filter(terms(text), lambda t: (F.octet_length(t) >= 3) & ~F.array_contains(stop, t))


def related_terms(a: Column, b: Column) -> Column:
    """One begins with the other, or both, of four bytes or more, begin with the same four characters."""
    long = (F.octet_length(a) >= 4) & (F.octet_length(b) >= 4) & (F.char_length(a) >= 4) & (F.char_length(b) >= 4)
    return F.startswith(a, b) | F.startswith(b, a) | (long & (F.left(a, F.lit(4)) == F.left(b, F.lit(4))))


def label(first: Column, first_count: Column, second: Column, second_count: Column, members: Column) -> Column:
    """A cluster's label from its two most frequent terms."""
    alone = second.isNull() | (first_count >= 2 * second_count) | related_terms(first, second)
    return F.when(members == 0, "empty").when(first.isNull(), "misc").when(alone, first).otherwise(F.concat_ws("-", first, second))


def little_endian(n: Column) -> Column:
    """The eight bytes of a bigint."""
    digits = F.lpad(F.hex(n), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in range(15, 0, -2))))


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    """chunk_ and 16 hex digits of SHA-256 over path, range and content."""
    raw = F.concat(F.encode(path, "UTF-8"), little_endian(start.cast("bigint")), little_endian(end.cast("bigint")), content.cast("binary"))
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(raw, 256), 1, 16))


def symbol_id(path: Column, name: Column) -> Column:
    return F.concat(F.lit("sym_"), path, F.lit("::"), name)


def valid_id(value: Column, kind: str) -> Column:
    prefix, least, most = ID_RULES[kind]
    good = value.startswith(prefix) & (F.char_length(value) >= least)
    if most:
        good &= F.char_length(value) <= most
    return good & value.rlike("^[a-z]+_[A-Za-z0-9_]+$") if kind == "job" else good


def derived_id(prefix: str, *parts: Column) -> Column:
    """A content-derived id with 16 hex digits, the same on every run."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256), 1, 16))


def _inside(raw: Column, at: Column) -> Column:
    """True where the byte at a 0-based offset goes on with a character."""
    return F.substring(F.hex(F.substring(raw, at.cast("int") + 1, 1)), 1, 1).isin("8", "9", "A", "B")


def floor_boundary(raw: Column, at: Column) -> Column:
    """The offset, or the last one before it where a character begins."""
    return F.when(~_inside(raw, at), at).when(~_inside(raw, at - 1), at - 1).when(~_inside(raw, at - 2), at - 2).otherwise(at - 3)


def ceiling_boundary(raw: Column, at: Column) -> Column:
    """The offset, or the next one after it where a character begins; past the end is a boundary."""
    return F.when(~_inside(raw, at), at).when(~_inside(raw, at + 1), at + 1).when(~_inside(raw, at + 2), at + 2).otherwise(at + 3)


def utf8_slice(raw: Column, start: Column, end: Column) -> Column:
    """struct(start, end, content): bytes start to end, widened to whole characters."""
    a, b = floor_boundary(raw, start), ceiling_boundary(raw, end)
    return F.struct(a.alias("start"), b.alias("end"), F.substring(raw, a.cast("int") + 1, (b - a).cast("int")).cast("string").alias("content"))


def range_length(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0))


def range_contains(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start <= other_start) & (other_end <= end)


def range_overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start < other_end) & (other_start < end)


def format_bytes(n: Column) -> Column:
    """Units of 1024, one decimal, without a trailing zero."""
    unit = F.when(n < 1 << 10, 0).when(n < 1 << 20, 1).when(n < 1 << 30, 2).otherwise(3)
    value = F.round(n / F.pow(F.lit(1024.0), unit), 1)
    shown = F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", value))
    return F.when(n == 0, "0 B").otherwise(F.concat_ws(" ", shown, F.element_at(F.array(*(F.lit(u) for u in ("B", "KB", "MB", "GB"))), unit + 1)))


def format_duration(ms: Column) -> Column:
    """Milliseconds, or from a second on seconds with two decimals, half up."""
    hundredths = F.floor((ms + 5) / 10)
    seconds = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("s"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(seconds)


def reason_title(reason: Column) -> Column:
    return F.array_join(F.transform(F.split(reason, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100_000))), " ")


def centrality_band(c: Column, names: tuple[str, str, str, str] = ("Very High", "High", "Medium", "Low")) -> Column:
    return F.when(c >= 0.7, names[0]).when(c >= 0.4, names[1]).when(c >= 0.2, names[2]).otherwise(names[3])


def is_terminal(event_type: Column) -> Column:
    return event_type.isin(*TERMINAL_EVENTS)


def event_summary(event_type: Column, payload: Column) -> Column:
    """One line for an event log; payload: a JSON object."""

    def field(name: str, default: str) -> Column:
        value = F.get_json_object(payload, f"$.{name}")
        return F.when(value.isNull() | value.isin("", "0"), F.lit(default)).otherwise(value)

    files = F.coalesce(F.nullif(field("files_processed", "0"), F.lit("0")), field("files_detected", "0"))
    embedded = F.when(field("chunks_embedded", "0").cast("bigint") > 0, F.concat(F.lit(", "), field("chunks_embedded", "0"), F.lit(" embedded"))).otherwise("")
    return (
        F.when(event_type.contains("started"), F.concat(F.lit("Started ingesting "), field("repo_url", "repository")))
        .when(event_type.contains("completed"), F.concat(F.lit("Completed ("), files, F.lit(" files, "), field("chunks_created", "0"), F.lit(" chunks"), embedded, F.lit(", "), field("files_skipped", "0"), F.lit(" skipped)")))
        .when(event_type.contains("file_detected"), F.concat(F.lit("Detected: "), field("file_path", "unknown"), F.lit(" ("), field("language", "unknown"), F.lit(")")))
        .when(event_type.contains("file_skipped"), F.concat(F.lit("Skipped: "), field("file_path", "unknown"), F.lit(" ("), field("reason", "unknown reason"), F.lit(")")))
        .when(event_type.contains("chunk_created"), F.concat(F.lit("Chunk: "), field("symbol_name", "unnamed"), F.lit(" in "), field("file_path", "unknown")))
        .otherwise(payload)
    )


def stage_of_elapsed(seconds: Column) -> Column:
    return F.when(seconds < 30, "ingest").when(seconds < 120, "embedding").otherwise("assembly")
