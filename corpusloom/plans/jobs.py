"""From files to tables: ingest, assemble, document, pack."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import symbol_id
from corpusloom.operators.chunks import symbol_chunks
from corpusloom.operators.cluster import cluster_count, fit_clusters
from corpusloom.operators.context import cluster_members, node_clusters, symbol_contexts, symbol_vectors
from corpusloom.operators.documentation import Summarizer, document, stub_summarizer
from corpusloom.operators.embedding import Embedder, embed, hashing_embedder
from corpusloom.operators.events import envelope
from corpusloom.operators.extract import extract_calls, extract_imports, extract_symbols
from corpusloom.operators.graph import calls_edges, imports_edges, related_edges
from corpusloom.operators.labels import cluster_labels
from corpusloom.operators.resolve import call_pairs
from corpusloom.operators.skip import classify
from corpusloom.schemas import InvalidInput, archive_key
from corpusloom.session import cut_lineage
from corpusloom.sources.bundle import pack


@dataclass
class Ingested:
    files: DataFrame
    skipped: DataFrame
    symbols: DataFrame
    calls: DataFrame
    imports: DataFrame
    chunks: DataFrame


@dataclass
class Assembled:
    assigned: DataFrame
    clusters: DataFrame
    edges: DataFrame
    contexts: DataFrame


def ingest(files: DataFrame, **options) -> Ingested:
    """Tables of files (path, size, content): what is read, what is skipped and why, symbols, calls, imports, chunks.

    Of files with a column archive, as sources.archives gives them, every table has it first: archives may hold equal paths. A null is an empty name.
    """
    own = archive_key(files)
    rows = classify(files.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in own}), **options)
    read = rows.where("skip_reason is null").select(*own, "path", "language", F.col("content").cast("string").alias("content"))
    symbols = extract_symbols(read)
    return Ingested(read, rows.where("skip_reason is not null").select(*own, "path", "skip_reason", "event_reason"), symbols, extract_calls(read), extract_imports(read), symbol_chunks(read, symbols))


def ingest_events(tables: Ingested, job_id: str, repo_url: str, at: str = "1970-01-01 00:00:00") -> DataFrame:
    """The events of an ingest in order: started, files detected and skipped, chunks, completed."""

    def json(**columns: Column) -> Column:
        return F.to_json(F.struct(*(c.alias(n) for n, c in columns.items())))

    one = tables.files.sparkSession.range(1)
    totals = tables.files.agg(F.count("*").alias("p")).join(F.broadcast(tables.skipped.agg(F.count("*").alias("s")))).join(F.broadcast(tables.chunks.agg(F.count("*").alias("c"))))
    parts = [
        one.select(F.lit(0).alias("stage"), F.lit("").alias("path"), F.lit(0).cast("bigint").alias("place"), F.lit("ingest.started.v1").alias("type"), json(repo_url=F.lit(repo_url)).alias("payload")),
        tables.files.select(F.lit(1), "path", F.lit(0).cast("bigint"), F.lit("ingest.file_detected.v1"), json(file_path=F.col("path"), language=F.col("language"))),
        tables.skipped.select(F.lit(1), "path", F.lit(0).cast("bigint"), F.lit("ingest.file_skipped.v1"), json(file_path=F.col("path"), reason=F.col("event_reason"))),
        tables.chunks.select(F.lit(1), "path", F.col("start") + 1, F.lit("ingest.chunk_created.v1"), json(chunk_id=F.col("chunk_id"), file_path=F.col("path"), symbol_name=F.col("metadata.symbol_name"), language=F.col("language"))),
        totals.select(F.lit(2), F.lit(""), F.lit(0).cast("bigint"), F.lit("ingest.completed.v1"), json(files_processed=F.col("p"), files_skipped=F.col("s"), chunks_created=F.col("c"))),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    # the events of one repository; in the event log every job is a partition of its own
    rows = rows.withColumn("sequence", (F.row_number().over(Window.partitionBy(F.lit(job_id)).orderBy("stage", "path", "place", "payload")) - 1).cast("bigint"))
    status = F.when(F.col("type") == "ingest.completed.v1", "success")
    return rows.select("sequence", *envelope(F.col("type"), F.col("payload"), F.lit(job_id), F.lit(repo_url), F.lit(at).cast("timestamp"), F.col("sequence"), status))


def symbol_metadata(tables: Ingested) -> DataFrame:
    """symbol_id, name, kind, language, file_path, signature, chunk_ids, calls and imports of every symbol (of every archive)."""
    own = archive_key(tables.symbols)
    chunks = tables.chunks.groupBy(*own, F.col("path").alias("file_path"), F.col("metadata.symbol_name").alias("name")).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    calls = call_pairs(tables.calls, tables.symbols).groupBy(*own, F.col("src").alias("symbol_id")).agg(F.array_sort(F.collect_list("dst")).alias("calls"))
    items = F.explode(F.coalesce("items", F.array("module_path")))
    imports = tables.imports.select(*own, "file_path", items.alias("item")).groupBy(*own, "file_path").agg(F.array_sort(F.collect_list("item")).alias("imports"))
    rows = tables.symbols.withColumn("symbol_id", symbol_id(F.col("file_path"), F.col("name"))).dropDuplicates([*own, "symbol_id"])
    empty = F.array().cast("array<string>")
    rows = rows.join(chunks, [*own, "file_path", "name"], "left").join(calls, [*own, "symbol_id"], "left").join(imports, [*own, "file_path"], "left")
    return rows.select(*own, "symbol_id", "name", "kind", "language", "file_path", "signature", *(F.coalesce(c, empty).alias(c) for c in ("chunk_ids", "calls", "imports")))


def assemble(chunks: DataFrame, vectors: DataFrame, symbols: DataFrame, threshold: float = 0.7, top_k: int = 5, seed: int = 42) -> Assembled:
    """Clusters with labels, edges and contexts of chunks (chunk_id, content), vectors (chunk_id, vector) and symbols."""
    n = vectors.count()
    spark = chunks.sparkSession
    if n:
        assigned, _ = fit_clusters(vectors.withColumnRenamed("chunk_id", "id"), cluster_count(n), seed=seed)
        assigned = cut_lineage(assigned.withColumnRenamed("id", "chunk_id"))
    else:
        assigned = spark.createDataFrame([], "chunk_id string, cluster int")
    labels = cluster_labels(assigned.join(chunks.select("chunk_id", "content"), "chunk_id"), "cluster", "content")
    nodes = symbols.select(F.col("symbol_id").alias("id"))
    ordered = vectors.select("chunk_id", "vector", F.col("chunk_id").alias("ord"))
    related = related_edges(cut_lineage(symbol_vectors(symbols, ordered)), threshold, top_k)
    edges = cut_lineage(calls_edges(symbols, nodes).unionByName(imports_edges(symbols, nodes)).unionByName(related))
    clusters = node_clusters(symbols, cluster_members(symbols, assigned), labels)
    contexts = symbol_contexts(symbols, edges.withColumn("ord", F.struct("kind", "src", "dst")), clusters)
    return Assembled(assigned, labels, edges, contexts)


def run_job(files: DataFrame, repo_url: str, git_ref: str = "HEAD", embedder: Embedder = hashing_embedder, summarizer: Summarizer = stub_summarizer, threshold: float = 0.7) -> tuple[bytes, dict]:
    """(bundle, statistics) of one repository's files; files of several archives are an error."""
    if not repo_url:
        raise InvalidInput("a job needs a repository")
    if archive_key(files) and files.select("archive").distinct().limit(2).count() > 1:
        raise InvalidInput("a job takes one archive: choose it by the column archive")
    read = ingest(files.drop("archive"))
    tables = Ingested(*(cut_lineage(getattr(read, f.name)) for f in fields(read)))
    symbols = cut_lineage(symbol_metadata(tables))
    vectors = cut_lineage(embed(tables.chunks, embedder).dropDuplicates(["chunk_id"]))
    built = assemble(tables.chunks.select("chunk_id", "content").distinct(), vectors, symbols, threshold)
    contexts = cut_lineage(built.contexts)
    return pack(contexts, built.edges, built.clusters, built.assigned, tables.chunks, repo_url, git_ref, document(contexts, summarizer), vectors)
