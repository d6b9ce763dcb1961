"""Queries over the driver's tables, one or more for each operator, and the same in SQL.

Tables stand in for code: embeddings for chunk vectors, lineitem for a large edge
list, documents for files, events for the event log. Arrays are compared as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.functions import prompts as R
from corpusloom.functions import text as T
from corpusloom.functions.vectors import cosine, has_dimension
from corpusloom.operators import chunks as C
from corpusloom.operators import cluster as K
from corpusloom.operators import context as X
from corpusloom.operators import events as E
from corpusloom.operators import graph as G
from corpusloom.operators import labels as L
from corpusloom.operators import search as S
from corpusloom.operators import skip as SK
from corpusloom.operators.documentation import document, totals
from corpusloom.operators.embedding import embed
from corpusloom.operators.extract import extract_calls, extract_imports, extract_symbols
from corpusloom.operators.resolve import resolve_calls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The largest cosine of the test vectors is about 0.5, so the default threshold of 0.7 would leave no edge.
NEAR = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- graph ---------------------------------------------------------------------------------------------------------

_RELATED = f"""
related as (
  select a.vec_id as src, b.vec_id as dst, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as w
  from embeddings a join embeddings b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) > {NEAR}
  qualify row_number() over (partition by a.vec_id order by round(w, 12) desc, b.vec_id) <= 5
)"""


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.related_edges(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), NEAR)


def _supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("calls").alias("kind"), F.lit(None).cast("double").alias("weight"))


@query(f"with {_RELATED} select src, dst, round(w, 6) as weight from related")
def related_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"""with {_RELATED}, ends as (select src as id, 0 as i, 1 as o from related union all select dst, 1, 0 from related)
select e.vec_id as id, coalesce(sum(i), 0)::bigint as in_degree, coalesce(sum(o), 0)::bigint as out_degree,
  round(coalesce(sum(i) + sum(o), 0) / ((select count(*) from embeddings) - 1), 9) as centrality,
  round(least(coalesce(sum(i) + sum(o), 0) / ((select count(*) from embeddings) - 1), 1.0), 9) as centrality_capped
from embeddings e left join ends on ends.id = e.vec_id group by e.vec_id""")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    rows = G.degree_centrality(nodes, _related(spark, sf_dir))
    return rows.select("id", "in_degree", "out_degree", F.round("centrality", 9).alias("centrality"), F.round("centrality_capped", 9).alias("centrality_capped"))


@query("""with n as (select count(distinct l_partkey) + count(distinct l_suppkey) as n, count(*) as e from lineitem)
select n as n_nodes, e as n_edges, round(e / (n::double * (n - 1)), 12) as density, round(2.0 * e / n, 9) as avg_degree from n""")
def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _supplies(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return G.graph_metrics(nodes, edges).select("n_nodes", "n_edges", F.round("density", 12).alias("density"), F.round("avg_degree", 9).alias("avg_degree"))


@query(f"with {_RELATED} select (select count(*) from lineitem) as calls, 0 as imports, (select count(*) from related) as related")
def edge_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    related = _related(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "kind", "weight")
    return G.edge_kind_counts(_supplies(spark, sf_dir).unionByName(related))


@query("""with ends as (select 'p' || l_partkey as id, 0 as i, 1 as o from lineitem union all select 's' || l_suppkey, 1, 0 from lineitem)
select id, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree, count(*) as degree from ends group by id""")
def supply_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _supplies(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return G.degrees(nodes, edges)


@query("""with e as (select o_orderkey as src, o_custkey as dst from orders)
select src, dst, 'calls' as kind from e where dst in (select c_custkey from customer where c_nationkey < 10) and src in (select o_orderkey from orders where o_totalprice > 1000)""")
def calls_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    symbols = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("symbol_id"), F.array(F.concat(F.lit("c"), "o_custkey")).alias("calls"))
    nodes = orders.where("o_totalprice > 1000").select(F.concat(F.lit("o"), "o_orderkey").alias("id")).unionAll(customers.where("c_nationkey < 10").select(F.concat(F.lit("c"), "c_custkey")))
    edges = G.calls_edges(symbols, nodes)
    return edges.select(F.substring("src", 2, 20).cast("bigint").alias("src"), F.substring("dst", 2, 20).cast("bigint").alias("dst"), "kind")


@query("""with e as (select distinct l_partkey, l_suppkey from lineitem), s as (select s_suppkey, s_name from supplier),
c as (select l_partkey, s_name, l_suppkey, row_number() over (partition by l_partkey order by l_suppkey) as r from e join s on s_suppkey = l_suppkey),
p as (select l_suppkey, p_name, l_partkey, row_number() over (partition by l_suppkey order by l_partkey) as r from e join part on p_partkey = l_partkey)
select 'p' || p_partkey as id, coalesce((select string_agg(s_name, ',' order by r) from c where c.l_partkey = p_partkey and r <= 10), '') as calls, '' as called_by from part
union all select 's' || s_suppkey, '', coalesce((select string_agg(p_name, ',' order by r) from p where p.l_suppkey = s_suppkey and r <= 10), '') from supplier""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, suppliers = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    nodes = parts.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name")).unionAll(suppliers.select(F.concat(F.lit("s"), "s_suppkey"), "s_name"))
    keys = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    edges = keys.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("calls").alias("kind"), F.lit(None).cast("double").alias("weight"), F.struct("l_partkey", "l_suppkey").alias("ord"))
    return X.neighbours(nodes, edges).select("id", F.array_join("calls", ",").alias("calls"), F.array_join("called_by", ",").alias("called_by"))


# --- clusters and labels -------------------------------------------------------------------------------------------

_CENTERS = """
centers as (
  select label, list(m order by i) as centroid from (
    select label, i, avg(x) as m from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by label, i
  ) group by label
), near as (
  select vec_id as id, label as cluster, round(list_distance(embedding::double[], centroid), 9) as distance
  from (select vec_id, embedding from embeddings), centers
  qualify row_number() over (partition by vec_id order by distance, cluster) = 1
)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), K.centroids(rows.select(F.col("label").alias("cluster"), F.col("embedding").alias("vector")), "cluster")


@query(f"with {_CENTERS} select id, cluster, round(distance, 6) as distance from near")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.nearest_centroid(*_vectors(spark, sf_dir)).select("id", "cluster", F.round("distance", 6).alias("distance"))


@query(f"with {_CENTERS} select label as cluster, count(id) as member_count from centers left join near on near.cluster = label group by label")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, centers = _vectors(spark, sf_dir)
    return K.cluster_sizes(centers, K.nearest_centroid(vectors, centers))


@query(f"""with {_CENTERS}, moved as (
  select near.cluster, i, avg(x) as m from near join (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) e on e.vec_id = near.id group by near.cluster, i
) select cluster, round(sum(m * i), 6) as weighted, count(*) as dimensions from moved group by cluster""")
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = K.kmeans_step(*_vectors(spark, sf_dir)).where("size > 0").select("cluster", F.posexplode("centroid").alias("i", "m"))
    return step.groupBy("cluster").agg(F.round(F.sum(F.col("m") * (F.col("i") + 1)), 6).alias("weighted"), F.count("*").alias("dimensions"))


@query()
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, _ = _vectors(spark, sf_dir)
    return K.fit_clusters(vectors, K.cluster_count(vectors.count()))[1].select("cluster", "size")


_TERMS = (
    "terms as (select {by} as cluster, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) >= 3)) as term from documents), "
    "freq as (select cluster, term, count(*) as n from terms where term not in (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ") group by cluster, term)"
)


@query(f"with {_TERMS.format(by='source')} select * from freq")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.term_frequency(table(spark, sf_dir, "documents").select(F.col("source").alias("cluster"), "text"))


@query(f"""with {_TERMS.format(by='source')}, two as (
  select cluster, max(case when r = 1 then term end) as a, max(case when r = 1 then n end) as na, max(case when r = 2 then term end) as b, max(case when r = 2 then n end) as nb
  from (select *, row_number() over (partition by cluster order by n desc, term) as r from freq) where r <= 2 group by cluster
), sizes as (select source as cluster, count(text) as member_count from documents group by source)
select sizes.cluster, case when a is null then 'misc' when b is null or na >= 2 * nb or starts_with(a, b) or starts_with(b, a)
  or (strlen(a) >= 4 and strlen(b) >= 4 and length(a) >= 4 and length(b) >= 4 and left(a, 4) = left(b, 4)) then a else a || '-' || b end as label, member_count
from sizes left join two on two.cluster = sizes.cluster""")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cluster_labels(table(spark, sf_dir, "documents").select(F.col("source").alias("cluster"), "text"))


# --- files, chunks, filters ----------------------------------------------------------------------------------------

@query("""with d as (select 'doc/' || doc_id as path, encode(text) as raw, strlen(text)::bigint as n from documents),
pieces as (select *, unnest(range(0, case when n <= 4096 then 1 else ceil(n / 3840.0)::bigint end)) as i, case when n <= 4096 then 1 else ceil(n / 3840.0)::bigint end as total from d),
b as (select *, 3840 * i as s0, case when total = 1 then n else least(3840 * i + 4096, n) end as e0 from pieces),
h as (select *, list_transform([0, 1, 2, 3], lambda k: substr(hex(raw[s0 - k + 1:s0 - k + 1]), 1, 1) in ('8', '9', 'A', 'B')) as back, list_transform([0, 1, 2, 3], lambda k: substr(hex(raw[e0 + k + 1:e0 + k + 1]), 1, 1) in ('8', '9', 'A', 'B')) as ahead from b),
r as (select path, raw, i, total, s0 - list_position(back, false) + 1 as s, e0 + list_position(ahead, false) - 1 as e from h),
c as (select *, raw[s + 1:e] as content, lpad(hex(s), 16, '0') as hs, lpad(hex(e), 16, '0') as he from r)
select 'chunk_' || substr(sha256(encode(path)
    || unhex(concat(substr(hs, 15, 2), substr(hs, 13, 2), substr(hs, 11, 2), substr(hs, 9, 2), substr(hs, 7, 2), substr(hs, 5, 2), substr(hs, 3, 2), substr(hs, 1, 2)))
    || unhex(concat(substr(he, 15, 2), substr(he, 13, 2), substr(he, 11, 2), substr(he, 9, 2), substr(he, 7, 2), substr(he, 5, 2), substr(he, 3, 2), substr(he, 1, 2)))
    || content), 1, 16) as chunk_id,
  path, s as "start", e as "end", case when total > 1 then i end as split_index, case when total > 1 then total end as split_total from c""")
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("text").alias("content"))
    return C.file_chunks(docs).drop("content")


_PATHS = """p as (select page_id, case page_id % 8 when 0 then 'src/main' || page_id || '.rs' when 1 then 'node_modules/pkg/index.js' when 2 then 'Cargo.lock'
  when 3 then 'src/layout' || page_id || '.tsx' when 4 then 'app/Model.PY' when 5 then '.hidden/x.go' when 6 then 'docs/readme.md' else 'tools/run' || page_id || '.mjs' end as path, html from pages)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("page_id") % 8, F.col("page_id")
    path = (
        F.when(k == 0, F.concat(F.lit("src/main"), i, F.lit(".rs"))).when(k == 1, "node_modules/pkg/index.js").when(k == 2, "Cargo.lock")
        .when(k == 3, F.concat(F.lit("src/layout"), i, F.lit(".tsx"))).when(k == 4, "app/Model.PY").when(k == 5, ".hidden/x.go")
        .when(k == 6, "docs/readme.md").otherwise(F.concat(F.lit("tools/run"), i, F.lit(".mjs")))
    )
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.col("html").cast("binary").alias("content"))
    return rows.withColumn("size", F.octet_length("content").cast("bigint"))


_LANG = "case lower(regexp_extract(path, '\\.([^./]+)$', 1)) when 'rs' then 'rust' when 'py' then 'python' when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'js' then 'javascript' when 'jsx' then 'javascript' when 'mjs' then 'javascript' when 'cjs' then 'javascript' when 'go' then 'go' end"
_PATTERNS = "[" + ", ".join(f"'{p}'" for p in SK.IGNORED) + "]"
_IGNORE = f"list_filter({_PATTERNS}, lambda q: list_contains(string_split(path, '/'), q) or contains(path, q) or (q[1] = '*' and len(list_filter(string_split(path, '/'), lambda c: ends_with(c, q[2:]))) > 0))[1]"
_CASCADE = f"""case when strlen(html) > 1500 then 'too_large' when path in ('Cargo.lock') then 'lock_file' when {_IGNORE} is not null then 'ignore_pattern' when contains(html, chr(0)) then 'binary' when {_LANG} is null then 'unsupported_language' end"""


@query(f"with {_PATHS} select page_id, path, {_CASCADE} as skip_reason, case when ({_CASCADE}) is null then {_LANG} end as language from p")
def skip_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SK.classify(_paths(spark, sf_dir), max_size=1500).select("page_id", "path", "skip_reason", "language")


@query(f"with {_PATHS}, s as (select {_CASCADE} as r from p) select count_if(r is null) as files_processed, count_if(r is not null) as files_skipped from s")
def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ingest_totals(SK.classify(_paths(spark, sf_dir), max_size=1500))


@query(f"with {_PATHS} select page_id, {_IGNORE} as pattern, path like '.%' or regexp_extract(path, '([^/]*)$', 1) like '.%' as hidden from p where path not like '.%'")
def ignore_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir).where("path not like '.%'")
    return rows.select("page_id", SK.ignore_pattern(F.col("path")).alias("pattern"), SK.is_hidden(F.col("path")).alias("hidden"))


@query(f"with {_PATHS} select page_id, {_LANG} as language, regexp_replace(path, '^[^/]*/', '') as below from p where path like '%/%'")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir).where("path like '%/%'")
    return rows.select("page_id", P.detect_language(F.col("path"), F.col("content").cast("string")).alias("language"), P.without_archive_root(F.col("path")).alias("below"))


@query("select lang as language, count(distinct source) as file_count, count(*) as chunk_count from documents group by lang")
def language_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.language_breakdown(table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("lang").alias("language")))


@query("""select doc_id, source as owner, lang as repo, case when doc_id % 2 = 0 then 'main/' || doc_id end as git_ref,
  'https://github.com/' || source || '/' || lang || '/archive/' || case when doc_id % 2 = 0 then 'main/' || doc_id else 'HEAD' end || '.zip' as archive from documents where doc_id % 3 <> 0""")
def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    tail = F.when(i % 2 == 0, F.concat(F.lit("/tree/main/"), i)).otherwise(F.lit(".git"))
    host = F.when(i % 3 == 0, "https://example.com/").when(i % 3 == 1, "https://github.com/").otherwise("github.com/")
    rows = table(spark, sf_dir, "documents").select("doc_id", P.parse_repo_url(F.concat(host, "source", F.lit("/"), "lang", tail)).alias("r")).where("r is not null")
    return rows.select("doc_id", "r.*", P.archive_url(F.col("r.owner"), F.col("r.repo"), F.col("r.git_ref")).alias("archive"))


@query("""select event_id, event_id >= 0 as job_ok, length('chunk_' || event_id) >= 10 as chunk_ok, length('sym_' || event_id) >= 8 as sym_ok, length('evt_' || event_id) >= 8 as evt_ok,
  'sym_src/' || event_type || '.rs::' || user_id as symbol_id from events""")
def id_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id").cast("string")
    ids = {k: T.valid_id(F.concat(F.lit(p), i), k) for k, p in (("chunk", "chunk_"), ("sym", "sym_"), ("evt", "evt_"))}
    job = T.valid_id(F.concat(F.lit("job_0000"), i), "job")
    name = T.symbol_id(F.concat(F.lit("src/"), "event_type", F.lit(".rs")), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", job.alias("job_ok"), *(c.alias(f"{k}_ok") for k, c in ids.items()), name.alias("symbol_id"))


@query("""with n as (select doc_id, n_chars * n_chars as n from documents),
u as (select *, case when n < 1024 then 0 when n < 1048576 then 1 when n < 1073741824 then 2 else 3 end as u from n),
v as (select *, round(n / pow(1024.0, u), 1) as v from u)
select doc_id, case when v = floor(v) then v::bigint::varchar else printf('%.1f', v) end || ' ' || ['B', 'KB', 'MB', 'GB'][u + 1] as shown from v""")
def display_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("bigint")
    return table(spark, sf_dir, "documents").select("doc_id", T.format_bytes(n * n).alias("shown"))


@query("""select doc_id, case when n_chars < 1000 then n_chars || 'ms' else ((n_chars + 5) // 1000) || '.' || lpad((((n_chars + 5) // 10) % 100)::varchar, 2, '0') || 's' end as duration,
  case when n_chars % 100 >= 70 then 'Very High' when n_chars % 100 >= 40 then 'High' when n_chars % 100 >= 20 then 'Medium' else 'Low' end as band,
  case when n_chars % 200 < 30 then 'ingest' when n_chars % 200 < 120 then 'embedding' else 'assembly' end as stage from documents""")
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", T.format_duration(n).alias("duration"), T.centrality_band((n % 100) / 100.0).alias("band"), T.stage_of_elapsed(n % 200).alias("stage"))


@query("""select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity, len(a.embedding) = 64 as has_dimension
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    a, b = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("b")), rows.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "b").select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("similarity"), has_dimension(F.col("x"), 64).alias("has_dimension"))


# --- events --------------------------------------------------------------------------------------------------------

_LOG = """log as (select event_id, 'job_' || user_id as job_id, ts as timestamp, value, props, json_extract_string(props, '$.k') as file_path, row_number() over (partition by user_id order by ts, event_id) - 1 as sequence,
  case event_type when 'signup' then 'ingest.started.v1' when 'view' then 'ingest.file_detected.v1' when 'error' then 'ingest.file_skipped.v1' when 'click' then 'ingest.chunk_created.v1' else 'ingest.completed.v1' end as event_type,
  case when event_type = 'purchase' and event_id % 4 <> 0 then case when value > 50 then 'success' else 'failed' end when event_id % 97 = 0 then 'success' end as status from events)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for kv in {"signup": "ingest.started.v1", "view": "ingest.file_detected.v1", "error": "ingest.file_skipped.v1", "click": "ingest.chunk_created.v1", "purchase": "ingest.completed.v1"}.items() for x in kv))
    done = (F.col("event_type") == "purchase") & (F.col("event_id") % 4 != 0)
    status = F.when(done, F.when(F.col("value") > 50, "success").otherwise("failed")).when(F.col("event_id") % 97 == 0, "success")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("job_"), "user_id").alias("job_id"), F.col("ts").alias("timestamp"), "value", status.alias("status"), kind[F.col("event_type")].alias("event_type"),
        F.to_json(F.struct(F.get_json_object("props", "$.k").alias("file_path"), F.lit("lang").alias("x"))).alias("payload"),
    )
    return E.with_sequence(rows)


@query(f"with {_LOG} select event_id, job_id, sequence from log")
def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("event_id", "job_id", "sequence")


@query(f"""with {_LOG}, s as (select job_id, count_if(event_type like '%file_detected%') as files_detected, count_if(event_type like '%file_skipped%') as files_skipped, count_if(event_type like '%chunk_created%') as chunks_created,
  count_if(event_type like '%completed%') as n, arg_max(coalesce(status, '-'), sequence) filter (event_type like '%completed%') as st from log group by job_id)
select job_id, files_detected, files_skipped, chunks_created, case when n = 0 then 'running' when st = '-' then 'completed' else st end as status from s""")
def event_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_statistics(_log(spark, sf_dir)).drop("duration_ms")


@query(f"""with {_LOG}, s as (select job_id, arg_max(coalesce(status, 'success'), sequence) filter (event_type = 'ingest.completed.v1') as st from log group by job_id) select job_id, coalesce(st, 'running') as status from s""")
def terminal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.terminal_status(_log(spark, sf_dir))


@query(f"""with {_LOG} select event_id, case when event_id % 50 = 0 then 'invalid_event_id' when event_id % 51 = 0 then 'invalid_event_type' when event_id % 52 = 0 then 'empty_repo_url'
  when event_type = 'ingest.completed.v1' and status is null then 'missing_status' when event_type <> 'ingest.completed.v1' and status is not null then 'unexpected_status' end as error from log""")
def event_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    name = F.when(i % 50 == 0, "x").otherwise(F.concat(F.lit("evt_"), i))
    kind = F.when(i % 51 == 0, "odd").otherwise(F.col("event_type"))
    url = F.when(i % 52 == 0, "").otherwise("u")
    return _log(spark, sf_dir).select("event_id", E.validation_error(name, kind, url, F.col("status")).alias("error"))


@query(f"""with {_LOG}, r as (select *, last_value(case when event_type = 'ingest.file_detected.v1' then 'seen' end ignore nulls) over (partition by job_id, file_path order by sequence rows unbounded preceding) as l
  from log where event_type in ('ingest.file_detected.v1', 'ingest.chunk_created.v1'))
select event_id, file_path, coalesce(replace(l, 'seen', 'unknown'), 'unknown') as language, l is not null as detected from r where event_type = 'ingest.chunk_created.v1'""")
def detected_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    known = E.with_detected_language(log, keep_undetected=False).select("event_id", F.lit(True).alias("detected"))
    return E.with_detected_language(log).select("event_id", "file_path", "language").join(known, "event_id", "left").na.fill(False, ["detected"])


@query(f"""with {_LOG}, k as (select *, case when event_id % 5 <> 0 then file_path || event_type end as idempotency_key from log)
select event_id, job_id from k where idempotency_key is null or event_id in (select arg_min(event_id, sequence) from k where idempotency_key is not null group by job_id, idempotency_key)""")
def unique_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("event_id") % 5 != 0, F.concat(E.field("file_path"), F.col("event_type")))
    return E.dedupe_events(_log(spark, sf_dir).withColumn("idempotency_key", key)).select("event_id", "job_id")


@query(f"with {_LOG} select file_path, count(*) as n from log where event_type = 'ingest.file_skipped.v1' group by file_path")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.counts_by(_log(spark, sf_dir), "ingest.file_skipped.v1", "file_path")


@query(f"""with {_LOG}, p as (select *, lag(event_id * 7919 % 10007) over (partition by job_id order by timestamp, event_id) as previous from log) select event_id, previous from p where previous is not null and event_id * 7919 % 10007 <= previous""")
def sequence_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("sequence", F.col("event_id") * 7919 % 10007)
    return E.sequence_breaks(log).select("event_id", "previous")


@query("""select epoch_us(time_bucket(interval 1 hour, ts)) as hour, event_type, count(*) as n from events group by all""")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("t", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("hour"), "event_type", "n")


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, epoch_us(min(ts)) as began, count(*) as n from s group by user_id, k""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.session_window("t", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("began"), "n")


# --- prompts, search, code -----------------------------------------------------------------------------------------

_TOKENS = "len(regexp_extract_all({}, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\\s]'))"


@query(f"""with t as (select conv_id, sum(case when role = 'assistant' then {_TOKENS.format('text')} else 0 end) as o, sum(case when role <> 'assistant' then {_TOKENS.format('text')} else 0 end) as i from conversations group by conv_id)
select conv_id, i::bigint as input_tokens, o::bigint as output_tokens, round(i / 1e6 * 0.15 + o / 1e6 * 0.60, 9) as cost from t""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("n", R.count_tokens(F.col("text")))
    sums = rows.groupBy("conv_id").agg(F.sum(F.when(F.col("role") != "assistant", F.col("n")).otherwise(0)).alias("input_tokens"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("output_tokens"))
    return sums.withColumn("cost", F.round(R.cost(F.col("input_tokens"), F.col("output_tokens")), 9))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = neighbours(spark, sf_dir).where("id like 's%'").select(F.substring("id", 2, 20).cast("bigint").alias("k"), F.filter(F.split("called_by", ","), lambda x: x != "").alias("called_by"))
    rows = table(spark, sf_dir, "supplier").join(near, F.col("s_suppkey") == F.col("k"))
    return rows.select(
        F.concat(F.lit("s"), "s_suppkey").alias("symbol_id"), F.lit("rust").alias("language"), F.col("s_name").alias("name"), F.lit("function").alias("kind"), F.lit("src/s.rs").alias("file_path"),
        F.concat("s_name", F.lit("()")).alias("signature"), F.array().cast("array<string>").alias("calls"), "called_by", F.when(F.col("s_nationkey") > 10, "label").alias("cluster_label"), (F.col("s_nationkey") / 25).alias("centrality"),
    )


_PROMPT = """e as (select distinct l_partkey, l_suppkey from lineitem), p as (select l_suppkey, p_name, l_partkey, row_number() over (partition by l_suppkey order by l_partkey) as r from e join part on p_partkey = l_partkey),
c as (select l_suppkey, string_agg(p_name, ', ' order by r) as names from p where r <= 10 group by l_suppkey),
prompts as (select 's' || s_suppkey as symbol_id, concat_ws(chr(10), 'You are documenting a rust codebase.', '', 'Symbol: ' || s_name, 'Kind: function', 'File: src/s.rs', 'Signature: ' || s_name || '()', 'Called by: ' || names,
  case when s_nationkey > 10 then 'Related to: label' end, format('Importance: {:.2f} (0-1 scale)', s_nationkey / 25), '', 'Write 1-2 sentences describing what this symbol does.', 'Be concise and precise. Focus on purpose, not implementation.') as prompt
  from supplier left join c on l_suppkey = s_suppkey)"""


@query(f"with {_PROMPT} select symbol_id, prompt, ({_TOKENS.format('prompt')})::bigint as tokens from prompts")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = {n: F.col(n) for n in ("language", "name", "kind", "file_path", "signature", "calls", "called_by", "cluster_label", "centrality")}
    text = R.prompt(c["language"], c["name"], c["kind"], c["file_path"], c["signature"], c["calls"], c["called_by"], c["cluster_label"], c["centrality"])
    return _contexts(spark, sf_dir).select("symbol_id", text.alias("prompt")).withColumn("tokens", R.count_tokens(F.col("prompt")))


@query()
def documentation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(document(_contexts(spark, sf_dir))).drop("warnings")


@query("select c_custkey, c_name, c_mktsegment as kind from customer where c_mktsegment = 'BUILDING' and (contains(lower(c_name), '00001') or contains(lower(c_mktsegment), '00001'))")
def search_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("kind"), F.col("c_mktsegment").alias("signature"), F.lit("f").alias("file_path"))
    return S.search_symbols(rows, "00001", "BUILDING").select("c_custkey", F.col("name").alias("c_name"), "kind")


@query("select source as file_path, string_agg(lpad(doc_id::varchar, 9, '0'), ',' order by lpad(doc_id::varchar, 9, '0')) as symbols from documents group by source")
def symbols_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("file_path"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.col("lang").alias("kind"))
    return S.symbols_by_file(rows).select("file_path", F.array_join(F.transform("symbols", lambda s: s["name"]), ",").alias("symbols"))


@query("""select d.file_path, d.language, coalesce(string_agg(c.turn::varchar, ',' order by c.turn), '') as chunks from (select distinct conv_id::varchar as file_path, 'en' as language from conversations where role = 'assistant') d
left join conversations c on c.conv_id::varchar = d.file_path group by all""")
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    chunks = rows.select(F.col("conv_id").cast("string").alias("file_path"), F.col("turn").alias("ord"), F.col("turn").cast("string").alias("chunk_id"))
    detected = rows.where("role = 'assistant'").select(F.col("conv_id").cast("string").alias("file_path"), F.lit("en").alias("language")).distinct()
    return S.file_tree(chunks, detected).select("file_path", "language", F.array_join("chunks", ",").alias("chunks"))


@query("select c_mktsegment as kind, (select count(distinct c_nationkey) from customer) as n_files from customer group by c_mktsegment")
def symbol_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("file_path"))
    return S.kinds(rows).join(F.broadcast(S.distinct_files(rows)))


@query("""with s as (select p_name as name, 'sym_part::' || p_name as id, p_partkey as k from part), t as (select name, arg_max(id, k) as id from s group by name),
c as (select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then 'obj.' || p_name when 2 then 'a::' || p_name else 'missing' || p_partkey end as name from part)
select p_partkey, c.name, coalesce(t1.id, t2.id, t3.id) as symbol_id, coalesce(t1.id, t2.id, t3.id) is not null as is_resolved
from c left join t t1 on t1.name = c.name left join t t2 on contains(c.name, '.') and t2.name = string_split(c.name, '.')[-1] left join t t3 on contains(c.name, '::') and t3.name = string_split(c.name, '::')[-1]""")
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    symbols = parts.select(F.col("p_name").alias("name"), F.lit("part").alias("file_path"), F.col("p_partkey").alias("ordinal"))
    k = F.col("p_partkey") % 4
    name: Column = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("obj."), "p_name")).when(k == 2, F.concat(F.lit("a::"), "p_name")).otherwise(F.concat(F.lit("missing"), "p_partkey"))
    calls = parts.select(name.alias("name"), F.lit("x").alias("file_path"), F.col("p_partkey").alias("ordinal"))
    return resolve_calls(calls, symbols).select(F.col("ordinal").alias("p_partkey"), "name", "symbol_id", "is_resolved")


_CODE = {
    "rust": "use std::io;\npub struct P{i} {{ a: u32 }}\nimpl P{i} {{ fn new() -> Self {{ P{i} {{ a: helper(1) }} }} }}\npub async fn run{i}(x: u32) -> u32 {{\n    helper(x)\n}}\nfn helper(x: u32) -> u32 {{ x }}\n",
    "python": "import os\nfrom a.b import c\nLIMIT = {i}\nclass K{i}(Base):\n    def m(self):\n        return helper()\n\nasync def run{i}(x: int) -> int:\n    return helper(x)\n",
    "typescript": "import {{ a }} from 'b';\nexport function run{i}(x: number): number {{ return helper(x); }}\nexport const go{i} = async (y) => run{i}(y);\nclass K{i} extends B {{ m() {{ return new C(); }} }}\n",
    "go": 'package main\nimport "fmt"\ntype T{i} struct {{ a int }}\nfunc (t T{i}) Run() int {{ return helper() }}\nfunc helper() int {{ fmt.Println("x"); return {i} }}\n',
}


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file for each supplier, of each language in turn."""
    i = F.col("s_suppkey").cast("string")
    names = list(_CODE)
    content = F.lit(None).cast("string")
    language = F.lit(None).cast("string")
    for k, n in enumerate(names):
        mine = F.col("s_suppkey") % len(names) == k
        text = F.replace(F.lit(_CODE[n].replace("{i}", "\x01").replace("{{", "{").replace("}}", "}")), F.lit("\x01"), i)
        content, language = F.when(mine, text).otherwise(content), F.when(mine, F.lit(n)).otherwise(language)
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/f"), i).alias("path"), language.alias("language"), content.alias("content"))
    return rows


_COUNTS = "with f as (select case s_suppkey % 4 when 0 then 'rust' when 1 then 'python' when 2 then 'typescript' else 'go' end as language, count(*) as n from supplier group by 1) select language, {} from f"


@query(_COUNTS.format("n * case language when 'rust' then 4 when 'python' then 3 when 'typescript' then 3 else 3 end as symbols, n * case language when 'rust' then 1 when 'typescript' then 2 else 0 end as public_only, n * case language when 'go' then 0 when 'rust' then 1 when 'python' then 1 else 1 end as async_ones"))
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract_symbols(_code(spark, sf_dir)).groupBy("language")
    public = F.count_if((F.col("visibility") == "public") & F.col("language").isin("rust", "typescript"))
    return rows.agg(F.count("*").alias("symbols"), F.when(F.col("language") == "rust", public - F.count_if(F.col("kind") == "struct")).otherwise(public).cast("bigint").alias("public_only"), F.count_if("is_async").alias("async_ones"))


@query(_COUNTS.format("n * case language when 'rust' then 2 when 'python' then 2 when 'typescript' then 3 else 2 end as calls"))
def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_calls(_code(spark, sf_dir)).groupBy("language").agg(F.count("*").alias("calls"))


@query(_COUNTS.format("n * case language when 'python' then 2 else 1 end as imports"))
def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_imports(_code(spark, sf_dir)).groupBy("language").agg(F.count("*").alias("imports"))


@query()
def code_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _code(spark, sf_dir)
    return C.symbol_chunks(files, extract_symbols(files)).select("chunk_id", "path", "start", "end", "metadata.symbol_name")


@query()
def chunk_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    return embed(docs)
