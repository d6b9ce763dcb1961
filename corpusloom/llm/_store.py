"""Tables that cut a plan's lineage, and the distributed steps on pairs that several operators share.

Every table lies under the folder that the cluster names in spark.checkpoint.dir,
which all executors share, so a lost executor costs the tasks it ran and no more.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 8 << 20
BLOCK = 1024  # members of a bucket that one task compares with as many others of it
PART = 1 << 16  # rows of a key that one task may get
SALTS = 256
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold BATCH bytes at most, so that long texts don't fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH:
        spark.conf.set(name, str(BATCH))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder in local mode (one machine), and an error on a cluster."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session with a setting, which is as before afterwards."""
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, value)
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def keep(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; the shuffle files of the write go at its end."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with setting(spark, _CLEAN, "true"):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing else uses; it belongs to the innermost open scope."""
    path = f"{shared_folder(spark)}/corpusloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    return path


class Scope:
    """The tables that one call of an operator writes: at its end all go but the one that holds its result.

    Tables of other calls are never touched, so any number of lazy results can
    be held at once.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.left = spark, [], []

    def __enter__(self) -> Scope:
        _scopes.open.append(self.made)
        return self

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table that stays."""
        written = keep(df, name)
        self.left.append(self.made.pop())
        return written

    def take(self, other: Scope) -> None:
        """Let this scope delete what an ended one left."""
        self.made += other.left

    def __exit__(self, *error: object) -> None:
        _scopes.open.pop()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        if _scopes.open:
            _scopes.open[-1].extend(self.left)


class _Scopes(threading.local):
    def __init__(self):
        self.open: list[list[str]] = []


_scopes = _Scopes()


def hot(sizes: DataFrame, key: str) -> DataFrame | None:
    """The keys with more than PART rows and over a thousandth of all rows; sizes: (key, n). By arithmetic there are less than 1024."""
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    if not most or most <= PART:
        return None
    return sizes.where(F.col("n") > max(PART, total >> 10)).select(key)


def attach(rows: DataFrame, table: DataFrame, key: str, heavy: DataFrame | None) -> DataFrame:
    """rows joined with table, which has one row a key. The rows of a heavy key are dealt to SALTS tasks."""
    if heavy is None:
        return rows.join(table, key)
    marks = F.broadcast(heavy.withColumn("_hot", F.lit(True)))
    own = rows.join(marks, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("_hot")
    salts = F.when(F.col("_hot"), F.expr(f"sequence(0L, {SALTS - 1}L)")).otherwise(F.array(F.lit(0).cast("long")))
    copies = table.join(marks, key, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return own.join(copies, [key, "_salt"]).drop("_salt")


def in_set(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of df whose column is probably among keys: a filter before an exact join, to shuffle less.

    A bitmap of 16 bits a key, 2**20 to 2**26 bits, is broadcast as rows of its 64-bit
    words that aren't zero (2**20 at most, whatever the size of keys); beyond
    that size more rows pass, none is lost.
    """
    n = keys.count()
    bits = 1 << min(26, max(20, (16 * max(n, 1) - 1).bit_length()))
    words = keys.select(F.expr(f"`{key}` & {bits - 1}L").alias("at")).groupBy(F.expr("at div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("_bits"))
    place = f"(`{column}` & {bits - 1}L)"
    return df.withColumn("_word", F.expr(f"{place} div 64")).join(F.broadcast(words), "_word").where(f"getbit(_bits, cast({place} % 64 as int)) = 1").drop("_word", "_bits")


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find: (node, component) for every node of edges (a, b); a component is named by its smallest node.

    Each round hooks every node to its smallest neighbour, halves the paths, and
    contracts the edges; a star of any size is one round. Nodes and edges stay
    in tables.
    """
    edges = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    schema, steps = edges, []
    while not edges.isEmpty():
        ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))
        above = up.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        up = keep(up.join(above, "parent").select("node", F.col("above").alias("parent")), "parents")
        steps.append(up)
        left = up.select(F.col("node").alias("a"), F.col("parent").alias("x"))
        right = up.select(F.col("node").alias("b"), F.col("parent").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = keep(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not steps:
        return schema.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    found = steps[-1].select("node", F.col("parent").alias("component"))
    for up in reversed(steps[:-1]):
        later = found.select(F.col("node").alias("parent"), "component")
        found = up.join(later, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
    return keep(found, "components")


def linked(members: DataFrame, heavy: DataFrame | None, verify: Callable[[DataFrame], DataFrame], sketches: Callable[[DataFrame], DataFrame], meet: Callable[[DataFrame, DataFrame], DataFrame], turns: int = 0) -> DataFrame:
    """Links (a, b) that connect all members of a bucket that links connect; members: distinct (bucket, id, n), n the bucket's size.

    Every pair of a bucket is compared, or its ends are connected by links found
    before: first every member is compared with its bucket's leader, the member
    that shares most buckets with most others, so a text that many were copied
    from connects them in one turn, and a bucket of two is done. In each other
    bucket that is then more than one component, every member outside the largest component meets all members of
    other components. The bucket's members are dealt to a grid of cells of about
    BLOCK x BLOCK; in a cell, meet(left, right) gives the pairs (a, b, score) that
    an exact bound on the sketches (id, ...) of these ids leaves possible, and only
    those become rows. In each of so many turns every member is compared with the
    partner of its best score, and pairs that this connects go. verify keeps the
    pairs (a, b) that hold.
    """
    known = members.groupBy("id").agg(F.sum("n").alias("score"))
    heads = members.join(known, "id").groupBy("bucket").agg(F.max(F.struct("score", "id")).alias("best")).select("bucket", F.col("best.id").alias("head"))
    led = attach(members.select("bucket", "id"), heads, "bucket", heavy).where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    links = keep(verify(keep(led.distinct(), "led")), "links")
    joined = components(links).select(F.col("node").alias("id"), "component")
    members = keep(members.select("bucket", "id").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")), "members")
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    parts = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1 and n > 2")
    parts = parts.select("bucket", F.col("most.component").alias("main"), F.expr(f"(n - most.n + {BLOCK - 1}) div {BLOCK}").alias("lefts"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("rights"))
    apart = keep(attach(members, parts, "bucket", heavy).withColumn("outside", F.expr("component <> main")).drop("main"), "apart")
    if apart.isEmpty():
        return links
    apart = keep(apart.join(sketches(apart.select("id").distinct()), "id"), "sketched")
    left = apart.where("outside").withColumn("i", F.expr("pmod(xxhash64(id), lefts)")).withColumn("j", F.expr("explode(sequence(0L, rights - 1))"))
    right = apart.withColumn("j", F.expr("pmod(xxhash64(id, 1), rights)")).withColumn("i", F.expr("explode(sequence(0L, lefts - 1))"))
    met = meet(left.drop("lefts", "rights", "outside"), right.drop("lefts", "rights"))
    met = keep(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").distinct(), "met")
    for _ in range(turns):
        if met.isEmpty():
            return links
        ends = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
        best = ends.groupBy("a").agg(F.max(F.struct("score", "b")).alias("best")).select(F.least("a", "best.b").alias("a"), F.greatest("a", "best.b").alias("b"))
        links = keep(links.unionByName(verify(keep(best.distinct(), "best"))), "links")
        joined = components(links)
        for end in ("a", "b"):
            met = met.join(joined.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left").withColumn(f"of_{end}", F.coalesce(f"of_{end}", end))
        met = keep(met.where("of_a <> of_b").select("a", "b", "score"), "met")
    return links.unionByName(keep(verify(met.select("a", "b")), "links"))
