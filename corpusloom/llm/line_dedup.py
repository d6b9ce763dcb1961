"""Fuzzy line dedup by MinHash, in DataFrame operations only.

Lines (split at \\n, trimmed, in lower case) that are equal are one node. A
node's signature has BANDS * ROWS minima over its character shingles (SHINGLE
UTF-16 units from every place). The ROWS minima of a band come from independent
parts of a 64-bit hash; over the bands each is read from another sixteenth of its
range first, as in one-permutation hashing whose empty bins borrow. So that long
lines cost no more than short ones, a line of n shingles is signed over those
whose hash is 0 modulo 1, 4 or 16, by n (STEPS); the ranges of n overlap by the
threshold, so two similar lines share one. The exact comparison takes them all.
Lines that agree in a band are compared by the exact Jaccard
similarity of all their shingles: every pair of a bucket is compared or already
connected. Distributed union-find joins those at or above the threshold, and of
each component the first line by (doc_id, text hash, line number) stays.

The lines are cut once, into a table. Texts are never shuffled but for the lines
that agree in a band. Lines are told apart by a 64-bit hash.

Defined cases: a null text is one empty line; lines without a word are never
removed; a line shorter than a shingle is one shingle; rows equal in doc_id and
text are one document and come out once; null doc_ids come last in the order; an
empty table gives an empty result. Other columns are not read. A line that
repeats itself counts its repeats in n: a much shorter line with the same set of
shingles may be signed in another way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._store import Scope, attach, components, hot, in_set, keep, linked, setting

SHINGLE = 8
THRESHOLD = 0.8
BANDS = 10
ROWS = 4
STEPS = ((0, 0, 128), (2, 102, 512), (4, 409, 1 << 31))  # bits of the hash that are 0, and the range of n: above, up to
WORDS = 64  # 64-bit words of the bitmap that bounds a pair's similarity
PART_WORDS = 16  # words of it that are gathered at once
_PARTS = ("shiftright(x, 32)", "shiftright(shiftleft(x, 32), 32)", "shiftright(shiftleft(x, 16), 32)", "shiftright(shiftleft(x, 48), 32)")
_TRIM = " \t\r\x0b\x0c"


def _mask(band: int, row: int) -> int:
    """32 bits whose upper four are another number for each band, as a signed integer."""
    k = band * ROWS + row
    full = (3 * band % 16) << 28 | (0x2545F491 * (2 * k + 1) + 0x61C88647 * k * k) % (1 << 28)
    return full - (1 << 32 if full >> 31 else 0)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_lines of the text, line_no, norm of all lines; norm is '' for lines without a word."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    # what is said of a text is made before its lines: beside the generator it would be made again for each of them
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), F.split(F.lower(F.coalesce(text, F.lit(""))), "\n", -1).alias("parts"))
    rows = rows.select("doc_id", "key", F.size("parts").cast("long").alias("n_lines"), "parts").select("doc_id", "key", "n_lines", F.posexplode("parts").alias("line_no", "line"))
    # btrim with a set of characters is slow, and few lines need it after trim
    rows = rows.select("doc_id", "key", "n_lines", "line_no", F.trim("line").alias("line"))
    odd = " or ".join(f"endswith(line, '{c}') or startswith(line, '{c}')" for c in _TRIM[1:])
    return rows.select("doc_id", "key", "n_lines", "line_no", F.when(F.expr(odd), F.btrim("line", F.lit(_TRIM))).otherwise(F.col("line")).alias("norm"))


def _signatures(lines: DataFrame) -> DataFrame:
    """(line, way, n, bands): a hash of each band's minima and the number of rows, for each way a line is signed; (line, norm) may repeat."""
    size = f"greatest(octet_length(raw) div 2 - {SHINGLE - 1}, 1)"
    ways = ", ".join(f"if(n > {above} and n <= {most}, {bits}, null)" for bits, above, most in STEPS)
    rows = lines.select("line", F.encode("norm", "UTF-16BE").alias("raw")).select("line", "raw", F.expr(size).alias("n"))
    rows = rows.select("line", "raw", "n", F.expr(f"explode(array_compact(array({ways})))").alias("way"))
    rows = rows.select("line", "way", "raw", F.expr("explode(sequence(1, n))").alias("at"))
    rows = rows.select("line", "way", "at", F.expr(f"xxhash64(substring(raw, 2 * at - 1, {2 * SHINGLE}))").alias("x"))
    rows = rows.where("at = 1 or x & (shiftleft(1L, way) - 1) = 0")
    rows = rows.select("line", "way", "at", *(F.expr(f"cast({p} as int)").alias(f"h{r}") for r, p in enumerate(_PARTS)))
    minima = [F.expr(f"min(h{r} ^ {_mask(b, r)})").alias(f"m{b}_{r}") for b in range(BANDS) for r in range(ROWS)]
    least = rows.groupBy("line", "way").agg(F.expr("sum(if(at = 1, 1L, 0L))").alias("n"), *minima)
    return least.select("line", "way", "n", F.array(*(F.xxhash64(F.lit(b), "way", *(F.col(f"m{b}_{r}") for r in range(ROWS))) for b in range(BANDS))).alias("bands"))


def _set(text: str) -> Column:
    """The distinct shingles of a text; its bytes are bound to a lambda's variable, or each shingle would copy the whole line."""
    one = f"array_distinct(transform(sequence(1, greatest(octet_length(r) div 2 - {SHINGLE - 1}, 1)), i -> xxhash64(substring(r, 2 * i - 1, {2 * SHINGLE}))))"
    return F.expr(f"transform(array(encode({text}, 'UTF-16BE')), r -> {one})[0]")


def _sketches(texts: DataFrame) -> DataFrame:
    """(id, xn, x0, ...): the number of a text's distinct shingles and a bitmap of them; texts: (id, norm)."""
    rows = texts.select("id", _set("norm").alias("s")).select("id", F.size("s").alias("xn"), F.explode("s").alias("x"))
    place = F.expr(f"cast(shiftright(x, 6) & {WORDS - 1} as int)").alias("word")
    rows = rows.select("id", "xn", place, F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit"))
    rows = rows.groupBy("id", "xn", F.expr(f"word div {PART_WORDS}").alias("part")).agg(*(F.expr(f"bit_or(if(word % {PART_WORDS} = {i}, bit, 0L))").alias(f"b{i}") for i in range(PART_WORDS)))
    return rows.groupBy("id", "xn").agg(*(F.expr(f"max(if(part = {i // PART_WORDS}, b{i % PART_WORDS}, null))").alias(f"x{i}") for i in range(WORDS)))


def _side(sketches: DataFrame, letter: str) -> DataFrame:
    """Sketches with the columns of one side of a pair, none of them null."""
    return sketches.withColumns({f"{letter}n": F.coalesce("xn", F.lit(0))} | {f"{letter}{i}": F.coalesce(f"x{i}", F.lit(0).cast("long")) for i in range(WORDS)})


_APART = " + ".join(f"bit_count(x{i} ^ y{i})" for i in range(WORDS))


def _possible(threshold: float) -> Column:
    """Whether the bitmaps allow the threshold: each bit that one side has alone is a shingle of that side alone, and sets of xn
    and yn shingles that differ in d have (xn + yn - d) / 2 in common."""
    return F.expr(f"({_APART}) * {1 + threshold}D <= {1 - threshold}D * (xn + yn) + 0.000001D")


def line_components(lines: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of the lines that are similar to another; lines: (line, norm), line the hash of norm; signed: their signatures."""
    places = signed.select(F.explode("bands").alias("bucket"), F.col("line").alias("id"))
    shared = keep(places.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    heavy = hot(shared, "bucket")
    members = keep(attach(in_set(places, "bucket", shared, "bucket"), shared, "bucket", heavy), "buckets")
    wanted = keep(members.select("id").distinct(), "wanted")
    texts = in_set(lines.withColumnRenamed("line", "id"), "id", wanted, "id").dropDuplicates(["id"]).join(wanted, "id")
    texts = keep(texts, "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        busy = {end: hot(pairs.groupBy(end).agg(F.count("*").alias("n")), end) for end in ("a", "b")}
        for end in ("a", "b"):
            pairs = attach(pairs, texts.select(F.col("id").alias(end), F.col("norm").alias(f"t{end}")), end, busy[end])
        both = pairs.select("a", "b", _set("ta").alias("sa"), _set("tb").alias("sb"))
        both = both.select("a", "b", F.expr("size(sa) + size(sb)").alias("n"), F.expr("size(array_intersect(sa, sb))").alias("common"))
        return both.where(f"common >= {threshold}D * (n - common)").select("a", "b")

    def sketches(ids: DataFrame) -> DataFrame:
        own = members.join(ids, "id").groupBy("id").agg(F.collect_list("bucket").alias("own"))
        return _sketches(texts.repartition("id").join(ids, "id")).join(own, "id")  # so that the groupings by id need no shuffle

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        words = [f"{{}}{i}" for i in ("n", *range(WORDS))]
        first = F.expr("array_min(array_intersect(xown, yown)) = bucket")  # a pair is made in one of its common buckets only
        left = _side(left, "x").select("bucket", "i", "j", F.col("id").alias("a"), F.col("component").alias("of"), F.col("own").alias("xown"), *(w.format("x") for w in words))
        right = _side(right, "y").select("bucket", "i", "j", F.col("id").alias("b"), "component", "outside", F.col("own").alias("yown"), *(w.format("y") for w in words))
        met = left.join(right, ["bucket", "i", "j"]).where(F.expr("of <> component and (a < b or not outside)") & _possible(threshold) & first)
        return met.select("a", "b", F.expr("-(bit_count(x0 ^ y0) + bit_count(x1 ^ y1) + bit_count(x2 ^ y2) + bit_count(x3 ^ y3))").alias("score"))

    return components(linked(members, heavy, verify, sketches, meet, turns=1))


def duplicate_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, key, n_lines, n_removed, removed_lines (numbers from 0, ascending)."""
    # most groups have few rows, so the small map before the large one only costs time
    with Scope(docs.sparkSession) as scope, setting(docs.sparkSession, "spark.sql.codegen.aggregate.map.twolevel.enabled", "false"):
        # the first line of a text is there even without a word, so that the texts needn't be read again to count their lines
        lines = keep(_lines(docs).withColumn("line", F.when(F.col("norm") != "", F.xxhash64("norm"))).where("line is not null or line_no = 0"), "lines")
        worded = lines.where("line is not null")
        signed = keep(_signatures(worded.select("line", "norm")), "signatures")
        same = line_components(worded.select("line", "norm"), signed, threshold)
        often = signed.where("n > 1").groupBy("line").agg(F.max("n").alias("n"))
        often = keep(often.join(same.withColumnRenamed("node", "line"), "line", "full").select("line", F.coalesce("component", "line").alias("component"), F.coalesce("n", F.lit(1)).alias("n")), "often")
        rows = in_set(worded.select("doc_id", "key", "line_no", "line"), "line", often, "line")
        placed = keep(attach(rows, often.select("line", "component"), "line", hot(often.select("line", "n"), "line")).drop("line"), "placed")
        place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "line_no")
        first = placed.groupBy("component").agg(F.min(place).alias("first")).select("first.doc_id", "first.key", "first.line_no")
        # lines, firsts and texts meet in one grouping by text, without a join; null ids are equal there
        none, number = F.lit(None).cast("int"), F.lit(None).cast("long")
        parts = lines.where("line_no = 0").select("doc_id", "key", "n_lines", none.alias("similar"), none.alias("first"))
        parts = parts.unionAll(placed.select("doc_id", "key", number, "line_no", none)).unionAll(first.select("doc_id", "key", number, none, "line_no"))
        whole = parts.groupBy("doc_id", "key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("similar").alias("similar"), F.collect_set("first").alias("first"))
        removed = F.sort_array(F.array_except("similar", "first"))
        found = whole.select("doc_id", "key", "n_lines", removed.alias("removed_lines")).select("doc_id", "key", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")
        return scope.result(found, "duplicate-lines")


def remove_lines(docs: DataFrame, found: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """docs without the lines that duplicate_lines found: doc_id, text, n_lines, n_removed and the columns asked for."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("_key"), text.alias("text"), *(F.col(c) for c in columns if c not in ("doc_id", "text")))
    marks = found.where("n_removed > 0").select(F.col("doc_id").alias("_id"), F.col("key").alias("_found"), "n_lines", "n_removed", "removed_lines").dropDuplicates(["_id", "_found"])
    joined = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_found")), "left")
    parts = F.split("text", "\n", -1)
    left = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains("removed_lines", i)), "\n")
    return joined.select(
        "doc_id",
        *(c for c in columns if c not in ("doc_id", "text")),
        F.when(F.col("removed_lines").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.coalesce("n_lines", F.size(parts).cast("long")).alias("n_lines"),
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
    )
