"""Ingest of archives as they land: every micro-batch of archives is read, filtered, extracted and cut."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpusloom.operators.skip import MAX_ARCHIVE_SIZE
from corpusloom.plans.jobs import Ingested, ingest
from corpusloom.sources.archives import unpack
from corpusloom.streaming.events import start

LISTING = "path string, modificationTime timestamp, length long, content binary"


def landed_archives(spark: SparkSession, path: str, files_per_trigger: int = 64, max_size: int = MAX_ARCHIVE_SIZE) -> DataFrame:
    """(archive, path, size, content) of the zip files that arrive at path; a batch holds a bounded number of them."""
    files = spark.readStream.format("binaryFile").schema(LISTING).option("pathGlobFilter", "*.zip").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return unpack(files.where(F.col("length") <= max_size))


def ingest_stream(files: DataFrame, write: Callable[[Ingested, int], None], checkpoint: str, until_empty: bool = False) -> StreamingQuery:
    """Give every batch's tables to write; a batch that fails is read again from the checkpoint."""
    return start(files, lambda batch, number: write(ingest(batch), number), checkpoint, until_empty=until_empty)
