"""Tables in and out: Parquet by name, change logs as streams, packet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows that one task sorts or computes, so that its memory and time do not grow with a table.
TASK_ROWS = 150_000


def parts_of(rows: DataFrame, each: int = TASK_ROWS) -> int:
    """How many partitions hold the rows of a table, ``each`` at most on average; one for each core at least. Parquet counts rows by its footers."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, and over as many tasks as their number takes, where the source has fewer splits; for plans that compute much for each row."""
    parts = parts_of(rows)
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts)


def read_log_stream(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 64) -> DataFrame:
    """New files of a change log as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def read_packets(spark: SparkSession, folder: str) -> DataFrame:
    """One packet a file: path and content."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def full_states(log: DataFrame, op: str = "op") -> DataFrame:
    """Only full-state replacements of a change log."""
    return log.filter(log[op] == "full")
