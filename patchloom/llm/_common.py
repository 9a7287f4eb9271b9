"""Reading tables, shared work folders and small expressions used by the operators."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no spark.checkpoint.dir and runs on this machine alone, as in tests.
LOCAL_DIR = "file:/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; sets a checkpoint folder if there is none and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = LOCAL_DIR
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Workspace:
    """Intermediate Parquet tables in the shared folder, deleted with ``drop`` or when the driver ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/patchloom-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(conf).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(id_name: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_name).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def text_volume(docs: DataFrame) -> tuple[int, int]:
    """Rows and UTF-8 bytes of ``text``."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def other_columns(docs: DataFrame) -> Column:
    """All columns but text as one struct, so that their names cannot clash with an operator's."""
    names = [c for c in docs.columns if c != "text"]
    return F.struct(*(docs[f"`{c}`"] for c in names), F.lit(0).alias("_")).alias("row")


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in order, from text and the struct ``row``."""
    return rows.select(*((F.col("text").cast(docs.schema["text"].dataType) if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a task holds the Python objects of few rows at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
