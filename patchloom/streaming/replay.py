"""Replay of a growing change log as a stream.

State between batches is a table in the shared folder, in buckets of the entities' keys. A
micro-batch reads and writes only the buckets that it touches: it folds its rows with what they
held before and writes their next version, and an index, of a row for each bucket, tells where the
current version of each is. Replaying a batch after a failure starts from the index before it and
writes the same versions again. Versions that neither the new index nor the one before it names are
deleted, so the table holds two versions of a bucket at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import fold


class ReplaySink:
    """foreachBatch sink that keeps the current state of every entity under ``path``, in ``buckets`` parts."""

    def __init__(self, path: str, keys: Sequence[str], leaf: str = "leaf", seq: str = "seq", op: str = "op", buckets: int = 256) -> None:
        self.path, self.keys, self.leaf, self.seq, self.op, self.buckets = path, list(keys), leaf, seq, op, buckets

    def _version(self, batch: int) -> str:
        return f"{self.path}/v={batch}"

    def _index(self, spark: SparkSession, batch: int) -> dict[int, int]:
        """Version of each bucket after a batch; a row for each bucket at most."""
        if batch < 0:
            return {}
        return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{self.path}/index/v={batch}").collect()}

    def _read(self, like: DataFrame, versions: dict[int, int]) -> DataFrame | None:
        """The rows of those buckets, from the versions named."""
        paths = [f"{self._version(v)}/_bucket={b}" for b, v in sorted(versions.items())]
        return like.sparkSession.read.schema(like.schema).parquet(*paths) if paths else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in batch.select(bucket.alias("b")).distinct().collect()}  # as many as there are buckets, at most
        held = self._index(spark, batch_id - 1)
        before = self._read(batch, {b: v for b, v in held.items() if b in touched})
        log = batch if before is None else before.unionByName(batch)
        # Masks are kept too: a late leaf below a mask must stay hidden.
        merged = fold.merge(log, self.keys, self.leaf, self.seq, self.op)
        merged.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(self._version(batch_id))
        index = held | dict.fromkeys(touched, batch_id)
        spark.createDataFrame(sorted(index.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index/v={batch_id}")
        self._drop(spark, batch_id, {*index.items(), *held.items()})

    def _drop(self, spark: SparkSession, batch_id: int, kept: set[tuple[int, int]]) -> None:
        """Deletes what the last two indexes do not name, and older indexes."""
        older = self._index(spark, batch_id - 2) if batch_id > 1 and self._there(spark, f"{self.path}/index/v={batch_id - 2}") else {}
        for b, v in older.items():
            if (b, v) not in kept:
                self._delete(spark, f"{self._version(v)}/_bucket={b}")
        if older:
            self._delete(spark, f"{self.path}/index/v={batch_id - 2}")

    def _fs(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def _there(self, spark: SparkSession, path: str) -> bool:
        fs, p = self._fs(spark, path)
        return fs.exists(p)

    def _delete(self, spark: SparkSession, path: str) -> None:
        fs, p = self._fs(spark, path)
        fs.delete(p, True)

    def state(self, like: DataFrame, batch: int) -> DataFrame:
        """The state after a batch: the last one, or the one before it."""
        log = self._read(like, self._index(like.sparkSession, batch))
        return fold.current_state(like.limit(0) if log is None else log, self.keys, self.leaf, self.seq, self.op)


def replay_stream(log: DataFrame, sink: ReplaySink, checkpoint: str) -> StreamingQuery:
    """Runs over what a streaming change log has now, then stops."""
    return log.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, keys: Sequence[str], every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by time window and keys; rows later than ``late`` after the newest are dropped, as the watermark says."""
    return events.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *keys, "n")
