"""Calls: correlation with responses, dispatch status, calls in flight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Most handlers that are broadcast to calls.
MOST_HANDLERS = 100_000


def answered(calls: DataFrame, responses: DataFrame, on: Sequence[str], timeout: int) -> DataFrame:
    """Each call with its first response of the same keys within ``timeout``; calls: call_id, at; responses: response_id, at.

    One window over calls and responses, latest first, carries the nearest response to each call, so
    that a key of many calls and responses makes no pairs. A response at a call's own time counts.
    """
    answer = F.struct(F.col("at").alias("answered_at"), F.col("response_id"))
    c = calls.select(*on, F.col("at").alias("_at"), F.lit(1).alias("_side"), F.struct(*calls.columns).alias("_call"), F.lit(None).cast(responses.select(answer).schema[0].dataType).alias("_r"))
    r = responses.select(*on, F.col("at").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(c.schema["_call"].dataType).alias("_call"), answer.alias("_r"))
    later = Window.partitionBy(*on).orderBy(F.desc("_at"), "_side", F.desc("_r.response_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = c.union(r).withColumn("_next", F.last("_r", ignorenulls=True).over(later)).filter("_side = 1")
    found = F.when(F.col("_next.answered_at") <= F.col("_at") + timeout, F.col("_next"))
    out = near.select("_call.*", found.alias("_found")).select(*calls.columns, "_found.answered_at", "_found.response_id")
    return out.withColumn("status", F.when(F.col("response_id").isNull(), "timeout").otherwise("answered"))


def dispatch(calls: DataFrame, handlers: DataFrame, most: int = MOST_HANDLERS) -> DataFrame:
    """Adds ``handled`` and ``error``; calls: name, access; handlers: name, min_access, broadcast if they are no more than ``most``."""
    h = handlers.select("name", F.coalesce("min_access", F.lit(0)).alias("_least"), F.lit(True).alias("_known"))
    if h.limit(most + 1).count() <= most:
        h = F.broadcast(h)
    out = calls.join(h, "name", "left").withColumn("handled", F.col("_known").isNotNull())
    return out.withColumn("error", F.when(F.col("handled") & (F.col("access") < F.col("_least")), "insufficient access")).drop("_least", "_known")


def in_flight(intervals: DataFrame, keys: Sequence[str], begin: str, end: str) -> DataFrame:
    """keys with ``peak``: the most intervals open at once; one that ends when another begins is closed by then."""
    delta: Column = F.explode(F.array(F.struct(F.col(begin).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e")
    steps = intervals.select(*keys, delta).select(*keys, "e.*").groupBy(*keys, "at").agg(F.sum("d").alias("net"), F.sum(F.when(F.col("d") < 0, F.col("d")).otherwise(0)).alias("ends"))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("n", F.sum("net").over(w)).groupBy(*keys).agg(F.max("n").cast("long").alias("peak"))
