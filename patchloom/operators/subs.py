"""Subscriptions: clamped reference counts, their edges, activity as of an event, access and routing.

A count starts at zero, goes up with a start and down with a stop, and a stop at zero changes
nothing. Clamping needs no fold: with s the running sum, the count is s - min(0, running min of s).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def counted(events: DataFrame, keys: Sequence[str], order: Sequence[str], delta: str = "delta") -> DataFrame:
    """Adds ``count`` after each row and ``before`` it; delta is 1, -1 or 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = events.withColumn("_s", F.sum(delta).over(w)).withColumn("_low", F.least(F.lit(0), F.min("_s").over(w)))
    count = (F.col("_s") - F.col("_low")).cast("long")
    s = s.withColumn("count", count)
    return s.withColumn("before", F.coalesce(F.lag("count").over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0)).cast("long")).drop("_s", "_low")


def edges(events: DataFrame, keys: Sequence[str], order: Sequence[str], delta: str = "delta") -> DataFrame:
    """Rows at which a count leaves or reaches zero, with ``edge``: on or off."""
    c = counted(events, keys, order, delta)
    edge = F.when((F.col("before") == 0) & (F.col("count") == 1), "on").when((F.col("before") == 1) & (F.col("count") == 0), "off")
    return c.withColumn("edge", edge).filter("edge IS NOT NULL")


def underflows(events: DataFrame, keys: Sequence[str], order: Sequence[str], delta: str = "delta") -> DataFrame:
    """Stops at zero."""
    return counted(events, keys, order, delta).filter((F.col(delta) < 0) & (F.col("before") == 0))


def active(events: DataFrame, keys: Sequence[str], order: Sequence[str], delta: str = "delta") -> DataFrame:
    """Keys whose count is above zero in the end."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    c = counted(events, keys, order, delta).withColumn("_n", F.row_number().over(last))
    return c.filter((F.col("_n") == 1) & (F.col("count") > 0)).select(*keys, "count")


def delivered(events: DataFrame, keys: Sequence[str], order: Sequence[str], fired: Column, delta: str = "delta") -> DataFrame:
    """Fired rows that find a listener, as of their place in the order."""
    return counted(events, keys, order, delta).filter(fired & (F.col("count") > 0))


def with_access(rows: DataFrame, stores: DataFrame, level: str, on: Sequence[str]) -> DataFrame:
    """Adds ``allowed`` and ``error``; stores: on and min_access, where null is public. Unknown stores are errors too."""
    joined = rows.join(stores.withColumn("_known", F.lit(True)), list(on), "left")
    enough = F.col(level) >= F.coalesce("min_access", F.lit(0))
    error = F.when(F.col("_known").isNull(), "unknown store").when(~enough, "insufficient access")
    return joined.withColumn("error", error).withColumn("allowed", error.isNull()).drop("_known")


#: Topologies of a store in wire order: fixed values.
STORE_TYPES = (
    "DeviceWithRelay", "DeviceWithNoRelay", "DeviceWithCloudImpl", "CloudOnly",
    "CloudImplOfDevice", "DeviceAndCloud", "DeviceWithCloudSource", "CloudSourceForDevice",
)


def routing(spark: SparkSession) -> DataFrame:
    """store_type with the four routing predicates; eight rows."""
    rows = [(t, t in ("DeviceWithRelay", "DeviceWithCloudImpl"), t == "DeviceWithCloudSource", t == "CloudImplOfDevice", t == "CloudSourceForDevice") for t in STORE_TYPES]
    return spark.createDataFrame(rows, "store_type string, streams_to_relay boolean, receives_from_relay boolean, accepts_device_updates boolean, streams_from_relay boolean")


def policy_allows(rows: DataFrame, include: DataFrame, exclude: DataFrame, on: str) -> DataFrame:
    """Rows of an included store, if any is named, and of no excluded one."""
    named = include.select(on).distinct()
    if named.isEmpty():
        kept = rows
    else:
        kept = rows.join(named, on, "left_semi")
    return kept.join(exclude.select(on).distinct(), on, "left_anti")
