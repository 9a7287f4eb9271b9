"""State packets applied to the stores that a registry knows: bytes in, rows of a nested log or errors out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import packets as wire
from ..functions import patches as build

FULL_STATE, PARTIAL_STATE = 2, 3


def received(packets: DataFrame, raw: str, stores: DataFrame) -> DataFrame:
    """Adds kind, store, payload and ``error``: what the bytes break, a packet that carries no state, or a store that is not registered."""
    rows = packets.withColumn("_p", wire.decode(F.col(raw)))
    rows = rows.select(*packets.columns, F.col("_p.kind").cast("int").alias("kind"), F.col("_p.store").alias("store"), F.col("_p.payload").alias("payload"), F.col("_p.error").alias("_error"))
    known = stores.select("store").distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "store", "left")
    error = F.coalesce("_error", F.when(~F.col("kind").isin(FULL_STATE, PARTIAL_STATE), "no state packet").when(F.col("_known").isNull(), "unknown store"))
    return rows.withColumn("error", error).drop("_error", "_known")


def state_log(rows: DataFrame, seq: str, patch_of: Callable[[Column], Column]) -> DataFrame:
    """store, seq, op, path, value of what ``received`` took; patch_of: the patch (see functions.patches) that a payload holds.

    A full state is a patch that replaces all.
    """
    patch = patch_of(F.col("payload"))
    full = F.concat(build.clear(build.path()), F.filter(patch, lambda r: r["op"] == "leaf"))
    good = rows.filter("error IS NULL")
    return good.select("store", seq, F.inline(F.when(F.col("kind") == FULL_STATE, full).otherwise(patch)))
