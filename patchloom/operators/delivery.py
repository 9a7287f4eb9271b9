"""Delivery: catch-up before live, anchored debouncing, bounded buffers, sessions, generations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .subs import counted


def catch_up_first(rows: DataFrame, viewer: Sequence[str], is_baseline: Column, order: Sequence[str]) -> DataFrame:
    """Adds ``position``: baselines come first, live updates follow in order."""
    w = Window.partitionBy(*viewer).orderBy((~is_baseline).cast("int"), *order)
    return rows.withColumn("position", F.row_number().over(w).cast("long"))


def catch_up(rows: DataFrame, viewer: Sequence[str], order: Sequence[str], kind: str = "kind", most: int = 1 << 10) -> DataFrame:
    """What viewers are sent, with ``position``, and ``overflow`` where a buffer is full; kind: subscribe, baseline, cancel or live.

    While a subscription waits for its baseline, live rows are held back, up to ``most`` of them.
    When none waits any more they follow that last baseline in order; if the last one waiting was
    cancelled instead, they are dropped. A row beyond the bound stays in the result with
    ``overflow``, and nothing of its viewer after it.
    """
    w = Window.partitionBy(*viewer).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.col(kind)
    delta = F.when(k == "subscribe", 1).when(k.isin("baseline", "cancel"), -1).otherwise(0)
    rows = counted(rows.withColumn("_delta", delta), viewer, order, "_delta").withColumnsRenamed({"count": "_waiting", "before": "_before"})
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_held", (k == "live") & (F.col("_waiting") > 0))
    rows = rows.withColumn("_wave", F.sum(((F.col("_before") == 0) & (F.col("_waiting") > 0)).cast("int")).over(upto))
    ends = (F.col("_before") > 0) & (F.col("_waiting") == 0)
    wave = Window.partitionBy(*viewer, "_wave")
    rows = rows.withColumn("_end", F.min(F.when(ends, F.struct(F.col("_n").alias("n"), k.alias("kind")))).over(wave))
    rows = rows.withColumn("_place", F.sum(F.col("_held").cast("int")).over(Window.partitionBy(*viewer, "_wave").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("overflow", F.col("_held") & (F.col("_place") > most))
    full = F.min(F.when(F.col("overflow"), F.col("_n"))).over(Window.partitionBy(*viewer))
    sent = F.when(F.col("_held"), F.col("overflow") | (F.col("_end.kind") == "baseline")).otherwise(k.isin("baseline", "live"))
    at = F.when(F.col("_held") & ~F.col("overflow"), F.col("_end.n")).otherwise(F.col("_n"))
    rows = rows.withColumn("_at", at).withColumn("_full", full)
    kept = rows.filter(F.coalesce(sent, F.lit(False)) & (F.col("_full").isNull() | (F.col("_at") <= F.col("_full"))))
    # A baseline that ends a wave stands before what it releases, whatever their order in time.
    place = Window.partitionBy(*viewer).orderBy("_at", "_held", "_n")
    return kept.withColumn("position", F.row_number().over(place).cast("long")).drop("_delta", "_waiting", "_before", "_n", "_held", "_wave", "_end", "_place", "_at", "_full")


def _anchors(at: str, length: int):
    """Adds the anchor to sorted rows, where ``_fresh`` marks the first one of each island."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = 0
        for batch in batches:
            column = batch.column(at)
            t = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            fresh = batch.column("_fresh").to_numpy(zero_copy_only=False).astype(bool)
            anchors = np.empty(len(t), np.int64)
            edges = np.unique(np.concatenate(([0], np.flatnonzero(fresh), [len(t)]))).tolist()
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                i = lo
                while i < hi:
                    if (i == lo and fresh[lo]) or t[i] >= anchor + length:
                        anchor = int(t[i])
                    end = i + max(1, int(np.searchsorted(t[i:hi], anchor + length)))
                    anchors[i:end], i = anchor, end
            kept = [c for c in batch.schema.names if c != "_fresh"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(anchors, mask=column.is_null().to_numpy(zero_copy_only=False))], [*kept, "anchor"])

    return task


def anchored_windows(rows: DataFrame, keys: Sequence[str], at: str, order: str, length: int) -> DataFrame:
    """Adds ``anchor``: the time of the first row of its window; a window lasts ``length`` and is not extended.

    ``at`` is a number (such as microseconds); a row without one has no anchor. A gap of ``length``
    or more always ends a window, so rows are dealt by the islands between such gaps and not by
    whole keys. A task reads its islands as a sorted stream and holds one anchor.
    """
    w = Window.partitionBy(*keys).orderBy(at, order)
    kind = StructType([*rows.schema.fields, StructField("anchor", LongType())])
    rows = rows.withColumn("_fresh", F.coalesce((F.col(at) - F.lag(at).over(w) >= length).cast("int"), F.lit(1)))
    rows = rows.withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    dealt = rows.repartition(*keys, "_island").sortWithinPartitions(*keys, "_island", at, F.desc("_fresh"))
    return dealt.drop("_island").mapInArrow(_anchors(at, length), kind)


def admitted(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, most_rows: int, most_bytes: int) -> DataFrame:
    """Adds ``admitted`` and ``overflow``: a buffer takes rows until one exceeds a bound, and none from there on."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = (F.count(F.lit(1)).over(w) > most_rows) | (F.sum(size).over(w) > most_bytes)
    rows = rows.withColumn("_over", over.cast("int"))
    return rows.withColumn("admitted", F.max("_over").over(w) == 0).withColumn("overflow", (F.sum("_over").over(w) == 1) & (F.col("_over") == 1)).drop("_over")


def since_full(rows: DataFrame, keys: Sequence[str], order: Sequence[str], is_full: Column) -> DataFrame:
    """Rows from the last full state of each key on; all rows where there is none."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.max(is_full.cast("int")).over(w), F.lit(0))
    return rows.withColumn("_later", later).filter("_later = 0").drop("_later")


def manifest_changes(current: DataFrame, desired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys with ``action``: start for those desired only, stop for those current only."""
    start = desired.select(*keys).distinct().join(current, list(keys), "left_anti").withColumn("action", F.lit("start"))
    stop = current.select(*keys).distinct().join(desired, list(keys), "left_anti").withColumn("action", F.lit("stop"))
    return start.union(stop)


def still_wanted(rows: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Buffered rows whose keys are in a manifest."""
    return rows.join(manifest.select(*keys).distinct(), list(keys), "left_semi")


def snapshot_modes(wanted: DataFrame, buildable: DataFrame, viewer: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """viewer, n_keys and mode: ``keyed`` if a snapshot can be built for every key a viewer wants, else the viewer gets all in ``full``."""
    rows = wanted.select(*viewer, *keys).distinct().join(buildable.select(*keys).distinct().withColumn("_known", F.lit(True)), list(keys), "left")
    return rows.groupBy(*viewer).agg(F.count(F.lit(1)).alias("n_keys"), F.when(F.count("_known") == F.count(F.lit(1)), "keyed").otherwise("full").alias("mode"))


def episodes(rows: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], timeout: int) -> DataFrame:
    """Adds ``episode``: a silence of ``timeout`` or more closes a session, and the next row opens another."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(w) >= timeout).cast("int"), F.lit(0))
    rows = rows.withColumn("_fresh", fresh)
    return rows.withColumn("episode", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("_fresh")


def session_lifecycle(rows: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], timeout: int, kind: str = "kind", generation: str = "generation") -> DataFrame:
    """keys, at, n (the attachment's number), change and reason: created, attached, detached and closed.

    Each attach starts the next generation. A detach counts if it names the generation it is in, the
    first time; stale ones are ignored. A session that stays detached for ``timeout`` is closed then,
    and the next attach creates another.
    """
    w = Window.partitionBy(*keys).orderBy(at, *order)
    upto, is_attach = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), F.col(kind) == "attach"
    rows = rows.withColumn("n", F.sum(is_attach.cast("long")).over(upto))
    rows = rows.filter(is_attach | ((F.col("n") > 0) & (F.col(generation) == F.col("n"))))
    of = Window.partitionBy(*keys, "n", is_attach).orderBy(at, *order)
    rows = rows.withColumn("_first", F.row_number().over(of)).filter(is_attach | (F.col("_first") == 1))
    before, after = F.lag(F.struct(kind, at)).over(w), F.lead(F.struct(kind, at)).over(w)
    rows = rows.withColumn("_before", before).withColumn("_after", after)
    gone = (F.col("_before")[kind] == "detach") & (F.col(at) - F.col("_before")[at] >= timeout)
    new = is_attach & (F.col("_before").isNull() | gone)
    expires = ~is_attach & (F.col("_after").isNull() | (F.col("_after")[at] - F.col(at) >= timeout))
    one = lambda t, change, reason: F.struct(t.alias("at"), F.lit(change).alias("change"), F.lit(reason).alias("reason"))
    now, then = F.col(at), F.col(at) + timeout
    out = F.array(
        F.when(new, one(now, "created", "")), F.when(is_attach, one(now, "attached", "")), F.when(~is_attach, one(now, "detached", "")), F.when(expires, one(then, "closed", "expired"))
    )
    return rows.select(*keys, "n", F.inline(F.filter(out, lambda x: x.isNotNull())))
