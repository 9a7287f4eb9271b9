"""The data plane: envelope rules and sizes, stream ids, block-set completeness, recovery gates, fair scheduling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME, BLOCK_SET = 1, 2
RECOVERY, DISCONTINUITY, COMMIT = 1, 2, 4
HEADER_BYTES, MOST_NAME, MOST_PAYLOAD = 60, 4096, 32 << 20


def has(flag: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(flag)) != 0


def envelope_error(most_payload: int = MOST_PAYLOAD) -> Column:
    """The first rule that an envelope row breaks; null if it is valid."""
    first, count, total = F.col("first_index"), F.col("item_count"), F.col("total_item_count")
    payload = F.octet_length("payload")
    frame, blocks, commit = F.col("payload_type") == FRAME, F.col("payload_type") == BLOCK_SET, has(COMMIT)
    rules = [
        (F.trim("stream_id") == "", "no stream id"),
        (F.octet_length("stream_id") > MOST_NAME, "stream id too long"),
        (F.col("generation") == 0, "generation zero"),
        (F.col("sequence") == 0, "sequence zero"),
        (F.col("frame_id") == 0, "frame id zero"),
        (F.trim("format") == "", "no format"),
        (F.octet_length("format") > MOST_NAME, "format too long"),
        (payload > most_payload, "payload too large"),
        (F.col("flags").bitwiseAND(F.lit(~(RECOVERY | DISCONTINUITY | COMMIT) & 0xFF)) != 0, "unknown flags"),
        (frame & commit, "frame commits"),
        (frame & ((first != 0) | (count != 0) | (total != 0)), "frame has a range"),
        (frame & (payload == 0), "frame empty"),
        (blocks & has(RECOVERY), "block set recovers"),
        (blocks & (total == 0), "no total"),
        (blocks & commit & ((first != 0) | (count != 0) | (payload != 0)), "commit has a range or payload"),
        (blocks & ~commit & (count == 0), "block without items"),
        (blocks & ~commit & (first + count > total), "range beyond total"),
        (blocks & ~commit & (payload == 0), "block empty"),
        (~frame & ~blocks, "unknown payload type"),
    ]
    error = F.lit(None).cast("string")
    for broken, what in reversed(rules):
        error = F.when(broken, what).otherwise(error)
    return error


def encoded_size() -> Column:
    return F.lit(HEADER_BYTES) + F.octet_length("stream_id") + F.octet_length("format") + F.octet_length("payload")


def stream_id(prefix: str, *parts: Column) -> Column:
    """A prefix and the SHA-256 of the parts, each after its length in bytes."""
    return F.concat(F.lit(prefix), F.sha2(F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts)), 256))


def complete_sets(blocks: DataFrame, keys: Sequence[str], first: str = "first_index", count: str = "item_count", total: str = "total_item_count") -> DataFrame:
    """keys with ``covered``, ``total`` and ``complete``: whether blocks, in whatever order and overlap, cover every item."""
    w = Window.partitionBy(*keys).orderBy(first, count)
    end = F.col(first) + F.col(count)
    reach = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    added = F.greatest(F.lit(0), end - F.greatest(F.col(first), reach))
    return blocks.withColumn("_added", added).groupBy(*keys).agg(
        F.sum("_added").cast("long").alias("covered"), F.max(total).cast("long").alias("total"), (F.sum("_added") == F.max(total)).alias("complete")
    )


def gated(frames: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, recovers: Column) -> DataFrame:
    """Adds ``accepted``: after a row that failed (for lack of room) a stream takes nothing until a row that recovers it.

    A row that would recover but fails itself is refused too, and another one is asked for. Where
    a discontinuity must be marked, it is part of ``recovers``.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    n = frames.withColumn("_n", F.row_number().over(w))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lost = F.coalesce(F.max(F.when(failed, F.col("_n"))).over(before), F.lit(0))
    found = F.coalesce(F.max(F.when(recovers & ~failed, F.col("_n"))).over(before), F.lit(0))
    return n.withColumn("accepted", ~failed & (recovers | (lost <= found))).drop("_n")


def published_sets(
    envelopes: DataFrame, stream: Sequence[str], generation: str = "generation", sequence: str = "sequence", frame: str = "frame_id", first: str = "first_index", count: str = "item_count", total: str = "total_item_count"
) -> DataFrame:
    """stream, generation, epoch, frame with ``sequence`` of the first commit, covered, total and published, for each committed frame.

    Blocks are provisional until a commit finds all items there. A new generation, and a row flagged
    as a discontinuity, discard what came before in their stream: rows of an older generation than
    one seen before are stale, and blocks before a discontinuity do not count after it.
    """
    w = Window.partitionBy(*stream).orderBy(sequence).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = envelopes.withColumn("_newest", F.max(generation).over(w)).filter(F.col(generation) == F.col("_newest")).drop("_newest")
    of = Window.partitionBy(*stream, generation).orderBy(sequence).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = fresh.withColumn("epoch", F.sum(has(DISCONTINUITY).cast("long")).over(of))
    keys = [*stream, generation, "epoch", frame]
    commits = rows.filter((F.col("payload_type") == BLOCK_SET) & has(COMMIT)).groupBy(*keys).agg(F.min_by(F.struct(sequence, total), sequence).alias("_c"))
    commits = commits.select(*keys, F.col("_c")[sequence].alias("_at"), F.col("_c")[total].alias("_total"))
    blocks = rows.filter((F.col("payload_type") == BLOCK_SET) & ~has(COMMIT)).join(commits, keys).filter(F.col(sequence) < F.col("_at"))
    done = complete_sets(blocks, keys, first, count, "_total").select(*keys, "covered")
    out = commits.join(done, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))
    return out.select(*keys, F.col("_at").alias(sequence), "covered", F.col("_total").cast("long").alias("total"), (F.col("covered") == F.col("_total")).alias("published"))


def drain_order(queues: DataFrame, uplink: Sequence[str], stream: str = "stream", unit: str = "unit", size: str = "size", weight: str = "weight", quantum: int = 16 << 10) -> DataFrame:
    """Adds ``turn``: the place of each queued unit when its uplink is drained by deficit round-robin.

    A visit adds quantum * weight to a stream's deficit and sends its first unit if it fits, so unit
    k of a stream goes at visit max over j <= k of ceil(sum of sizes to j / (quantum * weight)) + k - j:
    a running maximum, not a simulation. Visits of one round go in the order of streams.
    """
    w = Window.partitionBy(*uplink, stream).orderBy(unit).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k = F.count(F.lit(1)).over(w)
    need = F.ceil(F.sum(size).over(w) / (F.greatest(F.col(weight), F.lit(1)) * quantum))
    rows = queues.withColumn("_k", k).withColumn("_need", need - F.col("_k"))
    rows = rows.withColumn("visit", (F.col("_k") + F.max("_need").over(w)).cast("long"))
    order = Window.partitionBy(*uplink).orderBy("visit", stream, unit)
    return rows.withColumn("turn", F.row_number().over(order).cast("long")).drop("_k", "_need")
