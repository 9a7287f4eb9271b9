"""Streaming twins of debouncing, sessions and subscription counts, with state that Spark keeps and restores.

Each has the rules of its batch form. Rows of one key are taken in order of time within a
micro-batch; a row that is older than what its key has already seen counts where it arrives.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType


def _key_fields(rows: DataFrame, keys: Sequence[str]) -> list[StructField]:
    return [rows.schema[k] for k in keys]


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def debounced(rows: DataFrame, keys: Sequence[str], at: str, length: int, late: str = "10 minutes") -> DataFrame:
    """keys, anchor (microseconds) and n of each window, once it is over.

    A window starts with the first row after the one before and lasts ``length`` microseconds,
    which later rows do not extend. It is over when a row at or after its end arrives, or when the
    watermark, ``late`` behind the newest row, passes its end. State is one anchor and one count.
    """
    out = StructType([*_key_fields(rows, keys), StructField("anchor", LongType()), StructField("n", LongType())])

    def frame(key: tuple, closed: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame([(*key, a, n) for a, n in closed], columns=out.names)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            closed = [state.get]
            state.remove()
            yield frame(key, closed)
            return
        times = sorted(t for b in batches for t in _micros(b[at]))
        anchor, n = state.get if state.exists else (times[0], 0)
        closed = []
        for t in times:
            if t >= anchor + length:
                closed.append((anchor, n))
                anchor, n = t, 0
            n += 1
        state.update((anchor, n))
        # A timeout must lie beyond the watermark; a window that is over by then ends at the next batch.
        state.setTimeoutTimestamp(max(-(-(anchor + length) // 1000), state.getCurrentWatermarkMs() + 1))
        yield frame(key, closed)

    timed = rows.select(*keys, F.col(at).cast(TimestampType()).alias(at)).withWatermark(at, late)
    return timed.groupBy(*keys).applyInPandasWithState(step, out, "anchor long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(rows: DataFrame, keys: Sequence[str], at: str, timeout: int, late: str = "10 minutes") -> DataFrame:
    """keys, opened, last and n of each session, once it is closed: a silence of ``timeout`` microseconds closes it."""
    timed = rows.select(*keys, F.col(at).cast(TimestampType()).alias(at)).withWatermark(at, late)
    gap = f"{timeout - 1} microseconds"  # rows exactly a gap apart would share a session, but the timeout has passed then
    found = timed.groupBy(*keys, F.session_window(at, gap).alias("s")).agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    return found.select(*keys, F.col("s.start").alias("opened"), "last", "n")


def edges(rows: DataFrame, keys: Sequence[str], order: str, delta: Column) -> DataFrame:
    """keys, order and edge of the rows that change whether a key is subscribed, or that could not be.

    ``delta`` is 1 for a subscription and -1 for an end of one. edge is on for 0 to 1, off for 1 to 0,
    and underflow for an end at 0, which changes nothing. State is one count for each key.
    """
    out = StructType([*_key_fields(rows, keys), StructField(order, LongType()), StructField("edge", StringType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        found = []
        for at, d in sorted((int(at), int(d)) for b in batches for at, d in zip(b[order], b["_delta"], strict=True)):
            edge = ("on" if d > 0 else "underflow") if count == 0 else "off" if count + d == 0 else None
            count = max(0, count + d)
            if edge:
                found.append((*key, at, edge))
        state.update((count,))
        yield pd.DataFrame(found, columns=out.names)

    some = rows.select(*keys, F.col(order).cast("long").alias(order), delta.cast("int").alias("_delta")).filter(F.col("_delta").isin(1, -1))
    return some.groupBy(*keys).applyInPandasWithState(step, out, "count long", "append", GroupStateTimeout.NoTimeout)
