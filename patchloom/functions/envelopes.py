"""Envelopes as bytes: a header of 60 bytes, then stream id, format and payload; and the identity rules of their streams.

The header, little-endian: magic (4 bytes, the caller's), payload type, flags, two reserved bytes,
generation, sequence, time in nanoseconds and frame id (8 bytes each), first index, item count and
total item count (4 each), lengths of stream id and format (2 each) and of the payload (4).
Numbers of 8 bytes are longs; unsigned ones from 2**63 on read as negative.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dataplane import HEADER_BYTES, MOST_NAME, MOST_PAYLOAD, envelope_error
from .codec import little, number
from .packets import apart

#: Numbers of the header by column, with their offset and size: fixed values.
NUMBERS = {
    "payload_type": (4, 1), "flags": (5, 1), "reserved": (6, 2), "generation": (8, 8), "sequence": (16, 8), "ts_nanos": (24, 8), "frame_id": (32, 8),
    "first_index": (40, 4), "item_count": (44, 4), "total_item_count": (48, 4), "stream_size": (52, 2), "format_size": (54, 2), "payload_size": (56, 4),
}
SMALL = ("payload_type", "flags")
#: The header is written and read in words of 8 bytes, each of one conversion.
WORDS = range(0, HEADER_BYTES, 8)
MAGIC_BYTES = 4


def _shift(at: int) -> int:
    return 8 * (at % 8)


def _low(value: Column, size: int) -> Column:
    return value if size == 8 else value.bitwiseAND(F.lit((1 << 8 * size) - 1))


def _word(numbers: dict[str, Column], at: int) -> Column:
    """The bytes of one word of the header, without the magic."""
    first = MAGIC_BYTES if at == 0 else 0
    inside = [F.shiftleft(_low(numbers[n].cast("long"), size), _shift(k - first)) for n, (k, size) in NUMBERS.items() if at <= k < at + 8]
    return little(reduce(Column.bitwiseOR, inside), min(8, HEADER_BYTES - at) - first)


def encode(magic: bytes) -> Column:
    """Bytes of an envelope row; null where the row breaks a rule."""
    made = {"reserved": F.lit(0), "stream_size": F.octet_length("stream_id"), "format_size": F.octet_length("format"), "payload_size": F.octet_length("payload")}
    numbers = {n: made[n] if n in made else F.col(n) for n in NUMBERS}
    head = (_word(numbers, at) for at in WORDS)
    raw = F.concat(apart(F.lit(magic)), *head, F.col("stream_id").cast("binary"), F.col("format").cast("binary"), F.col("payload"))
    return F.when(envelope_error().isNull(), raw)


def decoded(rows: DataFrame, raw: str, magic: bytes, most_payload: int = MOST_PAYLOAD) -> DataFrame:
    """Adds the columns of an envelope and ``error``, the first rule that its bytes or its fields break; with an error the fields are null."""
    r, size = F.col(raw), F.octet_length(raw)
    rows = rows.withColumns({f"_word{at}": number(r if at else apart(r), at, 8) for at in WORDS})
    of = lambda at, n: _low(F.shiftrightunsigned(f"_word{at - at % 8}", _shift(at)), n)
    head = F.struct(*(of(at, n).cast("int" if name in SMALL else "long").alias(name) for name, (at, n) in NUMBERS.items()))
    rows = rows.withColumn("_head", head).drop(*(f"_word{at}" for at in WORDS))
    h = F.col("_head")
    text = HEADER_BYTES + h["stream_size"] + h["format_size"]
    broken = (
        F.when(apart(size) < HEADER_BYTES, "truncated")
        .when(F.substring(r, 1, len(magic)) != F.lit(magic), "unknown format")
        .when(h["reserved"] != 0, "reserved bits")
        .when((h["stream_size"] > MOST_NAME) | (h["format_size"] > MOST_NAME), "name too long")
        .when(h["payload_size"] > most_payload, "payload too large")
        .when(size != text + h["payload_size"], "length differs")
    )
    part = lambda at, n: F.substring(r, (at + 1).cast("int"), n.cast("int"))
    rows = rows.withColumn("_broken", broken).select(
        "*", *(h[n].alias(n) for n in NUMBERS if not n.endswith("_size") and n != "reserved"),
        part(F.lit(HEADER_BYTES), h["stream_size"]).cast("string").alias("stream_id"),
        part(HEADER_BYTES + h["stream_size"], h["format_size"]).cast("string").alias("format"),
        part(text, h["payload_size"]).alias("payload"),
    )
    rows = rows.withColumn("error", F.coalesce(apart(F.col("_broken")), envelope_error(most_payload))).drop("_head", "_broken")
    fields = [n for n in NUMBERS if not n.endswith("_size") and n != "reserved"] + ["stream_id", "format", "payload"]
    return rows.withColumns({n: F.when(F.col("error").isNull(), F.col(n)) for n in fields})


def subscription_error(store: Column, stream: Column, key: Column) -> Column:
    """The first rule that the identity of a stream breaks; null if it is complete and within bounds."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return (
        F.when(blank(store), "no store name").when(blank(stream), "no stream name").when(blank(key), "no key")
        .when(F.octet_length(store) > 256, "store name too long").when(F.octet_length(stream) > 256, "stream name too long").when(F.octet_length(key) > 4096, "key too long")
    )


def expires_at(millis: Column) -> Column:
    """When an endpoint expires; null if it lasts as long as its subscription."""
    return F.timestamp_millis(F.nullif(millis, F.lit(0)))
