"""The wire codec as column expressions: packed integers, strings, fielded records, call packets.

A packed integer has a first byte of continuation bit, sign bit and 6 bits, then 7 bits, 15 bits,
31 bits and 4 bits of magnitude, each with a continuation bit before it as long as more follows:
1, 2, 4, 8 or 9 bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


_EVERY = bytes(range(256))
#: The low half of each byte.
_HALVES = 0x0F0F0F0F0F0F0F0F


def _turned(v: Column) -> Column:
    """The halves of each byte exchanged, so that hexadecimal digits read backwards are the bytes backwards."""
    return F.shiftleft(v.bitwiseAND(F.lit(_HALVES)), 4).bitwiseOR(F.shiftrightunsigned(v, 4).bitwiseAND(F.lit(_HALVES)))


def little(value: Column, size: int) -> Column:
    """The low bytes of a number, the lowest first."""
    v = value.cast("long")
    if size == 1:
        return F.substring(F.lit(_EVERY), v.bitwiseAND(F.lit(255)).cast("int") + 1, F.lit(1))
    low = v if size == 8 else v.bitwiseAND(F.lit((1 << 8 * size) - 1))
    return F.unhex(F.reverse(F.lpad(F.hex(_turned(low)), 2 * size, "0")))


def packed_size(value: Column) -> Column:
    """Bytes of a packed integer; 9 for what is beyond a long."""
    v = value.try_cast("long")
    within = lambda bits: (v > -(1 << bits)) & (v < 1 << bits)
    return F.when(within(6), 1).when(within(13), 2).when(within(28), 4).when(within(59), 8).otherwise(9)


def packed(value: Column) -> Column:
    """A long as a packed integer. The smallest long, whose magnitude is no long, is null."""
    v = value.cast("long")
    m = F.when(v != F.lit(-(1 << 63)), F.abs(v))
    # Each part with its continuation bit set, and the last one without.
    head = m.bitwiseAND(F.lit(63)) + F.when(v < 0, 64).otherwise(0)
    part = lambda shift, bits: F.shiftright(m, shift).bitwiseAND(F.lit((1 << bits) - 1)) + (1 << bits)
    two = head + 128
    four = two + F.shiftleft(part(6, 7), 8)
    eight = four + F.shiftleft(part(13, 15), 16)
    return (
        F.when(m < 1 << 6, little(head, 1))
        .when(m < 1 << 13, little(two + F.shiftleft(F.shiftright(m, 6), 8), 2))
        .when(m < 1 << 28, little(four + F.shiftleft(F.shiftright(m, 13), 16), 4))
        .when(m < 1 << 59, little(eight + F.shiftleft(F.shiftright(m, 28), 32), 8))
        .otherwise(F.concat(little(eight.bitwiseOR(F.shiftleft(part(28, 31), 32)), 8), little(F.shiftright(m, 59), 1)))
    )


def number(raw: Column, at: Column | int, size: int) -> Column:
    """A little-endian unsigned number; bytes that are missing count as 0."""
    digits = F.reverse(F.hex(F.substring(raw, F.lit(at) + 1, F.lit(size))))
    return _turned(F.conv(F.concat(F.lit("0"), digits), 16, -10).cast("long"))


def packed_length(low: Column) -> Column:
    """How many bytes a packed integer takes, from its low 8 bytes as a number."""
    on = lambda bit: low.bitwiseAND(F.lit(1 << bit)) == 0
    return F.when(on(7), 1).when(on(15), 2).when(on(31), 4).when(low >= 0, 8).otherwise(9)


def unpacked_number(low: Column, last: Column) -> Column:
    """The long that a packed integer holds, from its low 8 bytes as a number and the ninth."""
    part = lambda shift, bits, to: F.shiftleft(F.shiftrightunsigned(low, shift).bitwiseAND(F.lit((1 << bits) - 1)), to)
    size = packed_length(low)
    two, four, eight = part(0, 6, 0) + part(8, 7, 6), part(16, 15, 13), part(32, 31, 28)
    m = F.when(size == 1, part(0, 6, 0)).when(size == 2, two).when(size == 4, two + four).when(size == 8, two + four + eight).otherwise(two + four + eight + F.shiftleft(last, 59))
    return F.when(low.bitwiseAND(F.lit(64)) != 0, -m).otherwise(m)


def unpacked(raw: Column) -> Column:
    """The long that a packed integer holds."""
    return unpacked_number(number(raw, 0, 8), number(raw, 8, 1))


def string(value: Column) -> Column:
    """Length in bytes, packed, and the UTF-8 bytes."""
    return F.concat(packed(F.octet_length(value)), value.cast("binary"))


def fielded(fields: Sequence[tuple[int, Column, Column]]) -> Column:
    """``[id][length][bytes]`` of each field that is not zero: (id, encoded value, whether it is zero)."""
    return F.concat(*(F.when(~zero, F.concat(little(F.lit(i), 1), packed(F.octet_length(raw)), raw)).otherwise(F.lit(b"")) for i, raw, zero in fields))


def call_packet(call_id: Column, name: Column, access: Column, payload: Column) -> Column:
    """A call to a device: kind 5, id, name after its length, access level, payload after its length."""
    return F.concat(
        little(F.lit(5), 1), little(call_id, 4), little(F.octet_length(name), 2), name.cast("binary"), little(access, 1), little(F.octet_length(payload), 4), payload
    )


def call_fields(raw: Column) -> Column:
    """kind, call_id, name, access, payload and error of a call packet."""
    name_size = number(raw, 5, 2).cast("int")
    rest = F.substring(raw, F.lit(8) + name_size, F.octet_length(raw))
    size = number(rest, 1, 4)
    error = F.when(number(raw, 0, 1) == 0, "kind zero").when(number(raw, 0, 1) != 5, "not a call").when(F.octet_length(rest) != size + 5, "length differs")
    return F.struct(
        number(raw, 0, 1).alias("kind"),
        number(raw, 1, 4).alias("call_id"),
        F.substring(raw, F.lit(8), name_size).cast("string").alias("name"),
        number(rest, 0, 1).alias("access"),
        F.substring(rest, F.lit(6), F.octet_length(rest)).alias("payload"),
        error.alias("error"),
    )
