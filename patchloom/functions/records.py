"""Typed values and fielded records as column expressions, driven by Spark types.

A boolean is one byte; whole numbers are packed; floating point numbers are their bits, the lowest byte first; text has its packed length before it; a time is
its packed Unix milliseconds; bytes, arrays and maps have a byte that is 1 for null, then a packed
length and their entries (a map's by key, so that equal maps have equal bytes). A struct is a
fielded record: ``[number][packed length][value]`` for each field that is not zero, where a field's
number is its ``fID`` metadata. Readers skip numbers they do not know. An optional value
(``{"optional": true}`` in the metadata) has a null byte before it.

A zero is left out of a record, so it reads back as zero, or null where the type can be null:
false, 0 and empty text for plain fields, null for optional ones, bytes, arrays, maps and times.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import floats
from .codec import little, number, packed, packed_length, unpacked_number
from .packets import let

_NULL, _SOME = b"\x01", b"\x00"
#: Numbers are one byte and none is 0, so a record has 255 fields at most.
MOST_FIELDS = 255
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL = (T.FloatType, T.DoubleType)
#: The byte that stands for a type where a value describes itself; elements' types follow.
CODES = {T.BooleanType: 1, T.StringType: 2, T.ByteType: 3, T.ShortType: 4, T.IntegerType: 5, T.LongType: 6, T.FloatType: 11, T.DoubleType: 12, T.TimestampType: 13}
UNSIGNED_BYTE, ARRAY, MAP = 7, 15, 16


def _packed(value: Column) -> Column:
    """``packed``, with a short way for the numbers that take one byte."""
    return let(value.cast("long"), lambda v: F.when((v >= 0) & (v < 64), little(v, 1)).otherwise(packed(v)))


def _string(value: Column) -> Column:
    return let(value, lambda v: F.concat(_packed(F.octet_length(v)), v.cast("binary")))


def encode(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value; null plain values are written as zero."""
    if isinstance(kind, T.BooleanType):
        return little(F.coalesce(value, F.lit(False)).cast("int"), 1)
    if isinstance(kind, WHOLE):
        return _packed(F.coalesce(value, F.lit(0)))
    if isinstance(kind, REAL):
        layout = floats.layout_of(kind)
        return let(floats.bits(F.coalesce(value, F.lit(0.0)), layout), lambda b: little(b, layout.size))
    if isinstance(kind, T.StringType):
        return _string(F.coalesce(value, F.lit("")))
    if isinstance(kind, T.TimestampType):
        return _packed(F.unix_millis(value))
    if isinstance(kind, T.StructType):
        return record(value, kind)
    if isinstance(kind, T.BinaryType):
        body = F.concat(F.lit(_SOME), _packed(F.octet_length(value)), value)
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit(_SOME), _packed(F.size(value)), _joined(F.transform(value, lambda x: encode(x, kind.elementType))))
    elif isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        entry = lambda k: F.concat(encode(k, kind.keyType), encode(F.element_at(value, k), kind.valueType))
        body = F.concat(F.lit(_SOME), _packed(F.size(value)), _joined(F.transform(keys, entry)))
    else:
        raise TypeError(f"no encoding of {kind.simpleString()}")
    return F.when(value.isNull(), F.lit(_NULL)).otherwise(body)


def _joined(parts: Column) -> Column:
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def _optional(field: T.StructField) -> bool:
    return bool(field.metadata.get("optional"))


def _numbered(number: int) -> Callable[[Column], Column]:
    return lambda raw: F.concat(little(F.lit(number), 1), _packed(F.octet_length(raw)), raw)


def record(value: Column, kind: T.StructType) -> Column:
    """A fielded record of a struct."""
    out = []
    for f in kind:
        x = value[f.name]
        raw = encode(x, f.dataType)
        if _optional(f):
            raw = F.concat(F.lit(_SOME), raw)
        zero = x.isNull()
        if not _optional(f):
            zeros = {T.BooleanType: ~x, T.StringType: x == ""} if isinstance(f.dataType, (T.BooleanType, T.StringType)) else {}
            plain = (x == 0) if isinstance(f.dataType, WHOLE) else ((x == 0) & ~x.cast("string").startswith("-")) if isinstance(f.dataType, REAL) else F.lit(False)
            zero = zero | (zeros.get(type(f.dataType)) if zeros else plain)
        out.append(F.when(zero, F.lit(b"")).otherwise(let(raw, _numbered(int(f.metadata["fID"])))))
    return F.concat(*out) if out else F.lit(b"")


def _packed_at(raw: Column, at: Column) -> Column:
    """struct(at: after the number, or null if bytes are missing; value)."""
    left = F.octet_length(raw) - at

    def longer(low: Column) -> Column:
        return let(packed_length(low), lambda n: F.struct(F.when(left >= n, at + n).cast("int").alias("at"), unpacked_number(low, number(raw, at + 8, 1)).alias("value")))

    def short(b0: Column) -> Column:
        """Most numbers take one byte, which needs no more than that."""
        low = b0.bitwiseAND(F.lit(63))
        one = F.struct(F.when(left >= 1, at + 1).cast("int").alias("at"), F.when(b0 >= 64, -low).otherwise(low).alias("value"))
        return F.when(b0 < 128, one).otherwise(let(number(raw, at, 8), longer))

    return let(number(raw, at, 1), short)


def _bytes_at(raw: Column, at: Column) -> Column:
    """struct(at, value) of bytes after their packed length."""

    def rest(n: Column) -> Column:
        end = n["at"] + n["value"]
        return F.struct(F.when((n["value"] >= 0) & (end <= F.octet_length(raw)), end).cast("int").alias("at"), F.substring(raw, n["at"] + 1, n["value"].cast("int")).alias("value"))

    return let(_packed_at(raw, at), rest)


def fields_of(raw: Column) -> Column:
    """struct(at, found): the first MOST_FIELDS fields of a record as array of struct(id, value); at is null if bytes are missing."""
    state = "struct<at:int,found:array<struct<id:int,value:binary>>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<id:int,value:binary>>").alias("found")).cast(state)
    total = F.octet_length(raw)

    def step(acc: Column, _: Column) -> Column:
        def read(part: Column) -> Column:
            one = F.struct(number(F.substring(raw, acc["at"] + 1, F.lit(1)), 0, 1).cast("int").alias("id"), part["value"].alias("value"))
            return F.struct(part["at"].alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

        # Past the end, or once broken, nothing moves.
        return F.when(acc["at"].isNull() | (acc["at"] >= total), acc).otherwise(let(_bytes_at(raw, acc["at"] + 1), read))

    # A field takes two bytes at least.
    turns = F.least(F.lit(MOST_FIELDS), F.greatest(F.lit(1), F.ceil(total / 2).cast("int")))
    return F.aggregate(F.sequence(F.lit(1), turns), begin, step)


def decode_at(raw: Column, at: Column, kind: T.DataType) -> Column:
    """struct(at, value) of the value of a type that starts at ``at``."""
    out = f"struct<at:int,value:{kind.simpleString()}>"
    one = lambda end, value: F.struct(end.cast("int").alias("at"), value.alias("value")).cast(out)
    if isinstance(kind, T.BooleanType):
        byte = number(F.substring(raw, at + 1, F.lit(1)), 0, 1)
        return one(F.when((byte <= 1) & (at < F.octet_length(raw)), at + 1), byte == 1)
    if isinstance(kind, WHOLE):
        return let(_packed_at(raw, at), lambda n: one(n["at"], n["value"].try_cast(kind.simpleString())))
    if isinstance(kind, REAL):
        layout = floats.layout_of(kind)
        bits = number(F.substring(raw, at + 1, F.lit(layout.size)), 0, layout.size)
        return one(F.when(at + layout.size <= F.octet_length(raw), at + layout.size), floats.from_bits(bits, layout).cast(kind.simpleString()))
    if isinstance(kind, T.StructType):  # a record has no end of its own: it goes as far as its field does
        inner = decode(F.substring(raw, at + 1, F.octet_length(raw)), kind)
        return let(inner, lambda d: one(F.when(d["error"].isNull(), F.octet_length(raw)), d["value"]))
    if isinstance(kind, T.TimestampType):
        return let(_packed_at(raw, at), lambda n: one(n["at"], F.timestamp_millis(n["value"])))
    if isinstance(kind, T.StringType):
        return let(_bytes_at(raw, at), lambda b: one(b["at"], b["value"].cast("string")))
    if isinstance(kind, T.BinaryType):
        some = let(_bytes_at(raw, at + 1), lambda b: one(b["at"], b["value"]))
    elif isinstance(kind, T.ArrayType):
        some = let(_list_at(raw, at + 1, kind.elementType, 1), lambda x: one(x["at"], x["found"]))
    elif isinstance(kind, T.MapType):
        pair = T.StructType([T.StructField("k", kind.keyType), T.StructField("v", kind.valueType)])
        some = let(_list_at(raw, at + 1, pair, 2), lambda x: one(x["at"], F.when(x["at"].isNotNull(), F.map_from_entries(x["found"]))))
    else:
        raise TypeError(f"no encoding of {kind.simpleString()}")
    flag = number(F.substring(raw, at + 1, F.lit(1)), 0, 1)
    return F.when(at >= F.octet_length(raw), one(F.lit(None), F.lit(None))).when(flag == 1, one(at + 1, F.lit(None))).when(flag == 0, some).otherwise(one(F.lit(None), F.lit(None)))


def _list_at(raw: Column, at: Column, kind: T.DataType, least: int) -> Column:
    """struct(at, found) of entries after their packed number; each takes ``least`` bytes or more."""
    state = f"struct<at:int,found:array<{kind.simpleString()}>>"
    broken = F.lit(None).cast(state)

    if least == 1 and isinstance(kind, T.StructType):
        raise TypeError("records in lists have no end of their own")

    def entry(here: Column) -> Column:
        if least == 1:
            return decode_at(raw, here, kind)
        k, v = kind[0].dataType, kind[1].dataType
        both = lambda a: let(decode_at(raw, a["at"], v), lambda b: F.struct(b["at"].alias("at"), F.struct(a["value"].alias("k"), b["value"].alias("v")).alias("value")))
        return let(decode_at(raw, here, k), both)

    def step(acc: Column, _: Column) -> Column:
        grown = lambda e: F.struct(e["at"].alias("at"), F.concat(acc["found"], F.array(e["value"])).alias("found"))
        return F.when(acc["at"].isNull(), acc).otherwise(let(entry(acc["at"]), grown))

    def entries(n: Column) -> Column:
        begin = F.struct(n["at"].alias("at"), F.array().cast(f"array<{kind.simpleString()}>").alias("found")).cast(state)
        fits = (n["value"] >= 0) & (n["at"] + n["value"] * least <= F.octet_length(raw))
        turns = F.slice(F.sequence(F.lit(0), n["value"].cast("int")), F.lit(2), n["value"].cast("int"))
        return F.when(fits, F.aggregate(turns, begin, step)).otherwise(broken)

    return let(_packed_at(raw, at), entries)


def decode(raw: Column, kind: T.StructType) -> Column:
    """struct(value, error) of a record: fields by number, whatever their order; of a number that repeats the last one counts."""

    def field(found: Column, f: T.StructField) -> Column:
        part = F.try_element_at(F.filter(found, lambda x: x["id"] == int(f.metadata["fID"])), F.lit(-1))["value"]
        if not _optional(f):
            return let(part, lambda r: decode_at(r, F.lit(0), f.dataType))
        flagged = lambda r: F.when(F.hex(F.substring(r, 1, 1)) == "00", decode_at(r, F.lit(1), f.dataType))
        return let(part, flagged)

    def missing(f: T.StructField) -> Column:
        zero = None if _optional(f) else False if isinstance(f.dataType, T.BooleanType) else 0 if isinstance(f.dataType, (*WHOLE, *REAL)) else "" if isinstance(f.dataType, T.StringType) else None
        return F.lit(zero).cast(f.dataType)

    def values(read: Column, total: Column) -> Column:
        parts = F.struct(*(field(read["found"], f).alias(f.name) for f in kind))
        held = lambda f: F.exists(read["found"], lambda x: x["id"] == int(f.metadata["fID"]))

        def whole(p: Column) -> Column:
            error = F.when(read["at"].isNull(), F.lit("truncated")).when(read["at"] < total, F.lit("too many fields"))
            for f in kind:
                error = F.coalesce(error, F.when(held(f) & p[f.name]["at"].isNull(), F.lit(f"field {f.name}")))
            value = F.struct(*(F.when(held(f), p[f.name]["value"]).otherwise(missing(f)).alias(f.name) for f in kind))
            return let(error, lambda e: F.struct(F.when(e.isNull(), value).alias("value"), e.alias("error")))

        return let(parts, whole)

    return let(raw, lambda r: let(fields_of(r), lambda read: values(read, F.octet_length(r))))


def descriptor(kind: T.DataType) -> bytes:
    """The bytes that describe a type."""
    if isinstance(kind, T.BinaryType):
        return bytes([ARRAY, UNSIGNED_BYTE])
    if isinstance(kind, T.ArrayType):
        return bytes([ARRAY]) + descriptor(kind.elementType)
    if isinstance(kind, T.MapType):
        return bytes([MAP]) + descriptor(kind.keyType) + descriptor(kind.valueType)
    if type(kind) not in CODES:
        raise TypeError(f"no description of {kind.simpleString()}")
    return bytes([CODES[type(kind)]])


def dynamic(value: Column, kind: T.DataType) -> Column:
    """A value with its type before it; null has no type and stays null."""
    return F.when(value.isNotNull(), F.concat(F.lit(descriptor(kind)), encode(value, kind)))


def read_dynamic(raw: Column, kinds: Mapping[str, T.DataType]) -> Column:
    """struct of the kinds by name, all null but the one that the bytes describe, and error: another type, or bytes missing or left over."""
    heads = {name: descriptor(kind) for name, kind in kinds.items()}
    if len(set(heads.values())) < len(heads):
        raise ValueError("two kinds have one description")
    is_kind = {name: F.substring(raw, 1, len(h)) == F.lit(h) for name, h in heads.items()}
    read = F.struct(*(F.when(is_kind[n], decode_at(raw, F.lit(len(heads[n])), k)).alias(n) for n, k in kinds.items()))

    def whole(r: Column) -> Column:
        ends = F.coalesce(*(r[n]["at"] for n in kinds))
        known = F.greatest(*(c.cast("int") for c in is_kind.values()), F.lit(0)) == 1
        error = F.when(~known, "unknown type").when(ends.isNull(), "truncated").when(ends < F.octet_length(raw), "trailing bytes")
        return F.struct(*(F.when(error.isNull(), r[n]["value"]).alias(n) for n in kinds), error.alias("error"))

    return F.when(raw.isNotNull(), let(read, whole))
