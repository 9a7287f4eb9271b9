"""All packet kinds and the device greeting as column expressions, from one table of layouts.

A packet is its kind and then the fields of its layout, one after another: ``u8`` and ``u32`` are
little-endian numbers, ``text`` has its length in bytes before it as two bytes, ``bytes`` as four,
and a ``map`` its number of entries as two bytes, then keys and values as text, keys in order.
Reading is one fold over the fields of the kind, with a cursor and the fields found so far.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import little, number

#: The fields of each kind, in order. ``map?`` is written only if it has entries.
LAYOUTS: dict[int, tuple[tuple[str, str], ...]] = {
    1: (("version", "u32"), ("metadata", "map")),
    2: (("store", "text"), ("payload", "bytes")),
    3: (("store", "text"), ("payload", "bytes")),
    4: (("name", "text"), ("payload", "bytes")),
    5: (("id", "u32"), ("name", "text"), ("access", "u8"), ("payload", "bytes"), ("metadata", "map?")),
    6: (("id", "u32"), ("payload", "bytes")),
    7: (("store", "text"), ("key", "text"), ("action", "u8")),
    8: (("store", "text"), ("name", "text"), ("key", "text"), ("payload", "bytes")),
    9: (("store", "text"), ("name", "text"), ("key", "text"), ("action", "u8")),
    10: (("name", "text"), ("access", "u8"), ("payload", "bytes")),
    11: (("store", "text"), ("name", "text"), ("key", "text"), ("action", "u8")),
    12: (("id", "u32"), ("message", "text")),
    13: (("id", "u32"), ("store", "text"), ("name", "text"), ("key", "text"), ("access", "u8"), ("action", "u8")),
    14: (("id", "u32"), ("name", "text"), ("payload", "bytes")),
    15: (("id", "u32"), ("payload", "bytes"), ("message", "text")),
    255: (("name", "text"), ("payload", "bytes")),
}
#: Kinds that applications may use for packets of their own, whose fields are not known.
FIRST_OWN, LAST_OWN = 128, 254
#: Kinds whose id may not be zero, and the kind whose name may not be empty.
NEEDS_ID, NEEDS_NAME = (12, 13), 255
#: Actions are 0, subscribe, and 1, unsubscribe.
ACTIONS = (0, 1)
GREETING = (("version", "u32"), ("device", "text"), ("auth_type", "text"), ("auth_data", "bytes"), ("metadata", "map"))

NUMBERS, TEXTS, BYTES = ("version", "id", "access", "action"), ("store", "name", "key", "message", "device", "auth_type"), ("payload", "auth_data")
_WIDTH = {"u8": 1, "u32": 4, "text": 2, "bytes": 4, "map": 2, "map?": 2}
_PART = "struct<field:string,value:binary>"


def _text(value: Column) -> Column:
    """A text after its length; null if it is too long."""
    size = F.octet_length(value)
    return F.when(size < 1 << 16, F.concat(little(size, 2), value.cast("binary")))


def _map(value: Column) -> Column:
    """Entries by key in byte order; null if there are too many or one is too long."""
    keys = F.transform(F.array_sort(F.transform(F.map_keys(value), lambda k: F.struct(F.hex(k.cast("binary")).alias("h"), k.alias("k")))), lambda s: s["k"])
    raw = F.transform(keys, lambda k: F.concat(_text(k), _text(F.coalesce(F.element_at(value, k), F.lit("")))))
    whole = F.aggregate(raw, F.lit(b""), lambda a, b: F.concat(a, b))
    return F.when(F.size(value) < 1 << 16, F.concat(little(F.size(value), 2), whole))


def _written(layout: tuple[tuple[str, str], ...], fields: Mapping[str, Column]) -> list[Column]:
    out = []
    for name, kind in layout:
        x = fields[name] if name in fields else None
        if kind in ("u8", "u32"):
            v = F.lit(0) if x is None else F.coalesce(x.cast("long"), F.lit(0))
            out.append(F.when((v >= 0) & (v < 1 << 8 * _WIDTH[kind]), little(v, _WIDTH[kind])))
        elif kind == "text":
            out.append(_text(F.lit("") if x is None else F.coalesce(x, F.lit(""))))
        elif kind == "bytes":
            v = F.lit(b"") if x is None else F.coalesce(x.cast("binary"), F.lit(b""))
            out.append(F.concat(little(F.octet_length(v), 4), v))
        elif x is None:
            out.append(F.lit(b"") if kind == "map?" else little(F.lit(0), 2))
        else:
            none = F.lit(b"") if kind == "map?" else little(F.lit(0), 2)
            out.append(F.when(x.isNull() | (F.size(x) == 0), none).otherwise(_map(x)))
    return out


def encode(kind: int, fields: Mapping[str, Column]) -> Column:
    """A packet of one kind; fields left out or null are zero or empty. Null where a rule of the kind is broken."""
    if FIRST_OWN <= kind <= LAST_OWN:
        return F.concat(little(F.lit(kind), 1), F.coalesce(fields["payload"].cast("binary"), F.lit(b"")))
    layout = LAYOUTS[kind]
    raw = F.concat(little(F.lit(kind), 1), *_written(layout, fields))
    if ("action", "u8") in layout:
        raw = F.when(F.coalesce(fields["action"], F.lit(0)).isin(*ACTIONS), raw)
    if kind in NEEDS_ID:
        raw = F.when(fields["id"] != 0, raw)
    if kind == NEEDS_NAME:
        raw = F.when(fields["name"] != "", raw)
    return raw


def encode_any(kind: Column, fields: Mapping[str, Column]) -> Column:
    """A packet of the row's kind, among those with a layout; null for any other."""
    out = F.lit(None).cast("binary")
    for k in LAYOUTS:
        out = F.when(kind == k, encode(k, fields)).otherwise(out)
    return out


def encode_greeting(fields: Mapping[str, Column]) -> Column:
    return F.concat(*_written(GREETING, fields))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def apart(value: Column) -> Column:
    """The value as it is. A projection that names a function over arrays is compiled in small methods, and not fused with
    others into one that is too long for the JIT compiler and then interpreted."""
    return let(value, lambda x: x)


def _number(raw: Column, at: Column, size: int) -> Column:
    return number(F.substring(raw, at + 1, F.lit(size)), 0, size)


def _entries_end(raw: Column, total: Column, at: Column, n: Column) -> Column:
    """Where 2 * n texts that start at ``at`` end; null if bytes are missing."""

    def step(here: Column, k: Column) -> Column:
        end = here + 2 + _number(raw, here, 2).cast("int")
        return F.when(k == 0, here).otherwise(let(end, lambda e: F.when((here + 2 <= total) & (e <= total), e)))

    # Each text takes two bytes at least, so a count beyond that is wrong whatever follows.
    return F.when(n * 4 <= total, F.aggregate(F.sequence(F.lit(0), n * 2), at, step))


def _fold(raw: Column, total: Column, layout: Column, start: int) -> Column:
    """struct(at, found): the cursor after the fields of the layout, null if bytes are missing, and the fields."""
    state = f"struct<at:int,found:array<{_PART}>>"

    def end_of(at: Column, kind: Column) -> Column:
        text = let(at + 2 + _number(raw, at, 2).cast("int"), lambda e: F.when((at + 2 <= total) & (e <= total), e))
        raw_bytes = let(at + 4 + _number(raw, at, 4), lambda e: F.when((at + 4 <= total) & (e <= total), e.cast("int")))
        entries = F.when(at + 2 <= total, _entries_end(raw, total, at + 2, _number(raw, at, 2).cast("int")))
        return (
            F.when(kind == "text", text)
            .when(kind == "bytes", raw_bytes)
            .when(kind == "u8", F.when(at + 1 <= total, at + 1))
            .when(kind == "u32", F.when(at + 4 <= total, at + 4))
            .when((kind == "map?") & (at == total), at)
            .otherwise(entries)
        )

    def step(acc: Column, f: Column) -> Column:
        def moved(end: Column) -> Column:
            begin = acc["at"] + F.when(f["kind"] == "text", 2).when(f["kind"] == "bytes", 4).otherwise(0)
            part = F.struct(f["field"].alias("field"), F.substring(raw, begin + 1, end - begin).alias("value"))
            found = F.when(end.isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(part)))
            return F.struct(end.alias("at"), found.alias("found")).cast(state)

        return let(end_of(acc["at"], f["kind"]), moved)

    begin = F.struct(F.lit(start).alias("at"), F.array().cast(f"array<{_PART}>").alias("found")).cast(state)
    return F.aggregate(layout, begin, step)


def _value(found: Column, field: str) -> Column:
    part = F.get(F.filter(found, lambda x: x["field"] == field), F.lit(0))["value"]
    if field in NUMBERS:
        return let(part, lambda raw: F.when(F.octet_length(raw) == 1, number(raw, 0, 1)).when(raw.isNotNull(), number(raw, 0, 4)))
    if field == "metadata":
        return let(part, lambda raw: F.when(F.octet_length(raw) > 2, _entries(raw)))
    return part if field in BYTES else part.cast("string")


def _entries(raw: Column) -> Column:
    """The map that whole bytes hold; of entries with one key the last one counts."""
    kind = "struct<at:int,texts:array<string>>"
    begin = F.struct(F.lit(2).alias("at"), F.array().cast("array<string>").alias("texts")).cast(kind)

    def step(acc: Column, _: Column) -> Column:
        size = _number(raw, acc["at"], 2).cast("int")
        text = F.substring(raw, acc["at"] + 3, size).cast("string")
        return F.struct((acc["at"] + 2 + size).alias("at"), F.concat(acc["texts"], F.array(text)).alias("texts")).cast(kind)

    def by_key(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))

    n = number(raw, 0, 2).cast("int")
    pair = lambda texts: lambda i: F.struct(F.get(texts, i * 2).alias("k"), F.get(texts, i * 2 + 1).alias("v"))
    texts = F.aggregate(F.sequence(F.lit(1), n * 2), begin, step)["texts"]
    return let(let(texts, lambda t: F.transform(F.sequence(F.lit(0), n - 1), pair(t))), by_key)


def _layout(fields: tuple[tuple[str, str], ...]) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind")) for name, kind in fields))


def decode(raw: Column) -> Column:
    """kind, the fields (null where the kind has none) and error of a packet.

    A kind without a layout keeps its bytes as payload. error is null or one of empty, kind zero,
    truncated, trailing bytes, unknown action, id zero, no name; the fields are then null too.
    """
    names = [f for f in (*NUMBERS, *TEXTS, *BYTES, "metadata") if f not in ("device", "auth_type", "auth_data")]
    layouts = F.create_map(*(x for k, fields in LAYOUTS.items() for x in (F.lit(k), _layout(fields))))

    def checked(raw: Column, total: Column, kind: Column, read: Column) -> Column:
        value = lambda f: _value(read["found"], f)
        error = (
            F.when(F.coalesce(total, F.lit(0)) == 0, "empty")
            .when(kind == 0, "kind zero")
            .when(~kind.isin(*LAYOUTS), F.lit(None))
            .when(read["at"].isNull(), "truncated")
            .when(~value("action").isin(*ACTIONS), "unknown action")
            .when(kind.isin(*NEEDS_ID) & (value("id") == 0), "id zero")
            .when((kind == NEEDS_NAME) & (value("name") == ""), "no name")
            .when(read["at"] < total, "trailing bytes")
        )
        whole = F.substring(raw, F.lit(2), total)

        def fields(error: Column) -> Column:
            values = [F.when(kind.isin(*LAYOUTS), value(f)).otherwise(whole) if f == "payload" else value(f) for f in names]
            return F.struct(kind.alias("kind"), error.alias("error"), *(F.when(error.isNull(), v).alias(f) for f, v in zip(names, values, strict=True)))

        return let(error, fields)

    def with_kind(raw: Column, head: Column) -> Column:
        total, kind = head["total"], head["kind"]
        return let(_fold(raw, total, F.try_element_at(layouts, kind), 1), lambda read: checked(raw, total, kind, read))

    head = lambda raw: F.struct(F.octet_length(raw).alias("total"), F.when(F.octet_length(raw) > 0, number(raw, 0, 1).cast("int")).alias("kind"))
    return let(raw, lambda r: let(head(r), lambda h: with_kind(r, h)))


def decode_greeting(raw: Column) -> Column:
    """version, device, auth_type, auth_data, metadata and error (truncated or trailing bytes) of a greeting."""

    def fields(total: Column, read: Column) -> Column:
        error = F.when(read["at"].isNull(), "truncated").when(read["at"] < total, "trailing bytes")
        return F.struct(error.alias("error"), *(F.when(error.isNull(), _value(read["found"], f)).alias(f) for f, _ in GREETING))

    return let(raw, lambda r: let(F.octet_length(r), lambda n: let(_fold(r, n, _layout(GREETING), 0), lambda read: fields(n, read))))


def flags(metadata: Column, keys: Mapping[str, str]) -> Column:
    """A struct of flags: whether the reserved key of each is '1'."""
    return F.struct(*(F.coalesce(F.try_element_at(metadata, F.lit(key)) == "1", F.lit(False)).alias(name) for name, key in keys.items()))


def with_flags(metadata: Column, keys: Mapping[str, Column]) -> Column:
    """The metadata with each reserved key '1' if its flag is set, and absent if not; null if nothing is left."""
    plain = F.coalesce(F.map_filter(metadata, lambda k, _: ~k.isin(*keys)), F.create_map().cast("map<string,string>"))
    for key, flag in keys.items():
        plain = F.when(flag, F.map_concat(plain, F.create_map(F.lit(key), F.lit("1")))).otherwise(plain)
    return F.when(F.size(plain) > 0, plain)
