"""Field paths as arrays of strings, and their keys: parts joined by ``%&``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "%&"


def client_name(part: Column) -> Column:
    """First letter lower-cased, unless the name is empty or has an underscore."""
    return F.when((part == "") | part.contains("_"), part).otherwise(F.concat(F.lower(F.substring(part, 1, 1)), F.substring(part, F.lit(2), F.length(part))))


def server_name(part: Column) -> Column:
    """First letter upper-cased, with the same exceptions."""
    return F.when((part == "") | part.contains("_"), part).otherwise(F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, F.lit(2), F.length(part))))


def path_key(path: Column) -> Column:
    """Only the first part is a field name for certain; map keys stay exact."""
    return F.array_join(F.transform(path, lambda p, i: F.when(i == 0, client_name(p)).otherwise(p)), SEPARATOR)


def split_key(key: Column) -> Column:
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.split(key, SEPARATOR))


def server_path(key: Column) -> Column:
    return F.transform(split_key(key), lambda p, i: F.when(i == 0, server_name(p)).otherwise(p))


def prefixes(path: Column) -> Column:
    """All prefixes of a path, from the root to itself."""
    return F.transform(F.sequence(F.lit(0), F.size(path)), lambda n: F.slice(path, F.lit(1), n))


def child_path(path: Column, field: str) -> Column:
    """What follows a leading field; null if the path leads elsewhere."""
    return F.when(F.get(path, F.lit(0)) == field, F.slice(path, F.lit(2), F.size(path)))


def array_index(part: Column) -> Column:
    """Index of an array path part; null if it is none."""
    index = part.try_cast("int")
    return F.when(index >= 0, index)


def typed_key(part: Column, kind: str) -> Column:
    """A map key of the given type, null out of its range. Unsigned kinds are uint8, uint16, uint32, uint64."""
    if not kind.startswith("uint"):
        return part.try_cast(kind)
    number = part.try_cast("decimal(38,0)")
    return F.when((number >= 0) & (number < F.lit(str(1 << int(kind[4:]))).cast("decimal(38,0)")), number)


def canonical_path(path: Column, kind: T.DataType, at: int = 0) -> Column:
    """The path as a schema spells it: field names as clients write them, map keys and indexes as they are.

    Paths that name one value in several ways become equal, so that they share one subscription.
    From a part on that the schema does not know, the rest stays as it is.
    """
    rest, part, size = F.slice(path, F.lit(at + 1), F.greatest(F.size(path), F.lit(1))), F.get(path, F.lit(at)), F.size(path)
    if isinstance(kind, T.StructType):
        out = rest
        for f in reversed(kind.fields):
            name = f.name if "_" in f.name else f.name[:1].lower() + f.name[1:]
            out = F.when(client_name(part) == name, F.concat(F.array(F.lit(name)), canonical_path(path, f.dataType, at + 1))).otherwise(out)
    elif isinstance(kind, (T.MapType, T.ArrayType)):
        inner = kind.valueType if isinstance(kind, T.MapType) else kind.elementType
        out = F.concat(F.array(part), canonical_path(path, inner, at + 1))
    else:
        return rest
    return F.when(size > at, out).otherwise(rest)
