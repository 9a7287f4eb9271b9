"""Builders of patches as column expressions: arrays of (op, path, value) that ``inline`` turns into rows of a nested log.

A patch is in normal form: ``whole`` and ``delete`` mask what stands at their path and below, ``leaf``
sets one value. So a set of a container is a ``whole`` with a leaf for each part, and a change
inside a container is the change's own rows with the container's path before them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _row(op: str, path: Column, value: Column) -> Column:
    return F.struct(F.lit(op).alias("op"), path.cast("array<string>").alias("path"), value.alias("value"))


def path(*parts: Column | str) -> Column:
    return F.array(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).cast("array<string>")


def set_leaf(at: Column, value: Column) -> Column:
    """A plain value at a path."""
    return F.array(_row("leaf", at, value))


def delete(at: Column, kind: str = "double") -> Column:
    return F.array(_row("delete", at, F.lit(None).cast(kind)))


def clear(at: Column, kind: str = "double") -> Column:
    """Empties what stands at a path."""
    return F.array(_row("whole", at, F.lit(None).cast(kind)))


def set_map(at: Column, value: Column, kind: str = "double") -> Column:
    """Replaces a map by a map: keys that it lacks are gone."""
    leaf = lambda e: _row("leaf", F.concat(at, F.array(e["key"].cast("string"))), e["value"])
    return F.concat(clear(at, kind), F.transform(F.map_entries(value), leaf))


def set_array(at: Column, value: Column, kind: str = "double") -> Column:
    """Replaces an array by an array."""
    leaf = lambda x, i: _row("leaf", F.concat(at, F.array(i.cast("string"))), x)
    return F.concat(clear(at, kind), F.transform(value, leaf))


def set_struct(at: Column, kind: str = "double", **fields: Column) -> Column:
    """Replaces a struct, field by field."""
    leaves = (_row("leaf", F.concat(at, F.array(F.lit(n))), v) for n, v in fields.items())
    return F.concat(clear(at, kind), F.array(*leaves))


def inside(at: Column, patch: Column) -> Column:
    """A patch of what stands at a path, as a patch of what holds it."""
    return F.transform(patch, lambda r: F.struct(r["op"].alias("op"), F.concat(at.cast("array<string>"), r["path"]).alias("path"), r["value"].alias("value")))


def patch(*parts: Column) -> Column:
    """Several changes as one; of those to one path the last one counts."""
    return F.concat(*parts)
