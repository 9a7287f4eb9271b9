"""Nested patches: merging, pruning and narrowing of logs whose rows stand at paths of any depth.

A nested log has rows (keys, seq, path, op, value). ``whole`` and ``delete`` mask what earlier rows
set at their path and below; ``leaf`` rows set one value; the leaves of a ``whole`` share its seq.
Masks of one seq stand at paths of which none is above another. ``depth`` bounds the schema's
nesting. Windows are partitioned by keys and a prefix of the path, so no entity is gathered beyond
what shares the prefix, and joins are equalities of keys, seq and prefixes.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.paths import prefixes
from . import fold

MASKS = ("whole", "delete")


def merge_nested(log: DataFrame, keys: Sequence[str], path: str = "path", seq: str = "seq", op: str = "op", depth: int = 4) -> DataFrame:
    """One patch out of the rows of each key: of what no later mask hides, the last mask and the last leaf of each path.

    Folding the merged rows gives what folding all rows gives.
    """
    last = Window.partitionBy(*keys, path, F.col(op) == "leaf").orderBy(F.desc(seq))
    alive = fold.surviving(log, keys, path, seq, op, depth)
    # A leaf that a later mask at its own path hides is gone by now; what is left of one path is a mask and the leaf after it.
    return alive.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def _at(keys: Sequence[str], path: str, d: int) -> WindowSpec:
    return Window.partitionBy(*keys, F.when(F.size(path) >= d, F.slice(path, 1, d)))


def lifetimes(log: DataFrame, keys: Sequence[str], path: str = "path", seq: str = "seq", op: str = "op", depth: int = 4) -> DataFrame:
    """Adds ``ended``: seq and depth of the row that ends a leaf (a later leaf of its path, or a mask at or above it; null while it lives),
    and ``owner``: depth of the whole of the same seq that a leaf is part of (null if it stands alone)."""
    is_leaf, size = F.col(op) == "leaf", F.size(path)
    ends, owners = [], []
    later = (Window.unboundedPreceding, -1)  # in falling order: a frame that only grows
    for d in range(depth + 1):
        w = _at(keys, path, d)
        mask = F.min(F.when(F.col(op).isin(*MASKS) & (size == d), F.col(seq))).over(w.orderBy(F.desc(seq)).rangeBetween(*later))
        ends.append(F.when(size >= d, F.when(mask.isNotNull(), F.struct(mask.alias("seq"), F.lit(d).alias("depth")))))
        whole = F.max((F.col(op) == "whole") & (size == d)).over(w.orderBy(seq).rangeBetween(0, 0))
        owners.append(F.when((size >= d) & whole, F.lit(d)))
    again = F.min(F.when(is_leaf, F.col(seq))).over(Window.partitionBy(*keys, path).orderBy(F.desc(seq)).rangeBetween(*later))
    ends.append(F.when(again.isNotNull(), F.struct(again.alias("seq"), size.alias("depth"))))
    return log.withColumn("ended", F.when(is_leaf, F.least(*ends))).withColumn("owner", F.when(is_leaf, F.coalesce(*owners)))


def prune_nested(
    log: DataFrame, keys: Sequence[str], path: str = "path", seq: str = "seq", op: str = "op", value: str = "value", depth: int = 4, index_depths: Collection[int] = (), parts: int | None = None
) -> DataFrame:
    """The rows that change the state they meet. ``parts`` is the number of partitions of the join, for logs of many rows.

    A leaf goes if its path holds an equal value (nulls equal nulls), a delete if nothing stands at
    its path or below, a whole, with its leaves, if what it replaces equals it. Rows whose path has
    a negative index at one of ``index_depths`` (counted from 1) go first.
    """
    bad = reduce(Column.__or__, (F.coalesce(F.get(path, F.lit(d - 1)).try_cast("int") < 0, F.lit(False)) for d in index_depths), F.lit(False))
    names, size = log.columns, F.size(path)
    rows = lifetimes(log.filter(~bad), keys, path, seq, op, depth)
    w = Window.partitionBy(*keys, path).orderBy(seq)
    leaf_before = F.last(F.when(F.col(op) == "leaf", F.struct(F.col(value).alias("value"), F.col("ended").alias("ended"))), ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -1))
    same = leaf_before["value"].eqNullSafe(F.col(value)) & (leaf_before["ended"]["seq"] == F.col(seq)) & (leaf_before["ended"]["depth"] == size)
    rows = rows.withColumn("_same", F.coalesce((F.col(op) == "leaf") & same, F.lit(False))).withColumn("_mask", F.when(F.col("owner").isNotNull(), F.slice(path, F.lit(1), F.col("owner"))).otherwise(F.col(path)))
    # What masks end, and what wholes bring: a whole changes something if the two differ for any path.
    leaves = rows.filter(F.col(op) == "leaf")
    part = lambda at, mask, old, new: leaves.select(
        *keys, at.alias("_seq"), mask.alias("_mask"), F.col(path).alias("_path"), F.lit(old).alias("_old"), F.lit(new).alias("_new"),
        (F.when(F.lit(bool(old)), F.col(value))).alias("_was"), (F.when(F.lit(bool(new)), F.col(value))).alias("_is"),
    )
    ended = part(F.col("ended.seq"), F.slice(path, F.lit(1), F.col("ended.depth")), 1, 0).filter("_seq IS NOT NULL")
    brought = part(F.col(seq), F.col("_mask"), 0, 1)
    met = ended.union(brought).groupBy(*keys, "_seq", "_mask", "_path").agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"), F.max("_was").alias("_was"), F.max("_is").alias("_is"))
    changed = met.groupBy(*keys, "_seq", "_mask").agg(
        F.max((F.col("_old") != F.col("_new")) | ~F.col("_was").eqNullSafe(F.col("_is"))).alias("_differs"), F.max(F.col("_old") == 1).alias("_ends")
    )
    rows, on = rows.withColumn("_seq", F.col(seq)), [*keys, "_seq", "_mask"]
    dealt = lambda d: d.repartition(parts, *on) if parts else d
    rows = dealt(rows).join(dealt(changed), on, "left")
    alone = (F.col(op) == "leaf") & F.col("owner").isNull()
    kept = F.when(alone, ~F.col("_same")).when(F.col(op) == "delete", F.coalesce("_ends", F.lit(False))).otherwise(F.coalesce("_differs", F.lit(False)))
    return rows.filter(kept).select(*names)


def narrow(
    log: DataFrame, wanted: DataFrame, keys: Sequence[str], path: str = "path", seq: str = "seq", op: str = "op", value: str = "value", target: str = "wanted", index_depths: Collection[int] = ()
) -> DataFrame:
    """What of each patch a wanted path (column ``target``) is told: keys, seq, path, op and value, each row once.

    Rows at or below a wanted path stay. So do leaves and deletes above it: they settle what stands
    there. A whole above it is narrowed to the part on the way: the part's value if the whole has
    it, else a delete, or nothing if the part is an array index (``index_depths``, counted from 1).
    """
    out = [*keys, seq, path, op, value]
    wants = wanted.select(*keys, F.col(target).alias("_wanted")).distinct()
    exact = wants.withColumnRenamed("_wanted", "_at")
    above = wants.select(*keys, F.explode(F.filter(prefixes(F.col("_wanted")), lambda p: F.size(p) < F.size("_wanted"))).alias("_at"), "_wanted")
    low = log.select(*out, F.explode(prefixes(F.col(path))).alias("_at")).join(exact, [*keys, "_at"], "left_semi").select(*out)
    high = log.filter(F.col(op) != "whole").join(above.select(*keys, F.col("_at").alias(path)).distinct(), [*keys, path], "left_semi").select(*out)
    next_part = F.slice("_wanted", F.lit(1), F.size("_at") + 1).alias("_part")
    cut = log.filter(F.col(op) == "whole").select(*keys, seq, F.col(path).alias("_at")).join(above, [*keys, "_at"]).select(*keys, seq, next_part).distinct()
    brought = log.filter(F.col(op) == "leaf").select(*keys, seq, path, value, F.explode(prefixes(F.col(path))).alias("_part")).join(cut, [*keys, seq, "_part"])
    leaves = brought.select(*keys, seq, path, F.lit("leaf").alias(op), value)
    there = brought.select(*keys, seq, "_part").distinct().withColumn("_there", F.lit(True))
    is_index = F.size("_part").isin(*index_depths) if index_depths else F.lit(False)
    marks = cut.join(there, [*keys, seq, "_part"], "left").filter(F.col("_there") | ~is_index)
    marks = marks.select(*keys, seq, F.col("_part").alias(path), F.when(F.col("_there"), "whole").otherwise("delete").alias(op), F.lit(None).cast(log.schema[value].dataType).alias(value))
    return low.union(high).union(leaves).union(marks).distinct()


def with_zeros(state: DataFrame, keys: Sequence[str], zeros: dict[str, object], field: str = "field", value: str = "value") -> DataFrame:
    """Every field of every element that has any: a change inside an absent element starts from zero values."""
    got = state.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(field, value))).alias("_got"))  # as many as a struct has fields
    each = F.inline(F.array(*(F.struct(F.lit(n).alias(field), F.lit(z).cast(state.schema[value].dataType).alias("_zero")) for n, z in zeros.items())))
    return got.select(*keys, "_got", each).select(*keys, field, F.when(F.map_contains_key("_got", F.col(field)), F.try_element_at("_got", F.col(field))).otherwise(F.col("_zero")).alias(value))


def zero_filled(items: DataFrame, keys: Sequence[str], index: str, value: str, zero: object) -> DataFrame:
    """Every index of each array from 0 to the highest one set; those not set hold the zero value. Negative indexes are no items.

    The gap below each item is filled from the item itself, so that no array is gathered.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    items = items.filter(F.col(index) >= 0).select(*keys, index, value, F.coalesce(F.lag(index).over(w), F.lit(-1)).alias("_before"))
    each = F.explode(F.sequence(F.col("_before") + 1, F.col(index))).alias("_index")
    rows = items.select(*keys, index, value, each)
    return rows.select(*keys, F.col("_index").cast("int").alias(index), F.when(F.col("_index") == F.col(index), F.col(value)).otherwise(F.lit(zero)).alias(value))
