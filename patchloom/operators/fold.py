"""Folding a changelog into state: masking, last writer per leaf, merging and pruning.

A changelog has rows (entity, seq, op, leaf, value). ``whole``, ``full`` and ``delete`` rows mask
everything earlier at their path and below; ``leaf`` rows set one value. A row survives if no
masking row follows at its path or an ancestor; the state is the last surviving row of each leaf.
All windows share the entity's partitioning, so a fold takes one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASKING = ("full", "whole", "delete", "set")


def masks(op: Column) -> Column:
    return op.isin(*MASKING)


def mask_seq(keys: Sequence[str], seq: str = "seq", op: str = "op") -> Column:
    """The last masking seq of an entity whose masks all stand at its root."""
    return F.max(F.when(masks(F.col(op)), F.col(seq)).otherwise(F.lit(0))).over(Window.partitionBy(*keys))


def current_state(log: DataFrame, keys: Sequence[str], leaf: str = "leaf", seq: str = "seq", op: str = "op") -> DataFrame:
    """The rows that make up the state: the last ``leaf`` row of each leaf that no mask follows."""
    # One aggregation by leaf, combined before the shuffle, so that no entity is one task; masks have no
    # leaf and share a group. What is left is as small as the states.
    kept = log.groupBy(*keys, F.when(F.col(op) == "leaf", F.col(leaf)).alias("_leaf")).agg(
        F.max(F.when(masks(F.col(op)), F.col(seq))).alias("_mask"), F.max_by(F.struct(*(F.col(f"`{c}`") for c in log.columns)), F.when(F.col(op) == "leaf", F.col(seq))).alias("_row")
    )
    kept = kept.withColumn("_mask", F.max("_mask").over(Window.partitionBy(*keys))).filter(F.col("_row").isNotNull())
    return kept.filter(F.col("_mask").isNull() | (F.col("_row")[seq] > F.col("_mask"))).select("_row.*")


def surviving(log: DataFrame, keys: Sequence[str], path: str = "path", seq: str = "seq", op: str = "op", depth: int = 4) -> DataFrame:
    """Rows of a log with nested paths that no later mask at their path or an ancestor hides.

    ``depth`` bounds the schema's nesting: one windowed maximum for each level, none of them wider
    than an entity.
    """
    hidden = F.lit(False)
    for d in range(depth + 1):
        at = Window.partitionBy(*keys, F.when(F.size(path) >= d, F.slice(path, 1, d)))
        by = F.max(F.when(masks(F.col(op)) & (F.size(path) == d), F.col(seq))).over(at)
        hidden = hidden | ((F.size(path) >= d) & F.coalesce(by > F.col(seq), F.lit(False)))
    return log.withColumn("_hidden", hidden).filter(~F.col("_hidden")).drop("_hidden")


def fold_paths(log: DataFrame, keys: Sequence[str], path: str = "path", seq: str = "seq", op: str = "op", depth: int = 4) -> DataFrame:
    """The last surviving ``leaf`` row of each path."""
    last = Window.partitionBy(*keys, path).orderBy(F.desc(seq))
    alive = surviving(log, keys, path, seq, op, depth).filter(F.col(op) == "leaf")
    return alive.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def merge(log: DataFrame, keys: Sequence[str], leaf: str = "leaf", seq: str = "seq", op: str = "op") -> DataFrame:
    """One patch out of the rows of each key: its last mask, and the last row of each leaf after it.

    Folding the merged rows gives what folding all rows gives.
    """
    mask = mask_seq(keys, seq, op)
    last = Window.partitionBy(*keys, leaf, F.col(op) == "leaf").orderBy(F.desc(seq))
    kept = log.withColumn("_mask", mask).filter(F.col(seq) >= F.col("_mask"))
    return kept.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_mask")


def prune(log: DataFrame, keys: Sequence[str], value: str, seq: str = "seq") -> DataFrame:
    """Rows whose value differs from the one before under the same keys; nulls equal nulls."""
    w = Window.partitionBy(*keys).orderBy(seq)
    before, first = F.lag(value).over(w), F.row_number().over(w)
    return log.withColumn("_new", (first == 1) | ~before.eqNullSafe(F.col(value))).filter("_new").drop("_new")
