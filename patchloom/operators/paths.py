"""Path algebra over DataFrames: reduction, affects and filtering, all by equality of prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import prefixes


def reduce_paths(paths: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """Distinct paths without those that descend from another path of the same keys."""
    each = paths.select(*keys, path).distinct()
    above = each.select(*keys, F.col(path).alias("_above"))
    strict = F.explode(F.transform(F.sequence(F.lit(0), F.size(path) - 1), lambda n: F.slice(path, F.lit(1), n)))
    below = each.filter(F.size(path) > 0).select(*keys, path, strict.alias("_above"))
    covered = below.join(above, [*keys, "_above"], "left_semi").select(*keys, path).distinct()
    return each.join(covered, [*keys, path], "left_anti")


def affects(changes: DataFrame, subscriptions: DataFrame, keys: Sequence[str], changed: str = "path", wanted: str = "wanted") -> DataFrame:
    """Pairs of a change and a subscription of which one path is a prefix of the other.

    A change meets subscriptions at or above it by its own prefixes, and subscriptions below it by
    theirs: two equality joins, never a loop over all pairs.
    """
    up = changes.withColumn("_at", F.explode(prefixes(F.col(changed)))).join(subscriptions.withColumn("_at", F.col(wanted)), [*keys, "_at"])
    strict = F.explode(F.filter(prefixes(F.col(wanted)), lambda p: F.size(p) < F.size(F.col(wanted))))
    down = changes.withColumn("_at", F.col(changed)).join(subscriptions.withColumn("_at", strict), [*keys, "_at"])
    return up.unionByName(down).drop("_at")


def filter_to(changes: DataFrame, wanted: DataFrame, keys: Sequence[str], changed: str = "path", path: str = "wanted") -> DataFrame:
    """Changes at or below a wanted path; no wanted path keeps nothing, the root keeps all."""
    n = changes.withColumn("_row", F.struct(*changes.columns)).withColumn("_at", F.explode(prefixes(F.col(changed))))
    hit = n.join(wanted.select(*keys, F.col(path).alias("_at")).distinct(), [*keys, "_at"], "left_semi")
    return hit.select("_row").distinct().select("_row.*")
