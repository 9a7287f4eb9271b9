"""Store schemas: field ids in column metadata, and the rules that a new version must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FIELD_ID, MAX_FIELD = "fID", 255


def field_ids(schema: StructType) -> dict[str, int]:
    """Ids by name; raises where one is missing, repeated or out of 1 to 255."""
    ids: dict[str, int] = {}
    for f in schema.fields:
        n = (f.metadata or {}).get(FIELD_ID)
        if n is None or not 1 <= n <= MAX_FIELD:
            raise ValueError(f"field {f.name} has no id from 1 to {MAX_FIELD}")
        if n in ids.values():
            raise ValueError(f"field {f.name} repeats id {n}")
        ids[f.name] = n
    return ids


def check_schema_compat(before: DataFrame, after: DataFrame) -> DataFrame:
    """struct, name and problem of each rule broken; both: struct, name, id, max_field.

    A name keeps its id, a new name takes an id above the old maximum, the maximum never falls.
    """
    old = before.select("struct", "name", F.col("id").alias("old_id"))
    highest = before.groupBy("struct").agg(F.max("max_field").alias("old_max"))
    now = after.join(highest, "struct").join(old, ["struct", "name"], "left")
    changed = F.when(F.col("old_id") != F.col("id"), "id changed").when(F.col("old_id").isNull() & (F.col("id") <= F.col("old_max")), "id reused")
    fields = now.select("struct", "name", changed.alias("problem")).filter("problem IS NOT NULL")
    falls = after.groupBy("struct").agg(F.max("max_field").alias("m")).join(highest, "struct").filter("m < old_max")
    return fields.union(falls.select("struct", F.lit("").alias("name"), F.lit("maximum falls").alias("problem")))
