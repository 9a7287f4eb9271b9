"""Queries over state: replay, snapshots, merging, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import fold
from .catalogue import query


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a changelog: signup replaces an entity, error deletes it, the others set a leaf."""
    op = F.when(F.col("event_type") == "signup", "whole").when(F.col("event_type") == "error", "delete").otherwise("leaf")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("ent"), seq.alias("seq"), "ts", op.alias("op"), F.when(op == "leaf", F.col("event_type")).alias("leaf"), "value"
    )


LOG = """ops AS (
  SELECT user_id AS ent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts,
    CASE event_type WHEN 'signup' THEN 'whole' WHEN 'error' THEN 'delete' ELSE 'leaf' END AS op,
    CASE WHEN event_type NOT IN ('signup', 'error') THEN event_type END AS leaf, value FROM events)"""


@query(
    "q_app_1_replay",
    f"""WITH {LOG},
x AS (SELECT *, max(CASE WHEN op IN ('whole', 'delete') THEN seq ELSE 0 END) OVER (PARTITION BY ent) AS mask FROM ops),
w AS (SELECT *, row_number() OVER (PARTITION BY ent, leaf ORDER BY seq DESC) AS rn FROM x WHERE op = 'leaf' AND seq > mask)
SELECT ent, leaf, value, CAST(seq AS BIGINT) AS seq FROM w WHERE rn = 1""",
)
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.current_state(event_log(spark, sf_dir), ["ent"]).select("ent", "leaf", "value", "seq")


@query(
    "q_app_2_array_zero_fill",
    """SELECT o AS l_orderkey, CAST(i AS INTEGER) AS idx, coalesce(q, 0.0) AS quantity
FROM (SELECT l_orderkey AS o, unnest(range(0, max(l_linenumber) + 1)) AS i FROM lineitem GROUP BY l_orderkey) g
LEFT JOIN (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL) l ON l.l_orderkey = g.o AND l.l_linenumber = g.i""",
)
def array_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed sets of an array that grows with zero values."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    sets = items.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "q"))).alias("sets"), F.max("l_linenumber").alias("top"))
    filled = F.transform(F.sequence(F.lit(0), "top"), lambda i: F.coalesce(F.try_element_at("sets", i), F.lit(0.0)))
    return sets.select("l_orderkey", F.posexplode(filled).alias("idx", "quantity"))


@query(
    "q_app_3_map",
    f"""WITH {LOG},
x AS (SELECT *, max(CASE WHEN op IN ('whole', 'delete') THEN seq ELSE 0 END) OVER (PARTITION BY ent) AS mask FROM ops),
w AS (SELECT *, row_number() OVER (PARTITION BY ent, leaf ORDER BY seq DESC) AS rn FROM x WHERE op = 'leaf' AND seq > mask)
SELECT ent, count(*) AS n_keys, string_agg(leaf, ',' ORDER BY leaf) AS keys, min(value) AS lowest FROM w WHERE rn = 1 GROUP BY ent""",
)
def nested_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State as a map for each entity."""
    state = fold.current_state(event_log(spark, sf_dir), ["ent"])
    maps = state.groupBy("ent").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "value"))).alias("m"))
    return maps.select("ent", F.size("m").cast("long").alias("n_keys"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.array_min(F.map_values("m")).alias("lowest"))


@query(
    "q_snp_1_state_at",
    f"""WITH {LOG},
cut AS (SELECT min(ts) + INTERVAL 10 DAY AS t FROM ops),
x AS (SELECT *, max(CASE WHEN op IN ('whole', 'delete') THEN seq ELSE 0 END) OVER (PARTITION BY ent) AS mask FROM ops, cut WHERE ts <= t),
w AS (SELECT *, row_number() OVER (PARTITION BY ent, leaf ORDER BY seq DESC) AS rn FROM x WHERE op = 'leaf' AND seq > mask)
SELECT ent, leaf, value, CAST(seq AS BIGINT) AS seq FROM w WHERE rn = 1""",
)
def state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State ten days after the first event."""
    start = events(spark, sf_dir).agg(F.min("ts")).first()[0]
    log = event_log(spark, sf_dir).filter(F.col("ts") <= F.lit(start) + F.expr("INTERVAL 10 DAYS"))
    return fold.current_state(log, ["ent"]).select("ent", "leaf", "value", "seq")


@query(
    "q_snp_2_keyed_snapshot",
    f"""WITH {LOG},
x AS (SELECT *, max(CASE WHEN op IN ('whole', 'delete') THEN seq ELSE 0 END) OVER (PARTITION BY ent) AS mask FROM ops),
w AS (SELECT *, row_number() OVER (PARTITION BY ent, leaf ORDER BY seq DESC) AS rn FROM x WHERE op = 'leaf' AND seq > mask),
wanted AS (SELECT DISTINCT user_id AS ent, k AS leaf FROM events, (VALUES ('view'), ('purchase')) v(k))
SELECT wanted.ent, wanted.leaf, CASE WHEN w.ent IS NULL THEN 'delete' ELSE 'set' END AS op, value
FROM wanted LEFT JOIN w ON w.ent = wanted.ent AND w.leaf = wanted.leaf AND rn = 1""",
)
def keyed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What subscribers of two keys get: the value, or an explicit delete where the key is missing."""
    state = fold.current_state(event_log(spark, sf_dir), ["ent"]).select("ent", "leaf", "value", F.lit(True).alias("found"))
    wanted = events(spark, sf_dir).select(F.col("user_id").alias("ent")).distinct().withColumn("leaf", F.explode(F.array(F.lit("view"), F.lit("purchase"))))
    return wanted.join(state, ["ent", "leaf"], "left").select("ent", "leaf", F.when(F.col("found"), "set").otherwise("delete").alias("op"), "value")


@query(
    "q_mrg_1_merge",
    f"""WITH {LOG},
c AS (SELECT *, (seq - 1) // 4 AS chunk FROM ops),
x AS (SELECT *, max(CASE WHEN op IN ('whole', 'delete') THEN seq ELSE 0 END) OVER (PARTITION BY ent, chunk) AS mask FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY ent, chunk, leaf, op = 'leaf' ORDER BY seq DESC) AS rn FROM x WHERE seq >= mask)
SELECT ent, CAST(chunk AS BIGINT) AS chunk, op, leaf, CASE WHEN op = 'leaf' THEN value END AS value, CAST(seq AS BIGINT) AS seq FROM w WHERE rn = 1""",
)
def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every four patches of an entity merged into one."""
    log = event_log(spark, sf_dir).withColumn("chunk", F.floor((F.col("seq") - 1) / 4))
    return fold.merge(log, ["ent", "chunk"]).select("ent", "chunk", "op", "leaf", F.when(F.col("op") == "leaf", F.col("value")).alias("value"), "seq")


@query(
    "q_pru_1_prune",
    """WITH w AS (SELECT event_id, user_id, event_type, props, lag(props) OVER p AS prev, row_number() OVER p AS n FROM events
  WINDOW p AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, user_id, event_type, props FROM w WHERE n = 1 OR props IS DISTINCT FROM prev""",
)
def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets without those that repeat the value before."""
    log = events(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    return fold.prune(log, ["user_id", "event_type"], "props", "at").select("event_id", "user_id", "event_type", "props")
