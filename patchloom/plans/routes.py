"""Queries over paths, subscriptions, access and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as names
from ..functions.paths import path_key
from ..operators import paths, subs
from .catalogue import query
from .state import events

ORDER = ["ts", "event_id"]


def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of events: [type], or [type, user] where the id is odd."""
    user = F.col("user_id").cast("string")
    path = F.when(F.col("event_id") % 2 == 0, F.array("event_type")).otherwise(F.array(F.col("event_type"), user))
    return events(spark, sf_dir).select("event_id", (F.col("user_id") % 8).alias("viewer"), F.when(F.col("event_type") == "signup", F.array(F.col("event_type"), user)).otherwise(path).alias("path"))


PATHS = """p AS (SELECT event_id, user_id % 8 AS viewer, event_type AS t, CAST(user_id AS VARCHAR) AS u,
  event_type = 'signup' OR event_id % 2 <> 0 AS deep FROM events)"""


@query(
    "q_red_1_reduce",
    f"""WITH {PATHS}, d AS (SELECT DISTINCT viewer, t, CASE WHEN deep THEN u END AS u FROM p)
SELECT viewer, CASE WHEN u IS NULL THEN t ELSE t || '%&' || u END AS path_key FROM d
WHERE u IS NULL OR NOT EXISTS (SELECT 1 FROM d a WHERE a.viewer = d.viewer AND a.t = d.t AND a.u IS NULL)""",
)
def reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.reduce_paths(changed_paths(spark, sf_dir), ["viewer"]).select("viewer", path_key(F.col("path")).alias("path_key"))


def wanted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight viewers: even ones want [click], odd ones [view, viewer]."""
    odd = F.col("viewer") % 2 == 1
    return spark.range(8).select(F.col("id").alias("viewer"), F.lit(0).alias("store")).select(
        "viewer", F.when(odd, F.array(F.lit("view"), F.col("viewer").cast("string"))).otherwise(F.array(F.lit("click"))).alias("wanted")
    )


WANTED = """s AS (SELECT range AS viewer, CASE WHEN range % 2 = 1 THEN 'view' ELSE 'click' END AS t, CASE WHEN range % 2 = 1 THEN CAST(range AS VARCHAR) END AS u FROM range(8))"""


@query(
    "q_aff_1_affects",
    f"""WITH {PATHS}, {WANTED}
SELECT event_id, p.viewer FROM p JOIN s ON s.viewer = p.viewer AND s.t = p.t WHERE s.u IS NULL OR NOT deep OR s.u = p.u""",
)
def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.affects(changed_paths(spark, sf_dir), wanted_paths(spark, sf_dir), ["viewer"]).select("event_id", "viewer")


@query(
    "q_fil_1_filter",
    f"""WITH {PATHS}, {WANTED}
SELECT event_id, p.viewer FROM p JOIN s ON s.viewer = p.viewer AND s.t = p.t WHERE s.u IS NULL OR (deep AND s.u = p.u)""",
)
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.filter_to(changed_paths(spark, sf_dir), wanted_paths(spark, sf_dir), ["viewer"]).select("event_id", "viewer")


@query(
    "q_key_1_keys",
    """SELECT event_id, event_type || '%&' || user_id || '%&Number' AS key, upper(event_type[1]) || event_type[2:] AS server_name, 3 AS parts, CASE WHEN user_id < 256 THEN CAST(user_id AS BIGINT) END AS as_uint8,
CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 3 - 1 AS INTEGER) END AS idx, CASE WHEN event_type = 'view' THEN user_id || '%&Number' END AS below_view FROM events""",
)
def subscription_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of paths and back: names for servers, typed map keys, indexes, what follows a field."""
    path = F.array(F.concat(F.upper(F.substring("event_type", 1, 1)), F.substring("event_type", F.lit(2), F.length("event_type"))), F.col("user_id").cast("string"), F.lit("Number"))
    rows = events(spark, sf_dir).withColumn("path", path).withColumn("key", path_key(F.col("path")))
    server = names.server_path(F.col("key"))
    below = names.child_path(names.split_key(F.col("key")), "view")
    return rows.select(
        "event_id", "key", F.get(server, F.lit(0)).alias("server_name"), F.size(server).alias("parts"), names.typed_key(F.get(server, F.lit(1)), "uint8").cast("long").alias("as_uint8"),
        names.array_index((F.col("event_id") % 3 - 1).cast("string")).alias("idx"), F.array_join(below, names.SEPARATOR).alias("below_view"),
    )


#: A state with a struct, a map of structs and a list.
STATE = T.StructType([
    T.StructField("View", T.MapType(T.StringType(), T.StructType([T.StructField("Number", T.LongType()), T.StructField("Sub_Part", T.LongType())]))),
    T.StructField("Click", T.ArrayType(T.StructType([T.StructField("Number", T.LongType())]))),
    T.StructField("Purchase", T.LongType()),
])


@query(
    "q_key_2_aliases",
    """WITH p AS (SELECT *, event_id % 2 = 0 AS up FROM events),
c AS (SELECT event_id, event_type || '%&' || CASE WHEN event_type IN ('view', 'click') THEN user_id || '%&number' WHEN up THEN user_id || '%&Number' ELSE user_id || '%&number' END AS key, user_id FROM p)
SELECT key, count(*) AS n, min(event_id) AS first_event FROM c GROUP BY key""",
)
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions by canonical key: spellings of one path that the schema knows are one."""
    up, kind = F.col("event_id") % 2 == 0, F.col("event_type")
    known = kind.isin("view", "click", "purchase")
    first = F.when(up & known, F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, F.lit(2), F.length(kind)))).otherwise(kind)
    path = F.array(first, F.col("user_id").cast("string"), F.when(up, "Number").otherwise("number"))
    rows = events(spark, sf_dir).select("event_id", F.array_join(names.canonical_path(path, STATE), names.SEPARATOR).alias("key"))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.when(F.col("event_type").isin("signup", "view"), 1).when(F.col("event_type").isin("error", "purchase"), -1).otherwise(0)
    return events(spark, sf_dir).withColumn("delta", delta)


def counts(keys: str, plus: str = "'signup', 'view'", minus: str = "'error', 'purchase'") -> str:
    return f"""e AS (SELECT *, CASE WHEN event_type IN ({plus}) THEN 1 WHEN event_type IN ({minus}) THEN -1 ELSE 0 END AS delta FROM events),
r AS (SELECT *, sum(delta) OVER (PARTITION BY {keys} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e),
l AS (SELECT *, least(0, min(s) OVER (PARTITION BY {keys} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS low FROM r),
c AS (SELECT *, s - low AS n FROM l),
b AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY {keys} ORDER BY ts, event_id), 0) AS before FROM c)"""


@query(
    "q_ref_1_edges",
    f"WITH {counts('user_id')} SELECT user_id, event_id, CASE WHEN before = 0 THEN 'on' ELSE 'off' END AS edge FROM b WHERE (before = 0 AND n = 1) OR (before = 1 AND n = 0)",
)
def store_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subs.edges(lifecycle(spark, sf_dir), ["user_id"], ORDER).select("user_id", "event_id", "edge")


@query(
    "q_ref_2_keyed_edges",
    f"WITH {counts('user_id % 10, event_id % 3')} SELECT user_id % 10 AS store, event_id % 3 AS k, event_id, CASE WHEN before = 0 THEN 'on' ELSE 'off' END AS edge FROM b WHERE (before = 0 AND n = 1) OR (before = 1 AND n = 0)",
)
def keyed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifecycle(spark, sf_dir).withColumn("store", F.col("user_id") % 10).withColumn("k", F.col("event_id") % 3)
    return subs.edges(rows, ["store", "k"], ORDER).select("store", "k", "event_id", "edge")


@query("q_ref_3_underflows", f"WITH {counts('user_id')} SELECT user_id, event_id FROM b WHERE delta < 0 AND before = 0")
def stops_at_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subs.underflows(lifecycle(spark, sf_dir), ["user_id"], ORDER).select("user_id", "event_id")


@query(
    "q_ref_4_access_while_active",
    f"""WITH {counts('user_id')},
ep AS (SELECT *, sum(CASE WHEN before = 0 AND n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS episode FROM b)
SELECT user_id, CAST(episode AS BIGINT) AS episode, CAST(max(event_id % 4) AS BIGINT) AS access FROM ep WHERE n > 0 GROUP BY ALL""",
)
def access_while_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest access level asked for in each active episode."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = subs.counted(lifecycle(spark, sf_dir), ["user_id"], ORDER)
    c = c.withColumn("episode", F.sum(((F.col("before") == 0) & (F.col("count") == 1)).cast("long")).over(w))
    return c.filter("count > 0").groupBy("user_id", "episode").agg(F.max(F.col("event_id") % 4).alias("access"))


@query("q_ref_5_active", f"WITH {counts('user_id')}, z AS (SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM b) SELECT user_id, CAST(n AS BIGINT) AS count FROM z WHERE k = 1 AND n > 0")
def active_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subs.active(lifecycle(spark, sf_dir), ["user_id"], ORDER)


_SIGNUP, _ERROR = "'signup'", "'error'"


@query("q_kev_1_keyed_events", f"WITH {counts('user_id', _SIGNUP, _ERROR)} SELECT user_id, event_id, value FROM b WHERE event_type = 'purchase' AND n > 0")
def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that fall between a signup and an error of their user."""
    delta = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    rows = events(spark, sf_dir).withColumn("delta", delta)
    return subs.delivered(rows, ["user_id"], ORDER, F.col("event_type") == "purchase").select("user_id", "event_id", "value")


def viewers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("store"), (F.col("c_custkey") % 5).alias("level"))
    stores = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("store"), F.nullif(F.col("n_regionkey"), F.lit(0)).alias("min_access"))
    return customers, stores.filter("store <> 7")


ACCESS = """a AS (SELECT c_custkey, c_nationkey AS store, c_custkey % 5 AS level, n_nationkey IS NULL OR n_nationkey = 7 AS unknown, coalesce(n_regionkey, 0) AS least
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey)"""


@query("q_acc_1_access", f"WITH {ACCESS} SELECT c_custkey, store FROM a WHERE NOT unknown AND level >= least")
def accessible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, stores = viewers(spark, sf_dir)
    return subs.with_access(rows, stores, "level", ["store"]).filter("allowed").select("c_custkey", "store")


@query(
    "q_acc_2_denials",
    f"WITH {ACCESS} SELECT c_custkey, store, CASE WHEN unknown THEN 'unknown store' ELSE 'insufficient access' END AS error FROM a WHERE unknown OR level < least",
)
def denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, stores = viewers(spark, sf_dir)
    return subs.with_access(rows, stores, "level", ["store"]).filter("NOT allowed").select("c_custkey", "store", "error")


_TYPES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(subs.STORE_TYPES))
ROUTES = f"""t AS (SELECT * FROM (VALUES {_TYPES}) v(i, store_type)),
m AS (SELECT store_type, i, store_type IN ('DeviceWithRelay', 'DeviceWithCloudImpl') AS streams_to_relay, store_type = 'DeviceWithCloudSource' AS receives_from_relay,
  store_type = 'CloudImplOfDevice' AS accepts_device_updates, store_type = 'CloudSourceForDevice' AS streams_from_relay FROM t)"""


@query("q_rte_1_routing", f"WITH {ROUTES} SELECT store_type, streams_to_relay, receives_from_relay, accepts_device_updates, streams_from_relay FROM m")
def routing_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subs.routing(spark)


@query("q_rte_2_routed", f"WITH {ROUTES} SELECT event_id, store_type FROM events JOIN m ON i = user_id % 8 WHERE streams_to_relay OR streams_from_relay")
def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the stores whose topology sends them across the relay."""
    types = F.element_at(F.array(*(F.lit(t) for t in subs.STORE_TYPES)), (F.col("user_id") % 8 + 1).cast("int"))
    rows = events(spark, sf_dir).select("event_id", types.alias("store_type"))
    return rows.join(F.broadcast(subs.routing(spark)), "store_type").filter("streams_to_relay OR streams_from_relay").select("event_id", "store_type")


@query("q_pol_1_policy", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'error') AND event_type NOT IN ('error')")
def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda *names: spark.createDataFrame([(n,) for n in names], "event_type string")
    return subs.policy_allows(events(spark, sf_dir).select("event_id", "event_type"), named("view", "click", "error"), named("error"), "event_type").select("event_id", "event_type")
