"""Queries over packets that carry state, keyed events, greetings, and what is sent on connect and on attach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import packets as wire
from ..functions import patches as build
from ..functions import records
from ..operators import delivery, fold, registry, subs
from ..sources.tables import spread
from .catalogue import query
from .routes import ORDER, ROUTES, counts
from .state import LOG, event_log, events


@query(
    "q_app_6_packets",
    """WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq, CASE event_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'event' END AS kind FROM events),
x AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'trailing bytes' WHEN kind = 'event' THEN 'no state packet' WHEN event_type = 'error' THEN 'unknown store' END AS error FROM e),
g AS (SELECT * FROM x WHERE error IS NULL),
m AS (SELECT event_type, max(seq) AS mask FROM g WHERE kind = 'full' GROUP BY ALL),
s AS (SELECT g.event_type, user_id % 5 AS k, arg_max(event_id, seq) AS v FROM g LEFT JOIN m ON m.event_type = g.event_type WHERE seq >= coalesce(mask, 0) GROUP BY ALL)
SELECT event_type AS store, CAST(k AS VARCHAR) AS path, CAST(v AS BIGINT) AS n FROM s UNION ALL SELECT error, NULL, count(*) FROM x WHERE error IS NOT NULL GROUP BY error""",
)
def packets_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full and partial states as packets, some damaged, some of a store that is not registered: the states, and the errors counted."""
    n = F.col("event_id")
    kind = F.when(n % 3 == 0, registry.FULL_STATE).when(n % 3 == 1, registry.PARTIAL_STATE).otherwise(4)
    payload = F.concat_ws(":", (F.col("user_id") % 5).cast("string"), n.cast("string")).cast("binary")
    raw = wire.encode_any(kind, {"store": F.col("event_type"), "name": F.col("event_type"), "payload": payload, "id": F.lit(1), "action": F.lit(0)})
    rows = events(spark, sf_dir).select(F.struct("ts", "event_id").alias("seq"), F.when(n % 13 == 0, F.concat(raw, F.lit(b"\x00"))).otherwise(raw).alias("raw"))
    stores = spark.createDataFrame([("signup",), ("view",), ("click",), ("purchase",)], "store string")
    got = registry.received(rows, "raw", stores)
    parts = lambda p: F.split(p.cast("string"), ":")
    log = registry.state_log(got, "seq", lambda p: build.set_leaf(build.path(F.get(parts(p), F.lit(0))), F.get(parts(p), F.lit(1)).cast("double")))
    state = fold.fold_paths(log, ["store"], depth=1).select("store", F.array_join("path", "/").alias("path"), F.col("value").cast("long").alias("n"))
    errors = got.filter("error IS NOT NULL").groupBy(F.col("error").alias("store")).agg(F.lit(None).cast("string").alias("path"), F.count(F.lit(1)).alias("n"))
    return state.union(errors)


_ON, _OFF = "'signup', 'view'", "'error'"


@query(
    "q_kev_2_opaque",
    f"WITH {counts('user_id % 7, event_id % 3', _ON, _OFF)} SELECT user_id % 7 AS store, event_id % 3 AS k, event_id, props AS payload FROM b WHERE event_type = 'purchase' AND n > 0",
)
def opaque_keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events already serialised go to the keys that someone listens to, their bytes untouched."""
    delta = F.when(F.col("event_type").isin("signup", "view"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    rows = events(spark, sf_dir).withColumn("delta", delta).withColumn("store", F.col("user_id") % 7).withColumn("k", F.col("event_id") % 3)
    rows = rows.withColumn("payload", F.col("props").cast("binary"))
    return subs.delivered(rows, ["store", "k"], ORDER, F.col("event_type") == "purchase").select("store", "k", "event_id", F.col("payload").cast("string").alias("payload"))


@query(
    "q_rte_3_on_connect",
    f"""WITH {ROUTES}, {LOG},
x AS (SELECT *, max(CASE WHEN op IN ('whole', 'delete') THEN seq ELSE 0 END) OVER (PARTITION BY ent) AS mask FROM ops),
w AS (SELECT *, row_number() OVER (PARTITION BY ent, leaf ORDER BY seq DESC) AS rn FROM x WHERE op = 'leaf' AND seq > mask)
SELECT ent, store_type, leaf, value FROM w JOIN m ON i = ent % 8 WHERE rn = 1 AND streams_to_relay""",
)
def sent_on_connect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full states of all stores that stream to the relay, as they are when it connects."""
    types = F.element_at(F.array(*(F.lit(t) for t in subs.STORE_TYPES)), (F.col("ent") % 8 + 1).cast("int"))
    state = fold.current_state(event_log(spark, sf_dir), ["ent"]).withColumn("store_type", types)
    return state.join(F.broadcast(subs.routing(spark)).filter("streams_to_relay"), "store_type", "left_semi").select("ent", "store_type", "leaf", "value")


@query(
    "q_ses_8_manifest_filter",
    """WITH m AS (SELECT DISTINCT user_id, event_id % 4 AS k FROM events WHERE event_type = 'view'),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM m WHERE m.user_id = events.user_id AND m.k = events.event_id % 4))
SELECT user_id, event_id, n AS place FROM s""",
)
def manifest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed events that a detached session buffered: those that the manifest it comes back with still wants, in order."""
    rows = events(spark, sf_dir).withColumn("k", F.col("event_id") % 4)
    manifest = rows.filter("event_type = 'view'").select("user_id", "k")
    kept = delivery.still_wanted(rows.filter("event_type = 'purchase'"), manifest, ["user_id", "k"])
    return kept.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)).cast("long").alias("place"))


#: Reserved keys of metadata by flag, as the caller names them.
FLAGS = {"on_demand": "app.onDemand", "streams": "app.streams"}


@query(
    "q_dev_1_greetings",
    """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'trailing bytes' WHEN c_custkey % 9 = 1 THEN 'truncated' END AS error, CASE WHEN c_custkey % 9 > 1 THEN c_name END AS device,
CASE WHEN c_custkey % 9 > 1 THEN CAST(c_custkey AS BIGINT) END AS version, c_custkey % 9 > 1 AND c_custkey % 2 = 0 AS on_demand, c_custkey % 9 > 1 AND c_custkey % 3 = 0 AS streams,
CASE WHEN c_custkey % 9 > 1 THEN c_mktsegment END AS segment FROM customer""",
)
def greetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greetings of devices with capability flags in their metadata, written and read again, some damaged."""
    k = F.col("c_custkey")
    metadata = wire.with_flags(F.create_map(F.lit("segment"), F.col("c_mktsegment")), {FLAGS["on_demand"]: k % 2 == 0, FLAGS["streams"]: k % 3 == 0})
    raw = wire.encode_greeting({"version": k, "device": F.col("c_name"), "auth_type": F.lit("key"), "auth_data": F.lit(b"x"), "metadata": metadata})
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", raw.alias("raw"))
    damaged = F.when(k % 9 == 0, F.concat("raw", F.lit(b"\x00"))).when(k % 9 == 1, F.substring("raw", F.lit(1), F.octet_length("raw") - 1)).otherwise(F.col("raw"))
    g = rows.select("c_custkey", wire.decode_greeting(damaged).alias("g"))
    f = g.withColumn("f", wire.flags(F.col("g.metadata"), FLAGS))
    return f.select("c_custkey", "g.error", "g.device", "g.version", "f.on_demand", "f.streams", F.try_element_at("g.metadata", F.lit("segment")).alias("segment"))


_PLACE = T.StructType([T.StructField("x", T.DoubleType(), metadata={"fID": 1}), T.StructField("y", T.FloatType(), metadata={"fID": 2}), T.StructField("of", T.StringType(), metadata={"fID": 3})])
#: A record in a record, with floating point numbers and a list of them.
SAMPLE = T.StructType([
    T.StructField("id", T.LongType(), metadata={"fID": 1}),
    T.StructField("at", _PLACE, metadata={"fID": 2}),
    T.StructField("list", T.ArrayType(T.DoubleType()), metadata={"fID": 3}),
])


@query(
    "q_cod_4_floats",
    """SELECT event_id AS id, value / 3 AS x, CAST(CAST(value AS FLOAT) AS DOUBLE) AS y, event_type AS of_type, -value AS first, CAST(event_id AS DOUBLE) AS second, CAST(NULL AS VARCHAR) AS error FROM events""",
)
def float_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floating point numbers of both sizes in a record within a record, written and read again."""
    value = F.struct(
        F.col("event_id").alias("id"), F.struct((F.col("value") / 3).alias("x"), F.col("value").cast("float").alias("y"), F.col("event_type").alias("of")).alias("at"),
        F.array(-F.col("value"), F.col("event_id").cast("double")).alias("list"),
    )
    raw = spread(events(spark, sf_dir)).select(records.record(value, SAMPLE).alias("raw"))
    p = raw.select(records.decode(F.col("raw"), SAMPLE).alias("p")).select("p.value.*", "p.error")
    return p.select("id", "at.x", F.col("at.y").cast("double").alias("y"), F.col("at.of").alias("of_type"), F.get("list", F.lit(0)).alias("first"), F.get("list", F.lit(1)).alias("second"), "error")


DYNAMIC = {"text": T.StringType(), "number": T.DoubleType(), "counts": T.MapType(T.StringType(), T.LongType())}


@query(
    "q_cod_5_dynamic",
    """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'unknown type' WHEN event_id % 17 = 0 THEN 'trailing bytes' END AS error, CASE WHEN event_id % 17 > 0 AND event_id % 5 = 0 THEN event_type END AS text,
CASE WHEN event_id % 17 > 0 AND event_id % 5 IN (1, 2) THEN value END AS number, CASE WHEN event_id % 17 > 0 AND event_id % 5 = 3 THEN user_id END AS counted FROM events""",
)
def dynamic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that describe themselves: text, numbers, maps, and a type that the reader does not know."""
    n, k = F.col("event_id"), F.col("event_id") % 5
    raw = (
        F.when(k == 0, records.dynamic(F.col("event_type"), DYNAMIC["text"])).when(k.isin(1, 2), records.dynamic(F.col("value"), DYNAMIC["number"]))
        .when(k == 3, records.dynamic(F.create_map("event_type", "user_id"), DYNAMIC["counts"])).otherwise(records.dynamic(n % 2 == 0, T.BooleanType()))
    )
    rows = spread(events(spark, sf_dir)).select("event_id", "event_type", F.when(n % 17 == 0, F.concat(raw, F.lit(b"\x00"))).otherwise(raw).alias("raw"))
    p = rows.select("event_id", "event_type", records.read_dynamic(F.col("raw"), DYNAMIC).alias("p")).select("event_id", "event_type", "p.*")
    return p.select("event_id", "error", "text", "number", F.try_element_at("counts", F.col("event_type")).alias("counted"))
