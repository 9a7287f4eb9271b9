"""Queries over delivery, sessions, the data plane, the codec and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec, records
from ..functions import envelopes as wire_envelopes
from ..functions import packets as wire
from ..functions.schema import check_schema_compat
from ..operators import dataplane, delivery, fold, rpc, subs
from ..sources.tables import spread
from .catalogue import query
from .routes import ORDER, PATHS, WANTED, changed_paths, counts, lifecycle, wanted_paths
from .state import LOG, event_log, events

HOUR = 3_600_000_000


def micros(c: str = "ts") -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


@query(
    "q_vwr_1_delivery",
    f"""WITH {PATHS}, {WANTED}
SELECT p.viewer, p.t AS store, count(*) AS n, max(event_id) AS last_event FROM p JOIN s ON s.viewer = p.viewer AND s.t = p.t WHERE s.u IS NULL OR NOT deep OR s.u = p.u GROUP BY ALL""",
)
def viewer_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each viewer gets of the changes that affect a subscription of theirs, once each."""
    from ..operators import paths

    got = paths.affects(changed_paths(spark, sf_dir), wanted_paths(spark, sf_dir), ["viewer"]).select("viewer", "event_id", F.get("path", F.lit(0)).alias("store")).distinct()
    return got.groupBy("viewer", "store").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))


@query(
    "q_vwr_2_full_fallback",
    """SELECT user_id % 8 AS viewer, user_id, CASE WHEN bool_and(value >= 1) THEN 'keyed' ELSE 'full' END AS mode, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY ALL""",
)
def full_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed snapshots if every key of a viewer can be built, else the full state."""
    rows = events(spark, sf_dir).filter("event_type <> 'signup'").groupBy((F.col("user_id") % 8).alias("viewer"), "user_id")
    return rows.agg(F.when(F.bool_and(F.col("value") >= 1), "keyed").otherwise("full").alias("mode"), F.count(F.lit(1)).alias("n"))


@query(
    "q_vwr_3_viewer_fallback",
    f"""WITH {LOG},
x AS (SELECT *, max(CASE WHEN op IN ('whole', 'delete') THEN seq ELSE 0 END) OVER (PARTITION BY ent) AS mask FROM ops),
alive AS (SELECT DISTINCT ent, leaf FROM x WHERE op = 'leaf' AND seq > mask),
wanted AS (SELECT DISTINCT user_id % 40 AS viewer, user_id AS ent, event_type AS leaf FROM events WHERE event_type IN ('view', 'purchase') AND event_id % 9 = user_id % 9)
SELECT viewer, count(*) AS n_keys, CASE WHEN count(alive.ent) = count(*) THEN 'keyed' ELSE 'full' END AS mode FROM wanted LEFT JOIN alive ON alive.ent = wanted.ent AND alive.leaf = wanted.leaf GROUP BY viewer""",
)
def viewer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key of a viewer that cannot be built gives that viewer the full state."""
    wants = F.col("event_type").isin("view", "purchase") & (F.col("event_id") % 9 == F.col("user_id") % 9)
    wanted = events(spark, sf_dir).filter(wants).select((F.col("user_id") % 40).alias("viewer"), F.col("user_id").alias("ent"), F.col("event_type").alias("leaf"))
    return delivery.snapshot_modes(wanted, fold.current_state(event_log(spark, sf_dir), ["ent"]), ["viewer"], ["ent", "leaf"])


_KIND = "CASE event_type WHEN 'signup' THEN 'subscribe' WHEN 'error' THEN 'cancel' WHEN 'purchase' THEN 'baseline' ELSE 'live' END"


@query(
    "q_cat_2_bounded",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT user_id, n, event_id, CASE kind WHEN 'subscribe' THEN 1 ELSE 0 END AS waiting, CAST([] AS BIGINT[]) AS held, false AS dead,
    CASE WHEN kind IN ('live', 'baseline') THEN [event_id] ELSE CAST([] AS BIGINT[]) END AS sent, false AS over FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, e.event_id,
    CASE e.kind WHEN 'subscribe' THEN waiting + 1 WHEN 'live' THEN waiting ELSE greatest(0, waiting - 1) END,
    CASE WHEN e.kind = 'live' AND waiting > 0 THEN list_append(held, e.event_id) WHEN e.kind IN ('baseline', 'cancel') AND waiting <= 1 THEN CAST([] AS BIGINT[]) ELSE held END,
    dead OR over,
    CASE WHEN dead OR over THEN CAST([] AS BIGINT[]) WHEN e.kind = 'baseline' THEN CASE WHEN waiting = 1 THEN list_concat([e.event_id], held) ELSE [e.event_id] END
      WHEN e.kind = 'live' AND (waiting = 0 OR len(held) >= 3) THEN [e.event_id] ELSE CAST([] AS BIGINT[]) END,
    e.kind = 'live' AND waiting > 0 AND len(held) >= 3
  FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1),
s AS (SELECT user_id, n, over AND NOT dead AS over, unnest(sent) AS event_id, generate_subscripts(sent, 1) AS i FROM r)
SELECT user_id, event_id, over AS overflow, row_number() OVER (PARTITION BY user_id ORDER BY n, i) AS position FROM s""",
)
def catch_up_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live rows wait for baselines, three at most; a cancelled wait drops them."""
    kind = F.when(F.col("event_type") == "signup", "subscribe").when(F.col("event_type") == "error", "cancel").when(F.col("event_type") == "purchase", "baseline").otherwise("live")
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts", kind.alias("kind"))
    return delivery.catch_up(rows, ["user_id"], ORDER, most=3).select("user_id", "event_id", "overflow", "position")


@query(
    "q_cat_1_catch_up",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END, ts, event_id) AS position FROM events",
)
def catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.catch_up_first(events(spark, sf_dir), ["user_id"], F.col("event_type") == "signup", ORDER).select("user_id", "event_id", "position")


@query(
    "q_deb_1_debounce",
    """WITH RECURSIVE r AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, t, n, t AS anchor FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.t, r.n, CASE WHEN r.t >= f.anchor + 21600000000 THEN r.t ELSE f.anchor END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT user_id, anchor, count(*) AS n FROM f GROUP BY ALL""",
)
def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours from a user's first event on, not extended by later ones."""
    rows = events(spark, sf_dir).select("user_id", "event_id", micros().alias("at"))
    return delivery.anchored_windows(rows, ["user_id"], "at", "event_id", 6 * HOUR).groupBy("user_id", "anchor").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_buf_1_admission",
    """WITH w AS (SELECT user_id, event_id, count(*) OVER p AS n, sum(octet_length(encode(props))) OVER p AS b FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT user_id, min(n) AS k FROM w WHERE n > 40 OR b > 300 GROUP BY user_id)
SELECT w.user_id, count(*) FILTER (k IS NULL OR n < k) AS admitted, count(*) FILTER (n = k) AS overflows FROM w LEFT JOIN f ON f.user_id = w.user_id GROUP BY w.user_id""",
)
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = delivery.admitted(events(spark, sf_dir), ["user_id"], ORDER, F.octet_length("props"), 40, 300)
    return rows.groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.count_if("overflow").alias("overflows"))


@query(
    "q_ses_1_detached",
    """WITH s AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM events)
SELECT user_id, event_id FROM s WHERE coalesce(later, 0) = 0""",
)
def detached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a detached session holds: its last full state and the patches after it."""
    return delivery.since_full(events(spark, sf_dir), ["user_id"], ORDER, F.col("event_type") == "signup").select("user_id", "event_id")


@query(
    "q_ses_2_flush_order",
    "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END, event_type, ts, event_id) AS place FROM events",
)
def flush_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores by name, then events, then endpoints."""
    rank = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).otherwise(0)
    w = Window.partitionBy("user_id").orderBy(rank, "event_type", *ORDER)
    return events(spark, sf_dir).select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query(
    "q_ses_3_manifest",
    """WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 7 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 5 = 0)
SELECT *, 'start' AS action FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'stop' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = events(spark, sf_dir), ["user_id", "event_type"]
    return delivery.manifest_changes(rows.filter("event_id % 7 = 0").select(*keys), rows.filter("event_id % 5 = 0").select(*keys), keys)


@query(
    "q_ses_4_episodes",
    """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 43200000000 THEN 1 ELSE 0 END AS f FROM events),
e AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS episode FROM g)
SELECT user_id, CAST(episode AS BIGINT) AS episode, count(*) AS n, min(event_id) AS low FROM e GROUP BY ALL""",
)
def session_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", micros().alias("at"))
    return delivery.episodes(rows, ["user_id"], "at", ["event_id"], 12 * HOUR).groupBy("user_id", "episode").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("low"))


@query(
    "q_ses_5_manifest",
    """WITH a AS (SELECT DISTINCT user_id, event_type, event_id % 3 AS k FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type, event_id % 3 AS k FROM events WHERE event_id % 2 = 1)
SELECT *, 'start' AS action FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'stop' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def manifest_by_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests, of the even events and of the odd ones."""
    keys = ["user_id", "event_type", "k"]
    rows = events(spark, sf_dir).withColumn("k", F.col("event_id") % 3)
    return delivery.manifest_changes(rows.filter("event_id % 2 = 0").select(*keys), rows.filter("event_id % 2 = 1").select(*keys), keys)


@query(
    "q_ses_6_detached_bytes",
    """WITH s AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM events),
b AS (SELECT *, sum(octet_length(encode(props))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bytes FROM s WHERE coalesce(later, 0) = 0)
SELECT user_id, count(*) FILTER (bytes <= 200) AS held, max(bytes) > 200 AS overflow FROM b GROUP BY user_id""",
)
def detached_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detached session holds what follows its last full state, up to a bound of bytes."""
    rows = delivery.since_full(events(spark, sf_dir), ["user_id"], ORDER, F.col("event_type") == "signup")
    rows = delivery.admitted(rows, ["user_id"], ORDER, F.octet_length("props"), 1 << 30, 200)
    return rows.groupBy("user_id").agg(F.count_if("admitted").alias("held"), F.bool_or("overflow").alias("overflow"))


@query(
    "q_ses_7_lifecycle",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type IN ('signup', 'view') AS attach, event_id % 4 AS late, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
    sum(CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events),
r AS (
  SELECT user_id, k, t, n, attach, CASE WHEN attach THEN 'on' ELSE 'none' END AS state, t AS since, attach AS created, false AS was_closed, CAST(NULL AS BIGINT) AS closed_at, CAST(NULL AS BIGINT) AS closed_n, false AS detached FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.k, e.t, e.n, e.attach,
    CASE WHEN e.attach THEN 'on' WHEN state = 'on' AND e.late <> 0 AND e.n > 0 THEN 'off' ELSE state END,
    CASE WHEN e.attach OR (state = 'on' AND e.late <> 0) THEN e.t ELSE since END,
    e.attach AND (state = 'none' OR state = 'off' AND e.t - since >= 43200000000),
    e.attach AND state = 'off' AND e.t - since >= 43200000000,
    CASE WHEN e.attach AND state = 'off' AND e.t - since >= 43200000000 THEN since + 43200000000 END,
    r.n,
    NOT e.attach AND state = 'on' AND e.late <> 0
  FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1),
last AS (SELECT user_id, arg_max(state, k) AS state, arg_max(since, k) AS since, arg_max(n, k) AS n FROM r GROUP BY user_id)
SELECT user_id, CAST(n AS BIGINT) AS n, t AS "at", 'created' AS change, '' AS reason FROM r WHERE created
UNION ALL SELECT user_id, CAST(n AS BIGINT), t, 'attached', '' FROM r WHERE attach
UNION ALL SELECT user_id, CAST(n AS BIGINT), t, 'detached', '' FROM r WHERE detached
UNION ALL SELECT user_id, CAST(closed_n AS BIGINT), closed_at, 'closed', 'expired' FROM r WHERE was_closed
UNION ALL SELECT user_id, CAST(n AS BIGINT), since + 43200000000, 'closed', 'expired' FROM last WHERE state = 'off'""",
)
def lifecycle_of_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups and views attach, the others detach, every fourth of them with a stale generation."""
    w = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    attach = F.col("event_type").isin("signup", "view")
    rows = events(spark, sf_dir).withColumn("g", F.sum(attach.cast("long")).over(w))
    rows = rows.select("user_id", "event_id", micros().alias("at"), F.when(attach, "attach").otherwise("detach").alias("kind"), F.when(F.col("event_id") % 4 == 0, F.col("g") - 1).otherwise(F.col("g")).alias("generation"))
    return delivery.session_lifecycle(rows, ["user_id"], "at", ["event_id"], 12 * HOUR)


@query(
    "q_ond_1_generations",
    f"""WITH {counts('user_id')}, g AS (SELECT *, sum(CASE WHEN before = 0 AND n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS generation FROM b)
SELECT user_id, event_id, CAST(generation AS BIGINT) AS generation, n > 0 AS streaming FROM g WHERE event_type = 'click'""",
)
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generation that a patch falls in, and whether anyone is subscribed then."""
    return with_generation(spark, sf_dir).filter("event_type = 'click'").select("user_id", "event_id", "generation", (F.col("count") > 0).alias("streaming"))


def with_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = subs.counted(lifecycle(spark, sf_dir), ["user_id"], ORDER)
    return c.withColumn("generation", F.sum(((F.col("before") == 0) & (F.col("count") == 1)).cast("long")).over(w))


@query(
    "q_ond_2_stale",
    f"""WITH {counts('user_id')}, g AS (SELECT *, sum(CASE WHEN before = 0 AND n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS generation FROM b),
s AS (SELECT *, lead(generation, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sent_in, lead(n, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sent_n FROM g)
SELECT user_id, event_id FROM s WHERE n > 0 AND sent_n > 0 AND sent_in = generation""",
)
def still_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that leave the queue three rows later, in the generation that queued them."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    g = with_generation(spark, sf_dir).withColumn("sent_in", F.lead("generation", 3).over(w)).withColumn("sent_n", F.lead("count", 3).over(w))
    return g.filter("count > 0 AND sent_n > 0 AND sent_in = generation").select("user_id", "event_id")


def envelopes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Order lines as envelopes, some of them broken."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return line.select(
        "l_orderkey", "l_linenumber", *more,
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("order-"), k.cast("string"))).alias("stream_id"),
        (k % 13).alias("generation"), (n % 7).cast("long").alias("sequence"), F.lit(1).cast("long").alias("frame_id"),
        F.when(k % 3 == 0, 1).when(k % 17 == 0, 9).otherwise(2).alias("payload_type"), ((k + n) % 9).cast("int").alias("flags"), F.col("l_returnflag").alias("format"),
        F.when(k % 3 == 0, 0).otherwise(n).cast("long").alias("first_index"), F.when(k % 3 == 0, 0).otherwise(1).cast("long").alias("item_count"),
        F.when(k % 3 == 0, 0).otherwise(5).cast("long").alias("total_item_count"), F.when(n == 4, F.lit("")).otherwise(F.col("l_linestatus")).cast("binary").alias("payload"),
    )


ENVELOPES = """v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE 'order-' || l_orderkey END AS sid, l_orderkey % 13 AS gen, l_linenumber % 7 AS seq,
  CASE WHEN l_orderkey % 3 = 0 THEN 1 WHEN l_orderkey % 17 = 0 THEN 9 ELSE 2 END AS pt, CAST((l_orderkey + l_linenumber) % 9 AS INTEGER) AS fl, l_returnflag AS fm,
  CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_linenumber END AS fi, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 1 END AS ic, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 5 END AS tc,
  CASE WHEN l_linenumber = 4 THEN '' ELSE l_linestatus END AS pl FROM lineitem)"""


@query(
    "q_env_1_validate",
    f"""WITH {ENVELOPES}, e AS (SELECT CASE WHEN sid = '' THEN 'no stream id' WHEN gen = 0 THEN 'generation zero' WHEN seq = 0 THEN 'sequence zero' WHEN fm = '' THEN 'no format' WHEN fl > 7 THEN 'unknown flags'
  WHEN pt = 1 AND (fl & 4) <> 0 THEN 'frame commits' WHEN pt = 1 AND pl = '' THEN 'frame empty' WHEN pt = 2 AND (fl & 1) <> 0 THEN 'block set recovers'
  WHEN pt = 2 AND (fl & 4) <> 0 THEN 'commit has a range or payload' WHEN pt = 2 AND fi + ic > tc THEN 'range beyond total' WHEN pt = 2 AND pl = '' THEN 'block empty' WHEN pt = 9 THEN 'unknown payload type' END AS error FROM v)
SELECT coalesce(error, 'valid') AS error, count(*) AS n FROM e GROUP BY ALL""",
)
def envelope_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes(spark, sf_dir).groupBy(F.coalesce(dataplane.envelope_error(), F.lit("valid")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("q_env_2_size", f"WITH {ENVELOPES} SELECT fm AS format, CAST(sum(60 + length(sid) + length(fm) + length(pl)) AS BIGINT) AS bytes FROM v GROUP BY ALL")
def envelope_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes(spark, sf_dir).groupBy("format").agg(F.sum(dataplane.encoded_size()).cast("long").alias("bytes"))


@query("q_env_3_stream_id", "SELECT c_custkey, 'stream:' || sha256(length(c_name) || ':' || c_name || length(c_mktsegment) || ':' || c_mktsegment) AS stream_id FROM customer")
def stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", dataplane.stream_id("stream:", F.col("c_name"), F.col("c_mktsegment")).alias("stream_id"))


MAGIC = b"ENV1"
_KEYED = ENVELOPES.replace(" FROM lineitem)", ", l_partkey FROM lineitem)")


@query(
    "q_env_4_bytes",
    f"""WITH {_KEYED}, w AS (SELECT *, l_partkey % 7 AS damage FROM v),
e AS (SELECT *, CASE WHEN sid = '' OR gen = 0 OR seq = 0 OR fl > 7 OR (pt = 1 AND ((fl & 4) <> 0 OR pl = '')) OR (pt = 2 AND ((fl & 1) <> 0 OR (fl & 4) <> 0 OR fi + ic > tc OR pl = '')) OR pt = 9 THEN 'not written'
  WHEN damage = 1 THEN 'truncated' WHEN damage = 2 THEN 'length differs' WHEN damage = 3 THEN 'unknown format' WHEN damage = 4 THEN 'reserved bits' END AS error FROM w)
SELECT l_orderkey, l_linenumber, error, CASE WHEN error IS NULL THEN sid END AS stream_id, CASE WHEN error IS NULL THEN gen END AS generation, CASE WHEN error IS NULL THEN l_orderkey * -1000 END AS ts_nanos,
  CASE WHEN error IS NULL THEN fi END AS first_index, CASE WHEN error IS NULL THEN fl END AS flags, CASE WHEN error IS NULL THEN pl END AS payload,
  CASE WHEN error IS DISTINCT FROM 'not written' THEN CAST(60 + length(sid) + length(fm) + length(pl) AS INTEGER) END AS size FROM e""",
)
def envelope_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes written and read again: of seven, one cut short, one with a byte too many, one of another format, one with reserved bits set."""
    rows = envelopes(spark, sf_dir, "l_partkey").withColumn("ts_nanos", F.col("l_orderkey") * -1000)
    raw, damage = F.col("raw"), F.col("l_partkey") % 7
    damaged = (
        F.when(damage == 1, F.substring(raw, 1, 59)).when(damage == 2, F.concat(raw, F.lit(b"x"))).when(damage == 3, F.concat(F.lit(b"OLD0"), F.substring(raw, F.lit(5), F.octet_length(raw))))
        .when(damage == 4, F.concat(F.substring(raw, 1, 6), F.lit(b"\x01\x00"), F.substring(raw, F.lit(9), F.octet_length(raw)))).otherwise(raw)
    )
    sent = rows.select("l_orderkey", "l_linenumber", "l_partkey", wire_envelopes.encode(MAGIC).alias("raw"))
    sent = sent.select("l_orderkey", "l_linenumber", F.octet_length("raw").alias("size"), damaged.alias("raw"))
    got = wire_envelopes.decoded(sent, "raw", MAGIC)
    error = F.when(F.col("raw").isNull(), "not written").otherwise(F.col("error"))
    kept = lambda c: F.when(F.col("raw").isNotNull(), F.col(c))
    return got.select(
        "l_orderkey", "l_linenumber", error.alias("error"), *(kept(c).alias(c) for c in ("stream_id", "generation", "ts_nanos", "first_index", "flags")), kept("payload").cast("string").alias("payload"), "size"
    )


@query(
    "q_env_5_identity",
    """WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END AS store, CASE WHEN c_custkey % 5 = 0 THEN repeat(c_mktsegment, 40) ELSE c_mktsegment END AS stream, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'k' END AS k FROM customer)
SELECT c_custkey, CASE WHEN trim(store) = '' THEN 'no store name' WHEN k = '' THEN 'no key' WHEN length(stream) > 256 THEN 'stream name too long' END AS error, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 4) * 1000 END AS expires_ms FROM s""",
)
def stream_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of streams, some of them incomplete or too long, and when their endpoints expire."""
    k, c = F.col("c_custkey"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    store, stream = F.when(k % 7 == 0, " ").otherwise(F.col("c_name")), F.when(k % 5 == 0, F.repeat("c_mktsegment", 40)).otherwise(F.col("c_mktsegment"))
    error = wire_envelopes.subscription_error(store, stream, F.when(k % 3 == 0, "").otherwise("k"))
    return c.select("c_custkey", error.alias("error"), F.unix_millis(wire_envelopes.expires_at(k % 4 * 1000)).alias("expires_ms"))


@query(
    "q_blk_2_published",
    """WITH e AS (SELECT user_id % 20 AS stream, event_id AS seq, event_id // 400 - CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS gen, event_id // 40 AS frame, event_id % 89 = 0 AS breaks, event_type = 'purchase' AS commits, user_id % 3 AS fi FROM events),
f AS (SELECT * FROM (SELECT *, max(gen) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS newest FROM e) WHERE gen = newest),
p AS (SELECT *, sum(CASE WHEN breaks THEN 1 ELSE 0 END) OVER (PARTITION BY stream, gen ORDER BY seq ROWS UNBOUNDED PRECEDING) AS epoch FROM f),
c AS (SELECT stream, gen, epoch, frame, min(seq) AS seq FROM p WHERE commits GROUP BY ALL)
SELECT c.stream, c.gen AS generation, CAST(c.epoch AS BIGINT) AS epoch, c.frame AS frame_id, c.seq AS sequence, count(DISTINCT p.fi) AS covered, CAST(3 AS BIGINT) AS total, count(DISTINCT p.fi) = 3 AS published
FROM c LEFT JOIN p ON p.stream = c.stream AND p.gen = c.gen AND p.epoch = c.epoch AND p.frame = c.frame AND NOT p.commits AND p.seq < c.seq GROUP BY ALL""",
)
def published_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as blocks of three items a frame, purchases commit; some rows are of an old generation, some mark a discontinuity."""
    n = F.col("event_id")
    flags = F.when(F.col("event_type") == "purchase", dataplane.COMMIT).otherwise(0) + F.when(n % 89 == 0, dataplane.DISCONTINUITY).otherwise(0)
    rows = events(spark, sf_dir).select(
        (F.col("user_id") % 20).alias("stream"), n.alias("sequence"), (F.floor(n / 400) - F.when(n % 97 == 0, 1).otherwise(0)).alias("generation"), F.floor(n / 40).alias("frame_id"),
        F.lit(dataplane.BLOCK_SET).alias("payload_type"), flags.alias("flags"), (F.col("user_id") % 3).alias("first_index"), F.lit(1).alias("item_count"), F.lit(3).alias("total_item_count"),
    )
    return dataplane.published_sets(rows, ["stream"])


@query(
    "q_blk_1_complete",
    """SELECT l_orderkey, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS covered, CAST(max(l_linenumber) AS BIGINT) AS total, count(DISTINCT l_linenumber) = max(l_linenumber) AS complete FROM lineitem GROUP BY l_orderkey""",
)
def block_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's lines, each a block of one item, are all there up to the highest."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_linenumber") - 1).alias("first_index"), F.lit(1).alias("item_count"))
    top = line.withColumn("total_item_count", F.max(F.col("first_index") + 1).over(Window.partitionBy("l_orderkey")))
    return dataplane.complete_sets(top, ["l_orderkey"])


@query(
    "q_sch_1_recovery_gate",
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT *, coalesce(max(CASE WHEN event_type = 'error' THEN k END) OVER w, 0) AS lost, coalesce(max(CASE WHEN event_type = 'signup' THEN k END) OVER w, 0) AS found FROM n
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id FROM g WHERE event_type = 'signup' OR (lost <= found AND event_type <> 'error')""",
)
def recovery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return dataplane.gated(events(spark, sf_dir), ["user_id"], ORDER, kind == "error", kind == "signup").filter("accepted").select("user_id", "event_id")


@query(
    "q_sch_3_full_queue",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type IN ('signup', 'view') AS recovers, event_id % 2 = 0 AS marked, event_id % 5 = 0 AS no_room, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (
  SELECT user_id, event_id, k, no_room AS needs, NOT no_room AS taken FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.k, CASE WHEN needs AND NOT (recovers AND marked) THEN true ELSE no_room END, NOT no_room AND (NOT needs OR (recovers AND marked)) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id FROM r WHERE taken""",
)
def full_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a frame that found no room, only a recovery frame that marks a discontinuity and fits itself goes on."""
    resumes = F.col("event_type").isin("signup", "view") & (F.col("event_id") % 2 == 0)
    return dataplane.gated(events(spark, sf_dir), ["user_id"], ORDER, F.col("event_id") % 5 == 0, resumes).filter("accepted").select("user_id", "event_id")


@query(
    "q_sch_2_drain_order",
    """WITH u AS (SELECT l_orderkey % 50 AS uplink, l_suppkey % 5 AS stream, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS unit, CAST(floor(l_quantity * 1000) AS BIGINT) AS size, l_suppkey % 5 + 1 AS weight FROM lineitem),
k AS (SELECT *, row_number() OVER w AS k, sum(size) OVER w AS s FROM u WINDOW w AS (PARTITION BY uplink, stream ORDER BY unit ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, k + max(ceil(s / (weight * 16384.0)) - k) OVER (PARTITION BY uplink, stream ORDER BY unit ROWS UNBOUNDED PRECEDING) AS visit FROM k)
SELECT uplink, unit, row_number() OVER (PARTITION BY uplink ORDER BY visit, stream, unit) AS turn FROM v""",
)
def drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, size = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.floor(F.col("l_quantity") * 1000)
    stream = F.col("l_suppkey") % 5
    units = line.select((F.col("l_orderkey") % 50).alias("uplink"), stream.alias("stream"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("unit"), size.alias("size"), (stream + 1).alias("weight"))
    return dataplane.drain_order(units, ["uplink"]).select("uplink", "unit", "turn")


_SIZES = "CASE WHEN abs(v) < 64 THEN 1 WHEN abs(v) < 8192 THEN 2 WHEN abs(v) < 268435456 THEN 4 WHEN abs(v) < 576460752303423488 THEN 8 ELSE 9 END"
_VALUES = "SELECT CAST(l_orderkey * l_partkey * (l_linenumber - 3) * (CASE WHEN l_suppkey % 3 = 0 THEN 100000007 ELSE 1 END) AS BIGINT) AS v FROM lineitem"


def codec_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all sizes; null where the product is beyond a long, so that no packed integer holds it."""
    n = (F.col("l_linenumber") - 3).cast("long") * F.when(F.col("l_suppkey") % 3 == 0, 100000007).otherwise(1)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.try_multiply(F.try_multiply(n, F.col("l_partkey")), F.col("l_orderkey")).alias("v"))


@query("q_cod_1_packed_size", f"SELECT CAST({_SIZES} AS INTEGER) AS size, count(*) AS n FROM ({_VALUES}) GROUP BY ALL")
def packed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_values(spark, sf_dir).groupBy(codec.packed_size(F.col("v")).alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("q_cod_2_round_trip", f"SELECT CAST({_SIZES} AS INTEGER) AS size, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM ({_VALUES}) GROUP BY ALL")
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed integers written and read again; numbers that cannot be written are counted under the size null."""
    rows = codec_values(spark, sf_dir).withColumn("raw", codec.packed(wire.apart(F.col("v"))))
    rows = rows.select(F.octet_length("raw").alias("size"), (codec.unpacked(wire.apart(F.col("raw"))) != F.col("v")).alias("differs"))
    return rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count_if("differs").alias("mismatches"))


@query("q_pkt_1_packets", "SELECT event_id, 5 AS kind, event_id AS call_id, event_type AS name, user_id % 256 AS access, CAST(CAST(length(props) AS BIGINT) AS BIGINT) AS payload_bytes, CASE WHEN event_id % 10 = 0 THEN 'length differs' END AS error FROM events")
def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call packets written and read again, every tenth with a byte too many."""
    raw = codec.call_packet(F.col("event_id"), F.col("event_type"), F.col("user_id") % 256, F.col("props").cast("binary"))
    raw = F.when(F.col("event_id") % 10 == 0, F.concat(raw, F.lit(b"\x00"))).otherwise(raw)
    rows = events(spark, sf_dir).select("event_id", "props", codec.call_fields(raw).alias("p"))
    extra = (F.col("event_id") % 10 == 0).cast("int")
    return rows.select("event_id", F.col("p.kind").cast("int").alias("kind"), "p.call_id", "p.name", "p.access", (F.octet_length("p.payload") - extra).cast("long").alias("payload_bytes"), "p.error")


#: The record that q_cod_3 writes and reads.
NOTE = T.StructType([
    T.StructField("id", T.LongType(), True, {"fID": 1}),
    T.StructField("name", T.StringType(), True, {"fID": 2}),
    T.StructField("at", T.TimestampType(), True, {"fID": 3}),
    T.StructField("pair", T.ArrayType(T.LongType()), True, {"fID": 4}),
    T.StructField("tags", T.MapType(T.StringType(), T.LongType()), True, {"fID": 5}),
    T.StructField("maybe", T.LongType(), True, {"fID": 6, "optional": True}),
])


@query(
    "q_cod_3_records",
    """SELECT event_id AS id, event_type AS name, epoch_us(ts) // 1000 AS at_ms, event_id AS first, -user_id AS second, user_id AS tag, CASE WHEN event_id % 2 = 1 THEN event_id % 4 - 1 END AS maybe,
CAST(NULL AS VARCHAR) AS error FROM events""",
)
def record_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fielded records with a list, a map and an optional value, written and read again."""
    value = F.struct(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("name"),
        F.col("ts").cast("timestamp").alias("at"),
        F.array("event_id", -F.col("user_id")).alias("pair"),
        F.create_map("event_type", "user_id").alias("tags"),
        F.when(F.col("event_id") % 2 == 1, F.col("event_id") % 4 - 1).alias("maybe"),
    )
    raw = spread(events(spark, sf_dir)).select(records.record(value, NOTE).alias("raw"))
    p = raw.select(records.decode(F.col("raw"), NOTE).alias("p")).select("p.value.*", "p.error")
    return p.select(
        "id", "name", F.unix_millis("at").alias("at_ms"), F.get("pair", F.lit(0)).alias("first"), F.get("pair", F.lit(1)).alias("second"),
        F.try_element_at("tags", F.col("name")).alias("tag"), "maybe", "error",
    )


_KINDS = ", ".join(map(str, wire.LAYOUTS))


@query(
    "q_pkt_2_kinds",
    f"""WITH k AS (SELECT *, list_extract([{_KINDS}], CAST(event_id % {len(wire.LAYOUTS)} + 1 AS INTEGER)) AS kind, event_id % 5 AS damage FROM events),
e AS (SELECT *, CASE WHEN damage = 1 THEN 'trailing bytes' WHEN damage = 2 THEN 'truncated' END AS error FROM k)
SELECT event_id, CAST(kind AS BIGINT) AS kind, error,
CASE WHEN error IS NULL AND kind IN (5, 6, 12, 13, 14, 15) THEN event_id + 1 END AS id,
CASE WHEN error IS NULL AND kind IN (2, 3, 7, 8, 9, 11, 13) THEN event_type END AS store,
CASE WHEN error IS NULL AND kind IN (4, 5, 8, 9, 10, 11, 13, 14, 255) THEN event_type || '%&' || user_id END AS name,
CASE WHEN error IS NULL AND kind IN (5, 10, 13) THEN user_id % 256 END AS access,
CASE WHEN error IS NULL AND kind IN (7, 9, 11, 13) THEN event_id % 2 END AS action,
CASE WHEN error IS NULL AND kind IN (2, 3, 4, 5, 6, 8, 10, 14, 15, 255) THEN props END AS payload,
CASE WHEN error IS NULL AND kind IN (1, 5) THEN event_type END AS note FROM e""",
)
def packet_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of every kind in turn, written and read again; of five, one with a byte too many and one cut short."""
    kind = F.get(F.array(*map(F.lit, wire.LAYOUTS)), (F.col("event_id") % len(wire.LAYOUTS)).cast("int"))
    fields = {
        "id": F.col("event_id") + 1,
        "version": F.lit(1),
        "store": F.col("event_type"),
        "name": F.concat("event_type", F.lit("%&"), F.col("user_id").cast("string")),
        "key": F.col("props"),
        "message": F.lit(""),
        "access": F.col("user_id") % 256,
        "action": F.col("event_id") % 2,
        "payload": F.col("props").cast("binary"),
        "metadata": F.create_map(F.lit("note"), F.col("event_type"), F.lit("at"), F.lit("")),
    }
    raw, damage = F.col("raw"), F.col("event_id") % 5
    rows = spread(events(spark, sf_dir)).select("event_id", wire.encode_any(kind, fields).alias("raw"))
    damaged = F.when(damage == 1, F.concat(raw, F.lit(b"\x00"))).when(damage == 2, F.substring(raw, F.lit(1), F.octet_length(raw) - 1)).otherwise(raw)
    p = rows.select("event_id", wire.decode(damaged).alias("p"))
    return p.select(
        "event_id", F.col("p.kind").cast("long").alias("kind"), "p.error", "p.id", "p.store", "p.name", "p.access", "p.action", F.col("p.payload").cast("string").alias("payload"),
        F.try_element_at("p.metadata", F.lit("note")).alias("note"),
    )


@query(
    "q_rpc_1_answers",
    """WITH c AS (SELECT event_id AS call_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'click'),
r AS (SELECT event_id AS response_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'view'),
p AS (SELECT call_id, response_id, row_number() OVER (PARTITION BY call_id ORDER BY r.at, response_id) AS k FROM c JOIN r ON r.user_id = c.user_id AND r.at >= c.at AND r.at <= c.at + 7200000000)
SELECT c.call_id, response_id, CASE WHEN response_id IS NULL THEN 'timeout' ELSE 'answered' END AS status FROM c LEFT JOIN p ON p.call_id = c.call_id AND k = 1""",
)
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "event_type", micros().alias("at"))
    calls = rows.filter("event_type = 'click'").select(F.col("event_id").alias("call_id"), "user_id", "at")
    responses = rows.filter("event_type = 'view'").select(F.col("event_id").alias("response_id"), "user_id", "at")
    return rpc.answered(calls, responses, ["user_id"], 2 * HOUR).select("call_id", "response_id", "status")


@query(
    "q_rpc_2_dispatch",
    """WITH h AS (SELECT * FROM (VALUES ('click', 2), ('view', NULL), ('purchase', 3)) v(name, least))
SELECT event_id, least IS NOT NULL OR name IS NOT NULL AS handled, CASE WHEN name IS NOT NULL AND user_id % 5 < coalesce(least, 0) THEN 'insufficient access' END AS error FROM events LEFT JOIN h ON name = event_type""",
)
def dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    handlers = spark.createDataFrame([("click", 2), ("view", None), ("purchase", 3)], "name string, min_access int")
    calls = events(spark, sf_dir).select("event_id", F.col("event_type").alias("name"), (F.col("user_id") % 5).alias("access"))
    return rpc.dispatch(calls, handlers).select("event_id", "handled", "error")


@query(
    "q_rpc_3_in_flight",
    """WITH i AS (SELECT user_id, epoch_us(ts) AS b, epoch_us(ts) + 3600000000 * (1 + event_id % 24) AS e FROM events),
d AS (SELECT user_id, b AS t, 1 AS d FROM i UNION ALL SELECT user_id, e, -1 FROM i),
s AS (SELECT user_id, t, sum(d) AS net FROM d GROUP BY ALL), r AS (SELECT user_id, sum(net) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT user_id, CAST(max(n) AS BIGINT) AS peak FROM r GROUP BY user_id""",
)
def in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", micros().alias("b"), (micros() + HOUR * (1 + F.col("event_id") % 24)).alias("e"))
    return rpc.in_flight(rows, ["user_id"], "b", "e")


@query("q_agg_1_queue", "SELECT event_type AS description, count(*) AS n FROM events GROUP BY ALL")
def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("description")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_agg_2_connections",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, count(*) AS packets, max(CASE WHEN k = 1 THEN event_type END) AS last_packet, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS open_us FROM l GROUP BY user_id""",
)
def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("at", micros())
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("packets"), F.max_by("event_type", F.struct("at", "event_id")).alias("last_packet"), (F.max("at") - F.min("at")).alias("open_us")
    )


@query(
    "q_scm_1_compat",
    """SELECT * FROM (VALUES ('S1', 'b', 'id changed'), ('S1', 'd', 'id reused'), ('S2', '', 'maximum falls')) v(struct, name, problem)""",
)
def schema_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of two structs: a changed id, a reused one, a lowered maximum."""
    kind = "struct string, name string, id int, max_field int"
    before = spark.createDataFrame([("S1", "a", 1, 3), ("S1", "b", 2, 3), ("S2", "x", 1, 2)], kind)
    after = spark.createDataFrame([("S1", "a", 1, 5), ("S1", "b", 4, 5), ("S1", "c", 5, 5), ("S1", "d", 3, 5), ("S2", "x", 1, 1)], kind)
    return check_schema_compat(before, after)
