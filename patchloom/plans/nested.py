"""Queries over nested patches: builders, merging, pruning, narrowing, arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patches as build
from ..operators import fold, patches
from ..sources.tables import parts_of
from .catalogue import query
from .state import events

FIELDS = ("quantity", "price", "tax")


def nested_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as patches of a map of maps: signup replaces all, some views replace one map, error deletes one, others set a value."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    kind, n = F.col("event_type"), F.col("event_id")
    value = (n % 2).cast("double")
    key = F.when(n % 11 == 0, F.lit("-1")).otherwise((n % 3).cast("string"))
    one = F.create_map(F.lit("0"), value)
    change = (
        F.when(kind == "signup", build.patch(build.clear(build.path()), build.set_leaf(build.path("view", "0"), F.lit(1.0))))
        .when(kind == "error", build.delete(F.array(F.get(F.array(F.lit("view"), F.lit("click"), F.lit("purchase")), (n % 3).cast("int")))))
        .when((kind == "view") & (n % 4 == 0), build.inside(build.path("view"), build.set_map(build.path(), one)))
        .otherwise(build.set_leaf(build.path(kind, key), value))
    )
    rows = events(spark, sf_dir)
    return rows.repartition(parts_of(rows), "user_id").withColumn("seq", at).select(F.col("user_id").alias("ent"), "seq", F.inline(change))


#: The same rows, plainly: p1 and p2 are the parts of the path, d its length.
NESTED = """e AS (SELECT user_id AS ent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id AS k, event_type AS t FROM events),
n AS (
  SELECT ent, seq, 'whole' AS op, NULL AS p1, NULL AS p2, 0 AS d, CAST(NULL AS DOUBLE) AS v FROM e WHERE t = 'signup'
  UNION ALL SELECT ent, seq, 'leaf', 'view', '0', 2, 1.0 FROM e WHERE t = 'signup'
  UNION ALL SELECT ent, seq, 'delete', ['view', 'click', 'purchase'][CAST(k % 3 + 1 AS INTEGER)], NULL, 1, NULL FROM e WHERE t = 'error'
  UNION ALL SELECT ent, seq, 'whole', 'view', NULL, 1, NULL FROM e WHERE t = 'view' AND k % 4 = 0
  UNION ALL SELECT ent, seq, 'leaf', 'view', '0', 2, CAST(k % 2 AS DOUBLE) FROM e WHERE t = 'view' AND k % 4 = 0
  UNION ALL SELECT ent, seq, 'leaf', t, CASE WHEN k % 11 = 0 THEN '-1' ELSE CAST(k % 3 AS VARCHAR) END, 2, CAST(k % 2 AS DOUBLE) FROM e WHERE t NOT IN ('signup', 'error') AND NOT (t = 'view' AND k % 4 = 0))"""
_COVERS = "(m.op = 'leaf' AND m.p1 = l.p1 AND m.p2 = l.p2 OR m.op <> 'leaf' AND (m.d = 0 OR m.d = 1 AND m.p1 = l.p1))"
_PATH = "coalesce(p1, '') || CASE WHEN d = 2 THEN '/' || p2 ELSE '' END AS path"


def shown(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("ent", "seq", "op", F.array_join("path", "/").alias("path"), "value", *more)


@query(
    "q_bld_1_built",
    f"WITH {NESTED} SELECT ent, CAST(seq AS BIGINT) AS seq, op, {_PATH}, v AS value FROM n",
)
def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(nested_log(spark, sf_dir))


@query(
    "q_app_5_nested",
    f"""WITH {NESTED}, life AS (SELECT * FROM n l WHERE op = 'leaf' AND NOT EXISTS (SELECT 1 FROM n m WHERE m.ent = l.ent AND m.seq > l.seq AND {_COVERS}))
SELECT ent, CAST(seq AS BIGINT) AS seq, op, {_PATH}, v AS value FROM life""",
)
def nested_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(fold.fold_paths(nested_log(spark, sf_dir), ["ent"], depth=2))


@query(
    "q_mrg_2_nested",
    f"""WITH {NESTED}, l AS (SELECT *, (seq - 1) // 5 AS chunk FROM n), m AS (SELECT * FROM l)
SELECT ent, CAST(chunk AS BIGINT) AS chunk, CAST(seq AS BIGINT) AS seq, op, {_PATH}, v AS value FROM l
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.ent = l.ent AND m.chunk = l.chunk AND m.seq > l.seq AND
  (m.op = 'leaf' AND l.op = 'leaf' AND m.p1 = l.p1 AND m.p2 = l.p2 OR m.op <> 'leaf' AND (m.d = 0 OR m.d = 1 AND l.d >= 1 AND m.p1 = l.p1)))""",
)
def nested_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every five patches of an entity merged into one."""
    log = nested_log(spark, sf_dir).withColumn("chunk", F.floor((F.col("seq") - 1) / 5))
    return shown(patches.merge_nested(log, ["ent", "chunk"], depth=2), "chunk")


@query(
    "q_pru_2_nested",
    f"""WITH {NESTED}, ok AS (SELECT * FROM n WHERE coalesce(p2, '') <> '-1'),
life AS (SELECT *, (SELECT min(m.seq) FROM ok m WHERE m.ent = l.ent AND m.seq > l.seq AND {_COVERS}) AS ended FROM ok l WHERE op = 'leaf'),
whole AS (SELECT * FROM ok WHERE op = 'whole'),
met AS (SELECT w.ent, w.seq, w.d, w.p1 AS wp, l.p1, l.p2, l.v, 1 AS side FROM whole w JOIN life l ON l.ent = w.ent AND l.seq < w.seq AND coalesce(l.ended, w.seq) >= w.seq AND (w.d = 0 OR w.p1 = l.p1)
  UNION ALL SELECT w.ent, w.seq, w.d, w.p1, l.p1, l.p2, l.v, 2 FROM whole w JOIN life l ON l.ent = w.ent AND l.seq = w.seq AND (w.d = 0 OR w.p1 = l.p1)),
differs AS (SELECT DISTINCT ent, seq FROM (SELECT ent, seq FROM met GROUP BY ent, seq, p1, p2 HAVING count(*) <> 2 OR min(v) <> max(v))),
kept AS (
  SELECT ok.* FROM ok JOIN differs USING (ent, seq)
  UNION ALL SELECT * FROM ok d WHERE op = 'delete' AND EXISTS (SELECT 1 FROM life l WHERE l.ent = d.ent AND l.seq < d.seq AND coalesce(l.ended, d.seq) >= d.seq AND l.p1 = d.p1)
  UNION ALL SELECT * FROM ok r WHERE op = 'leaf' AND NOT EXISTS (SELECT 1 FROM whole w WHERE w.ent = r.ent AND w.seq = r.seq)
    AND NOT EXISTS (SELECT 1 FROM life l WHERE l.ent = r.ent AND l.seq < r.seq AND coalesce(l.ended, r.seq) >= r.seq AND l.p1 = r.p1 AND l.p2 = r.p2 AND l.v = r.v))
SELECT ent, CAST(seq AS BIGINT) AS seq, op, {_PATH}, v AS value FROM kept""",
)
def nested_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches without what changes nothing: equal values, absent deletes, equal wholes, negative indexes."""
    return shown(patches.prune_nested(nested_log(spark, sf_dir), ["ent"], depth=2, index_depths=[2], parts=parts_of(events(spark, sf_dir))))


@query(
    "q_fil_2_narrow",
    f"""WITH {NESTED}, x AS (SELECT * FROM n),
w AS (SELECT 'view' AS a, '1' AS b UNION ALL SELECT 'click', NULL),
s AS (SELECT ent, seq, op, p1, p2, d, v FROM x WHERE d = 2 AND EXISTS (SELECT 1 FROM w WHERE a = p1 AND (b IS NULL OR b = p2))
  UNION SELECT ent, seq, op, p1, p2, d, v FROM x WHERE d = 1 AND op = 'delete' AND p1 IN ('view', 'click')
  UNION SELECT ent, seq, op, p1, p2, d, v FROM x WHERE d = 1 AND op = 'whole' AND p1 = 'click'
  UNION SELECT ent, seq, 'delete', 'view', '1', 2, NULL FROM x WHERE d = 1 AND op = 'whole' AND p1 = 'view'
  UNION SELECT ent, seq, 'whole', 'view', NULL, 1, NULL FROM x WHERE d = 0
  UNION SELECT ent, seq, 'leaf', 'view', '0', 2, 1.0 FROM x WHERE d = 0
  UNION SELECT ent, seq, 'delete', 'click', NULL, 1, NULL FROM x WHERE d = 0)
SELECT ent, CAST(seq AS BIGINT) AS seq, op, {_PATH}, v AS value FROM s""",
)
def nested_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What viewers of [view, 1] and of [click] are told of each patch."""
    log = nested_log(spark, sf_dir)
    wanted = log.select("ent").distinct().withColumn("wanted", F.explode(F.array(build.path("view", "1"), build.path("click"))))
    return shown(patches.narrow(log, wanted, ["ent"]))


def array_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as patches of an array of structs: the first replaces the array, every third a struct, others set one field."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = line.repartition(parts_of(line), "l_orderkey")
    first = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    seq, n = F.row_number().over(first).cast("long"), F.col("l_linenumber")
    line = line.select("l_orderkey", seq.alias("seq"), n.alias("n"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_tax").cast("double").alias("tax"))
    whole = build.set_struct(build.path("0"), quantity=F.col("quantity"), tax=F.col("tax"))
    change = (
        F.when(F.col("seq") == 1, build.patch(build.clear(build.path()), F.filter(whole, lambda r: r["op"] == "leaf")))
        .when(F.col("n") % 3 == 0, build.set_struct(build.path(F.col("n")), quantity=F.col("quantity"), tax=F.col("tax")))
        .otherwise(build.set_leaf(build.path(F.col("n"), F.lit("quantity")), F.col("quantity")))
    )
    return line.select(F.col("l_orderkey").alias("ent"), "seq", F.inline(change))


@query(
    "q_app_4_arrays",
    """WITH r AS (SELECT l_orderkey AS ent, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS q, CAST(l_tax AS DOUBLE) AS t,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem),
c AS (SELECT ent, seq, CASE WHEN seq = 1 THEN 0 ELSE n END AS i, q, CASE WHEN seq = 1 OR n % 3 = 0 THEN t END AS t, seq = 1 OR n % 3 = 0 AS whole FROM r),
s AS (SELECT ent, i, max(CASE WHEN whole THEN seq ELSE 0 END) AS base FROM c GROUP BY ALL),
x AS (SELECT c.ent, c.i, arg_max(q, c.seq) AS quantity, max(CASE WHEN c.seq = base THEN t END) AS tax FROM c JOIN s ON s.ent = c.ent AND s.i = c.i WHERE c.seq >= base GROUP BY ALL),
g AS (SELECT ent, unnest(range(0, max(i) + 1)) AS i FROM x GROUP BY ent)
SELECT g.ent, CAST(g.i AS INTEGER) AS idx, coalesce(quantity, 0) AS quantity, 0.0::DOUBLE AS price, coalesce(tax, 0) AS tax FROM g LEFT JOIN x ON x.ent = g.ent AND x.i = g.i""",
)
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of structs after wholes, sets and changes inside elements; what was never set is zero."""
    leaves = fold.fold_paths(array_log(spark, sf_dir), ["ent"], depth=2)
    leaves = leaves.select("ent", F.get("path", F.lit(0)).cast("int").alias("idx"), F.get("path", F.lit(1)).alias("field"), "value")
    elements = patches.with_zeros(leaves, ["ent", "idx"], dict.fromkeys(FIELDS, 0.0))
    filled = elements.groupBy("ent", "idx").agg(F.struct(*(F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in FIELDS)).alias("x"))
    rows = patches.zero_filled(filled, ["ent"], "idx", "x", None)
    return rows.select("ent", "idx", *(F.coalesce(F.col("x")[n], F.lit(0.0)).alias(n) for n in FIELDS))
