"""Nested patches against a plain model of state: a dictionary of leaves by path."""

import random

import pytest
from pyspark.sql import functions as F

from patchloom.functions import patches as build
from patchloom.operators import fold, patches

KIND = "ent long, seq long, op string, path array<string>, value double"


def random_log(seed, n=150):
    """One change for each seq: a whole or delete at some depth, the leaves of a whole, or a leaf."""
    rng = random.Random(seed)
    part = lambda: rng.choice("abc")
    rows = []
    for seq in range(1, n):
        ent, op = rng.randrange(3), rng.choice(["whole", "delete", "leaf", "leaf", "leaf", "leaf"])
        at = [part() for _ in range(3 if op == "leaf" else rng.randrange(3))]
        rows.append((ent, seq, op, at, rng.choice([0.0, 1.0, None]) if op == "leaf" else None))
        if op == "whole":
            for rest in {tuple(part() for _ in range(3 - len(at))) for _ in range(rng.randrange(4))}:
                rows.append((ent, seq, "leaf", at + list(rest), rng.choice([0.0, 1.0])))
    return rows


def applied(state, rows):
    """The state after the rows of one seq, masks first."""
    state = dict(state)
    for _, _, op, at, _ in rows:
        if op != "leaf":
            state = {p: v for p, v in state.items() if p[: len(at)] != tuple(at)}
    return state | {tuple(at): v for _, _, op, at, v in rows if op == "leaf"}


def by_seq(rows):
    out = {}
    for r in rows:
        out.setdefault((r[0], r[1]), []).append(r)
    return sorted(out.items(), key=lambda x: x[0][1])


@pytest.mark.parametrize("seed", range(4))
def test_merge_law(spark, seed):
    rows = random_log(seed)
    every = spark.createDataFrame(rows, KIND).withColumn("chunk", F.floor(F.col("seq") / 7))
    once = patches.merge_nested(every, ["ent", "chunk"])
    state = lambda d: sorted((r["ent"], tuple(r["path"]), r["value"]) for r in fold.fold_paths(d, ["ent"]).collect())
    states = {}
    for (ent, _), same in by_seq(rows):
        states[ent] = applied(states.get(ent, {}), same)
    assert state(once) == state(every) == sorted(((e, p, v) for e, s in states.items() for p, v in s.items()), key=lambda x: x[:2])
    assert patches.merge_nested(once, ["ent", "chunk"]).count() == once.count() < every.count()


@pytest.mark.parametrize("seed", range(4))
def test_prune_by_a_plain_model(spark, seed):
    """A change stays, whole, if and only if the state after it is another one."""
    rows = random_log(seed) + [(0, 999, "leaf", ["-1", "b", "c"], 5.0), (0, 1000, "delete", [], None), (0, 1001, "delete", [], None)]
    expected, states = [], {}
    for (ent, _), same in by_seq(rows):
        if any(r[3] and r[3][0] == "-1" for r in same):
            continue
        before = states.get(ent, {})
        states[ent] = applied(before, same)
        if states[ent] != before:
            expected += same
    got = patches.prune_nested(spark.createDataFrame(rows, KIND), ["ent"], index_depths=[1])
    key = lambda r: (r[0], r[1], r[2], tuple(r[3]), str(r[4]))
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, expected))
    assert patches.prune_nested(got, ["ent"]).count() == got.count()


def test_narrowing(spark):
    rows = [
        (1, 1, "whole", ["m"], None), (1, 1, "leaf", ["m", "x", "n"], 1.0), (1, 1, "leaf", ["m", "y", "n"], 2.0),  # x is there, z is not
        (1, 2, "leaf", ["m", "x"], 3.0), (1, 3, "delete", ["m"], None), (1, 4, "leaf", ["m", "x", "n", "deep"], 4.0), (1, 5, "leaf", ["m", "y"], 5.0),
        (2, 1, "whole", ["l"], None), (2, 1, "leaf", ["l", "0"], 1.0), (2, 2, "whole", ["l", "0"], None), (3, 1, "whole", ["m"], None), (4, 1, "leaf", ["q"], 1.0),
    ]
    wanted = [(1, ["m", "x", "n"]), (1, ["m", "z"]), (2, ["l", "0"]), (2, ["l", "7"]), (3, [])]
    d = spark.createDataFrame(rows, KIND)
    w = spark.createDataFrame(wanted, "ent long, wanted array<string>")
    got = [r for ents, index in (("ent <> 2", []), ("ent = 2", [2])) for r in patches.narrow(d.filter(ents), w, ["ent"], index_depths=index).collect()]
    assert sorted((r["ent"], r["seq"], r["op"], "/".join(r["path"]), r["value"] or 0) for r in got) == [
        (1, 1, "delete", "m/z", 0), (1, 1, "leaf", "m/x/n", 1.0), (1, 1, "whole", "m/x", 0), (1, 2, "leaf", "m/x", 3.0), (1, 3, "delete", "m", 0), (1, 4, "leaf", "m/x/n/deep", 4.0),
        (2, 1, "leaf", "l/0", 1.0), (2, 1, "whole", "l/0", 0), (2, 2, "whole", "l/0", 0), (3, 1, "whole", "m", 0),
    ]
    assert patches.narrow(d, spark.createDataFrame([], "ent long, wanted array<string>"), ["ent"]).count() == 0


def test_builders_and_zero_values(spark):
    numbers = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0))
    change = build.patch(
        build.inside(build.path("m"), build.set_map(build.path(), numbers)), build.set_array(build.path("l"), F.array(F.lit(7.0), F.lit(8.0))), build.delete(build.path("gone")),
        build.set_struct(build.path("s", F.lit(3)), quantity=F.lit(9.0)), build.set_leaf(build.path("v"), F.lit(0.5)),
    )
    rows = spark.range(1).select(F.inline(change)).collect()
    assert [(r["op"], "/".join(r["path"]), r["value"]) for r in rows] == [
        ("whole", "m", None), ("leaf", "m/a", 1.0), ("leaf", "m/b", 2.0), ("whole", "l", None), ("leaf", "l/0", 7.0), ("leaf", "l/1", 8.0), ("delete", "gone", None),
        ("whole", "s/3", None), ("leaf", "s/3/quantity", 9.0), ("leaf", "v", 0.5),
    ]
    state = spark.createDataFrame([(1, "x", 5.0), (2, "y", None)], "e int, field string, value double")
    assert sorted((r["e"], r["field"], r["value"]) for r in patches.with_zeros(state, ["e"], {"x": 0.0, "y": 0.0}).collect() if r["value"] is not None) == [(1, "x", 5.0), (1, "y", 0.0), (2, "x", 0.0)]
    items = spark.createDataFrame([(1, 2, 5.0), (1, -1, 4.0), (2, 0, 1.0)], "e int, i int, v double")
    assert sorted(map(tuple, patches.zero_filled(items, ["e"], "i", "v", 0.0).collect())) == [(1, 0, 0.0), (1, 1, 0.0), (1, 2, 5.0), (2, 0, 1.0)]


def test_parts_grow_with_rows(spark, tmp_path):
    """Logs are dealt to partitions of bounded rows; a prune dealt so keeps the same rows."""
    from patchloom.operators import patches as ops
    from patchloom.plans import nested
    from patchloom.sources.tables import parts_of

    assert [parts_of(spark.range(n), 100) for n in (0, 400, 4001)] == [4, 4, 41]
    log = nested.nested_log(spark, "/root/testdata/sf0.001")
    got = [sorted(map(str, ops.prune_nested(log, ["ent"], depth=2, index_depths=[2], parts=p).collect())) for p in (None, 7)]
    assert got[0] and got[0] == got[1]
    (tmp_path / "t").mkdir()
    spark.range(900_000).selectExpr("id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "1.0D AS l_quantity", "1.0D AS l_extendedprice", "0.1D AS l_tax", "timestamp'2024-01-01' AS l_shipdate").write.parquet(f"{tmp_path}/t/lineitem.parquet")
    assert "l_orderkey" in (plan := nested.array_log(spark, f"{tmp_path}/t")._jdf.queryExecution().optimizedPlan().toString()) and "], 6" in plan


def test_spread_by_rows(spark):
    """Rows that take much computing go to as many tasks as their number takes."""
    from patchloom.sources import tables

    rows = spark.range(0, 6 * tables.TASK_ROWS + 1, 1, 2)
    got = tables.spread(rows)
    assert got.rdd.getNumPartitions() == 7 and got.count() == rows.count()
