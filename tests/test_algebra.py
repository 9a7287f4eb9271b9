"""Laws of the patch algebra, path fixtures, counts, codec bytes, data-plane rules, streaming."""

import random

import pytest
from pyspark.sql import functions as F

from patchloom.functions import codec, paths, schema
from patchloom.operators import dataplane, delivery, fold, subs
from patchloom.operators import paths as algebra


def log(spark, rows):
    return spark.createDataFrame(rows, "ent long, seq long, op string, leaf string, value string")


def test_merge_law(spark):
    """Folding merged patches gives what folding all patches gives; merging twice changes nothing."""
    rng = random.Random(5)
    rows = [(rng.randrange(4), i, *rng.choice([("leaf", "a"), ("leaf", "b"), ("leaf", "c"), ("whole", None), ("delete", None)]), str(i)) for i in range(1, 200)]
    every = log(spark, rows).withColumn("chunk", F.floor(F.col("seq") / 5))
    once = fold.merge(every, ["ent", "chunk"])
    state = lambda d: sorted(map(tuple, fold.current_state(d, ["ent"]).select("ent", "leaf", "value").collect()))
    assert state(once) == state(every)
    assert fold.merge(once, ["ent", "chunk"]).count() == once.count()


def test_nested_masks(spark):
    rows = [(1, 1, "leaf", ["m", "5", "n"], "1"), (1, 2, "leaf", ["m", "6", "n"], "2"), (1, 3, "set", ["m", "5"], None), (1, 4, "leaf", ["m", "5", "n"], "3"),
            (1, 5, "delete", ["m", "6"], None), (1, 6, "leaf", ["b"], "x"), (2, 1, "leaf", ["b"], "y"), (2, 2, "full", [], None)]
    d = spark.createDataFrame(rows, "ent long, seq long, op string, path array<string>, value string")
    got = fold.fold_paths(d, ["ent"]).select("ent", "path", "value").collect()
    assert sorted((r[0], tuple(r[1]), r[2]) for r in got) == [(1, ("b",), "x"), (1, ("m", "5", "n"), "3")]


def test_prune_is_idempotent(spark):
    rows = [(1, i, "leaf", "a", v) for i, v in enumerate(["x", "x", None, None, "x", "y", "y"])]
    once = fold.prune(log(spark, rows), ["ent", "leaf"], "value")
    assert [r["value"] for r in once.orderBy("seq").collect()] == ["x", None, "x", "y"]
    assert fold.prune(once, ["ent", "leaf"], "value").count() == 4


@pytest.mark.parametrize(
    ("given", "left"),
    [
        ([["k"], ["k", "s"], ["o", "s"], ["o"], ["k"]], {("k",), ("o",)}),
        ([["k"], [], ["o"]], {()}),
        ([["a", "b"], ["a", "c"], ["a", "b", "d"]], {("a", "b"), ("a", "c")}),
    ],
)
def test_reduce(spark, given, left):
    d = spark.createDataFrame([(1, p) for p in given], "v int, path array<string>")
    assert {tuple(r["path"]) for r in algebra.reduce_paths(d, ["v"]).collect()} == left


def test_affects_and_keys(spark):
    cases = [([], ["m", "5"], True), (["m"], ["m", "5"], True), (["m", "5", "n"], ["m", "5"], True), (["m", "6"], ["m", "5"], False), (["b"], ["m", "5"], False), (["m"], ["m"], True)]
    changes = spark.createDataFrame([(k, a) for k, (a, _, _) in enumerate(cases)], "k int, path array<string>")
    wanted = spark.createDataFrame([(k, b) for k, (_, b, _) in enumerate(cases)], "k int, wanted array<string>")
    hit = [r["k"] for r in algebra.affects(changes, wanted, ["k"]).collect()]
    assert sorted(hit) == [k for k, c in enumerate(cases) if c[2]]
    row = spark.createDataFrame([(["MapPtrTest", "5", "Number"], "mapPtrTest%&5%&Number", "")], "p array<string>, k string, e string")
    got = row.select(paths.path_key(F.col("p")), paths.server_path(F.col("k")), paths.split_key(F.col("e")), paths.typed_key(F.lit("300"), "uint8"), paths.array_index(F.lit("-1"))).first()
    assert list(got) == ["mapPtrTest%&5%&Number", ["MapPtrTest", "5", "Number"], [], None, None]


def test_counts_never_fall_below_zero(spark):
    rng = random.Random(9)
    deltas = [rng.choice([1, -1, -1, 1, 0]) for _ in range(300)]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(deltas)], "k int, i int, delta int")
    n, expected = 0, []
    for x in deltas:
        n = max(0, n + x)
        expected.append(n)
    assert [r["count"] for r in subs.counted(d, ["k"], ["i"]).orderBy("i").collect()] == expected
    edges = [r["edge"] for r in subs.edges(d, ["k"], ["i"]).orderBy("i").collect()]
    assert edges == ["on", "off"] * (len(edges) // 2) + ["on"] * (len(edges) % 2)


def test_packed_integers(spark):
    values = sorted({s * (1 << b) + o for b in range(63) for s in (1, -1) for o in (-1, 0, 1)} | {0, (1 << 63) - 1})
    d = spark.createDataFrame([(v,) for v in values], "v long").withColumn("raw", codec.packed(F.col("v")))
    for r in d.select("v", "raw", codec.unpacked(F.col("raw")).alias("back"), codec.packed_size(F.col("v")).alias("size")).collect():
        m = abs(r["v"]).bit_length()
        assert (r["back"], len(r["raw"]), r["size"]) == (r["v"], *[1 if m <= 6 else 2 if m <= 13 else 4 if m <= 28 else 8 if m <= 59 else 9] * 2), r


def test_call_packet_bytes(spark):
    raw = codec.call_packet(F.lit(42), F.lit("M"), F.lit(3), F.lit(b"\x09\x0a"))
    got, back = spark.range(1).select(raw.alias("r"), codec.call_fields(raw).alias("f")).first()
    assert bytes(got).hex() == "052a00000001004d0302000000090a"
    assert (back["call_id"], back["name"], back["access"], bytes(back["payload"]), back["error"]) == (42, "M", 3, b"\x09\x0a", None)


def test_envelope_rules(spark):
    kind = "stream_id string, generation long, sequence long, frame_id long, payload_type int, flags int, format string, first_index long, item_count long, total_item_count long, payload binary"
    rows = [("s", 2, 11, 7, 1, 3, "f", 0, 0, 0, b"abc"), ("s", 1, 1, 1, 2, 0, "f", 16, 8, 2048, b"abc"), ("s", 1, 1, 1, 2, 4, "f", 0, 0, 2048, b""),
            ("s", 1, 1, 1, 2, 1, "f", 16, 8, 2048, b"abc"), ("s", 1, 1, 1, 2, 4, "f", 1, 0, 2048, b""), ("s", 1, 1, 1, 9, 0, "f", 0, 0, 0, b"a")]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(dataplane.envelope_error()).collect()]
    assert got == [None, None, None, "block set recovers", "commit has a range or payload", "unknown payload type"]


def test_block_sets_with_overlaps(spark):
    d = spark.createDataFrame([(1, 0, 3, 6), (1, 2, 4, 6), (2, 0, 2, 6), (2, 4, 2, 6), (3, 0, 6, 6), (3, 1, 2, 6)], "k int, first_index long, item_count long, total_item_count long")
    assert {r["k"]: (r["covered"], r["complete"]) for r in dataplane.complete_sets(d, ["k"]).collect()} == {1: (6, True), 2: (4, False), 3: (6, True)}


def test_drain_order_matches_visits(spark):
    rng = random.Random(3)
    queues = {s: [(u, rng.randrange(1, 60_000)) for u in range(rng.randrange(1, 8))] for s in range(4)}
    deficit, at, out = [0] * 4, [0] * 4, []
    while len(out) < sum(map(len, queues.values())):
        for s, units in queues.items():
            if at[s] < len(units):
                deficit[s] += (16 << 10) * (s + 1)
                if units[at[s]][1] <= deficit[s]:
                    deficit[s] -= units[at[s]][1]
                    out.append((s, units[at[s]][0]))
                    at[s] += 1
    d = spark.createDataFrame([(0, s, u, n, s + 1) for s, units in queues.items() for u, n in units], "uplink int, stream int, unit int, size long, weight int")
    assert [(r["stream"], r["unit"]) for r in dataplane.drain_order(d, ["uplink"]).orderBy("turn").collect()] == out


def test_debounce_windows_are_anchored(spark):
    d = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 4, 9, 10, 19, 21, 40])], "k int, i long, at long")
    got = delivery.anchored_windows(d, ["k"], "at", "i", 10).orderBy("at").collect()
    assert [r["anchor"] for r in got] == [0, 0, 0, 10, 10, 21, 40]


def test_field_ids():
    from pyspark.sql.types import LongType, StructField, StructType

    ok = StructType([StructField("a", LongType(), metadata={"fID": 1}), StructField("b", LongType(), metadata={"fID": 3})])
    assert schema.field_ids(ok) == {"a": 1, "b": 3}
    with pytest.raises(ValueError, match="repeats"):
        schema.field_ids(StructType([*ok.fields, StructField("c", LongType(), metadata={"fID": 3})]))


def test_stream_replay_equals_batch(spark, tmp_path):
    from patchloom.sources.tables import read_log_stream
    from patchloom.streaming.replay import ReplaySink, replay_stream

    rng = random.Random(8)
    rows = [(rng.randrange(5), i, *rng.choice([("leaf", "a"), ("leaf", "b"), ("whole", None), ("delete", None)]), str(i)) for i in range(1, 90)]
    d, source = log(spark, rows), str(tmp_path / "log")
    sink = ReplaySink(str(tmp_path / "state"), ["ent"])
    for k in range(3):
        d.filter(F.col("seq") % 3 == k if k else F.col("seq") % 3 == 0).write.mode("append").parquet(source)
        replay_stream(read_log_stream(spark, source, d.schema), sink, str(tmp_path / "checkpoint")).awaitTermination()
    state = lambda x: sorted(map(tuple, x.select("ent", "leaf", "value").collect()))
    assert state(sink.state(d, 2)) == state(fold.current_state(d, ["ent"]))


def test_works_without_llm(tmp_path):
    """The entry imports, and its queries are there, when the llm folder and the pipeline are not."""
    import shutil
    import subprocess
    import sys

    from conftest import ROOT

    shutil.copytree(f"{ROOT}/patchloom", tmp_path / "patchloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_app_1_replay' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_anchors_of_a_key_without_gaps(spark):
    """A key whose rows never leave a gap, with ties and a row without a time, over many batches."""
    rng = random.Random(5)
    times = sorted(rng.choices(range(20_000), k=30_000))
    rows = [("hot", t, n) for n, t in enumerate(times)] + [("cold", t, n) for n, t in enumerate((0, 9, 10, 500, 509, 520))] + [("none", None, 0)]
    rng.shuffle(rows)
    got = delivery.anchored_windows(spark.createDataFrame(rows, "k string, t long, n long"), ["k"], "t", "n", 10).groupBy("k", "anchor").count().collect()
    want = {("none", None): 1}
    for key in ("hot", "cold"):
        anchor = None
        for t in sorted(t for k, t, _ in rows if k == key):
            anchor = t if anchor is None or t >= anchor + 10 else anchor
            want[key, anchor] = want.get((key, anchor), 0) + 1
    assert {(r[0], r[1]): r[2] for r in got} == want
