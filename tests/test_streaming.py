"""Streams against their batch forms, a file for each micro-batch."""

import random

import pytest
from pyspark.sql import functions as F

from patchloom.operators import delivery, subs
from patchloom.sources.tables import read_log_stream
from patchloom.streaming import windows

SECOND = 1_000_000


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a stream over the rows in three files, then over a last row far later that closes what is open; rows that came out."""

    def run(d, make):
        source = str(tmp_path / "source")
        for part in range(4):
            d.filter(F.col("part") == part).coalesce(1).write.mode("append").parquet(source)
        made = make(read_log_stream(spark, source, d.schema, files_at_once=1))
        out = str(tmp_path / "out")
        query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(made.schema).parquet(out)

    return run


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    times = sorted(rng.sample(range(900), 240))
    data = [(n, rng.choice("abc"), rng.choice((1, -1)), t, n // 80) for n, t in enumerate(times)]
    data += [(240, "d", 1, 950, 2), (241, "d", 1, 960, 2), (242, "d", 1, 980, 2), (243, "z", 1, 90_000, 3)]
    return spark.createDataFrame(data, "n long, k string, delta int, t long, part int").withColumn("at", F.timestamp_seconds("t")).coalesce(1)


def test_debounce(rows, streamed):
    got = streamed(rows, lambda s: windows.debounced(s, ["k"], "at", 20 * SECOND, "1 second"))
    batch = delivery.anchored_windows(rows.withColumn("us", F.unix_micros("at")), ["k"], "us", "n", 20 * SECOND)
    want = batch.filter("k <> 'z'").groupBy("k", "anchor").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions(rows, streamed):
    got = streamed(rows, lambda s: windows.sessions(s, ["k"], "at", 20 * SECOND, "1 second"))
    batch = delivery.episodes(rows.withColumn("us", F.unix_micros("at")), ["k"], "us", ["n"], 20 * SECOND)
    want = batch.filter("k <> 'z'").groupBy("k", "episode").agg(F.min("at").alias("opened"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).drop("episode")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_edges(rows, streamed):
    got = streamed(rows, lambda s: windows.edges(s, ["k"], "n", F.col("delta")))
    want = subs.edges(rows, ["k"], ["n"]).select("k", "n", "edge").union(subs.underflows(rows, ["k"], ["n"]).select("k", "n", F.lit("underflow")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_replay_touches_only_some_buckets(spark, tmp_path):
    """A batch writes the buckets of its own entities, a replayed batch writes the same again, and old versions go."""
    import os

    from patchloom.operators import fold
    from patchloom.streaming.replay import ReplaySink

    kind = "ent long, seq long, op string, leaf string, value string"
    sink = ReplaySink(str(tmp_path / "state"), ["ent"], buckets=16)
    batches = [[(e, e, "leaf", "a", f"old{e}") for e in range(40)]] + [[(n, 100 + n, "leaf", "a", f"new{n}"), (n + 1, 200 + n, "whole", None, None)] for n in range(4)]
    seen = []
    for k, rows in enumerate(batches):
        d = spark.createDataFrame(rows, kind)
        sink(d, k)
        sink(d, k)
        seen += rows
        every = spark.createDataFrame(seen, kind)
        state = lambda x: sorted(map(tuple, x.select("ent", "leaf", "value").collect()))
        assert state(sink.state(every, k)) == state(fold.current_state(every, ["ent"]))
        written = [x for x in os.listdir(tmp_path / "state" / f"v={k}") if x.startswith("_bucket")]
        assert k == 0 or len(written) <= 2
    versions = [x for v in os.listdir(tmp_path / "state") if v.startswith("v=") for x in os.listdir(tmp_path / "state" / v) if x.startswith("_bucket")]
    assert max(map(versions.count, versions)) <= 3 and len(os.listdir(tmp_path / "state" / "index")) <= 2
