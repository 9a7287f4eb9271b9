"""Packets of every kind: bytes, round trips, and what is refused."""

import pytest
from pyspark.sql import functions as F

from patchloom.functions import packets as P


def values():
    return {
        "version": F.lit(7), "id": F.lit(70_000), "access": F.lit(200), "action": F.lit(1), "store": F.lit("Größe"), "name": F.lit("n"), "key": F.lit("a%&b"),
        "message": F.lit(""), "payload": F.lit(b"\x00\xff"), "metadata": F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("")),
    }


PLAIN = {
    "version": 7, "id": 70_000, "access": 200, "action": 1, "store": "Größe", "name": "n", "key": "a%&b", "message": "", "payload": b"\x00\xff",
    "metadata": {"a": "", "z": "1"},
}


def test_every_kind_round_trips(spark):
    raw = [P.encode(k, values()) for k in P.LAYOUTS]
    row = spark.range(1).select(*raw).first()
    rows = spark.createDataFrame([(k, bytearray(x)) for k, x in zip(P.LAYOUTS, row, strict=True)], "k int, raw binary").select("k", P.decode(F.col("raw")).alias("p")).collect()
    for k, p in rows:
        layout, got = P.LAYOUTS[k], p.asDict()
        assert (got.pop("kind"), got.pop("error")) == (k, None), (k, got)
        want = {name: PLAIN[name] for name, _ in layout}
        assert {f: bytes(v) if isinstance(v, bytearray) else v for f, v in got.items() if v is not None} == want


def test_bytes(spark):
    got = spark.range(1).select(
        P.encode(7, {"store": F.lit("s"), "key": F.lit(""), "action": F.lit(0)}).alias("a"),
        P.encode(5, {"id": F.lit(42), "name": F.lit("M"), "access": F.lit(3), "payload": F.lit(b"\x09\x0a")}).alias("b"),
        P.encode(1, {"version": F.lit(2), "metadata": F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("xy"))}).alias("c"),
        P.encode(200, {"payload": F.lit(b"\x01")}).alias("d"),
    ).first()
    assert [bytes(x).hex() for x in got] == ["07010073" + "0000" + "00", "052a00000001004d0302000000090a", "01020000000200010061" + "02007879" + "0100620100" + "31", "c801"]


def test_what_cannot_be_written_is_null(spark):
    long = F.repeat(F.lit("x"), 70_000)
    bad = [(7, {"action": F.lit(2)}), (4, {"name": long}), (12, {"id": F.lit(0)}), (255, {"name": F.lit("")}), (10, {"access": F.lit(256)})]
    assert all(x is None for x in spark.range(1).select(*(P.encode(k, values() | over) for k, over in bad)).first())


@pytest.mark.parametrize(
    ("raw", "error"),
    [("", "empty"), (None, "empty"), ("00aa", "kind zero"), ("04", "truncated"), ("040500", "truncated"), ("0401006101000000", "truncated"), ("04010061000000" + "0000", "trailing bytes"),
     ("070100610000" + "09", "unknown action"), ("0c000000000000", "id zero"), ("ff000000000000", "no name"), ("01000000000200" + "010061", "truncated"),
     ("0100000000ffff", "truncated"), ("05010000000000" + "00" + "00000000" + "0100", "truncated"), ("c801", None), ("2a", None)],
)
def test_errors(spark, raw, error):
    d = spark.createDataFrame([(None if raw is None else bytearray.fromhex(raw),)], "raw binary").select(P.decode(F.col("raw")).alias("p"))
    p = d.first()["p"]
    assert p["error"] == error
    if raw in ("c801", "2a"):
        assert (p["kind"], bytes(p["payload"])) == (int(raw[:2], 16), bytes.fromhex(raw[2:]))


def test_repeated_keys_and_greeting(spark):
    raw = bytearray.fromhex("01000000000200" + "01006101003101006101" + "0032")
    p = spark.createDataFrame([(raw,)], "raw binary").select(P.decode(F.col("raw")).alias("p")).first()["p"]
    assert (p["error"], p["metadata"]) == (None, {"a": "2"})
    hello = {"version": F.lit(1), "device": F.lit("d"), "auth_type": F.lit("t"), "auth_data": F.lit(b"\x05"), "metadata": F.create_map(F.lit("k"), F.lit("v"))}
    g = spark.range(1).select(P.decode_greeting(P.encode_greeting(hello)).alias("g"), P.decode_greeting(F.concat(P.encode_greeting(hello), F.lit(b"\x00"))).alias("h")).first()
    assert (g["g"]["version"], g["g"]["device"], g["g"]["auth_type"], bytes(g["g"]["auth_data"]), g["g"]["metadata"], g["g"]["error"]) == (1, "d", "t", b"\x05", {"k": "v"}, None)
    assert g["h"]["error"] == "trailing bytes"


def test_flags(spark):
    d = spark.createDataFrame([({"own": "x", "cap.a": "1"}, True), (None, False), ({"cap.b": "1"}, False)], "m map<string,string>, b boolean")
    got = d.select(P.flags(F.col("m"), {"a": "cap.a", "b": "cap.b"}).alias("f"), P.with_flags(F.col("m"), {"cap.b": F.col("b"), "cap.a": F.lit(False)}).alias("w")).collect()
    assert [tuple(r["f"]) for r in got] == [(True, False), (False, False), (False, True)]
    assert [r["w"] for r in got] == [{"own": "x", "cap.b": "1"}, None, None]


def test_numbers_beyond_a_long(spark, tmp_path):
    """Keys of large tables, whose product no long holds: counted with 9 bytes, or as not written."""
    from patchloom.plans import flows

    line = [(10**7, 10**6, 3, 4), (10**7, 10**6, 3, 3), (5, 2, 1, 4), (1, 1, 1, 1)]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, flows.packed_sizes(spark, str(tmp_path)).collect())) == [(1, 3), (9, 1)]
    assert sorted(map(tuple, flows.round_trip(spark, str(tmp_path)).collect()), key=str) == [(1, 3, 0), (None, 1, 0)]


def test_numbers_by_plain_python(spark):
    """Bytes of numbers of any size, of those cut short, and packed integers at the bounds of their sizes."""
    import random

    from patchloom.functions import codec

    rng = random.Random(3)
    values = [s * ((1 << b) + d) for b in (0, 6, 13, 28, 59, 62) for d in (-1, 0, 1) for s in (1, -1)] + [(1 << 63) - 1, -(1 << 63), *(rng.randrange(-(1 << 63), 1 << 63) >> rng.randrange(64) for _ in range(200))]
    raw = F.concat(codec.little(F.col("v"), 8), F.lit(b"z"))
    sizes = {f"n{k}": codec.number(raw, 0, k) for k in (1, 2, 4, 8)} | {f"l{k}": codec.little(F.col("v"), k) for k in (1, 2, 4, 8)}
    more = {"short": codec.number(raw, 7, 4), "none": codec.number(raw, 20, 4), "no": codec.number(F.lit(None).cast("binary"), 0, 4), "p": codec.packed(F.col("v")), "size": codec.packed_size(F.col("v"))}
    for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", codec.unpacked(codec.packed(F.col("v"))).alias("back"), *(c.alias(n) for n, c in (sizes | more).items())).collect():
        whole = r["v"].to_bytes(8, "little", signed=True)
        assert all(bytes(r[f"l{k}"]) == whole[:k] for k in (1, 2, 4, 8)) and all(r[f"n{k}"] == int.from_bytes(whole[:k], "little") for k in (1, 2, 4)) and r["n8"] == r["v"]
        assert (r["short"], r["none"], r["no"]) == (whole[7] + 256 * ord("z"), 0, None)
        assert r["back"] == (None if r["v"] == -(1 << 63) else r["v"]) and r["size"] == (9 if r["p"] is None else len(r["p"]))


@pytest.mark.parametrize("name", ["q_env_4_bytes", "q_cod_2_round_trip"])
def test_wide_projections_stand_apart(spark, name):
    """No long projection is fused into one method, which would be too long for the JIT compiler."""
    from patchloom.plans import all_queries

    frame = all_queries()[name](spark, "/root/testdata/sf0.001")
    frame.collect()
    lines = frame._jdf.queryExecution().executedPlan().toString().split("\n")
    assert any("*(" in line for line in lines) and all(len(line) < 2000 for line in lines if "*(" in line)
