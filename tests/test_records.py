"""Fielded records: bytes, round trips, evolution and broken input."""

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.functions import floats, records


def field(name, kind, number, **more):
    return T.StructField(name, kind, True, {"fID": number, **more})


KIND = T.StructType([
    field("flag", T.BooleanType(), 1), field("n", T.LongType(), 2), field("s", T.StringType(), 3), field("at", T.TimestampType(), 4), field("raw", T.BinaryType(), 5),
    field("list", T.ArrayType(T.LongType()), 6), field("names", T.ArrayType(T.StringType()), 7), field("map", T.MapType(T.StringType(), T.LongType()), 8),
    field("maybe", T.LongType(), 200, optional=True), field("deep", T.ArrayType(T.ArrayType(T.IntegerType())), 9),
])
ROWS = [
    (True, -5, "héllo", datetime(2024, 5, 6, 7, 8, 9, 123000), b"\x00\x01", [1, -64, 1 << 40], ["", "x" * 300], {"b": 1, "a": -(1 << 62)}, 0, [[1], [], [2, 3]]),
    (False, 0, "", None, None, None, None, None, None, None),
    (True, 1 << 62, "y" * 9000, datetime(1969, 1, 1), b"", [], [], {}, 7, [[]]),
]


def plain(row):
    return tuple(bytes(x) if isinstance(x, bytearray) else x for x in row)


def test_round_trip(spark):
    d = spark.createDataFrame(ROWS, KIND).select(records.record(F.struct(*KIND.names), KIND).alias("raw"))
    got = d.select(records.decode(F.col("raw"), KIND).alias("p")).collect()
    assert [r["p"]["error"] for r in got] == [None] * 3
    assert [plain(r["p"]["value"]) for r in got] == ROWS
    assert bytes(d.collect()[1]["raw"]) == b""


def test_bytes_skips_and_errors(spark):
    kind = T.StructType([field("n", T.LongType(), 2), field("l", T.ArrayType(T.LongType()), 6), field("b", T.BooleanType(), 7)])
    raw = spark.createDataFrame([(5, [1, 2], True)], kind).select(records.record(F.struct("n", "l", "b"), kind)).first()[0]
    assert bytes(raw).hex() == "020105" + "060400020102" + "070101"
    cases = ["090302030402" + "0105", "0201", "020105" + "0602" + "00" + "09", "070102", "02", "02ff", "020105020106", "", "020107" * 255, "020107" * 256]
    d = spark.createDataFrame([(bytearray.fromhex(x),) for x in cases], "raw binary").coalesce(1)
    got = [r["p"] for r in d.select(records.decode(F.col("raw"), kind).alias("p")).collect()]
    assert [p["error"] for p in got] == [None, "truncated", "field l", "field b", "truncated", "truncated", None, None, None, "too many fields"]
    assert [p["value"]["n"] for p in (got[0], got[6], got[7])] == [5, 6, 0]


def test_float_bits(spark):
    """Bits of doubles and singles by arithmetic, against struct, with the least, largest and special ones."""
    import random
    import struct

    rng = random.Random(2)
    values = [0.0, -0.0, 1.0, -1.0, 0.1, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1e-310, float("inf"), float("-inf"), 1e-45, 1.1754943508222875e-38, 3.4028234663852886e38]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(500)] + [2.0**k for k in range(-1074, 1024, 7)] + [2.0**k * (1 - 2**-53) for k in range(-1000, 1024, 9)]
    values = [v for v in values if v == v]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    for r in d.select("v", floats.bits(F.col("v")).alias("b"), floats.from_bits(floats.bits(F.col("v"))).alias("back")).collect():
        assert struct.pack("<q", r["b"]) == struct.pack("<d", r["v"]) and struct.pack("<d", r["back"]) == struct.pack("<d", r["v"]), r
    singles = spark.createDataFrame([(struct.unpack("<f", struct.pack("<f", v))[0],) for v in values if abs(v) < 3.4e38 or abs(v) == float("inf")], "v float")
    for r in singles.select("v", floats.bits(F.col("v"), floats.SINGLE).alias("b"), floats.from_bits(floats.bits(F.col("v"), floats.SINGLE), floats.SINGLE).alias("back")).collect():
        assert struct.pack("<q", r["b"])[:4] == struct.pack("<f", r["v"]) and struct.pack("<f", r["back"]) == struct.pack("<f", r["v"]), r
    nan = spark.range(1).select(floats.bits(F.lit(float("nan"))).alias("b"), floats.from_bits(F.lit(0x7FF8 << 48)).alias("n")).first()
    assert nan["b"] == 0x7FF8 << 48 and nan["n"] != nan["n"]
