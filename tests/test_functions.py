import random
import struct

import pytest
from pyspark.sql import functions as F

from tickloom.functions import binary, text
from tickloom.functions.buckets import bucket, event_time
from tickloom.functions.tags import enum_label, tag_set


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def results(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def doubles():
    rng = random.Random(5)
    vals = [0.0, -0.0, 1.0, -1.0, 0.5, 0.0000005, 0.0000015, 0.0000025, 1e-9, -1e-9, 2.5e-7, 12345.65, 1234.565, 0.15,
            999999.5, 9999995.0, 999999.4999999, 150.25, 1e6, 1e5, 123456.5, 123455.5, 1e15 + 0.3, 9007199254.7409925,
            123456789012.5, 1e-4, 9.9999995e-5, 0.00012345650, 2.0**62, 1234565.0, 12345650.0, 12345650.5, 99999.95,
            0.999999999, 0.9999995, 100.0, 10.0, 1e18, 4.35, 2.675, 1.005]
    for _ in range(3000):
        vals.append(round(rng.uniform(-1e6, 1e6), rng.randint(0, 8)))
        vals.append(rng.uniform(-1, 1) * 10 ** rng.uniform(-3.9, 17))
        vals.append(rng.randint(0, 10**8) / 1e7 * rng.choice([1, 10, 100, 1000]))
    return vals


def trim(t):
    return t.rstrip("0").rstrip(".") if "." in t else t


def test_fixed6_rounds_like_c(spark):
    vals = doubles() + [float("inf"), float("-inf"), float("nan"), None]
    got = results(column(spark, vals, "double"), text.fixed6(F.col("v")))
    want = [None if v is None else trim("%.6f" % v) for v in vals]
    bad = [(v, g, w) for v, g, w in zip(vals, got, want) if g != w]
    assert not bad, bad[:10]


def test_general6_rounds_like_c(spark):
    vals = [v for v in doubles() if v == 0 or abs(v) >= 1e-4] + [1.5e-7, 1e-5, 2e-10, None]
    got = results(column(spark, vals, "double"), text.general6(F.col("v")))
    want = [None if v is None else "%g" % v for v in vals]
    bad = [(v, g, w) for v, g, w in zip(vals, got, want) if g != w]
    assert not bad, bad[:10]


def test_printable(spark):
    vals = ['Hello\nWorld\t!"Quote"', "a\\b\r", "", "héllo wörld", "日本 x", "\x01\x7f~", None, "plain", "🙂", "tail\n", "\n", "a\u2028", "[]^~ !#"]

    def want(s):
        if s is None:
            return None
        named = {0x5C: "\\\\", 0x22: '\\"', 10: "\\n", 13: "\\r", 9: "\\t"}
        return "".join(named.get(b) or (chr(b) if 0x20 <= b < 0x7F else f"\\x{b:02x}") for b in s.encode())

    assert results(column(spark, vals, "string"), text.printable(F.col("v"))) == [want(v) for v in vals]


def test_line_and_csv_escapes(spark):
    vals = ["a b,c=d", 'say "x" \\', "x\ny", "plain"]
    df = column(spark, vals, "string")
    assert results(df, text.escape_tag(F.col("v")))[0] == "a\\ b\\,c\\=d"
    assert results(df, text.escape_measurement(F.col("v")))[0] == "a\\ b\\,c=d"
    assert results(df, text.line_string(F.col("v")))[1] == '"say \\"x\\" \\\\"'
    assert results(df, text.csv_text(F.col("v"))) == ['"a b,c=d"', '"say ""x"" \\"', '"x\ny"', "plain"]


def test_binary_fields(spark):
    rng = random.Random(7)
    rows = []
    for i in range(500):
        f = rng.choice([rng.uniform(-1e9, 1e9), 5e-324, -2.5e-310, 0.0, -0.0, 1.7e308, float("inf"), 150.25,
                        struct.unpack("<d", struct.pack("<Q", rng.getrandbits(52) | rng.randint(0, 2046) << 52))[0]])
        rows.append((rng.getrandbits(8), rng.getrandbits(16), rng.getrandbits(32), rng.getrandbits(64), f,
                     rng.choice([b"NYSE", b"x" * 16, b"", b"AB\0CD", "é".encode("latin-1")])))
    rows.append((255, 65535, 2**32 - 1, 2**64 - 1, -1.0, b"LSE"))
    rows.append((0, 0, 0, 2**63 - 1, 1.0, b"LSE"))
    data = [bytearray(struct.pack("<BHIQd16s", *r)) for r in rows]
    df = column(spark, data, "binary")
    v = "v"
    got = df.orderBy("i").select(
        binary.u8(v, 0), binary.u16(v, 1), binary.u32(v, 3), binary.u64(v, 7), binary.u63(v, 7), binary.f64(v, 15),
        binary.chars(v, 23, 16),
    ).collect()
    for g, w in zip(got, rows):
        assert (g[0], g[1], g[2], int(g[3])) == w[:4]
        assert g[4] == (w[3] if w[3] < 2**63 else None)
        assert struct.pack("<d", g[5]) == struct.pack("<d", w[4])
        assert g[6] == w[5].split(b"\0")[0].decode("latin-1")


def test_bucket_and_event_time(spark):
    ts = 1714041600123456789
    row = spark.range(1).select(
        bucket(F.lit(ts), 500_000_000).alias("b"), F.unix_micros(event_time(F.lit(ts))).alias("us")
    ).first()
    assert row.b == ts // 500_000_000 * 500_000_000
    assert row.us == ts // 1000


def test_tag_sets_ignore_order_and_reject_repeats(spark):
    df = spark.sql("select map('a','1','b','2') t, 1 x union all select map('b','2','a','1'), 2")
    assert [r.s for r in df.groupBy("t").agg(F.sum("x").alias("s")).collect()] == [3]
    one = spark.range(1).select(tag_set({"b": F.lit(2), "a": F.lit("x")}).alias("t")).first().t
    assert list(one.items()) == [("a", "x"), ("b", "2")]
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        spark.sql("select map('a','1','a','2') t").collect()


def test_enum_label(spark):
    df = column(spark, [0, 4, 65, None], "int")
    assert results(df, enum_label(F.col("v"), {0: "UNKNOWN", 4: "TRADE"}, "Kind")) == ["UNKNOWN", "TRADE", "Kind(65)", None]
    assert results(df, enum_label(F.col("v"), {}))[1] == "enum(4)"
