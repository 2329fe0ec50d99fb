import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators import dump
from tickloom.options import AggregationOptions
from tickloom.sinks import formats

DATA = [("NYSE", "A B", None, 5, 1.25, 'x"y', 100), ("L,SE", None, 2.0, None, None, None, 200), ("N", "q", None, None, None, None, 300)]
COLUMNS = "market string, instrument string, zeta double, n bigint, price double, note string, bucket_ts bigint"
TAGS = {"market": "Market", "instrument": "Instrument"}
FIELDS = ["zeta", "n", "price", "note"]


def test_line_protocol_skips_nulls_and_empty_rows(spark):
    df = spark.createDataFrame(DATA, COLUMNS)
    lines = sorted(r.line for r in formats.line_protocol(df, "my meas", TAGS, FIELDS).collect())
    assert lines == ['my\\ meas,Instrument=A\\ B,Market=NYSE n=5i,note="x\\"y",price=1.25 100', "my\\ meas,Market=L\\,SE zeta=2 200"]


def test_csv_keeps_empty_rows(spark):
    df = spark.createDataFrame(DATA, COLUMNS)
    rows = formats.csv_rows(df, "m", TAGS, FIELDS)
    assert rows.columns == ["measurement", "tag_Instrument", "tag_Market", "field_n", "field_note", "field_price", "field_zeta", "time"]
    assert sorted(r.line for r in formats.csv_line(rows).collect()) == [
        'm,,"L,SE",,,,2,200', 'm,A B,NYSE,5,"x""y",1.25,,100', "m,q,N,,,,,300"]


def test_files_per_flush(spark, tmp_path):
    df = spark.createDataFrame(DATA, COLUMNS)
    for kind in ("csv", "influxdb_line"):
        options = AggregationOptions(output_format=kind, output_dir=str(tmp_path), filename_prefix="md")
        for batch in (0, 1, 1):
            path = formats.write_metrics(df, "trades", TAGS, FIELDS, options, batch)
        assert path.startswith(f"{tmp_path}/md_trades.")
        root = path.rsplit("/", 1)[0]
        if kind == "csv":
            back = spark.read.csv(root, header=True, quote='"', escape='"')
            assert back.count() == 6
            assert back.filter("field_note = 'x\"y'").count() == 2
        else:
            assert spark.read.text(root).count() == 4


def md(**m):
    return {k: m[k] for k in m}


def test_dump_demo_order(spark):
    header = T.StructType([T.StructField("msg_type", T.IntegerType()), T.StructField("msg_seq_num", T.LongType()), T.StructField("timestamp_ns", T.LongType())])
    schema = T.StructType([
        T.StructField("header", header, metadata=md(type_name="MsgHeader")),
        T.StructField("market", T.StringType(), metadata=md(char_width=16)),
        T.StructField("order_id", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("quantity", T.LongType()),
        T.StructField("side", T.StringType(), metadata=md(char=True)),
        T.StructField("kind", T.IntegerType(), metadata=md(enum={"4": "Kind::TRADE"}, enum_name="Kind")),
        T.StructField("other", T.IntegerType(), metadata=md(enum={"4": "Kind::TRADE"}, enum_name="Kind")),
    ])
    df = spark.createDataFrame([((1, 12345, 1714041600000000000), "NYSE", 9876543210, 150.25, 100, "B", 4, 9)], schema)
    assert dump.dump_text(df, "order", type_name="OrderNewMsg").first().text == """order = OrderNewMsg {
  header = MsgHeader {
    msg_type = 1
    msg_seq_num = 12345
    timestamp_ns = 1714041600000000000
  }
  market = "NYSE" (4/16)
  order_id = 9876543210
  price = 150.25
  quantity = 100
  side = 'B'
  kind = Kind::TRADE
  other = Kind(9)
}"""


def test_dump_containers(spark):
    df = spark.sql("""
        select map('MSFT', 420, 'AAPL', 150, 'GOOGL', 2800) prices, named_struct('first', 'AAPL', 'second', 150.25D) quote,
          array(named_struct('a', true), cast(null as struct<a: boolean>)) list, cast(null as int) nothing,
          'Hello\\nWorld\\t!"Quote"' text, cast(array() as array<int>) none, cast(null as map<int,int>) no_map, X'41FF' raw
    """)
    value = lambda column, **k: df.select(dump.dump_value(F.col(column), df.schema[column].dataType, **k)).first()[0]
    assert value("prices", name="prices") == """prices = [3] {
  key = "AAPL"
  val = 150
  key = "GOOGL"
  val = 2800
  key = "MSFT"
  val = 420
}"""
    assert value("quote") == '(\n  first = "AAPL"\n  second = 150.25\n)'
    assert value("list") == "[2] {\n  [0] = struct {\n    a = true\n  }\n  [1] = (null)\n}"
    assert value("nothing", name="null_ptr") == "null_ptr = (null)"
    assert value("text") == '"Hello\\nWorld\\t!\\"Quote\\""'
    assert value("none") == "[0] {\n}"
    assert value("no_map") == "(null)"
    assert value("raw") == '"A\\xff"'


def test_dump_stops_at_its_depth(spark):
    kind = T.IntegerType()
    value = "1"
    for _ in range(12):
        value, kind = f"named_struct('x', {value})", T.StructType([T.StructField("x", kind)])
    text = spark.sql(f"select {value} v").select(dump.dump_value(F.col("v"), kind)).first()[0]
    assert "  " * 10 + "x = (max depth reached)\n" in text
    assert text.count("{") == 10
    assert json.dumps(text)


def test_csv_files_keep_outer_blanks(spark, tmp_path):
    rows = spark.createDataFrame([(" A ", "x ", 5)], "sym string, note string, bucket_ts bigint")
    options = AggregationOptions(output_format="csv", output_dir=str(tmp_path), filename_prefix="p")
    path = formats.write_metrics(rows, "m", ["sym"], ["note"], options, 0)
    back = spark.read.csv(path, header=True, quote='"', escape='"').first()
    assert (back.tag_sym, back.field_note) == (" A ", "x ")
