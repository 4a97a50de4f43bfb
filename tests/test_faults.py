"""Values and bytes at the edges: counts, empty values, ranges, clashing names, ties and nulls."""

import json
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillpack.functions import codecs as c
from quillpack.functions import fallback, values
from quillpack.functions import wire as w
from quillpack.operators import layout, streams
from quillpack.plans.records import Added, Field, MadeOptional, Record, Removed, decode_record

L = F.lit


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_counts_are_those_of_the_bytes(spark):
    units, bytes_ = c.sequence(c.unit), c.sequence(c.i8)
    row = one(spark, F.size(units.decode(F.unhex(L("14")))).alias("n"), bytes_.try_decode(F.unhex(L("1400"))).alias("short"), bytes_.try_decode(F.unhex(L("feffffff0f"))).alias("huge"), c.sequence(c.string).try_decode(F.unhex(L("04026104"))).alias("cut"))
    assert row.n == 10
    assert (row.short.value, row.short._error) == (None, w.ENDED)
    assert row.huge._error == w.ENDED and row.cut._error == w.ENDED


@pytest.mark.parametrize("known", [True, False])
@pytest.mark.parametrize("inner", ["i64", "string"])
def test_long_arrays(spark, known, inner):
    codec = c.sequence(getattr(c, inner), known)
    rows = spark.range(1).select(F.expr(f"transform(sequence(1, 30000), x -> cast(x as {'bigint' if inner == 'i64' else 'string'}))").alias("a"))
    back = rows.select("a", codec.enc(F.col("a")).alias("b")).select((codec.decode(F.col("b"), strict=True) == F.col("a")).alias("same"))
    assert back.first().same


def test_map_keeps_the_last_of_repeated_keys(spark):
    data = F.unhex(L("06" + "00026100000001" + "00026200000002" + "00026100000003"))
    assert one(spark, c.map_of(c.string, c.i32).decode(data).alias("m")).m == {"a": 3, "b": 2}


def test_empty_and_odd_bits(spark):
    rows = spark.createDataFrame([([],), ([True],), ([True] * 9,)], "x array<boolean>")
    got = [(r.h, r.v) for r in rows.select(F.hex(c.bit_array.enc(F.col("x"))).alias("h"), c.bit_array.decode(c.bit_array.enc(F.col("x"))).alias("v")).collect()]
    assert got == [("00", []), ("0180", [True] + [False] * 7), ("02FF80", [True] * 9 + [False] * 7)]


@pytest.mark.parametrize("text", ["1.123456789012", "-0.000000000001", "0.000000000000", "-123456.000000000000"])
def test_binary_decimals_are_exact(spark, text):
    codec = c.decimal_binary(18, 12)
    assert str(one(spark, codec.decode(codec.enc(L(text).cast("decimal(18,12)"))).cast("string").alias("v")).v) == text
    assert one(spark, c.decimal_binary(10, 0).decode(F.unhex(L("fffffffffffffffe" + "017b"))).cast("string").alias("v")).v == "12300"


WRONG = [(c.i8, 300), (c.i16, -40000), (c.i32, 1 << 31), (c.u8, -1), (c.var_u32, -1), (c.var_u32, 1 << 35), (c.var_i32, 1 << 31), (c.char(), ""), (c.char(), "ab")]


@pytest.mark.parametrize("k", range(len(WRONG)))
def test_values_out_of_range_are_errors(spark, k):
    codec, x = WRONG[k]
    with pytest.raises(PySparkException):
        one(spark, codec.enc(L(x)).alias("b"))


def test_characters_that_are_none(spark):
    assert one(spark, c.char().try_decode(F.unhex(L("80b003"))).alias("d")).d._error == "FailedToDecodeCharacter"


def test_json_numbers_and_bad_bytes():
    assert fallback.json_bytes(1 << 70) == b"\5" + struct.pack(">d", 2.0**70)
    assert fallback.json_bytes((1 << 64) - 1)[0] == 4
    deep = b"\x08\x02" * 20_000 + b"\0"
    assert fallback.json_value(deep)[1] == len(deep)
    for data in (b"", b"\x03\0", b"\x07\x0aab", b"\x08\x04\0", b"\x0b", b"\x05" + struct.pack(">d", float("nan")), b"\x07\x02\xff", b"\x08\x01"):
        with pytest.raises(ValueError):
            fallback.json_value(data)


def test_json_errors_are_codes(spark):
    rows = spark.createDataFrame([(bytearray(b"\x08\x02\x02"),), (bytearray(b"\x08\x04\0"),), (None,)], "b binary")
    assert [tuple(r.d) for r in rows.select(fallback.try_json_of_binary(F.col("b")).alias("d")).collect()] == [("[true]", None), (None, w.ENDED), (None, None)]


POINT = Record((Field("x", c.i32), Field("y", c.i32)))


def test_newer_writers_are_read(spark):
    """The documented versions of a point, read by one that knows x and y only."""
    data = ["000000000a00000014", "01100e0000000a000000140c6f726967696e", "02100201010000000a0000001400", "031000030a6c6162656c03010000000a00000014"]
    rows = spark.createDataFrame([(k, bytearray.fromhex(h)) for k, h in enumerate(data)], "k int, b binary")
    got = {r.k: (r.decoded.x, r.decoded.y, r.decoded._error) for r in decode_record(rows, "b", POINT, 0).collect()}
    assert got == {k: (10, 20, None) for k in range(4)}
    nested = c.product(POINT.codec(), c.boolean)
    assert one(spark, nested.decode(F.unhex(L("00" + data[0] + "01"))).alias("d")).d["_1"]


def test_newer_writer_made_a_field_optional_or_removed_it(spark):
    later = Record((*POINT.fields, Field("z", c.string)), (Added("z"), MadeOptional("y"), Removed("x")))
    value = F.struct(L(7).alias("y"), L("z").alias("z"))
    rows = spark.range(1).select(later.enc(value).alias("b"), later.at(2).enc(F.struct(L(1).alias("x"), L(None).cast("int").alias("y"), L("z").alias("z"))).alias("c"))
    assert decode_record(rows, "b", POINT, 0).first().decoded._error == w.REMOVED
    assert decode_record(rows, "c", POINT, 0).first().decoded._error == w.NONE_FOUND
    # the position of y is its place among the fields that are written
    assert decode_record(rows, "b", Record((Field("y", c.i32),)), 0).first().decoded.y == 7


def test_columns_of_the_input_keep_their_values(spark):
    names = ["_v", "_h0", "_c0", "_f_x", "_count", "_n", "_key", "row", "stream", "text", "n", "place", "a.b"]
    rows = spark.range(2).select(*[F.concat(L(x), F.col("id").cast("string")).alias(x) for x in names], F.col("id"), POINT.enc(F.struct(L(1).alias("x"), L(2).alias("y"))).alias("b"))
    for made in (decode_record(rows, "b", POINT, 0), streams.dedup_encode(rows, "stream", "id", "text"), streams.back_references(rows, "stream", "id", F.col("text"))):
        assert {tuple(r[x] for x in names) for r in made.collect()} == {tuple(f"{x}{k}" for x in names) for k in range(2)}


def test_ties_and_nulls_in_streams(spark):
    rows = spark.createDataFrame([("s", 1, "b", 0), ("s", 1, "a", 1), ("s", 2, None, 2), ("s", 3, "b", 3), (None, 1, "a", 4), ("s", 1, "a", 5)], "s string, i int, t string, k int")
    got = {r.k: (r.string_id, r.bytes and r.bytes.hex()) for r in streams.dedup_encode(rows, "s", "i", "t").collect()}
    assert got[0] == (2, "0262") and got[2] == (None, None) and got[3] == (2, "03") and got[4] == (1, "0261")
    assert sorted([got[1], got[5]]) == [(1, "01"), (1, "0261")]
    coded = streams.dedup_encode(rows, "s", "i", "t").select("s", "i", "k", "bytes")
    assert {r.k: r.text for r in streams.dedup_decode(coded, "s", "i", "bytes").collect()} == {0: "b", 1: "a", 2: None, 3: "b", 4: "a", 5: "a"}


def test_bad_references_are_errors(spark):
    rows = spark.createDataFrame([("s", 1, bytearray.fromhex("09"))], "s string, i int, b binary")
    with pytest.raises(PySparkException):
        streams.dedup_decode(rows, "s", "i", "b").collect()


def test_rows_for_display(spark):
    parts = [("a", F.unhex(L("00" * 3))), ("b", F.unhex(L("00" * 7))), ("c", F.unhex(L("00" * 40)))]
    got = [(r.row, r.start, r.len, r.labels) for r in layout.wrapped(spark.range(1), "id", parts).orderBy("row").collect()]
    assert got == [(0, 0, 10, "a,b"), (1, 10, 16, "c"), (2, 26, 16, "c"), (3, 42, 8, "c")]


def test_stored_payloads_must_fit(spark):
    rows = spark.createDataFrame([(1, bytearray(b"x" * 50)), (2, bytearray(b"y"))], "id int, d binary")
    coded, store = rows.select("id", layout.payload(F.col("d"), 10).alias("b")), layout.stored_payloads(F.col("d"), rows, 10)
    assert {r.id: bytes(r.data) for r in layout.resolved_payloads(coded, "id", "b", store).collect()} == {1: b"x" * 50, 2: b"y"}
    with pytest.raises(PySparkException):
        layout.resolved_payloads(coded, "id", "b", store.limit(0)).collect()


def test_words_of_one_value():
    pair = values.Schema(values.Fields((("a", values.Text(True)), ("b", values.Text(True))), head=False))
    assert pair.bytes_of({"a": "same", "b": "same"}).hex() == "0873616d6501"
    assert pair.value_of(bytes.fromhex("0873616d6501")) == {"a": "same", "b": "same"}
    with pytest.raises(values.Wrong, match=w.BAD_STRING_ID):
        pair.value_of(bytes.fromhex("0873616d6503"))


def test_cycles_and_long_lists():
    ring = {"value": 0, "objects": [{"label": x, "next": (k + 1) % 3} for k, x in enumerate("abc")]}
    data = values.NODES.bytes_of(ring)
    assert data.hex() == "00" + "0261" + "0100" + "0262" + "0100" + "0263" + "0101"
    assert values.NODES.value_of(data) == ring
    n = 50_000
    chain = {"value": 0, "objects": [{"label": str(k), "next": k + 1 if k < n - 1 else None} for k in range(n)]}
    assert values.NODES.value_of(values.NODES.bytes_of(chain)) == chain
    with pytest.raises(values.Wrong):
        values.NODES.value_of(bytes.fromhex("05"))


def test_dynamic_values():
    types = dict(values.dynamic_value().names)["value"]
    assert [name for name, _ in types.cases].index("Handle") == 21
    samples = [{"Bool": True}, {"U8": 255}, {"S8": -128}, {"U64": (1 << 64) - 1}, {"F32": 0.5}, {"Char": "λ"}, {"String": "é"}, {"List": []}, {"Option": None}, {"Result": {"err": None}}, {"Variant": {"case_idx": 2, "case_value": {"Tuple": [{"Enum": 1}]}}}, {"Flags": [True, False]}, {"Handle": {"uri": "u", "resource_id": 1}}]
    for schema in (values.dynamic_value(), values.dynamic_value(byte_lists=True)):
        for x in [*samples, {"Record": samples}, {"List": [{"U8": k} for k in range(200)]}]:
            assert schema.value_of(schema.bytes_of(x)) == x
    whole = values.dynamic_value(byte_lists=True).bytes_of({"Record": samples})
    for cut in range(len(whole)):
        with pytest.raises(values.Wrong):
            values.dynamic_value(byte_lists=True).value_of(whole[:cut])
    for bad in ({"U8": 256}, {"None": 1}, {"Char": "ab"}):
        with pytest.raises(values.Wrong):
            values.dynamic_value().bytes_of(bad)


def test_errors_of_values_are_codes(spark):
    schema = values.dynamic_value()
    rows = spark.createDataFrame([(json.dumps({"S32": 5}),), (None,)], "j string").select(schema.enc(F.col("j")).alias("b"))
    got = [tuple(r.d) for r in rows.select(schema.try_decode(F.col("b")).alias("d")).collect()]
    assert got == [('{"S32":5}', None), (None, None)]
    assert one(spark, schema.try_decode(F.unhex(L("0030"))).alias("d")).d._error == w.BAD_CONSTRUCTOR


def test_streams_of_batches(spark, tmp_path):
    from quillpack.streaming import dedup

    kind = "s string, i int, t string"
    for k, part in enumerate(([("x", 1, "a"), ("x", 2, "b"), ("y", 1, "a")], [("x", 3, "a"), ("x", 4, "c"), ("y", 2, None)])):
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = dedup.dedup_encode_stream(source, "s", "i", "t").writeStream.format("memory").queryName("dedup_out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.s, r.i): (r.string_id, r.bytes and bytes(r.bytes).hex()) for r in spark.sql("select * from dedup_out").collect()}
    assert got == {("x", 1): (1, "0261"), ("x", 2): (2, "0262"), ("x", 3): (1, "01"), ("x", 4): (3, "0263"), ("y", 1): (1, "0261"), ("y", 2): (None, None)}


def versions():
    a, new, b = ("field_a", values.Text()), ("new_field_1", values.Flag()), ("field_b", values.Number("i"))
    steps = (("added", "new_field_1", True), ("optional", "field_b"), ("removed", "field_b"), ("transient", "field_a", "unset"))
    maybe = ("field_b", values.Maybe(b[1]))
    fields = ((a, b), (a, new, b), (a, new, maybe), (a, new), (a, new))
    return [values.Schema(values.Evolved(f, steps[:k])) for k, f in enumerate(fields)]


@pytest.mark.parametrize("reader", range(5))
def test_histories_among_recursive_values(reader):
    from tests.test_records import BYTES

    family = versions()
    whole = {"field_a": "hello", "new_field_1": True, "field_b": 42}
    assert family[reader].bytes_of(whole).hex() == BYTES[reader]
    for writer, h in enumerate(BYTES):
        data = bytes.fromhex(h)
        if reader < 4 and (writer == 4 or writer == 3 and reader < 2):
            with pytest.raises(values.Wrong, match=w.REMOVED):
                family[reader].value_of(data)
            continue
        expected = {k: v for k, v in whole.items() if k in dict(family[reader].root.fields)}
        expected |= {"field_b": None} if reader == 2 and writer == 3 else {}
        expected |= {"field_a": "unset"} if reader == 4 else {}
        assert family[reader].value_of(data) == expected
        for cut in range(len(data) if writer else 0):
            with pytest.raises(values.Wrong):
                family[reader].value_of(data[:cut])
    none = family[2].bytes_of(whole | {"field_b": None})
    with pytest.raises(values.Wrong, match=w.NONE_FOUND):
        family[1].value_of(none)
