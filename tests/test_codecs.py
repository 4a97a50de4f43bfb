"""Exact bytes of documented values, and that they are read back."""

import pytest
from pyspark.sql import functions as F

from quillpack.functions import codecs as c

L = F.lit
VECTORS = {
    "i32": (lambda: (c.i32, L(42)), "0000002a"),
    "u16": (lambda: (c.u16, L(1000)), "03e8"),
    "bool": (lambda: (c.boolean, L(True)), "01"),
    "char": (lambda: (c.char(), L("λ")), "bb07"),
    "char16": (lambda: (c.char(c.Options(utf16_chars=True)), L("A")), "0041"),
    "string": (lambda: (c.string, L("meadow")), "0c6d6561646f77"),
    "some": (lambda: (c.option(c.i32), L(7)), "0100000007"),
    "none": (lambda: (c.option(c.i32), L(None).cast("int")), "00"),
    "ok": (lambda: (c.result_of(c.i32, c.string), F.struct(L(7).alias("ok"), L(None).cast("string").alias("err"))), "0100000007"),
    "err": (lambda: (c.result_of(c.i32, c.string), F.struct(L(None).cast("int").alias("ok"), L("no").alias("err"))), "00046e6f"),
    "list": (lambda: (c.sequence(c.i32), F.array(L(1), L(2), L(3))), "06000000010000000200000003"),
    "unknown size": (lambda: (c.sequence(c.i32, False), F.array(L(1), L(2))), "010100000001010000000200"),
    "map": (lambda: (c.map_of(c.string, c.i32), F.create_map(L("a"), L(1), L("b"), L(2))), "040002610000000100026200000002"),
    "pair": (lambda: (c.tuple_of(c.i32, c.boolean), F.struct(L(42).alias("_0"), L(True).alias("_1"))), "000000002a01"),
    "date": (lambda: (c.date, F.to_date(L("2024-06-22"))), "e80f0616"),
    "time": (lambda: (c.time_of_day, L(34_205_000_000_125)), "091e057d"),
    "decimal": (lambda: (c.decimal(10, 2), L("123.45").cast("decimal(10,2)")), "0c3132332e3435"),
    "bits": (lambda: (c.bit_array, F.array(*[L(k in (0, 2)) for k in range(8)])), "01a0"),
    "mac": (lambda: (c.mac, L("00:11:22:33:44:55")), "001122334455"),
    "json": (lambda: (c.json_text, L('{"a":1}')), "077b2261223a317d"),
    "var_u32": (lambda: (c.var_u32, L(16384)), "808001"),
    "var_i32": (lambda: (c.var_i32, L(-64)), "7f"),
    "i128": (lambda: (c.i128, L("-5").cast("decimal(38,0)")), "f" * 31 + "b"),
    "u64": (lambda: (c.u64, L("18446744073709551615").cast("decimal(20,0)")), "f" * 16),
    "f64": (lambda: (c.f64, L(1.5)), "3ff8000000000000"),
    "bigint": (lambda: (c.bigint64, L(-129)), "02ff7f"),
    "ipv4": (lambda: (c.ipv4, L("10.0.200.1")), "000a00c801"),
}


@pytest.mark.parametrize("name", VECTORS)
def test_vector(spark, name):
    make, expected = VECTORS[name]
    codec, x = make()
    row = spark.range(1).select(F.hex(codec.enc(x)).alias("h"), codec.decode(codec.enc(x), strict=True).alias("d"), x.alias("x"), codec.size(x).alias("n")).first()
    assert row.h.lower() == expected
    assert row.d == row.x
    assert 2 * row.n == len(expected)


@pytest.mark.parametrize("codec, data", [(c.i32, "0000"), (c.string, "0c64"), (c.option(c.i32), "05"), (c.nonzero(c.i32), "00000000"), (c.sequence(c.i32), "0600000001")])
def test_bad_bytes_are_reported(spark, codec, data):
    row = spark.range(1).select(codec.try_decode(F.unhex(L(data))).alias("d")).first()
    assert row.d.value is None and row.d._error
