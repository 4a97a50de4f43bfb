"""Queries that once left out a part of their tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillpack.functions import codecs as c
from quillpack.functions import wire as w
from quillpack.plans.queries import PRODUCT, QUERIES
from quillpack.plans import queries as catalogue
from tests.test_records import BYTES


def shortest(n):
    width = next(k for k in range(1, 40) if -(1 << 8 * k - 1) <= n < 1 << 8 * k - 1)
    return f"{width:02X}{n % (1 << 8 * width):0{2 * width}X}"


@pytest.mark.parametrize("name, head", [("encode_bigint_wide", ""), ("encode_decimal_binary_wide", f"{50:016X}")])
def test_wide_numbers_of_all_widths(spark, tmp_path, name, head):
    keys = [-32769, -1, 0, 1, 127, 128, 32767, 32768, 150_000, 8_388_607, 8_388_608, 1 << 31, (1 << 40) + 5]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.bytes for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {k: head + shortest(k << 64) for k in keys}


def test_decimals_of_keys_beyond_six_digits(spark, tmp_path):
    keys = [0, 149_999, 999_999, 1_000_000, 8_999_999, 99_999_999_999]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.value for r in QUERIES["decode_decimal_binary_long"](spark, str(tmp_path)).collect()}
    assert got == {k: f"{k // 100_000}.{k % 100_000:05d}0000001" for k in keys}


@pytest.mark.parametrize("name", ["evolve_union_case", "evolve_union_case_all"])
def test_union_with_a_history_inside(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    found = QUERIES[name](spark, data)
    got = {r[0]: tuple(r) for r in found.collect()}
    rows = con.sql(f"SELECT {', '.join(chr(34) + x + chr(34) for x in found.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert got == {r[0]: r for r in rows} and len(got) == len(rows)


@pytest.mark.parametrize("version", range(5))
def test_records_of_every_version_inside_others(spark, version):
    """All five versions of the documented record before a byte that must stay in place."""
    nested = c.product(PRODUCT.at(version).codec(), c.boolean, names=["r", "after"])
    rows = spark.createDataFrame([(v, bytearray.fromhex("00" + h + "01")) for v, h in enumerate(BYTES[: version + 1])], "v int, b binary")
    got = {r.v: r.d for r in rows.select("v", nested.try_decode(F.col("b")).alias("d")).collect()}
    for writer in range(version + 1):
        if version == 4:
            assert got[writer]._error is None and got[writer].value.r.asDict() == {"new_field_1": True, "field_a": "unset"}
            continue
        assert got[writer]._error is None and got[writer].value.after is True
        assert got[writer].value.r.field_a == "hello"
        assert got[writer].value.r.asDict().get("field_b") == (None if version == 3 else 42)
    cut = spark.createDataFrame([(bytearray.fromhex("00" + BYTES[version])[:-3],)], "b binary")
    assert cut.select(nested.try_decode(F.col("b")).alias("d")).first().d._error == w.ENDED
