"""Documented bytes of record versions, and reading each version as each other."""

import pytest
from pyspark.sql import functions as F

from quillpack.functions import codecs as c
from quillpack.functions import wire as w
from quillpack.plans.queries import PRODUCT
from quillpack.plans.records import Added, Field, Record, Removed, decode_record

L = F.lit
BYTES = ["000a68656c6c6f0000002a", "0114020a68656c6c6f0000002a01", "02160201ff0a68656c6c6f010000002a01", "030c02030e6669656c645f6203010a68656c6c6f01", "040002030e6669656c645f620301030e6669656c645f6101"]


def product(version):
    return PRODUCT.at(version).enc(F.struct(L("hello").alias("field_a"), L(True).alias("new_field_1"), L(42).alias("field_b")))


def test_bytes_of_versions(spark):
    row = spark.range(1).select(*[F.hex(product(v)).alias(f"v{v}") for v in range(5)]).first()
    assert [x.lower() for x in row] == BYTES


def test_stated_bytes(spark):
    point = Record((Field("x", c.i32), Field("y", c.i32)), (Added("x", 0), Removed("z")))
    row = spark.range(1).select(F.hex(point.enc(F.struct(L(1).alias("x"), L(-10).alias("y")))).alias("h")).first()
    assert row.h.lower() == "020808" + "03027a" + "fffffff600000001"


@pytest.mark.parametrize("reader", range(5))
def test_every_version_reads_every_other(spark, reader):
    rows = spark.createDataFrame([(v, bytearray.fromhex(h)) for v, h in enumerate(BYTES)], "v int, b binary")
    got = {r.v: r.decoded.asDict() for r in decode_record(rows, "b", PRODUCT, reader).collect()}
    for writer in range(5):
        error = got[writer].pop("_error")
        if reader == 4:
            assert got[writer] == {"new_field_1": True, "field_a": "unset"} and error is None
        elif writer == 4 or writer == 3 and reader < 2:
            assert error == w.REMOVED
        else:
            assert error is None
            assert got[writer]["field_a"] == "hello"
            assert got[writer].get("new_field_1", True) is True
            assert got[writer].get("field_b") == (None if reader == 3 or writer == 3 else 42)


def test_none_for_a_required_field(spark):
    rows = spark.createDataFrame([(bytearray.fromhex("02100201ff0a68656c6c6f0001"),)], "b binary")
    assert decode_record(rows, "b", PRODUCT, 1).first().decoded._error == w.NONE_FOUND


def test_validation():
    with pytest.raises(ValueError):
        Record((Field("a", c.i32),), (Added("b", 1),))
