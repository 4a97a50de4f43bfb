"""Wire primitives as Column expressions: fixed-width and variable-length numbers, strings and byte blocks.

Writers map a Column to a binary Column. Readers map a binary Column and a
position (from 1) to a struct of the value ``v``, the position ``p`` after it and
an error code ``e`` that is null where all is well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: names of the decoding errors
ENDED = "InputEndedUnexpectedly"
BAD_STRING = "FailedToDecodeString"
BAD_NUMBER = "InvalidVarInt"
FAILED = "DeserializationFailure"
BAD_CONSTRUCTOR = "InvalidConstructorId"
BAD_STRING_ID = "InvalidStringId"
REMOVED = "FieldRemovedInSerializedVersion"
NO_DEFAULT = "FieldWithoutDefaultValueIsMissing"
NONE_FOUND = "NonOptionalFieldSerializedAsNone"
TRANSIENT_CASE = "SerializingTransientConstructor"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def be(x: Column, width: int) -> Column:
    """The last ``width`` bytes of a whole number, big-endian two's complement."""
    return F.unhex(F.right(F.lpad(F.hex(x.cast("bigint")), 16, "0"), F.lit(2 * width)))


def be_u64(x: Column) -> Column:
    """Eight bytes of an unsigned number held as decimal(20,0)."""
    return F.unhex(F.lpad(F.conv(x.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0"))


def be_i128(x: Column) -> Column:
    """Sixteen bytes of a decimal(38,0), by its quotient and rest by 2^64."""
    x = x.cast("decimal(38,0)")
    two64 = F.lit("18446744073709551616").cast("decimal(38,0)")
    low = F.pmod(x, two64).cast("decimal(20,0)")
    high = ((x - low.cast("decimal(38,0)")) / two64).cast("decimal(38,0)").cast("bigint")
    return F.concat(be(high, 8), be_u64(low))


def f64_bits(x: Column) -> Column:
    return F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x.cast("double")).cast("bigint")


def f32_bits(x: Column) -> Column:
    return F.call_function("reflect", F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x.cast("float")).cast("bigint")


def var_u32_size(n: Column) -> Column:
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)


def var_u32(n: Column) -> Column:
    """Seven bits a byte, lowest first, the top bit set on all but the last."""
    n = n.cast("bigint")
    group = lambda k, more: F.right(F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(F.lit(127)) + more), 2, "0"), F.lit(2))
    upto = lambda last: F.unhex(F.concat(*[group(k, 128 if k < last else 0) for k in range(last + 1)]))
    return F.when(n < 1 << 7, upto(0)).when(n < 1 << 14, upto(1)).when(n < 1 << 21, upto(2)).when(n < 1 << 28, upto(3)).otherwise(upto(4))


def zigzag(n: Column) -> Column:
    n = n.cast("bigint")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def var_i32(n: Column) -> Column:
    return var_u32(zigzag(n))


def byte_at(b: Column, p: Column) -> Column:
    """The byte at a position as a number; null beyond the end."""
    return F.conv(F.nullif(F.hex(F.substring(b, p, F.lit(1))), F.lit("")), 16, 10).cast("int")


def result(v: Column, p: Column, e: Column | str | None = None) -> Column:
    e = F.lit(e) if isinstance(e, str) else e
    return F.struct(v.alias("v"), p.alias("p"), (F.lit(None) if e is None else e).cast("string").alias("e"))


def read_fixed(width: int, make: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """make gets the hexadecimal digits of the bytes."""

    def read(b: Column, p: Column) -> Column:
        h = F.hex(F.substring(b, p, F.lit(width)))
        return result(F.when(F.length(h) == 2 * width, make(h)), p + width, F.when(F.length(h) != 2 * width, ENDED))

    return read


def signed(width: int) -> Callable[[Column], Column]:
    """The value of hexadecimal digits as a signed number of that width."""
    if width == 8:
        return lambda h: F.conv(h, 16, -10).cast("bigint")
    half, whole = 1 << (8 * width - 1), 1 << (8 * width)
    return lambda h: F.pmod(F.conv(h, 16, 10).cast("bigint") + half, F.lit(whole)) - half


def unsigned(h: Column) -> Column:
    return F.conv(h, 16, 10)


def read_var_u32(b: Column, p: Column) -> Column:
    """Up to five bytes as one number of 40 bits, whose parts are taken out by shifts."""

    def of_digits(h: Column) -> Column:
        return let(F.struct((F.length(h) / 2).cast("int").alias("n"), F.conv(F.rpad(h, 10, "F"), 16, 10).cast("bigint").alias("x")), of_bytes)

    def of_bytes(s: Column) -> Column:
        n, x = s["n"], s["x"]
        part = lambda k: F.shiftright(x, 32 - 8 * k).bitwiseAND(F.lit(127))
        more = lambda k: F.shiftright(x, 39 - 8 * k).bitwiseAND(F.lit(1)) == 1
        # a byte that is not there is FF, so it is never the last
        last = F.when(~more(0), 0).when(~more(1), 1).when(~more(2), 2).when(~more(3), 3).when(~more(4), 4).otherwise(9)
        value = part(0)
        for k in range(1, 5):
            value = value + F.when(last >= k, F.shiftleft(part(k), 7 * k)).otherwise(0)
        wrong = F.when(last == 9, F.when(n < 5, ENDED).otherwise(BAD_NUMBER))
        return result(F.when(last < 9, value), (p + F.when(last < 9, last + 1).otherwise(0)).cast("int"), wrong)

    return let(F.hex(F.substring(b, p, F.lit(5))), of_digits)


def read_var_i32(b: Column, p: Column) -> Column:
    unzig = lambda n: F.shiftright(n, 1).bitwiseXOR(-(n.bitwiseAND(F.lit(1))))
    return let(read_var_u32(b, p), lambda r: result(unzig(r["v"]), r["p"], r["e"]))


def string(x: Column) -> Column:
    return F.concat(var_u32(2 * F.octet_length(x)), F.encode(x, "utf-8"))


def string_size(x: Column) -> Column:
    n = F.octet_length(x)
    return n + var_u32_size(2 * n)


def block(x: Column) -> Column:
    return F.concat(var_u32(F.octet_length(x)), x)


def read_sized(read_length: Callable[[Column, Column], Column], make: Callable[[Column], Column], error: str, kind: str) -> Callable[[Column, Column], Column]:
    """Bytes after a length; a negative length or one beyond the end is an error."""

    def read(b: Column, p: Column) -> Column:
        def with_length(r: Column) -> Column:
            n, value = r["v"].cast("int"), make(F.substring(b, r["p"], r["v"].cast("int")))
            none = F.lit(None).cast(kind)
            wrong = F.when(r["e"].isNotNull(), r["e"]).when(n < 0, FAILED).otherwise(ENDED)
            fits = r["e"].isNull() & (n >= 0) & (r["p"] - 1 + n <= F.octet_length(b))
            return F.when(fits, result(value, r["p"] + n, F.when(value.isNull(), error))).otherwise(result(none, r["p"], wrong))

        return let(read_length(b, p), with_length)

    return read


read_string = read_sized(read_var_i32, lambda x: F.try_validate_utf8(x), BAD_STRING, "string")
read_block = read_sized(read_var_u32, lambda x: x, FAILED, "binary")

BYTES = T.BinaryType()
