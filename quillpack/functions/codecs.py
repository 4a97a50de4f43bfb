"""Codecs: how a typed value becomes bytes and back, as Column expressions.

A codec has enc(x), read(b, p) and size(x). Combinators build codecs of nested
values from those of their parts. Nulls are values of ``option`` only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillpack.functions import wire as w

Read = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Options:
    """utf16_chars: characters as two bytes; binary_decimals and binary_json: the typed forms instead of text."""

    utf16_chars: bool = False
    binary_decimals: bool = False
    binary_json: bool = False


@dataclass(frozen=True)
class Codec:
    enc: Callable[[Column], Column]
    read: Read
    sql_type: str
    size_of: Callable[[Column], Column] | None = None
    least: int = 1  # bytes that any value takes at least
    width: int | None = None  # bytes that every value takes, where no bytes of that many are wrong

    def size(self, x: Column) -> Column:
        """Bytes that enc(x) has, without building them where a formula is known."""
        return self.size_of(x) if self.size_of else F.octet_length(self.enc(x))

    def decode(self, b: Column, strict: bool = False) -> Column:
        """The value; fails with the error code on bad bytes. strict: also where bytes are left over."""

        def finish(r: Column) -> Column:
            extra = F.when(r["p"] <= F.octet_length(b), F.lit(w.FAILED)) if strict else F.lit(None)
            return let_error(F.coalesce(r["e"], extra), r["v"])

        # a bound buffer is not copied out of its row again for each place that reads it
        return w.let(b, lambda b: w.let(self.read(b, F.lit(1)), finish))

    def try_decode(self, b: Column) -> Column:
        """struct of value and _error; the value is null where there is an error."""
        return w.let(b, lambda b: w.let(self.read(b, F.lit(1)), lambda r: F.struct(F.when(r["e"].isNull(), r["v"]).alias("value"), r["e"].alias("_error"))))


def let_error(e: Column, v: Column) -> Column:
    return F.when(e.isNotNull(), F.raise_error(e)).otherwise(v)


def fixed(width: int, sql_type: str, make: Callable[[Column], Column], enc: Callable[[Column], Column] | None = None) -> Codec:
    return Codec(enc or (lambda x: w.be(x, width)), w.read_fixed(width, lambda h: make(h).cast(sql_type)), sql_type, lambda x: F.lit(width), width, width)


def in_range(x: Column, top: int, low: int = 0) -> Column:
    return F.when((x < low) | (x > top), F.raise_error(F.lit("LengthTooLarge: not a number of that width"))).otherwise(x)


def whole(n: int, kind: str) -> Codec:
    half = 1 << (8 * n - 1)
    return fixed(n, kind, w.signed(n), (lambda x: w.be(in_range(x, half - 1, -half), n)) if n < 8 else None)


i8, i16, i32, i64 = (whole(n, kind) for n, kind in ((1, "tinyint"), (2, "smallint"), (4, "int"), (8, "bigint")))


u8, u16, u32 = (fixed(n, kind, w.unsigned, lambda x, n=n: w.be(in_range(x, (1 << 8 * n) - 1), n)) for n, kind in ((1, "smallint"), (2, "int"), (4, "bigint")))
u64 = fixed(8, "decimal(20,0)", w.unsigned, w.be_u64)
isize, usize = i64, u64  # as wide as on any machine


def of_halves(h: Column) -> Column:
    two64 = F.lit("18446744073709551616").cast("decimal(38,0)")
    return F.conv(F.left(h, F.lit(16)), 16, -10).cast("decimal(38,0)") * two64 + F.conv(F.right(h, F.lit(16)), 16, 10).cast("decimal(38,0)")


i128 = fixed(16, "decimal(38,0)", of_halves, w.be_i128)
bits_of = lambda cls, method: lambda n: F.call_function("reflect", F.lit(cls), F.lit(method), n)
f64 = fixed(8, "double", lambda h: bits_of("java.lang.Double", "longBitsToDouble")(F.conv(h, 16, -10).cast("bigint")), lambda x: w.be(w.f64_bits(x), 8))
f32 = fixed(4, "float", lambda h: bits_of("java.lang.Float", "intBitsToFloat")(w.signed(4)(h).cast("int")), lambda x: w.be(w.f32_bits(x), 4))
boolean = fixed(1, "boolean", lambda h: h != "00", lambda x: F.when(x, w.constant(b"\1")).otherwise(w.constant(b"\0")))
unit = Codec(lambda x: w.constant(b""), lambda b, p: w.result(F.lit(None).cast("string"), p), "string", lambda x: F.lit(0), 0, 0)
var_u32 = Codec(lambda x: w.var_u32(in_range(x, (1 << 32) - 1)), w.read_var_u32, "bigint", w.var_u32_size)
var_i32 = Codec(lambda x: w.var_i32(in_range(x, (1 << 31) - 1, -(1 << 31))), w.read_var_i32, "bigint", lambda x: w.var_u32_size(w.zigzag(x)))
string = Codec(w.string, w.read_string, "string", w.string_size)
block = Codec(w.block, w.read_block, "binary", lambda x: F.octet_length(x) + w.var_u32_size(F.octet_length(x)))


def mapped(inner: Codec, to: Callable[[Column], Column], back: Callable[[Column], Column], sql_type: str, wrong: Callable[[Column], Column] | None = None, size_of: Callable[[Column], Column] | None = None) -> Codec:
    """inner over to(x), read through back; wrong(v) gives an error code for values that must not be read."""

    def read(b: Column, p: Column) -> Column:
        return w.let(inner.read(b, p), lambda r: w.result(back(r["v"]).cast(sql_type), r["p"], F.coalesce(r["e"], wrong(r["v"]) if wrong else F.lit(None).cast("string"))))

    return Codec(lambda x: inner.enc(to(x)), read, sql_type, size_of, inner.least)


def nonzero(inner: Codec) -> Codec:
    return mapped(inner, lambda x: x, lambda x: x, inner.sql_type, lambda v: F.when(v == 0, w.FAILED), inner.size_of)


def char(options: Options = Options()) -> Codec:
    """One code point."""

    def single(x: Column) -> Column:
        return F.when(F.char_length(x) != 1, F.raise_error(F.lit("FailedToDecodeCharacter: not one character"))).otherwise(F.ascii(x))

    if options.utf16_chars:
        outside = lambda x: F.when(F.ascii(x) > 0xFFFF, F.raise_error(F.lit("FailedToDecodeCharacter: outside two bytes"))).otherwise(single(x))
        return mapped(u16, outside, lambda v: F.decode(w.be(v, 2), "UTF-16BE"), "string", lambda v: F.when(v.between(0xD800, 0xDFFF), "FailedToDecodeCharacter"))
    wrong = lambda v: F.when((v > 0x10FFFF) | v.between(0xD800, 0xDFFF), "FailedToDecodeCharacter")
    return mapped(var_u32, single, lambda v: F.when(wrong(v).isNull(), F.decode(w.be(v, 4), "UTF-32")), "string", wrong)


def product(*codecs: Codec, names: list[str] | None = None, head: bytes = b"\0") -> Codec:
    """Values one after the other behind fixed head bytes; a struct with fields _0, _1 ... or of the given names."""
    names = names or [f"_{k}" for k in range(len(codecs))]

    def read(b: Column, p: Column) -> Column:
        def step(k: int, p: Column, e: Column, values: list[Column]) -> Column:
            if k == len(codecs):
                return w.result(F.struct(*[v.alias(n) for v, n in zip(values, names)]), p, e)
            return w.let(codecs[k].read(b, p), lambda r: step(k + 1, r["p"], F.coalesce(e, r["e"]), [*values, r["v"]]))

        return step(0, p + len(head), F.when(p - 1 + len(head) > F.octet_length(b), w.ENDED).cast("string"), [])

    kind = f"struct<{','.join(f'{n}:{c.sql_type}' for c, n in zip(codecs, names))}>"
    total = lambda x: sum((c.size(x[n]) for c, n in zip(codecs, names)), F.lit(len(head)))
    return Codec(lambda x: F.concat(w.constant(head), *[c.enc(x[n]) for c, n in zip(codecs, names)]), read, kind, total, len(head) + sum(c.least for c in codecs))


def tuple_of(*codecs: Codec) -> Codec:
    """One to eight values behind a zero byte; single values have it too, so that they can be read again."""
    return product(*codecs)


def range_of(inner: Codec) -> Codec:
    return product(inner, inner, names=["start", "end"], head=b"")


def tagged(b: Column, p: Column, cases: dict[int, Callable[[Column], Column]], nothing: Column) -> Column:
    """Reads a tag byte and goes on by it; other tags are errors."""

    tag = w.byte_at(b, p)
    out = F.when(tag.isNull(), w.result(nothing, p, w.ENDED))
    for value, go in cases.items():
        out = out.when(tag == value, go(p + 1))
    return out.otherwise(w.result(nothing, p, w.FAILED))


def option(inner: Codec) -> Codec:
    null = lambda: F.lit(None).cast(inner.sql_type)
    enc = lambda x: F.when(x.isNull(), w.constant(b"\0")).otherwise(F.concat(w.constant(b"\1"), inner.enc(x)))
    read = lambda b, p: tagged(b, p, {0: lambda q: w.result(null(), q), 1: lambda q: inner.read(b, q)}, null())
    return Codec(enc, read, inner.sql_type, lambda x: F.when(x.isNull(), 1).otherwise(1 + inner.size(x)))


def result_of(ok: Codec, err: Codec) -> Codec:
    """struct<ok, err>: ok counts where it is not null."""
    kind = f"struct<ok:{ok.sql_type},err:{err.sql_type}>"
    null = lambda: F.lit(None).cast(kind)
    enc = lambda x: F.when(x["ok"].isNotNull(), F.concat(w.constant(b"\1"), ok.enc(x["ok"]))).otherwise(F.concat(w.constant(b"\0"), err.enc(x["err"])))
    good = lambda r: w.result(F.struct(r["v"].alias("ok"), F.lit(None).cast(err.sql_type).alias("err")), r["p"], r["e"])
    bad = lambda r: w.result(F.struct(F.lit(None).cast(ok.sql_type).alias("ok"), r["v"].alias("err")), r["p"], r["e"])
    return Codec(enc, lambda b, p: tagged(b, p, {1: lambda q: w.let(ok.read(b, q), good), 0: lambda q: w.let(err.read(b, q), bad)}, null()), kind)


def bound(inner: Codec) -> Codec:
    """struct<kind, value>: 0 unbounded, 1 included, 2 excluded."""
    kind = f"struct<kind:tinyint,value:{inner.sql_type}>"
    made = lambda k, v: F.struct(F.lit(k).cast("tinyint").alias("kind"), v.alias("value"))
    null = lambda: F.lit(None).cast(inner.sql_type)
    enc = lambda x: F.when(x["kind"] == 0, w.constant(b"\0")).otherwise(F.concat(w.be(x["kind"], 1), inner.enc(x["value"])))
    case = lambda b, k: lambda q: w.let(inner.read(b, q), lambda r: w.result(made(k, r["v"]), r["p"], r["e"]))
    return Codec(enc, lambda b, p: tagged(b, p, {0: lambda q: w.result(made(0, null()), q), 1: case(b, 1), 2: case(b, 2)}, F.lit(None).cast(kind)), kind)


def joined(x: Column, item: Callable[[Column], Column]) -> Column:
    """The bytes of all items one after the other, as one text of hexadecimal digits, so that none are copied again for each item."""
    return F.unhex(F.array_join(F.transform(x, lambda i: F.hex(item(i))), ""))


STEPS = 256  # items that are read before they are put with the others, as an array is copied for each


def sequence(inner: Codec, known_size: bool = True) -> Codec:
    """An array: its count and items, or -1 and each item behind a one, ended by a zero. Reads both forms.

    Items of one width are read at their places; others one after the other, in
    runs of STEPS, so an array of n items is read in about n steps. A count whose
    items cannot be in the bytes that are left is an error before any is read.
    """
    if known_size:
        enc = lambda x: F.concat(w.var_u32(2 * F.size(x)), joined(x, inner.enc))
    else:
        enc = lambda x: F.concat(w.constant(b"\1"), joined(x, lambda i: F.concat(w.constant(b"\1"), inner.enc(i))), w.constant(b"\0"))
    kind = f"array<{inner.sql_type}>"
    none = lambda: F.lit(None).cast(kind)
    empty = lambda: F.array().cast(kind)

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))

    def runs(n: Column, p: Column, stop: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
        """n steps from a state of no items at p, in two levels: the items of a run, and all runs."""
        state = lambda v, x: F.struct(v.alias("v"), x["p"].alias("p"), x["e"].alias("e"), x["done"].alias("done"))
        start = lambda v, p: F.struct(v.alias("v"), p.alias("p"), F.lit(None).cast("string").alias("e"), F.lit(False).alias("done"))

        def run(all_runs: Column, k: Column) -> Column:
            some = F.aggregate(upto(F.least(n - (k - 1) * STEPS, F.lit(STEPS))), state(empty(), all_runs), lambda acc, _: F.when(stop(acc), acc).otherwise(step(acc)))
            return F.when(stop(all_runs), all_runs).otherwise(w.let(some, lambda x: state(F.array_append(all_runs["v"], x["v"]), x)))

        nothing = F.array().cast(f"array<{kind}>")
        return w.let(F.aggregate(upto(F.ceil(n / STEPS)), start(nothing, p), run), lambda x: state(F.flatten(x["v"]), x))

    stopped = lambda acc: acc["e"].isNotNull() | acc["done"]
    after = lambda acc, r: F.struct(F.array_append(acc["v"], r["v"]).alias("v"), r["p"].alias("p"), r["e"].alias("e"), F.lit(False).alias("done"))

    def read(b: Column, p: Column) -> Column:
        return w.let(b, lambda b: items_at(b, p))

    def items_at(b: Column, p: Column) -> Column:
        def counted(r: Column) -> Column:
            n, left = r["v"], F.octet_length(b) + 1 - r["p"]
            if inner.width:
                at = lambda i: inner.read(b, r["p"] + (i - 1) * inner.width)["v"]
                found = w.result(F.transform(upto(n), at), (r["p"] + n * inner.width).cast("int"))
            else:
                found = w.let(runs(n, r["p"], stopped, lambda acc: w.let(inner.read(b, acc["p"]), lambda x: after(acc, x))), lambda x: w.result(x["v"], x["p"], x["e"]))
            return F.when(n * inner.least > left, w.result(none(), r["p"], w.ENDED)).otherwise(found)

        def marked(r: Column) -> Column:
            # the steps are as many as bytes are left, and stop at the zero byte
            ended = lambda acc, e: F.struct(acc["v"].alias("v"), (acc["p"] + 1).alias("p"), F.lit(e).cast("string").alias("e"), F.lit(True).alias("done"))
            item = lambda acc: w.let(inner.read(b, acc["p"] + 1), lambda x: after(acc, x))
            step = lambda acc: w.let(w.byte_at(b, acc["p"]), lambda t: F.when(t == 1, item(acc)).when(t == 0, ended(acc, None)).otherwise(ended(acc, w.FAILED)))
            all_steps = runs(F.octet_length(b) - r["p"] + 1, r["p"], stopped, step)
            return w.let(all_steps, lambda x: w.result(x["v"], x["p"], F.when(x["e"].isNull() & ~x["done"], w.ENDED).otherwise(x["e"])))

        return w.let(w.read_var_i32(b, p), lambda r: F.when(r["e"].isNotNull(), w.result(none(), p, r["e"])).when(r["v"] < -1, w.result(none(), p, w.FAILED)).when(r["v"] == -1, marked(r)).otherwise(counted(r)))

    return Codec(enc, read, kind)


def fixed_array(inner: Codec, n: int) -> Codec:
    return mapped(sequence(inner), lambda x: x, lambda x: x, f"array<{inner.sql_type}>", lambda v: F.when(F.size(v) != n, w.FAILED))


def nonempty(inner: Codec) -> Codec:
    full = lambda x: F.when(F.size(x) > 0, x).otherwise(F.raise_error(F.lit(f"{w.FAILED}: empty")))
    return mapped(sequence(inner), full, lambda x: x, f"array<{inner.sql_type}>", lambda v: F.when(F.size(v) == 0, w.FAILED))


def set_of(inner: Codec) -> Codec:
    """Sorted distinct items; repeats collapse when read."""
    return mapped(sequence(inner), lambda x: F.array_sort(F.array_distinct(x)), F.array_distinct, f"array<{inner.sql_type}>")


def map_of(key: Codec, value: Codec) -> Codec:
    """Entries in order of their keys, so that equal maps have equal bytes; the last of repeated keys counts when read."""
    entry = product(key, value, names=["key", "value"])
    # entries in order of keys and places; of equal keys the last stays
    numbered = lambda v: F.array_sort(F.transform(v, lambda x, i: F.struct(x["key"].alias("key"), i.alias("i"), x["value"].alias("value"))))
    lasts = lambda v: F.filter(v, lambda x, i: (i == F.size(v) - 1) | ~F.coalesce(F.get(v, i + 1)["key"] == x["key"], F.lit(False)))
    pairs = lambda v: F.transform(lasts(v), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    later = lambda v: w.let(numbered(v), pairs)
    return mapped(sequence(entry), lambda m: F.array_sort(F.map_entries(m)), lambda v: F.map_from_entries(later(v)), f"map<{key.sql_type},{value.sql_type}>")


duration = product(u64, u32, names=["secs", "nanos"], head=b"")
weekday = month = i8
uuid = Codec(lambda x: F.unhex(F.replace(x, F.lit("-"), F.lit(""))), w.read_fixed(16, lambda h: F.regexp_replace(F.lower(h), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")), "string", lambda x: F.lit(16))
mac = Codec(lambda x: F.unhex(F.replace(x, F.lit(":"), F.lit(""))), w.read_fixed(6, lambda h: F.regexp_replace(F.lower(h), "(..)(?=.)", "$1:")), "string", lambda x: F.lit(6))
url = mapped(string, lambda x: x, lambda x: x, "string", lambda v: F.when(F.try_parse_url(v, F.lit("PROTOCOL")).isNull(), w.FAILED), w.string_size)
decimal_text = lambda p, s: mapped(string, lambda x: x.cast(f"decimal({p},{s})").cast("string"), lambda v: v.try_cast(f"decimal({p},{s})"), f"decimal({p},{s})", lambda v: F.when(v.try_cast(f"decimal({p},{s})").isNull(), w.FAILED))


def least_bytes(x: Column) -> Column:
    """The shortest two's complement of a whole number of 64 bits."""
    x = x.cast("bigint")
    out = w.be(x, 8)
    for n in range(7, 0, -1):
        half = 1 << (8 * n - 1)
        out = F.when((x >= -half) & (x < half), w.be(x, n)).otherwise(out)
    return out


def of_least_bytes(v: Column) -> Column:
    fill = F.when(F.conv(F.left(F.hex(v), F.lit(2)), 16, 10).cast("int") >= 128, "F").otherwise("0")
    return F.conv(F.right(F.concat(F.repeat(fill, F.lit(16)), F.hex(v)), F.lit(16)), 16, -10).cast("bigint")


bigint64 = mapped(block, least_bytes, of_least_bytes, "bigint", lambda v: F.when(F.octet_length(v) > 8, "LengthTooLarge"))


def decimal_binary(p: int, s: int) -> Codec:
    """The scale and the unscaled number, which must fit 64 bits; read exactly, whatever the writer's scale."""

    def to(x: Column) -> Column:
        digits = F.replace(x.cast(f"decimal({p},{s})").cast("string"), F.lit("."), F.lit(""))
        return F.struct(F.lit(s).cast("bigint").alias("scale"), digits.cast("decimal(38,0)").cast("bigint").alias("unscaled"))

    def back(v: Column) -> Column:
        digits = F.abs(v["unscaled"].cast("decimal(20,0)")).cast("string")
        places = F.greatest(v["scale"], F.lit(0)).cast("int")
        filled = F.lpad(digits, F.greatest(F.length(digits), places + 1), "0")
        text = F.concat(F.when(v["unscaled"] < 0, "-").otherwise(""), F.substring(filled, F.lit(1), F.length(filled) - places), F.lit("."), F.right(filled, places))
        return F.concat(F.rtrim(text, F.lit(".")), F.when(v["scale"] < 0, F.repeat(F.lit("0"), -v["scale"].cast("int"))).otherwise("")).try_cast(f"decimal({p},{s})")

    wrong = lambda v: F.when(~v["scale"].between(-38, 76), w.FAILED).when(back(v).isNull(), w.FAILED)
    guarded = lambda v: F.when(v["scale"].between(-38, 76), back(v))
    return mapped(product(i64, bigint64, names=["scale", "unscaled"], head=b""), to, guarded, f"decimal({p},{s})", wrong)


def decimal(p: int, s: int, options: Options = Options()) -> Codec:
    return decimal_binary(p, s) if options.binary_decimals else decimal_text(p, s)


json_text = mapped(block, lambda x: F.encode(F.to_json(F.parse_json(x)), "utf-8"), lambda v: F.try_validate_utf8(v), "string")
nanos_of = lambda ts: (F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000)) * 1000)
seconds_of = lambda ts: F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("bigint")
timestamp = mapped(
    product(i64, u32, names=["s", "n"], head=b""),
    lambda ts: F.struct(seconds_of(ts).alias("s"), nanos_of(ts).alias("n")),
    lambda v: F.timestamp_micros(v["s"] * 1_000_000 + F.floor(v["n"] / 1000).cast("bigint")), "timestamp", size_of=lambda x: F.lit(12),
)
as_u32 = lambda x: F.when(x < 0, x.cast("bigint") + (1 << 32)).otherwise(x.cast("bigint"))
date = mapped(
    product(var_u32, u8, u8, names=["y", "m", "d"], head=b""),
    lambda d: F.struct(as_u32(F.year(d)).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d")),
    lambda v: F.make_date(F.when(v["y"] >= 1 << 31, v["y"] - (1 << 32)).otherwise(v["y"]).cast("int"), v["m"].cast("int"), v["d"].cast("int")), "date",
)
#: nanoseconds of the day
time_of_day = mapped(
    product(u8, u8, u8, var_u32, names=["h", "m", "s", "n"], head=b""),
    lambda t: F.struct(F.floor(t / 3_600_000_000_000).alias("h"), F.floor(F.pmod(t, F.lit(3_600_000_000_000)) / 60_000_000_000).alias("m"), F.floor(F.pmod(t, F.lit(60_000_000_000)) / 1_000_000_000).alias("s"), F.pmod(t, F.lit(1_000_000_000)).alias("n")),
    lambda v: ((v["h"] * 60 + v["m"]) * 60 + v["s"]).cast("bigint") * 1_000_000_000 + v["n"], "bigint",
)


def day_nanos(ts: Column) -> Column:
    """Nanoseconds of the day on the clock that ts shows, with or without a zone."""
    return (F.hour(ts) * 60 + F.minute(ts)).cast("bigint") * 60_000_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint") * 1000


def local_time(v: Column) -> Column:
    seconds = (F.floor(v["t"] / 1000) % 60_000_000).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    parts = (F.year(v["d"]), F.month(v["d"]), F.dayofmonth(v["d"]), F.floor(v["t"] / 3_600_000_000_000).cast("int"), (F.floor(v["t"] / 60_000_000_000) % 60).cast("int"), seconds.cast("decimal(16,6)"))
    return F.call_function("make_timestamp_ntz", *parts)


datetime_naive = mapped(product(date, time_of_day, names=["d", "t"], head=b""), lambda ts: F.struct(F.to_date(ts).alias("d"), day_nanos(ts).alias("t")), local_time, "timestamp_ntz")
offset = mapped(product(var_i32, head=b"\0"), lambda s: F.struct(s.alias("_0")), lambda v: v["_0"], "int")
zone = mapped(product(string, head=b"\1"), lambda s: F.struct(s.alias("_0")), lambda v: v["_0"], "string")
#: struct<local, offset> with the local time; struct<utc, tz> with the time in UTC
datetime_offset = product(datetime_naive, offset, names=["local", "offset"], head=b"")
datetime_zone = product(datetime_naive, zone, names=["utc", "tz"], head=b"")
eighth = lambda x, k: F.lpad(F.hex(sum((F.when(F.coalesce(F.get(x, 8 * k + i), F.lit(False)), 128 >> i).otherwise(0) for i in range(8)), F.lit(0))), 2, "0")
#: bits in bytes, the first bit highest; read back as whole bytes
bit_array = Codec(
    lambda x: w.block(F.unhex(F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.size(x) / 8).cast("int")), lambda k: 8 * k < F.size(x)), lambda k: eighth(x, k)), ""))),
    lambda b, p: w.let(w.read_block(b, p), lambda r: w.result(F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.octet_length(r["v"])), lambda k: k > 0), lambda k: F.array(*[w.byte_at(r["v"], k).bitwiseAND(F.lit(128 >> i)) > 0 for i in range(8)]))), r["p"], r["e"])),
    "array<boolean>",
)
ipv4 = Codec(
    lambda x: F.concat(w.constant(b"\0"), joined(F.split(x, "\\."), lambda o: u8.enc(o.cast("int")))),
    lambda b, p: tagged(b, p, {0: read_octets(b)}, F.lit(None).cast("string")), "string", lambda x: F.lit(5),
)


def read_octets(b: Column) -> Callable[[Column], Column]:
    return lambda q: w.read_fixed(4, lambda h: F.concat_ws(".", *[F.conv(F.substring(h, 2 * k + 1, 2), 16, 10) for k in range(4)]))(b, q)
