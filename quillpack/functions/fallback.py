"""Codecs that Column expressions cannot give, as Arrow batches: DEFLATE blocks, the JSON value tree, IPv6 addresses and numbers of any length."""

from __future__ import annotations

import ipaddress
import json
import math
import struct
import zlib
from collections.abc import Callable, Iterator
from decimal import Context, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillpack.functions import codecs as c


def _var_u32(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_var_u32(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return n, at


def _compress(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Plain length, packed length, and the bytes as raw DEFLATE."""

    def one(x: bytes | None) -> bytes | None:
        if x is None:
            return None
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = packer.compress(x) + packer.flush()
        return _var_u32(len(x)) + _var_u32(len(packed)) + packed

    for series in data:
        yield series.map(one)


def _inflate(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(x: bytes | None) -> bytes | None:
        if x is None:
            return None
        plain, at = _read_var_u32(x, 0)
        packed, at = _read_var_u32(x, at)
        out = zlib.decompress(x[at : at + packed], -15)
        if len(out) != plain:
            raise ValueError("DecompressionFailure")
        return out

    for series in data:
        yield series.map(one)


# fixed values: tags of the JSON value tree
NULL, FALSE, TRUE, INTEGER, UNSIGNED, FLOAT, DECIMAL, STRING, ARRAY, OBJECT = range(10)


def json_bytes(value: object) -> bytes:
    text = lambda s: _var_u32(2 * len(s.encode())) + s.encode()
    if value is None or value is True or value is False:
        return bytes([NULL if value is None else TRUE if value else FALSE])
    if isinstance(value, int):
        if -(1 << 63) <= value < 1 << 63:
            return bytes([INTEGER]) + struct.pack(">q", value)
        if 0 <= value < 1 << 64:
            return bytes([UNSIGNED]) + struct.pack(">Q", value)
        # a number beyond both is a double where one holds it, as it has no exact form in most JSON readers
        return bytes([FLOAT]) + struct.pack(">d", float(value)) if abs(value) < 1 << 1023 else bytes([DECIMAL]) + text(str(value))
    if isinstance(value, float):
        return bytes([FLOAT]) + struct.pack(">d", value)
    if isinstance(value, str):
        return bytes([STRING]) + text(value)
    if isinstance(value, list):
        return bytes([ARRAY]) + _var_u32(2 * len(value)) + b"".join(map(json_bytes, value))
    return bytes([OBJECT]) + _var_u32(2 * len(value)) + b"".join(text(k) + json_bytes(value[k]) for k in sorted(value))


def json_value(data: bytes, at: int = 0) -> tuple[object, int]:
    """The value at a position and the position after it; ValueError with an error code on bad bytes. Lists and objects are kept on a stack, so any depth is read."""

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("InputEndedUnexpectedly")
        at += n
        return data[at - n : at]

    def length() -> int:
        nonlocal at
        n = 0
        for k in range(5):
            byte = take(1)[0]
            n |= (byte & 127) << 7 * k
            if byte < 128:
                break
        else:
            raise ValueError("InvalidVarInt")
        if n % 2:
            raise ValueError("DeserializationFailure: negative length")
        return n // 2

    def text() -> str:
        try:
            return take(length()).decode()
        except UnicodeDecodeError as e:
            raise ValueError("FailedToDecodeString") from e

    open_values: list[list] = []  # container, items still to come, key of the next one
    while True:
        tag = take(1)[0]
        if tag in (NULL, FALSE, TRUE):
            value = (None, False, True)[tag]
        elif tag in (INTEGER, UNSIGNED, FLOAT):
            value = struct.unpack({INTEGER: ">q", UNSIGNED: ">Q", FLOAT: ">d"}[tag], take(8))[0]
            if tag == FLOAT and not math.isfinite(value):
                raise ValueError("DeserializationFailure: not a JSON number")
        elif tag in (DECIMAL, STRING):
            value = text()
            if tag == DECIMAL:
                value = int(value) if value.lstrip("-").isdigit() else float(value)
        elif tag in (ARRAY, OBJECT):
            value, n = [] if tag == ARRAY else {}, length()
            if n:
                open_values.append([value, n, text() if tag == OBJECT else None])
                continue
        else:
            raise ValueError(f"DeserializationFailure: tag {tag}")
        while open_values:
            holder = open_values[-1]
            if isinstance(holder[0], dict):
                holder[0][holder[2]] = value
            else:
                holder[0].append(value)
            holder[1] -= 1
            if holder[1]:
                holder[2] = text() if isinstance(holder[0], dict) else None
                break
            value = open_values.pop()[0]
        else:
            return value, at


def _json_encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(lambda x: None if x is None else json_bytes(json.loads(x)))


def _json_decode(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in data:
        yield series.map(lambda x: None if x is None else json.dumps(json_value(x)[0], separators=(",", ":"), sort_keys=True, ensure_ascii=False))


def ip_bytes(text: str) -> bytes:
    """A tag and the octets of an address of either version."""
    address = ipaddress.ip_address(text)
    return bytes([address.version == 6]) + address.packed


def ip_text(data: bytes) -> str:
    width = {0: 4, 1: 16}.get(data[0]) if data else None
    if width is None or len(data) <= width:
        raise ValueError("DeserializationFailure: address")
    return str(ipaddress.ip_address(data[1 : 1 + width]))


def whole_bytes(n: int) -> bytes:
    """The shortest two's complement of a whole number of any length, after its length."""
    data = n.to_bytes((n if n >= 0 else ~n).bit_length() // 8 + 1, "big", signed=True)
    return _var_u32(len(data)) + data


def whole_number(data: bytes, at: int = 0) -> int:
    n, at = _read_var_u32(data, at)
    if len(data) < at + n:
        raise ValueError("InputEndedUnexpectedly")
    return int.from_bytes(data[at : at + n], "big", signed=True)


def decimal_bytes(text: str) -> bytes:
    """Scale and unscaled number of a decimal of any length; the scale is negative where zeros before the point are left out, as in 12E3."""
    try:
        sign, digits, exponent = Decimal(text).as_tuple()
    except InvalidOperation:
        exponent = ""
    if not isinstance(exponent, int):
        raise ValueError(f"not a decimal: {text}")
    unscaled = int("".join(map(str, digits)) or "0")
    return struct.pack(">q", -exponent) + whole_bytes(-unscaled if sign else unscaled)


def decimal_of(data: bytes) -> str:
    unscaled = Decimal(whole_number(data, 8))
    exact = Context(prec=max(len(unscaled.as_tuple().digits), 1))
    return str(unscaled.scaleb(-struct.unpack(">q", data[:8])[0], exact))


def _each(of: Callable[[object], object]) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in values:
            yield series.map(lambda x: None if x is None else of(x))

    # Spark reads the kind of function from its hints
    run.__annotations__ = {"values": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


# made when used: workers import this module too, and have no session


def ip(text: Column) -> Column:
    return F.pandas_udf(_each(ip_bytes), "binary")(text)


def ip_of(data: Column) -> Column:
    return F.pandas_udf(_each(ip_text), "string")(data)


def bigint(digits: Column) -> Column:
    """Bytes of whole numbers of any length, given as decimal text."""
    return F.pandas_udf(_each(lambda x: whole_bytes(int(x))), "binary")(digits)


def bigint_of(data: Column) -> Column:
    return F.pandas_udf(_each(lambda x: str(whole_number(x))), "string")(data)


def big_decimal(text: Column) -> Column:
    """Binary form of decimals of any length, given as text."""
    return F.pandas_udf(_each(decimal_bytes), "binary")(text)


def big_decimal_of(data: Column) -> Column:
    return F.pandas_udf(_each(decimal_of), "string")(data)


def compressed(data: Column) -> Column:
    return F.pandas_udf(_compress, "binary")(data)


def inflated(data: Column) -> Column:
    return F.pandas_udf(_inflate, "binary")(data)


def try_json_of_binary(data: Column) -> Column:
    """struct of value (JSON text) and _error; the value is null where there is an error."""

    def run(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in values:
            rows = []
            for x in series:
                try:
                    rows.append((None if x is None else json.dumps(json_value(bytes(x))[0], separators=(",", ":"), sort_keys=True, ensure_ascii=False), None))
                except ValueError as e:
                    rows.append((None, str(e).partition(":")[0]))
                except RecursionError:  # the bytes are read at any depth, but their JSON text is not written
                    rows.append((None, "DeserializationFailure"))
            yield pd.DataFrame(rows, columns=["value", "_error"], dtype=object)

    run.__annotations__ = {"values": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "value string, _error string")(data)


def json_binary(text: Column) -> Column:
    return F.pandas_udf(_json_encode, "binary")(text)


def json_of_binary(data: Column) -> Column:
    return F.pandas_udf(_json_decode, "string")(data)


def json_encoded(text: Column, options: c.Options = c.Options()) -> Column:
    """JSON as its text, or as the value tree where the options say so."""
    return json_binary(text) if options.binary_json else c.json_text.enc(text)


def json_decoded(data: Column, options: c.Options = c.Options()) -> Column:
    return json_of_binary(data) if options.binary_json else c.json_text.decode(data)
