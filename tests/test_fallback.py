"""Codecs of addresses and numbers of any length, as plain functions."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillpack.functions import fallback as f


@given(st.integers(-(1 << 900), 1 << 900))
def test_whole_numbers(n):
    data = f.whole_bytes(n)
    assert f.whole_number(data) == n
    body = data[1:]
    assert len(body) == 1 or not (body[0] == 0 and body[1] < 128 or body[0] == 255 and body[1] >= 128)


def test_shortest_forms():
    assert [f.whole_bytes(n).hex() for n in (0, -1, 127, 128, -128, -129)] == ["0100", "01ff", "017f", "020080", "0180", "02ff7f"]
    with pytest.raises(ValueError):
        f.whole_number(b"\x05\x01")


@pytest.mark.parametrize("text", ["0", "-0.001", "123.45", "9" * 70 + "." + "1" * 30, "1E+5"])
def test_decimals(text):
    assert f.decimal_of(f.decimal_bytes(text)) == text


def test_decimals_that_are_none():
    for text in ("NaN", "Infinity", "x", ""):
        with pytest.raises(ValueError):
            f.decimal_bytes(text)


@pytest.mark.parametrize("text,data", [("1.2.3.4", "0001020304"), ("::1", "01" + "0" * 31 + "1"), ("2001:db8::ff", "0120010db8" + "0" * 22 + "ff")])
def test_addresses(text, data):
    assert f.ip_bytes(text).hex() == data
    assert f.ip_text(bytes.fromhex(data)) == text
    with pytest.raises(ValueError):
        f.ip_text(bytes.fromhex(data)[:-1])
