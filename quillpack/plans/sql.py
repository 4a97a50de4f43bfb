"""The same bytes as hexadecimal text in DuckDB SQL, for the oracles of the queries."""

from __future__ import annotations


def be(x: str, width: int) -> str:
    return f"right(lpad(hex(({x})::BIGINT),16,'0'),{2 * width})"


def var_u32(n: str) -> str:
    n = f"({n})::BIGINT"
    group = lambda k, more: f"(({n} >> {7 * k}) & 127) + {128 if more else 0}"
    upto = lambda last: f"printf('{'%02X' * (last + 1)}', {', '.join(group(k, k < last) for k in range(last + 1))})"
    return f"(CASE WHEN {n} < 128 THEN {upto(0)} WHEN {n} < 16384 THEN {upto(1)} WHEN {n} < 2097152 THEN {upto(2)} WHEN {n} < 268435456 THEN {upto(3)} ELSE {upto(4)} END)"


def var_i32(n: str) -> str:
    return var_u32(f"CASE WHEN ({n}) < 0 THEN -2*({n})::BIGINT - 1 ELSE 2*({n})::BIGINT END")


def string(s: str) -> str:
    return f"({var_u32(f'2*strlen({s})')} || hex(encode({s})))"


def size_of_string(s: str) -> str:
    return f"(strlen({s}) + CASE WHEN strlen({s}) < 64 THEN 1 WHEN strlen({s}) < 8192 THEN 2 WHEN strlen({s}) < 1048576 THEN 3 ELSE 4 END)"


def block(b: str) -> str:
    return f"({var_u32(f'octet_length({b})')} || hex({b}))"


def f64(x: str) -> str:
    return f"hex((({x})::DOUBLE::BIT)::BLOB)"


def f32(x: str) -> str:
    return f"hex((({x})::FLOAT::BIT)::BLOB)"


def option(x: str, inner: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN '00' ELSE '01' || {inner} END)"


def date(d: str) -> str:
    return f"({var_u32(f'year({d})')} || {be(f'month({d})', 1)} || {be(f'day({d})', 1)})"


def time(ts: str) -> str:
    return f"({be(f'hour({ts})', 1)} || {be(f'minute({ts})', 1)} || {be(f'epoch_us({ts}) // 1000000 % 60', 1)} || {var_u32(f'(epoch_us({ts}) % 1000000) * 1000')})"


def joined(items: str, item: str) -> str:
    """item is SQL over x."""
    return f"coalesce(array_to_string(list_transform({items}, lambda x: {item}), ''), '')"
