"""Values of recursive types: unions that hold themselves, texts and objects that are written once per value.

Spark has no recursive column types, so such a value is a JSON text in its column
and the types are described by the classes below. Encoding and decoding run in
Arrow batches. Each step of a value is a generator that a loop drives, so depth is
bounded by memory and not by the interpreter's stack.

A record is an object, a union case an object of one key, an option null or its
value. Where a type has Shared objects the text is {"value": ..., "objects":
[...]} and a shared object is its index among the objects, so cycles can be said.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillpack.functions import wire as w


class Wrong(ValueError):
    """Bytes or values that cannot be read or written; the text starts with the error code."""


def var_u32(n: int) -> bytes:
    if not 0 <= n < 1 << 32:
        raise Wrong("LengthTooLarge")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def var_i32(n: int) -> bytes:
    if not -(1 << 31) <= n < 1 << 31:
        raise Wrong("LengthTooLarge")
    return var_u32(n << 1 if n >= 0 else ~n << 1 | 1)


class Out:
    """Bytes of one value, and what it has written once."""

    def __init__(self, objects: list):
        self.data, self.objects = bytearray(), objects
        self.strings: dict[str, int] = {}
        self.refs: dict[int, int] = {}


class In:
    """Bytes of one value from a position on, and what it has read once."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.strings: list[str] = []
        self.objects: list = []

    def take(self, n: int) -> bytes:
        if n < 0:
            raise Wrong(w.FAILED)
        if self.at + n > len(self.data):
            raise Wrong(w.ENDED)
        self.at += n
        return self.data[self.at - n : self.at]

    def var_u32(self) -> int:
        n = 0
        for k in range(5):
            byte = self.take(1)[0]
            n |= (byte & 127) << 7 * k
            if byte < 128:
                return n
        raise Wrong(w.BAD_NUMBER)

    def var_i32(self) -> int:
        n = self.var_u32()
        return n >> 1 ^ -(n & 1)

    def text(self, size: int) -> str:
        try:
            return self.take(size).decode()
        except UnicodeDecodeError as e:
            raise Wrong(w.BAD_STRING) from e


Step = Generator


def driven(step: Step) -> object:
    """The result of a step; steps that it yields are run first, and their results sent back."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
    return value


class Type:
    """put and get are generators: they yield the steps of their parts."""

    def put(self, x: object, out: Out, names: dict[str, Type]) -> Step:
        raise NotImplementedError

    def get(self, data: In, names: dict[str, Type]) -> Step:
        raise NotImplementedError


@dataclass(frozen=True)
class Number(Type):
    """A number of fixed width, by its struct format."""

    form: str

    def put(self, x, out, names):
        try:
            out.data += struct.pack(f">{self.form}", float(x) if self.form in "fd" else x)
        except (struct.error, OverflowError) as e:
            raise Wrong("LengthTooLarge") from e
        return
        yield

    def get(self, data, names):
        return struct.unpack(f">{self.form}", data.take(struct.calcsize(f">{self.form}")))[0]
        yield


@dataclass(frozen=True)
class Flag(Type):
    def put(self, x, out, names):
        out.data.append(1 if x else 0)
        return
        yield

    def get(self, data, names):
        return data.take(1) != b"\0"
        yield


@dataclass(frozen=True)
class VarU32(Type):
    def put(self, x, out, names):
        out.data += var_u32(x)
        return
        yield

    def get(self, data, names):
        return data.var_u32()
        yield


@dataclass(frozen=True)
class Char(Type):
    """One code point."""

    def put(self, x, out, names):
        if len(x) != 1:
            raise Wrong("FailedToDecodeCharacter")
        out.data += var_u32(ord(x))
        return
        yield

    def get(self, data, names):
        n = data.var_u32()
        if n > 0x10FFFF or 0xD800 <= n < 0xE000:
            raise Wrong("FailedToDecodeCharacter")
        return chr(n)
        yield


@dataclass(frozen=True)
class Text(Type):
    """once: a text that the value has written before is a reference to it."""

    once: bool = False

    def put(self, x, out, names):
        if self.once and x in out.strings:
            out.data += var_i32(-out.strings[x])
            return
        data = x.encode()
        out.data += var_i32(len(data)) + data
        if self.once:
            out.strings[x] = len(out.strings) + 1
        return
        yield

    def get(self, data, names):
        n = data.var_i32()
        if self.once and n < 0:
            if -n > len(data.strings):
                raise Wrong(w.BAD_STRING_ID)
            return data.strings[-n - 1]
        text = data.text(n)
        if self.once:
            data.strings.append(text)
        return text
        yield


@dataclass(frozen=True)
class Many(Type):
    """A list: its count and items; both forms are read."""

    of: Type

    def put(self, x, out, names):
        out.data += var_i32(len(x))
        for item in x:
            yield self.of.put(item, out, names)

    def get(self, data, names):
        n, found = data.var_i32(), []
        if n < -1:
            raise Wrong(w.FAILED)
        while len(found) < n or n == -1:
            if n == -1 and (more := data.take(1)[0]) != 1:
                if more:
                    raise Wrong(w.FAILED)
                break
            found.append((yield self.of.get(data, names)))
        return found


@dataclass(frozen=True)
class Bytes(Many):
    """A list of one case of a union, or of any: 1 and a block where all items are of that case, else 0 and the list."""

    case: str = ""

    def put(self, x, out, names):
        if all(list(item) == [self.case] for item in x):
            out.data += b"\1" + var_u32(len(x)) + bytes(item[self.case] for item in x)
        else:
            out.data.append(0)
            yield Many.put(self, x, out, names)

    def get(self, data, names):
        tag = data.take(1)[0]
        if tag > 1:
            raise Wrong(w.FAILED)
        if tag:
            return [{self.case: byte} for byte in data.take(data.var_u32())]
        return (yield Many.get(self, data, names))


@dataclass(frozen=True)
class Maybe(Type):
    of: Type

    def put(self, x, out, names):
        out.data.append(0 if x is None else 1)
        if x is not None:
            yield self.of.put(x, out, names)

    def get(self, data, names):
        tag = data.take(1)[0]
        if tag > 1:
            raise Wrong(w.FAILED)
        return (yield self.of.get(data, names)) if tag else None


@dataclass(frozen=True)
class Either(Type):
    """{"ok": ...} behind a one or {"err": ...} behind a zero."""

    ok: Type
    err: Type

    def put(self, x, out, names):
        out.data.append(1 if "ok" in x else 0)
        yield self.ok.put(x["ok"], out, names) if "ok" in x else self.err.put(x["err"], out, names)

    def get(self, data, names):
        tag = data.take(1)[0]
        if tag > 1:
            raise Wrong(w.FAILED)
        return {"ok" if tag else "err": (yield (self.ok if tag else self.err).get(data, names))}


@dataclass(frozen=True)
class Fields(Type):
    """A record of version 0, or with no head the fields alone."""

    fields: tuple[tuple[str, Type], ...]
    head: bool = True

    def put(self, x, out, names):
        if self.head:
            out.data.append(0)
        for name, of in self.fields:
            yield of.put(x.get(name), out, names)

    def get(self, data, names):
        if self.head and data.take(1) != b"\0":
            raise Wrong(w.FAILED)
        found = {}
        for name, of in self.fields:
            found[name] = yield of.get(data, names)
        return found


@dataclass(frozen=True)
class Evolved(Type):
    """A record with a history: steps (kind, name, default) of the kinds below. Other versions, newer ones too, are read by their header.

    A field that was made optional is a Maybe; removed fields are not listed, transient ones are and get their default.
    """

    fields: tuple[tuple[str, Type], ...]
    steps: tuple[tuple, ...]

    def step_of(self, kind: str, name: str) -> int:
        return next((k for k, step in enumerate(self.steps, 1) if step[:2] == (kind, name)), 0)

    def default_of(self, name: str) -> tuple | None:
        return next((step[2:] for step in reversed(self.steps) if step[0] in ("added", "transient") and step[1] == name and len(step) > 2), None)

    def put(self, x, out, names):
        whole, chunks, places = out.data, [bytearray() for _ in range(len(self.steps) + 1)], {}
        for name, of in self.fields:
            if self.step_of("transient", name):
                continue
            g = self.step_of("added", name)
            out.data = chunks[g]
            places[name] = g or -sum(place <= 0 for place in places.values())
            yield of.put(x.get(name), out, names)
        out.data = whole
        whole.append(len(self.steps))
        for k in range(len(self.steps) + 1):
            kind, name = self.steps[k - 1][:2] if k else ("added", "")
            if kind == "added":
                whole += var_i32(len(chunks[k])) if self.steps else b""
            elif kind == "optional" and name in places:
                whole += var_i32(-1) + struct.pack(">b", places[name])
            else:
                whole += var_i32(-2)
                yield Text(once=True).put(name, out, names)
        for chunk in chunks:
            whole += chunk

    def header(self, data: In, version: int) -> Step:
        """Start and end of each chunk, places made optional and names removed."""
        sizes, optional, removed = [], set(), set()
        for _ in range(version + 1 if version else 0):
            code = data.var_i32()
            sizes.append(max(code, 0))
            if code == -1:
                optional.add(struct.unpack(">b", data.take(1))[0])
            elif code == -2:
                removed.add((yield Text(once=True).get(data, {})))
            elif code < 0:
                raise Wrong(w.FAILED)
        ends = [data.at, *(data.at + sum(sizes[: k + 1]) for k in range(len(sizes)))]
        if ends[-1] > len(data.data):
            raise Wrong(w.ENDED)
        return ends, optional, removed

    def get(self, data, names):
        version = data.take(1)[0]
        ends, optional, removed = yield self.header(data, version)
        at, seen, found = list(ends[:-1] or ends), {}, {}
        for name, of in self.fields:
            g, maybe = self.step_of("added", name), isinstance(of, Maybe)
            default = self.default_of(name)
            if self.step_of("transient", name):
                found[name] = default[0] if default else None
                continue
            if name in removed:
                if not maybe:
                    raise Wrong(w.REMOVED)
                found[name] = None
                continue
            place = g or -seen.get(0, 0)
            seen[g] = seen.get(g, 0) + 1
            if version < g:
                if default is None:
                    raise Wrong(w.FAILED if maybe else w.NO_DEFAULT)
                found[name] = default[0]
                continue
            if version:
                data.at = at[g]
            if maybe:
                since = self.step_of("optional", name) or g
                found[name] = yield (of.of if version < since else of).get(data, names)
            elif place in optional:
                found[name] = yield Maybe(of).get(data, names)
                if found[name] is None:
                    raise Wrong(w.NONE_FOUND)
            else:
                found[name] = yield of.get(data, names)
            if version:
                if data.at > ends[g + 1]:
                    raise Wrong(w.ENDED)
                at[g] = data.at
        if version:
            data.at = ends[-1]
        return found


@dataclass(frozen=True)
class Unit(Type):
    """No bytes."""

    def put(self, x, out, names):
        return
        yield

    def get(self, data, names):
        return None
        yield


@dataclass(frozen=True)
class Uuid(Type):
    def put(self, x, out, names):
        data = bytes.fromhex(x.replace("-", ""))
        if len(data) != 16:
            raise Wrong(w.FAILED)
        out.data += data
        return
        yield

    def get(self, data, names):
        h = data.take(16).hex()
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
        yield


@dataclass(frozen=True)
class Set(Many):
    """Distinct items in order."""

    def put(self, x, out, names):
        yield Many.put(self, sorted(set(x)), out, names)

    def get(self, data, names):
        return sorted(set((yield Many.get(self, data, names))))


@dataclass(frozen=True)
class Map(Type):
    """Entries of an object in order of their keys, each a record; of repeated keys the last is read."""

    of: Type

    def entries(self) -> Many:
        return Many(Fields((("key", Text()), ("value", self.of))))

    def put(self, x, out, names):
        yield self.entries().put([{"key": k, "value": x[k]} for k in sorted(x)], out, names)

    def get(self, data, names):
        return {entry["key"]: entry["value"] for entry in (yield self.entries().get(data, names))}


@dataclass(frozen=True)
class Choice(Type):
    """A union by the order of its cases; a case of no type is a unit, written as an empty record."""

    cases: tuple[tuple[str, Type | None], ...]

    def put(self, x, out, names):
        (case, value), = x.items()
        number = next((k for k, (name, _) in enumerate(self.cases) if name == case), None)
        if number is None:
            raise Wrong(w.BAD_CONSTRUCTOR)
        out.data += b"\0" + var_u32(number)
        yield (self.cases[number][1] or Fields(())).put({} if value is None and self.cases[number][1] is None else value, out, names)

    def get(self, data, names):
        if data.take(1) != b"\0":
            raise Wrong(w.FAILED)
        number = data.var_u32()
        if number >= len(self.cases):
            raise Wrong(w.BAD_CONSTRUCTOR)
        name, of = self.cases[number]
        value = yield (of or Fields(())).get(data, names)
        return {name: None if of is None else value}


@dataclass(frozen=True)
class Named(Type):
    """A type by its name, so that types can hold themselves."""

    name: str

    def put(self, x, out, names):
        yield names[self.name].put(x, out, names)

    def get(self, data, names):
        return (yield names[self.name].get(data, names))


@dataclass(frozen=True)
class Shared(Type):
    """An object that is written where it comes first and referred to after that, itself included."""

    of: Type

    def put(self, x, out, names):
        if x in out.refs:
            out.data += var_u32(out.refs[x])
            return
        out.refs[x] = len(out.refs) + 1
        out.data.append(0)
        yield self.of.put(out.objects[x], out, names)

    def get(self, data, names):
        number = data.var_u32()
        if number:
            if number > len(data.objects):
                raise Wrong("InvalidRefId")
            return number - 1
        place = len(data.objects)
        data.objects.append(None)
        data.objects[place] = yield self.of.get(data, names)
        return place


@dataclass(frozen=True)
class Schema:
    """The type of a value, the types that it names, and whether it has shared objects."""

    root: Type
    names: tuple[tuple[str, Type], ...] = ()
    shared: bool = False

    def bytes_of(self, x: object) -> bytes:
        value, objects = (x["value"], x["objects"]) if self.shared else (x, [])
        out = Out(objects)
        driven(self.root.put(value, out, dict(self.names)))
        return bytes(out.data)

    def value_of(self, data: bytes) -> object:
        source = In(data)
        value = driven(self.root.get(source, dict(self.names)))
        return {"value": value, "objects": source.objects} if self.shared else value

    def enc(self, text: Column) -> Column:
        """Bytes of values given as JSON; null stays null."""

        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for series in texts:
                yield pd.Series([None if x is None else self.bytes_of(json.loads(x)) for x in series], dtype=object)

        run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "binary")(text)

    def try_decode(self, data: Column) -> Column:
        """struct of value, as JSON with sorted keys, and _error; the value is null where there is an error."""

        def one(x: bytes | None) -> tuple[str | None, str | None]:
            if x is None:
                return None, None
            try:
                return json.dumps(self.value_of(bytes(x)), separators=(",", ":"), sort_keys=True, ensure_ascii=False), None
            except Wrong as e:
                return None, str(e)
            except RecursionError:  # the bytes are read at any depth, but their JSON text is not written
                return None, w.FAILED

        def run(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for series in values:
                yield pd.DataFrame([one(x) for x in series], columns=["value", "_error"], dtype=object)

        run.__annotations__ = {"values": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, "value string, _error string")(data)

    def decode(self, data: Column) -> Column:
        """The value as JSON; fails with the error code on bad bytes."""
        read = self.try_decode(data)
        return F.when(read["_error"].isNotNull(), F.raise_error(read["_error"])).otherwise(read["value"])


def dynamic_value(byte_lists: bool = False) -> Schema:
    """Dynamically typed values: scalars, lists, tuples, records, variants, options and results of each other."""
    me, items = Named("value"), Many(Named("value"))
    lists = Bytes(Named("value"), "U8") if byte_lists else items
    # fixed values: the cases in their order
    cases = (
        ("Bool", Flag()), ("U8", Number("B")), ("U16", Number("H")), ("U32", Number("I")), ("U64", Number("Q")),
        ("S8", Number("b")), ("S16", Number("h")), ("S32", Number("i")), ("S64", Number("q")),
        ("F32", Number("f")), ("F64", Number("d")), ("Char", Char()), ("String", Text()),
        ("List", lists), ("Tuple", items), ("Record", items),
        ("Variant", Fields((("case_idx", Number("I")), ("case_value", Maybe(me))))),
        ("Enum", Number("I")), ("Flags", Many(Flag())), ("Option", Maybe(me)), ("Result", Either(Maybe(me), Maybe(me))),
        ("Handle", Fields((("uri", Text()), ("resource_id", Number("Q"))))),
    )
    return Schema(me, (("value", Choice(cases)),))


#: an error with its causes; places are a custom record with no fields but optional texts and a line
EXCEPTION = Schema(Named("exception"), (
    ("place", Fields((("class", Maybe(Text())), ("method", Maybe(Text())), ("file", Maybe(Text())), ("line", VarU32())))),
    ("exception", Fields((("class_name", Text()), ("message", Text()), ("stack_trace", Many(Named("place"))), ("cause", Maybe(Named("exception")))))),
))
#: a root that holds a linked list of nodes, which may come back to earlier ones
NODES = Schema(Shared(Named("node")), (("node", Fields((("label", Text()), ("next", Maybe(Shared(Named("node"))))), head=False)),), shared=True)
#: texts that are written once for each value
WORDS = Schema(Many(Text(once=True)))
#: a record of many kinds of fields, with a history of its own and inside a case of a union
ELEMENT = Fields((("id", Text()),))
CASES = Choice((("First", Fields((("elem", ELEMENT),))), ("Second", Evolved((("uuid", Uuid()), ("desc", Maybe(Text()))), (("transient", "cached"),)))))
WIDE = Schema(
    Evolved(
        (
            ("byte", Number("b")), ("short", Number("h")), ("int", Number("i")), ("long", Number("q")), ("float", Number("f")), ("double", Number("d")),
            ("boolean", Flag()), ("unit", Unit()), ("string", Text()), ("uuid", Uuid()), ("exception", Named("exception")),
            ("list", Many(ELEMENT)), ("array", Many(Number("q"))), ("vector", Many(ELEMENT)), ("set", Set(Text())),
            ("either", Either(Flag(), Text())), ("tried", Either(CASES, Named("exception"))), ("option", Maybe(Map(CASES))),
        ),
        (("optional", "option"), ("added", "string", "default string"), ("added", "set", [])),
    ),
    EXCEPTION.names,
)
