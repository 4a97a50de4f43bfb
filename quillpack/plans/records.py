"""Records and tagged unions: their versions, their bytes, and reading one version as another.

A ``Record`` lists every field that its history ever had, in declared order, and
the steps of its history; ``at(n)`` is the version after n steps, which knows
nothing of later ones. The spec is compiled on the driver into Column
expressions, so encoding and decoding are projections. As removed fields stay in
the spec, a reader skips exactly the bytes that an older writer gave them; what a
newer writer added, made optional or removed it learns from the header of the
bytes and skips unknown chunks whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpack.functions import codecs as c
from quillpack.functions import wire as w


@dataclass(frozen=True)
class Field:
    name: str
    codec: c.Codec
    optional: bool = False


@dataclass(frozen=True)
class Added:
    name: str
    default: Any = None
    has_default: bool = True


@dataclass(frozen=True)
class MadeOptional:
    name: str


@dataclass(frozen=True)
class Removed:
    name: str


@dataclass(frozen=True)
class MadeTransient:
    name: str
    default: Any = None


Step = Added | MadeOptional | Removed | MadeTransient


def compact_zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 31)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


@dataclass(frozen=True)
class Record:
    fields: tuple[Field, ...]
    steps: tuple[Step, ...] = ()

    def __post_init__(self) -> None:
        known = {f.name for f in self.fields}
        if len(known) != len(self.fields):
            raise ValueError("field names repeat")
        if len(self.steps) > 254:
            raise ValueError("a history has 254 steps at most")
        for k, step in enumerate(self.steps, 1):
            if step.name not in known:
                # a field that was gone before this history began: it has no bytes to skip
                if not isinstance(step, Removed):
                    raise ValueError(f"step {k} names no field: {step.name}")
            elif isinstance(step, MadeOptional) and (self.generation(step.name) > 127 or self.position(step.name) < -128):
                raise ValueError(f"{step.name} is too far back to be made optional")

    def at(self, version: int) -> Record:
        """The record after that many steps of its history."""
        later = {x.name for x in self.steps[version:] if isinstance(x, Added)}
        return Record(tuple(f for f in self.fields if f.name not in later), self.steps[:version])

    def _step(self, kind: type | tuple[type, ...], name: str) -> int | None:
        return next((k for k, s in enumerate(self.steps, 1) if isinstance(s, kind) and s.name == name), None)

    def generation(self, name: str) -> int:
        return self._step(Added, name) or 0

    def position(self, name: str) -> int:
        """As stored for a field made optional: minus its place among the written fields of chunk 0, or the number of its chunk."""
        g = self.generation(name)
        return g or -[f.name for f in self.fields if not self.generation(f.name) and (f.name == name or not self.gone(f.name))].index(name)

    def optional_since(self, f: Field) -> int | None:
        return self.generation(f.name) if f.optional else self._step(MadeOptional, f.name)

    def gone(self, name: str) -> bool:
        return self._step((Removed, MadeTransient), name) is not None

    def written(self) -> list[Field]:
        return [f for f in self.fields if not self.gone(f.name)]

    def codec_of(self, f: Field) -> c.Codec:
        return c.option(f.codec) if self.optional_since(f) is not None else f.codec

    def header(self, sizes: list[Column]) -> list[Column]:
        """Entries of the evolution header; a name that was written before is a reference to it."""
        seen: dict[str, int] = {}

        def removed(name: str) -> Column:
            if name in seen:
                return w.constant(b"\3" + compact_zigzag(-seen[name]))
            seen[name] = len(seen) + 1
            return w.constant(b"\3" + compact_zigzag(len(name.encode())) + name.encode())

        out = [w.var_u32(2 * sizes[0])]
        for k, step in enumerate(self.steps, 1):
            if isinstance(step, Added):
                out.append(w.var_u32(2 * sizes[k]))
            elif isinstance(step, MadeOptional) and not self.gone(step.name):
                out.append(w.constant(b"\1" + (self.position(step.name) % 256).to_bytes(1)))
            else:
                out.append(removed(step.name))
        return out

    def enc(self, x: Column) -> Column:
        """Bytes of a struct that has the written fields."""
        chunk = lambda g: F.concat(w.constant(b""), *[self.codec_of(f).enc(x[f.name]) for f in self.written() if self.generation(f.name) == g])
        if not self.steps:
            return F.concat(w.constant(b"\0"), chunk(0))
        names = [f"c{k}" for k in range(len(self.steps) + 1)]
        parts = F.struct(*[chunk(k).alias(n) for k, n in enumerate(names)])
        return w.let(parts, lambda p: F.concat(w.constant(bytes([len(self.steps)])), *self.header([F.octet_length(p[n]) for n in names]), *[p[n] for n in names]))

    def parts(self, x: Column) -> list[tuple[str, Column]]:
        """The bytes of a struct in named parts, in their order: the version, the entries of the header and the written fields."""
        chunks = [[f for f in self.written() if self.generation(f.name) == g] for g in range(len(self.steps) + 1)]
        data = {f.name: self.codec_of(f).enc(x[f.name]) for f in self.written()}
        out = [("version", w.constant(bytes([len(self.steps)])))]
        if self.steps:
            sizes = [sum((F.octet_length(data[f.name]) for f in fields), F.lit(0)) for fields in chunks]
            out += [(f"header {k}", entry) for k, entry in enumerate(self.header(sizes))]
        return out + [(f.name, data[f.name]) for fields in chunks for f in fields]

    def default_of(self, f: Field) -> tuple[Column, bool]:
        step = next((s for s in reversed(self.steps) if isinstance(s, (Added, MadeTransient)) and s.name == f.name), None)
        given = step is not None and (not isinstance(step, Added) or step.has_default)
        return F.lit(step.default if given else None).cast(f.codec.sql_type), given

    def sql_type(self) -> str:
        return f"struct<{','.join(f'{f.name}:{f.codec.sql_type}' for f in self.read_fields())}>"

    def read_fields(self) -> list[Field]:
        """What a reader gets: written fields, and transient ones with their default."""
        return [f for f in self.fields if self._step(Removed, f.name) is None]

    def read(self, b: Column, p: Column, bind: Callable[[Column, Callable[[Column], Column]], Column] = w.let) -> Column:
        """The record at p, written by any version of this history or a later one, as this version.

        bind gives a value a name: within an expression, or as a column.
        """
        n = len(self.steps)
        ordered = [f for g in range(n + 1) for f in self.fields if self.generation(f.name) == g]
        shown = self.read_fields()

        def chunks(head: Column) -> Column:
            version = head["version"]
            # bytes of version 0 have no sizes: chunk 0 is what the fields take
            size = lambda k: F.coalesce(F.get(head["sizes"], F.lit(k)), F.lit(0))
            starts = [head["p"]]
            for g in range(n + 1):
                starts.append(starts[-1] + size(g))
            after = head["p"] + F.aggregate(head["sizes"], F.lit(0), lambda total, x: total + x)
            names = [f"s{g}" for g in range(n + 2)]
            layout = F.struct(*[x.cast("int").alias(k) for x, k in zip(starts, names)], after.cast("int").alias("after"))
            return bind(layout, lambda at: fields(head, [at[k] for k in names], at["after"], ordered, at["s0"], [head["e"], F.when(version.isNull(), w.ENDED)], {}, []))

        def fields(head: Column, starts: list[Column], after: Column, todo: list[Field], p: Column, errors: list[Column], values: dict[str, Column], before: list[Column]) -> Column:
            version = head["version"]
            if not todo:
                end = F.when(version == 0, p).otherwise(after)
                e = F.coalesce(*errors, F.when(end - 1 > F.octet_length(b), w.ENDED))
                return w.result(F.struct(*[values[f.name].alias(f.name) for f in shown]), end, e)
            f, rest = todo[0], todo[1:]
            g = self.generation(f.name)
            removed = F.array_contains(head["removed"], f.name)
            place = F.lit(g) if g else -sum(before, F.lit(0))
            since = self.optional_since(f)
            tagged = F.array_contains(head["optional"], place.cast("int"))
            tagged = tagged if since is None else (tagged | (version >= since))
            there = (version >= g) & ~removed
            null = F.lit(None).cast(f.codec.sql_type)
            last = not rest or self.generation(rest[0].name) != g
            # what comes last in a chunk of known size and is not wanted need not be read
            unread = (version > 0) if self.gone(f.name) and last else F.lit(False)
            raw = F.when(~there | unread, w.result(null, p)).when(tagged, c.option(f.codec).read(b, p)).otherwise(f.codec.read(b, p))

            def put(got: Column) -> Column:
                limit = F.when(version == 0, F.octet_length(b)).otherwise(starts[g + 1] - 1)
                value, more = self.value_for(f, version, removed, tagged, got)
                more += [got["e"], F.when(there & (got["p"] - 1 > limit), w.ENDED)]
                onward = F.when(version == 0, got["p"]).otherwise(starts[self.generation(rest[0].name)]) if rest and last else got["p"]
                present = [] if g else [there.cast("int")]
                return fields(head, starts, after, rest, onward, [*errors, *more], values | {f.name: value}, before + present)

            return bind(raw, put)

        return bind(read_header(b, p), chunks)

    def value_for(self, f: Field, version: Column, removed: Column, tagged: Column, got: Column) -> tuple[Column, list[Column]]:
        """What this version gets for a field, and its possible errors."""
        g = self.generation(f.name)
        default, given = self.default_of(f)
        if self.gone(f.name):
            return default, []
        early = version < g
        if self.optional_since(f) is None:
            errors = [F.when(~early & removed, w.REMOVED), F.when(~early & tagged & got["v"].isNull() & got["e"].isNull(), w.NONE_FOUND)]
            errors += [] if given or not g else [F.when(early, w.NO_DEFAULT)]
        else:
            errors = [F.when(early, w.FAILED)] if g and not given else []
        return F.when(early, default).otherwise(got["v"]), errors

    def codec(self) -> c.Codec:
        """As part of other values; a record with a history is written as its last version and reads all of them."""
        if self.steps:
            return c.Codec(self.enc, self.read, self.sql_type())
        inner = c.product(*[c.option(f.codec) if f.optional else f.codec for f in self.fields], names=[f.name for f in self.fields])
        return c.Codec(self.enc, inner.read, inner.sql_type, inner.size_of, least=inner.least)


def decode_record(df: DataFrame, buffer: str, family: Record, reader: int, out: str = "decoded") -> DataFrame:
    """df with ``out``: struct of the fields of the reader's version, and _error.

    The reader is ``family.at(reader)`` and reads bytes of older and newer
    versions. The header, the chunks and each field are columns of their own
    while it works, under names that no column of df has, so a plan stays as long
    as the history; a column ``out`` of df is replaced. Null bytes are an error.
    """
    made, prefix = [df], f"_{uuid.uuid4().hex}_"

    def bind(value: Column, body: Callable[[Column], Column]) -> Column:
        name = f"{prefix}{len(made)}"
        made.append(made[-1].withColumn(name, value))
        return body(F.col(name))

    read = family.at(reader).read(F.col(buffer), F.lit(1), bind)
    fields = [f.name for f in family.at(reader).read_fields()]
    rows = made[-1].withColumn(prefix, read)
    shown = [F.when(F.col(prefix)["e"].isNull(), F.col(prefix)["v"][x]).alias(x) for x in fields]
    value = F.struct(*shown, F.col(prefix)["e"].alias("_error"))
    return rows.select(*[value.alias(out) if x == out else F.col(f"`{x}`") for x in df.columns], *[value.alias(out)] * (out not in df.columns))


def read_header(b: Column, p: Column) -> Column:
    """struct of version, p (start of the chunks), sizes by chunk, optional positions, removed names and e."""
    state = lambda p, e, sizes, optional, removed, names: F.struct(p.alias("p"), e.cast("string").alias("e"), sizes.alias("sizes"), optional.alias("optional"), removed.alias("removed"), names.alias("names"))
    none, empty = F.lit(None).cast("string"), F.array()
    start = state(p + 1, none, empty.cast("array<int>"), empty.cast("array<int>"), empty.cast("array<string>"), empty.cast("array<string>"))

    def entry(a: Column, _: Column) -> Column:
        def coded(r: Column) -> Column:
            size = state(r["p"], none, F.array_append(a["sizes"], r["v"].cast("int")), a["optional"], a["removed"], a["names"])
            place = F.pmod(w.byte_at(b, r["p"]) + 128, F.lit(256)) - 128
            optional = state(r["p"] + 1, F.when(w.byte_at(b, r["p"]).isNull(), w.ENDED), F.array_append(a["sizes"], F.lit(0)), F.array_append(a["optional"], place), a["removed"], a["names"])

            def named(s: Column) -> Column:
                back = F.get(a["names"], (-s["n"] - 1).cast("int"))
                name = F.when(s["n"] < 0, back).otherwise(s["v"])
                names = F.when(s["n"] < 0, a["names"]).otherwise(F.array_append(a["names"], s["v"]))
                return state(s["p"], F.coalesce(s["e"], F.when(name.isNull(), w.BAD_STRING_ID)), F.array_append(a["sizes"], F.lit(0)), a["optional"], F.array_append(a["removed"], name), names)

            def name_at(n: Column) -> Column:
                text = F.try_validate_utf8(F.substring(b, n["p"], n["v"].cast("int")))
                fits = n["p"] - 1 + n["v"] <= F.octet_length(b)
                return F.struct(n["v"].alias("n"), F.when(n["v"] < 0, F.lit(None)).otherwise(text).alias("v"), F.when(n["v"] < 0, n["p"]).otherwise(n["p"] + n["v"].cast("int")).alias("p"), F.coalesce(n["e"], F.when((n["v"] >= 0) & ~fits, w.ENDED)).alias("e"))

            removed = w.let(w.let(w.read_var_i32(b, r["p"]), name_at), named)
            failed = lambda e: state(r["p"], e, a["sizes"], a["optional"], a["removed"], a["names"])
            return F.when(r["e"].isNotNull(), failed(r["e"])).when(r["v"] >= 0, size).when(r["v"] == -1, optional).when(r["v"] == -2, removed).otherwise(failed(F.lit(w.FAILED)))

        return F.when(a["e"].isNotNull(), a).otherwise(w.let(w.read_var_i32(b, a["p"]), coded))

    version = w.byte_at(b, p)
    entries = F.when(version > 0, F.sequence(F.lit(0), version)).otherwise(empty.cast("array<int>"))
    parsed = F.aggregate(entries, start, entry)
    finish = lambda a: F.struct(version.alias("version"), a["p"].alias("p"), F.coalesce(a["e"], F.when(version.isNull(), w.ENDED)).alias("e"), a["sizes"].alias("sizes"), a["optional"].alias("optional"), a["removed"].alias("removed"))
    return w.let(parsed, finish)


@dataclass(frozen=True)
class Case:
    """body: a Record, a codec for a transparent or custom case, or None for a unit case."""

    name: str
    body: Record | c.Codec | None = None
    transient: bool = False

    def parts(self) -> c.Codec:
        if self.body is None:
            return c.product(names=[], head=b"\0")
        return self.body.codec() if isinstance(self.body, Record) else self.body


@dataclass(frozen=True)
class Union:
    """Values are struct<case, one nullable member for each case with a body>."""

    cases: tuple[Case, ...]
    sorted_ids: bool = False

    def ids(self) -> dict[str, int]:
        order = sorted(self.cases, key=lambda x: x.name) if self.sorted_ids else self.cases
        return {x.name: k for k, x in enumerate(x for x in order if not x.transient)}

    def bodies(self) -> list[Case]:
        return [x for x in self.cases if x.body is not None]

    def sql_type(self) -> str:
        return f"struct<{','.join(['case:string', *(f'{x.name}:{x.parts().sql_type}' for x in self.bodies())])}>"

    def enc(self, x: Column) -> Column:
        ids, out = self.ids(), F.when(x["case"].isNull(), F.lit(None).cast("binary"))
        for case in self.cases:
            if case.transient:
                out = out.when(x["case"] == case.name, F.raise_error(F.lit(w.TRANSIENT_CASE)))
                continue
            body = w.constant(b"\0") if case.body is None else case.parts().enc(x[case.name])
            out = out.when(x["case"] == case.name, F.concat(w.constant(b"\0"), w.var_u32(F.lit(ids[case.name])), body))
        return out.otherwise(F.raise_error(F.lit(w.BAD_CONSTRUCTOR)))

    def read(self, b: Column, p: Column) -> Column:
        ids = self.ids()
        kinds = {x.name: x.parts().sql_type for x in self.bodies()}
        value = lambda case, of: F.struct(F.lit(case).cast("string").alias("case"), *[(of if name == case else F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()])

        def payload(case: Case, p: Column) -> Column:
            return w.let(case.parts().read(b, p), lambda s: w.result(value(case.name, s["v"]), s["p"], s["e"]))

        def by_id(r: Column) -> Column:
            out = F.when(r["e"].isNotNull(), w.result(value(None, F.lit(None)), r["p"], r["e"]))
            for case in self.cases:
                if case.transient:
                    continue
                if case.body is None:
                    made = w.result(value(case.name, F.lit(None)), r["p"] + 1, F.when(r["p"] > F.octet_length(b), w.ENDED))
                else:
                    made = payload(case, r["p"])
                out = out.when(r["v"] == ids[case.name], made)
            return out.otherwise(w.result(value(None, F.lit(None)), r["p"], w.BAD_CONSTRUCTOR))

        return w.let(w.read_var_u32(b, p + 1), by_id)

    def codec(self) -> c.Codec:
        return c.Codec(self.enc, self.read, self.sql_type())
