"""Layout, envelopes and chunks of encoded values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpack.functions import codecs as c
from quillpack.functions import wire as w


def placed(parts: list[tuple[str, Column]]) -> Column:
    """Array of label, start (from 0) and len of named bytes that follow each other."""
    lengths = F.array(*[F.octet_length(data).cast("bigint") for _, data in parts])
    start = lambda n, k: F.aggregate(F.slice(n, 1, F.lit(k)), F.lit(0).cast("bigint"), lambda total, x: total + x)
    return w.let(lengths, lambda n: F.array(*[F.struct(F.lit(label).alias("label"), start(n, k).alias("start"), F.get(n, F.lit(k)).alias("len")) for k, (label, _) in enumerate(parts)]))


def segments(df: DataFrame, key: str, parts: list[tuple[str, Column]]) -> DataFrame:
    """A row for each named byte range of a value: pos, label, start (from 0) and len."""
    rows = df.select(key, F.posexplode(placed(parts)).alias("pos", "part"))
    return rows.select(key, "pos", "part.label", "part.start", "part.len")


def coverage(df: DataFrame, key: str, parts: list[tuple[str, Column]], data: Column) -> DataFrame:
    """Whether the named parts of each value cover exactly its bytes, without moving a row."""
    covered = sum((F.octet_length(x).cast("bigint") for _, x in parts), F.lit(0).cast("bigint"))
    return df.select(key, F.octet_length(data).cast("bigint").alias("bytes"), covered.alias("covered")).withColumn("exact", F.col("covered") == F.col("bytes"))


def wrapped(df: DataFrame, key: str, parts: list[tuple[str, Column]], width: int = 16, least: int = 8) -> DataFrame:
    """Rows for display: key, row, start, len and labels; a row has at most ``width`` bytes and ends with a part once it has ``least``."""

    def rows_of(found: Column) -> Column:
        state = lambda rows, at: F.struct(rows.alias("rows"), at.alias("at"))
        row = lambda start, size, labels: F.struct(start.alias("start"), size.alias("len"), labels.alias("labels"))
        kind = "array<struct<start:bigint,len:bigint,labels:array<string>>>"

        def add(acc: Column, part: Column) -> Column:
            open_row = F.get(acc["rows"], F.size(acc["rows"]) - 1)
            room = F.when((F.size(acc["rows"]) > 0) & (open_row["len"] < least), F.lit(width) - open_row["len"]).otherwise(F.lit(0))
            first = F.least(room, part["len"])
            grown = F.concat(F.slice(acc["rows"], F.lit(1), F.size(acc["rows"]) - 1), F.array(row(open_row["start"], open_row["len"] + first, F.array_append(open_row["labels"], part["label"]))))
            kept = F.when(first > 0, grown).otherwise(acc["rows"])
            rest = part["len"] - first
            more = F.transform(F.filter(F.sequence(F.lit(0).cast("bigint"), F.floor(rest / width)), lambda k: k * width < rest), lambda k: row(part["start"] + first + k * width, F.least(F.lit(width).cast("bigint"), rest - k * width), F.array(part["label"])))
            return state(F.concat(kept, more), part["start"] + part["len"])

        return F.aggregate(found, state(F.array().cast(kind), F.lit(0).cast("bigint")), add)["rows"]

    rows = df.select(key, F.posexplode(w.let(placed(parts), rows_of)).alias("row", "r"))
    return rows.select(key, "row", "r.start", "r.len", F.array_join("r.labels", ",").alias("labels"))


def hex_dump(data: Column, width: int = 16) -> Column:
    """Lines of ``width`` bytes, as lower-case pairs."""
    pairs = F.regexp_extract_all(F.lower(F.hex(data)), F.lit("(..)"), F.lit(1))
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / width).cast("int")), lambda k: F.array_join(F.slice(pairs, k * width + 1, F.lit(width)), " "))
    return F.when(F.octet_length(data) == 0, "").otherwise(F.array_join(rows, "\n"))


def envelope(data: Column, version: int = 3) -> Column:
    return F.concat(w.constant(bytes([version])), data)


def open_envelope(data: Column, version: int = 3) -> Column:
    """The bytes behind a version byte; other versions are an error."""
    return F.when(w.byte_at(data, F.lit(1)) == version, F.substring(data, F.lit(2), F.octet_length(data))).otherwise(F.raise_error(F.lit(w.FAILED + ": unknown version")).cast("binary"))


def payload(data: Column, limit: int) -> Column:
    """A block in place, or above limit bytes a reference: uuid and digest, both from the MD5 of the bytes."""
    digest = F.unhex(F.md5(data))
    return F.when(F.octet_length(data) > limit, F.concat(w.constant(b"\1"), digest, w.block(digest))).otherwise(F.concat(w.constant(b"\0"), w.block(data)))


def read_payload(data: Column) -> Column:
    """struct of the bytes in place (inner), or the uuid and digest of bytes that are elsewhere, and e."""
    kind = "struct<inner:binary,uuid:binary,digest:binary,e:string>"
    made = lambda inner, uuid, digest, e: F.struct(inner.alias("inner"), uuid.alias("uuid"), digest.alias("digest"), e.alias("e")).cast(kind)
    none = F.lit(None).cast("binary")
    inner = w.let(w.read_block(data, F.lit(2)), lambda r: made(r["v"], none, none, r["e"]))
    outer = w.let(w.read_block(data, F.lit(18)), lambda r: made(none, F.substring(data, 2, 16), r["v"], r["e"]))
    tag = w.byte_at(data, F.lit(1))
    return F.when(tag == 0, inner).when(tag == 1, outer).otherwise(made(none, none, none, F.when(tag.isNull(), w.ENDED).otherwise(w.FAILED)))


def stored_payloads(data: Column, df: DataFrame, limit: int) -> DataFrame:
    """uuid and stored of the bytes that payload leaves out, each once."""
    return df.where(F.octet_length(data) > limit).select(F.unhex(F.md5(data)).alias("uuid"), data.alias("stored")).dropDuplicates(["uuid"])


def resolved_payloads(df: DataFrame, key: str, data: str, store: DataFrame) -> DataFrame:
    """key, and the bytes of each payload, in place or from the store; a reference that the store has not, or of another digest, is an error."""
    rows = df.select(key, read_payload(F.col(data)).alias("p"))
    found = rows.join(store.select(F.col("uuid").alias("of"), "stored"), F.col("p.uuid") == F.col("of"), "left")
    fits = F.unhex(F.md5("stored")) == F.col("p.digest")
    bad = F.raise_error(F.coalesce(F.col("p.e"), F.lit(w.FAILED + ": payload"))).cast("binary")
    value = F.when(F.col("p.e").isNull() & F.col("p.inner").isNotNull(), F.col("p.inner")).when(fits, F.col("stored")).otherwise(bad)
    return found.select(key, value.alias("data"))


def pack_chunks(df: DataFrame, bucket: Column, order: str, data: str) -> DataFrame:
    """bucket, first (least order value), n and chunk (all entries of the bucket in order, as blocks)."""
    rows = df.select(bucket.alias("bucket"), F.struct(F.col(order).alias("k"), w.block(F.col(data)).alias("b")).alias("entry"))
    packed = rows.groupBy("bucket").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    joined = F.unhex(F.array_join(F.transform("entries", lambda e: F.hex(e["b"])), ""))
    return packed.select("bucket", F.get("entries", F.lit(0))["k"].alias("first"), F.size("entries").alias("n"), joined.alias("chunk"))


def unpack_chunks(df: DataFrame) -> DataFrame:
    """bucket, place and data of every entry of chunks of pack_chunks."""
    # a chunk is a list of blocks whose count stands beside it
    counted = F.concat(w.var_u32(2 * F.col("n")), F.col("chunk"))
    return df.select("bucket", F.posexplode(c.sequence(c.block).decode(counted)).alias("place", "data"))
