"""Operators with state over ordered rows: string de-duplication and back-references.

A stream is all rows of one key in order. The first occurrence of a string is
written out and gets the next number of its stream; later ones refer to it. The
distinct strings of a stream are numbered, not its rows, so a stream of very many
rows is spread over its strings. Rows of one place in the order come in the order
of their strings, and of equal ones one is the first. A null text has no number
and no bytes. Columns of the input keep their values whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpack.functions import wire as w


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The row of df as one column beside those given, so that names do not clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[x.alias(name) for name, x in columns.items()])


def unpacked(rows: DataFrame, df: DataFrame, **columns: Column) -> DataFrame:
    """The rows of df with further columns, which replace those of their names."""
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in columns]
    return rows.select(*kept, *[x.alias(name) for name, x in columns.items()])


def numbered(rows: DataFrame) -> DataFrame:
    """rows (row, stream, place, text) with n, the number of the text in its stream, and fresh, whether it is the first."""
    firsts = rows.where("text is not null").groupBy("stream", "text").agg(F.min("place").alias("first"))
    firsts = firsts.withColumn("n", F.row_number().over(Window.partitionBy("stream").orderBy("first", "text")))
    known = firsts.select(F.col("stream").alias("s"), F.col("text").alias("t"), "first", "n")
    here = rows.join(known, F.col("stream").eqNullSafe(F.col("s")) & (F.col("text") == F.col("t")), "left").drop("s", "t")
    # of equal rows at one place the first is any of them
    copies = Window.partitionBy("stream", "text", "place").orderBy(F.lit(0))
    return here.withColumn("fresh", F.coalesce((F.col("place") == F.col("first")) & (F.row_number().over(copies) == 1), F.lit(False))).drop("first")


def dedup_ids(df: DataFrame, stream: str, order: str, text: str) -> DataFrame:
    """df with string_id (from 1, by first occurrence in the stream) and is_new."""
    rows = numbered(packed(df, stream=F.col(stream), place=F.col(order), text=F.col(text)))
    return unpacked(rows, df, string_id=F.col("n").cast("bigint"), is_new=F.col("fresh"))


def dedup_encode(df: DataFrame, stream: str, order: str, text: str, out: str = "bytes") -> DataFrame:
    """df with string_id, is_new and the bytes of each text: the text itself, or minus its number."""
    rows = numbered(packed(df, stream=F.col(stream), place=F.col(order), text=F.col(text)))
    data = F.when(F.col("fresh"), w.string(F.col("text"))).otherwise(w.var_i32(-F.col("n")))
    return unpacked(rows, df, string_id=F.col("n").cast("bigint"), is_new=F.col("fresh"), **{out: data})


def dedup_decode(df: DataFrame, stream: str, order: str, data: str, out: str = "text") -> DataFrame:
    """Reads what dedup_encode wrote: references are joined to the strings of their stream. Null bytes are a null text."""
    rows = packed(df, stream=F.col(stream), place=F.col(order), data=F.col(data), n=w.read_var_i32(F.col(data), F.lit(1)))
    rows = rows.withColumn("own", F.when(F.col("n.v") >= 0, w.read_string(F.col("data"), F.lit(1))["v"]))
    order_of = Window.partitionBy("stream").orderBy("place", "own")
    known = rows.where("n.v >= 0").select(F.col("stream").alias("s"), F.row_number().over(order_of).alias("k"), F.col("own").alias("known"))
    found = rows.join(known, F.col("stream").eqNullSafe(F.col("s")) & (-F.col("n.v") == F.col("k")), "left")
    bad = F.raise_error(F.coalesce(F.col("n.e"), F.lit(w.BAD_STRING_ID))).cast("string")
    value = F.when(F.col("data").isNull(), F.lit(None).cast("string")).otherwise(F.coalesce("own", "known", bad))
    return unpacked(found, df, **{out: value})


def back_references(df: DataFrame, stream: str, order: str, key: Column) -> DataFrame:
    """df with string_id, is_new and ref: 0 for an object seen first in its stream, else the number that it got then."""
    rows = numbered(packed(df, stream=F.col(stream), place=F.col(order), text=key))
    ref = F.when(F.col("fresh"), 0).otherwise(F.col("n")).cast("bigint")
    return unpacked(rows, df, string_id=F.col("n").cast("bigint"), is_new=F.col("fresh"), ref=ref)
