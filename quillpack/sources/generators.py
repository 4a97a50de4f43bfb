"""Deterministic test data of any size: every value follows from the row's number and a seed, so partitions don't matter."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: kinds of log entries, in order
KINDS = ("imported", "exported_invoked", "completed", "create_promise", "complete_promise", "suspend", "error", "debug")
START_MS, STEP_MS = 1_700_000_000_000, 37


def draw(n: int, *of: Column | int) -> Column:
    """A whole number below n, even and fixed by ``of``."""
    return F.pmod(F.xxhash64(*[x if isinstance(x, Column) else F.lit(x) for x in of]), F.lit(n))


def noise(size: int, *of: Column | int) -> Column:
    """size bytes that do not compress, fixed by ``of``: digests of ``of`` and a counter."""
    salt = F.concat_ws(",", *[(x if isinstance(x, Column) else F.lit(x)).cast("string") for x in of])
    digests = F.transform(F.sequence(F.lit(0), F.lit(max(math.ceil(size / 32), 1) - 1)), lambda k: F.sha2(F.concat_ws(":", salt, k.cast("string")), 256))
    return F.unhex(F.left(F.array_join(digests, ""), F.lit(2 * size)))


def cycle(size: int, start: Column, period: int = 251) -> Column:
    """size bytes that count up from ``start`` and begin anew after ``period``."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda i: F.lpad(F.hex(F.pmod(start.cast("bigint") + i, F.lit(256))), 2, "0"))
    return F.unhex(F.left(F.repeat(F.array_join(steps, ""), F.lit(math.ceil(size / period))), F.lit(2 * size)))


def log_batch(spark: SparkSession, n: int, size: int = 4096) -> DataFrame:
    """n entries: kinds in turn, evenly spaced times, counting identifiers and payloads; size is of at least one byte."""
    i = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (i % len(KINDS) + 1).cast("int"))
    token = F.regexp_replace(F.lpad(F.lower(F.hex(i)), 32, "0"), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    return spark.range(n).select(i.alias("idx"), kind.alias("kind"), (START_MS + STEP_MS * i).alias("ts_ms"), token.alias("token"), cycle(size, i).alias("payload"))


def event_log(spark: SparkSession, n: int, size: int = 256, seed: int = 42) -> DataFrame:
    """n entries of random kinds (never debug), half with a key of 16 characters, each with size random bytes."""
    i = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, KINDS[:-1])), (draw(len(KINDS) - 1, i, seed) + 1).cast("int"))
    key = F.when(draw(2, i, seed, 1) == 0, F.left(F.md5(F.concat_ws(":", i, F.lit(seed))), F.lit(16)))
    convention = F.when(draw(4, i, seed, 2) > 0, draw(3, i, seed, 3).cast("int"))
    return spark.range(n).select(i.alias("idx"), kind.alias("kind"), (START_MS + i).alias("ts_ms"), draw(4, i, seed, 4).cast("int").alias("function_type"), key.alias("key"), convention.alias("convention"), noise(size, i, seed).alias("payload"))


def tagged_payloads(spark: SparkSession, n: int, tags: int = 32, size: int = 65_536) -> DataFrame:
    """n records of an id, tags and a large payload, for readers that skip or add a chunk."""
    i = F.col("id")
    return spark.range(n).select(i, F.transform(F.sequence(F.lit(1), F.lit(tags)), lambda k: F.concat(F.lit("tag-"), k.cast("string"))).alias("tags"), cycle(size, i).alias("payload"))


def complete_trees(spark: SparkSession, trees: int = 16, depth: int = 6) -> DataFrame:
    """Nodes of complete binary trees, numbered by level from 1: tree, node, left and right (null in leaves)."""
    per_tree, inner = (1 << (depth + 1)) - 1, (1 << depth) - 1
    node = F.col("id") % per_tree + 1
    child = lambda more: F.when(node <= inner, 2 * node + more)
    return spark.range(trees * per_tree).select(F.floor(F.col("id") / per_tree).alias("tree"), node.alias("node"), child(0).alias("left"), child(1).alias("right"))


def typed_values(spark: SparkSession, length: int = 1000, size: int = 65536) -> DataFrame:
    """name and value (JSON of a dynamically typed value) of some shapes: a number, records, a long list, and bytes as a list."""
    medium = {"Record": [{"String": "typed value"}, {"S64": 42}, {"F64": 2.5}, {"Bool": True}, {"Option": {"U32": 7}}, {"Flags": [True, False, True]}, {"Enum": 3}]}
    complex_value = {"Tuple": [medium, {"Variant": {"case_idx": 1, "case_value": medium}}, {"Result": {"err": {"String": "no"}}}, {"Handle": {"uri": "urn:resource:value", "resource_id": 9}}]}
    shapes = {"simple": {"S32": 1}, "medium": medium, "complex": complex_value}
    numbers = lambda case, n, x: f"concat('{{\"List\":[', array_join(transform(sequence(0, {n - 1}), k -> concat('{{\"{case}\":', {x}, '}}')), ','), ']}}')"
    rows = [f"'{name}', '{json.dumps(value)}'" for name, value in shapes.items()]
    rows += [f"'list', {numbers('S32', length, 'k')}", f"'binary', {numbers('U8', size, 'k % 256')}"]
    return spark.sql(" UNION ALL ".join(f"SELECT {row}" for row in rows)).toDF("name", "value")
