"""SimHash near-duplicates through vantage-point trees over distinct fingerprints.

A tree built from a bounded sample of fingerprints cuts Hamming space into
shards: each inner node has a vantage point and a radius, and a fingerprint goes
inside or outside by its distance. Fingerprints within reach of the boundary
also visit the other side as queries, so every pair within ``reach`` bits meets
in the home shard of one of the two. A shard is searched by a tree of its own,
with the triangle bound to prune branches and exact distances in the leaves.
Pairs leave a shard as a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpack.llm.components import components
from quillpack.llm.forest import Forest
from quillpack.llm.store import settle, ship_code

HASH_SEED = 42
BITS = 64


def fingerprint(data: bytes, width: int) -> int:
    """SimHash of the word shingles of UTF-8 text; 0 when it has no words."""
    words = data.lower().split()  # on bytes, both are about ASCII only
    if not words:
        return 0
    text = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [hash_of(text, HASH_SEED)]
    else:
        starts = [0, *ends]
        hashes = [hash_of(text[a : b - 1], HASH_SEED) for a, b in zip(starts, ends[width - 1 :])]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """Bits that are set in more than half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = np.array(hashes[at : at + (1 << 15)], ">u8")
        counts += np.unpackbits(block.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; a null text has no words."""
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py() or b"", width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col], df[text_col].cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int16)


def vantage(points: np.ndarray, dice: np.random.Generator, tries: int = 6) -> tuple[np.uint64, int] | None:
    """The vantage point and radius with the lightest boundary among balanced cuts; None if no cut parts the points."""
    best = None
    for k in dice.integers(0, len(points), tries):
        d = distances(points, points[k])
        counts = np.bincount(d, minlength=BITS + 3)
        inside = np.cumsum(counts) / len(points)
        for mu in np.flatnonzero((inside >= 0.25) & (inside < 0.75)) if len(points) > 8 else []:
            weight = counts[max(0, mu - 1) : mu + 3].sum() / len(points) + abs(inside[mu] - 0.5)
            if best is None or weight < best[0]:
                best = (weight, points[k], int(mu))
        if best is None and d.min() < d.max():
            best = (9.0, points[k], int(np.clip(np.median(d), d.min(), d.max() - 1)))
    return best and best[1:]


@dataclass
class Node:
    point: np.uint64 = np.uint64(0)
    radius: int = 0
    inner: Node | None = None
    outer: Node | None = None
    shard: int = -1


def build(sample: np.ndarray, shards: int, dice: np.random.Generator) -> Node:
    """A tree with about ``shards`` leaves of equal weight in the sample; leaves are numbered from 0."""
    n = 0

    def grow(points: np.ndarray, leaves: int) -> Node:
        nonlocal n
        cut = vantage(points, dice) if leaves > 1 and len(points) > 1 else None
        if cut is None:
            n += 1
            return Node(shard=n - 1)
        point, radius = cut
        near = distances(points, point) <= radius
        share = min(leaves - 1, max(1, round(leaves * near.mean())))
        return Node(point, radius, grow(points[near], share), grow(points[~near], leaves - share))

    return grow(sample, shards)


def route(tree: Node, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, positions, whether each is there as a query only) for all shards that the points visit."""
    stack = [(tree, np.arange(len(points)), np.zeros(0, np.int64))]
    while stack:
        node, home, guests = stack.pop()
        if node.shard >= 0:
            if len(home) or len(guests):
                yield node.shard, np.concatenate([home, guests]), np.repeat([False, True], [len(home), len(guests)])
            continue
        h, g = distances(points[home], node.point), distances(points[guests], node.point)
        stack.append((node.inner, home[h <= node.radius], guests[g <= node.radius + reach]))
        edge = home[(h <= node.radius) & (h > node.radius - reach)]
        stack.append((node.outer, home[h > node.radius], np.concatenate([edge, guests[g > node.radius - reach]])))


def close_pairs(points: np.ndarray, home: int, reach: int, dice: np.random.Generator, leaf: int = 192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within reach of which one is among the first ``home`` points, the homes; by a tree over these."""

    def meet(h: np.ndarray, g: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(h), 1024):
            for to in range(0, len(g), 4096):
                i, j = np.nonzero(np.bitwise_count(points[h[at : at + 1024], None] ^ points[None, g[to : to + 4096]]) <= reach)
                if len(i):
                    yield h[at + i], g[to + j]

    stack = [(np.arange(home), np.arange(home, len(points)))]
    while stack:
        h, g = stack.pop()
        if not len(h):
            continue
        cut = vantage(points[h], dice, 3) if len(h) > leaf else None
        if cut is None:
            yield from meet(h, h)
            if len(g):
                yield from meet(h, g)
            continue
        point, radius = cut
        dh, dg = distances(points[h], point), distances(points[g], point)
        stack.append((h[dh <= radius], g[dg <= radius + reach]))
        stack.append((h[dh > radius], np.concatenate([h[(dh <= radius) & (dh > radius - reach)], g[dg > radius - reach]])))


def links(classes: DataFrame, *, fp: str = "fp", node: str = "rep", reach: int = 2, shard_size: int = 2048, sample_size: int = 262144, most_shards: int = 65536) -> DataFrame:
    """Edges a, b between nodes whose distinct fingerprints differ in at most ``reach`` bits, as spanning forests.

    The sample (four fingerprints for each shard, at most sample_size and an
    eighth of all) only places the cuts of the tree, which every task holds; all
    fingerprints are routed and compared exactly. Beyond most_shards times
    shard_size fingerprints the shards grow, and a task's own tree with them.
    """
    spark = classes.sparkSession
    ship_code(spark)
    n = classes.count()
    shards = int(min(most_shards, max(1, n // shard_size)))
    fraction = min(0.125, min(sample_size, max(32768, 4 * shards)) / max(n, 1))
    drawn = classes.select(fp).where(F.pmod(F.xxhash64(fp, F.lit(7)), F.lit(10**15)) < int(fraction * 10**15)).limit(sample_size)
    sample = [r[0] for r in drawn.collect()] if shards > 1 else []
    tree = build(np.unique(np.array(sample, np.int64)).view(np.uint64), shards, np.random.default_rng(11)) if sample else Node(shard=0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, nodes = batch.column(0).to_numpy().view(np.uint64), batch.column(1)
            for shard, at, guest in route(tree, points, reach):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard), pa.int32()), batch.column(0).take(pa.array(at)), nodes.take(pa.array(at)), pa.array(guest)], names=["shard", "fp", "node", "guest"])

    def search(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("guest").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        points, nodes = table.column("fp").to_numpy().view(np.uint64), table.column("node")
        forest = Forest(len(points))
        for a, b in close_pairs(points, int((~table.column("guest").to_numpy()).sum()), reach, np.random.default_rng(5)):
            forest.add(a, b)
        a, b = forest.links()
        return pa.table({"a": nodes.take(pa.array(a)), "b": nodes.take(pa.array(b))})

    kind = classes.schema[node].dataType.simpleString()
    sent = classes.select(F.col(fp), F.col(node)).mapInArrow(send, f"shard int, fp long, node {kind}, guest boolean")
    return sent.groupBy("shard").applyInArrow(search, f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3, reach: int = 2, **how) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, one row per input row.

    component_id is the least doc_id that links of at most ``reach`` differing
    bits reach, itself included. Texts without words share the fingerprint zero.
    Rows without a doc_id link nothing; they get the component of the documents
    with their fingerprint, or null where there are none.
    """
    prints = settle(fingerprints(df, id_col=id_col, text_col=text_col, width=width))
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"))
    found = components(settle(links(classes, reach=reach, **how)))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    named = settle(named)
    return prints.join(named, F.col("fp") == F.col("of"), "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
