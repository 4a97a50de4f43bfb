"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors of a label are one class. Each table cuts the classes of a label by
the signs of their products with ``bits`` random directions; classes that share
a bucket are compared exactly, in square tiles of bounded size, so a bucket of
any size is spread over tasks and no pair leaves one. The signs of all tables
together tell the angle of two classes well enough to screen the tiles first:
only members that may have a partner in a tile get their vectors sent there, so
a vector does not travel once for each table. A pair counts in the first table in
which its two members share a bucket, which makes the link counts exact sums.
Tiles send out counts and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpack.llm.components import components
from quillpack.llm.forest import Forest
from quillpack.llm.store import settle, ship_code


def table_shape(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables): bits grow with the logarithm of n, and tables so that a pair at the threshold is missed with probability ``miss``."""
    bits = max(8, min(30, math.ceil(math.log2(max(n, 2))) - 3))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def signatures(vectors: np.ndarray, bits: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One signature per row and table, and the signs of all tables in words of 64 bits."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = vectors @ planes >= 0
    packed = np.packbits(signs, axis=1)
    words = np.zeros((len(vectors), 8 * math.ceil(packed.shape[1] / 8)), np.uint8)
    words[:, : packed.shape[1]] = packed
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64)), words.view(np.int64)


def most_apart(signs: int, threshold: float) -> int:
    """Signs in which vectors at the threshold differ, with six deviations on top (missed with probability 1e-9)."""
    p = math.acos(threshold) / math.pi
    return math.ceil(signs * p + 6 * math.sqrt(signs * p * (1 - p)))


def by_tile(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each tile, of rows sorted by the columns that name one; a tile has at most about two blocks of rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        whole = pa.Table.from_batches(held)
        if not whole.num_rows:
            continue
        key = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in names])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield whole.slice(a, b - a)
        held = whole.slice(cuts[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sides(block: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two sides of a tile, which are one for a block with itself."""
    every = np.arange(len(block))
    return (every, every) if same else (np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min()))


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, miss: float = 1e-4, seed: int = 17, tile: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per input row.

    Vectors are compared when their labels are equal and not null and they have
    the same length. A vector that is null, empty or zero, or that holds a null
    or a non-finite component, links with nothing: 0 links, its own component.
    Rows that repeat a vec_id count as vectors of their own in n_links; a row
    without a vec_id links nothing.
    """
    spark = df.sparkSession
    ship_code(spark)
    rows = df.select(df[id_col].alias("vec_id"), df[label_col].alias("label"), df[vector_col].alias("v"))
    fine = F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = settle(rows.withColumn("ok", F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))))
    good = rows.where("ok").withColumn("v", F.col("v").cast("array<double>"))
    same = good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    same = settle(same.withColumn("cid", F.monotonically_increasing_id()))  # fixed once it is checkpointed
    n = same.count()
    bits, tables = table_shape(n, threshold, miss)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            out, packed = [None] * len(vectors), [None] * len(vectors)
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(k)
            for at in by_size.values():
                for k, s, w in zip(at, *(x.tolist() for x in signatures(np.array([vectors[k] for k in at]), bits, tables, seed))):
                    out[k], packed[k] = s, w
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind), pa.array(packed, kind)], names=["cid", "sigs", "signs"])

    signed = same.select("cid", "v").mapInArrow(sign, "cid long, sigs array<long>, signs array<long>")
    known = settle(same.join(signed, "cid").select("cid", "label", "weight", F.size("v").alias("dim"), "v", "sigs", "signs"))
    members = known.select("cid", "label", "dim", F.posexplode("sigs").alias("t", "sig"))
    sizes = settle(members.groupBy("label", "dim", "t", "sig").agg(F.count("*").alias("size")).where("size > 1"))
    keys = ["label", "dim", "t", "sig"]
    blocks = F.ceil(F.col("size") / tile)
    placed = members.join(sizes, keys).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    placed = placed.select("cid", *keys, "block", F.explode(tiles).alias("at")).select(F.col("cid").alias("of"), F.xxhash64(*keys, "at.i", "at.j").alias("part"), *[F.col(k).alias(f"k_{k}") for k in keys], "at.i", "at.j", "block")
    placed = settle(placed)
    names = ["part", *(f"k_{k}" for k in keys), "i", "j"]
    reach = most_apart(bits * tables, threshold)

    def in_tiles(rows: DataFrame) -> DataFrame:
        return rows.repartition(F.col("part")).sortWithinPartitions(*names)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a tile that have another within reach on its other side."""
        for table in by_tile(batches, names):
            signs, block = matrix(table.column("signs")), table.column("block").to_numpy()
            same_block = table.column("i")[0] == table.column("j")[0]
            left, right = sides(block, same_block)
            near = np.zeros(len(block), bool)
            for at in range(0, len(left), 512):
                a = left[at : at + 512]
                for to in range(at if same_block else 0, len(right), 512):
                    b = right[to : to + 512]
                    apart = np.zeros((len(a), len(b)), np.uint16)
                    for k in range(signs.shape[1]):
                        apart += np.bitwise_count(signs[a, None, k] ^ signs[None, b, k])
                    hit = (apart <= reach) & (a[:, None] != b[None])
                    near[a] |= hit.any(axis=1)
                    near[b] |= hit.any(axis=0)
            yield from table.drop_columns(["signs"]).take(pa.array(np.flatnonzero(near))).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    screened = in_tiles(placed.join(known.select("cid", "signs"), F.col("of") == F.col("cid")).select(*placed.columns, "signs"))
    screened = settle(screened.mapInArrow(screen, ", ".join(f"{c} {kinds[c]}" for c in placed.columns)))
    work = in_tiles(screened.join(known.select("cid", "weight", "v", "sigs"), F.col("of") == F.col("cid")).drop("of"))

    def compare(vectors: np.ndarray, sigs: np.ndarray, weights: np.ndarray, block: np.ndarray, t: int, same_block: bool) -> tuple[np.ndarray, Forest]:
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        counts, forest = np.zeros(len(vectors), np.int64), Forest(len(vectors))
        left, right = sides(block, same_block)
        for at in range(0, len(left), 512):
            a = left[at : at + 512]
            for to in range(at if same_block else 0, len(right), 512):
                b = right[to : to + 512]
                hit = (vectors[a] @ vectors[b].T) / (norms[a][:, None] * norms[b][None]) >= threshold
                i, j = np.nonzero(hit)
                if same_block:
                    i, j = i[a[i] < b[j]], j[a[i] < b[j]]
                first = ~(sigs[a[i], :t] == sigs[b[j], :t]).any(axis=1)
                i, j = a[i[first]], b[j[first]]
                np.add.at(counts, i, weights[j])
                np.add.at(counts, j, weights[i])
                forest.add(i, j)
        return counts, forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_tile(batches, names):
            if table.num_rows < 2:
                continue
            cid, block = table.column("cid").to_numpy(), table.column("block").to_numpy()
            same_block = table.column("i")[0] == table.column("j")[0]
            if not same_block and (block == block.min()).all():
                continue
            t = table.column("k_t")[0].as_py()
            counts, forest = compare(matrix(table.column("v")), matrix(table.column("sigs")), table.column("weight").to_numpy(), block, t, same_block)
            child, root = forest.links()
            near = np.flatnonzero(counts)
            to = np.arange(len(cid))
            to[child] = root
            yield pa.RecordBatch.from_arrays([pa.array(cid[near]), pa.array(cid[to[near]]), pa.array(counts[near])], names=["a", "b", "n"])

    found = settle(work.mapInArrow(run, "a long, b long, n long"))
    sums = settle(found.groupBy(F.col("a").alias("node_")).agg(F.sum("n").alias("n")))
    groups = components(found)
    linked = settle(groups.join(same.select("cid", "rep"), F.col("node") == F.col("cid")).select("node", "component", "rep"))
    leasts = settle(linked.groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("least")))
    groups = settle(linked.join(leasts, F.col("component") == F.col("of")).select("node", "least"))
    facts = same.join(sums, F.col("cid") == F.col("node_"), "left").join(groups, F.col("cid") == F.col("node"), "left")
    facts = settle(facts.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("least", "rep").alias("least")))
    joined = rows.withColumn("key", F.when(F.col("ok"), F.col("v").cast("array<double>"))).join(facts.withColumnRenamed("label", "of_label").withColumnRenamed("v", "of_v"), (F.col("label") == F.col("of_label")) & (F.col("key") == F.col("of_v")), "left")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
