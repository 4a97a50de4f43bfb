"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents of equal token length are interchangeable, so the search works on the
exact histogram of piece lengths: at most ``capacity`` rows whatever the size of
the corpus. A chromosome is a set of groups, each a pattern of lengths in one
bin and the number of bins filled by it. Crossover injects the well-filled
groups of one parent whole, takes over groups of the other as often as their
lengths are still left (which removes duplicates) and places what is displaced
by best fit, longest first. Islands evolve in parallel tasks and send their
elite to the next island after each round. The winning plan is turned into
ranges of ranks per length, and every piece finds its sequence and offset by its
rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import json
import math
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpack.llm.fast_ids import encoder
from quillpack.llm.store import Scratch, settle, ship_code

Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first
MOST_PLACES = 1 << 18  # rows of the plan's table that are broadcast, about 20 MB; a larger one is joined by its lengths


@dataclass(frozen=True)
class Search:
    """Size of the genetic search; its cost does not depend on the number of documents."""

    islands: int = 6
    population: int = 6
    children: int = 10
    rounds: int = 3
    well_filled: float = 0.999
    seed: int = 20240501


class Bins:
    """Open and closed bins by free space, with best-fit placement of many equal lengths at once."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.groups: dict[int, dict[Pattern, int]] = {}
        self.frees: list[int] = []

    def add(self, pattern: Pattern, free: int, times: int) -> None:
        if times <= 0:
            return
        at = self.groups.get(free)
        if at is None:
            at = self.groups[free] = {}
            if free:
                bisect.insort(self.frees, free)
        at[pattern] = at.get(pattern, 0) + times

    def take(self, free: int) -> tuple[Pattern, int]:
        at = self.groups[free]
        found = at.popitem()
        if not at:
            del self.groups[free]
            self.frees.pop(bisect.bisect_left(self.frees, free))
        return found

    def place(self, length: int, count: int) -> None:
        """Best fit: the fullest bin that still takes the length gets as many as fit, then the next."""
        while count > 0:
            k = bisect.bisect_left(self.frees, length)
            if k < len(self.frees):
                free = self.frees[k]
                pattern, bins = self.take(free)
            else:
                free, pattern, bins = self.capacity, (), -(-count // (self.capacity // length))
            each = free // length
            full = min(bins, count // each)
            self.add((*pattern, (length, each)), free - each * length, full)
            count -= full * each
            bins -= full
            if count and bins:
                self.add((*pattern, (length, count)), free - count * length, 1)
                count, bins = 0, bins - 1
            if pattern:
                self.add(pattern, free, bins)

    def plan(self) -> dict[Pattern, int]:
        merged: dict[Pattern, int] = {}
        for at in self.groups.values():
            for pattern, times in at.items():
                lengths: dict[int, int] = {}
                for length, n in pattern:
                    lengths[length] = lengths.get(length, 0) + n
                key = tuple(sorted(lengths.items(), reverse=True))
                merged[key] = merged.get(key, 0) + times
        return merged


def filled(pattern: Pattern) -> int:
    return sum(length * n for length, n in pattern)


def fitness(plan: dict[Pattern, int], capacity: int) -> tuple[int, float]:
    """Fewer bins first; then bins that are very full beside bins that are nearly empty. Smaller is better."""
    return sum(plan.values()), -sum(m * (filled(p) / capacity) ** 2 for p, m in plan.items())


def best_fit(counts: dict[int, int], capacity: int, start: dict[Pattern, int] | None = None) -> dict[Pattern, int]:
    """Places all counts, longest first, into the bins of start and new ones."""
    bins = Bins(capacity)
    for pattern, times in (start or {}).items():
        bins.add(pattern, capacity - filled(pattern), times)
    for length in sorted(counts, reverse=True):
        bins.place(length, counts[length])
    return bins.plan()


def crossover(a: dict[Pattern, int], b: dict[Pattern, int], counts: dict[int, int], capacity: int, share: float, well_filled: float, dice: random.Random) -> dict[Pattern, int]:
    """Injects whole well-filled groups of b, keeps what still fits of a, and best-fits the displaced lengths."""
    left, child = dict(counts), {}

    def use(pattern: Pattern, wanted: int) -> None:
        times = min([wanted, *(left[length] // n for length, n in pattern)])
        if times > 0:
            child[pattern] = child.get(pattern, 0) + times
            for length, n in pattern:
                left[length] -= n * times

    for pattern, m in b.items():
        if filled(pattern) >= well_filled * capacity and dice.random() < share:
            use(pattern, m)
    loose = sorted(a, key=filled, reverse=True)
    for pattern in loose:
        if filled(pattern) >= 0.98 * capacity or dice.random() < 0.5:
            use(pattern, a[pattern])
    return best_fit({length: n for length, n in left.items() if n}, capacity, child)


def mutate(plan: dict[Pattern, int], counts: dict[int, int], capacity: int, dice: random.Random) -> dict[Pattern, int]:
    """Dissolves the emptier groups and a few others, in part or whole, and best-fits their lengths longest first."""
    kept, left = {}, {}
    for pattern, m in plan.items():
        gone = m if filled(pattern) < capacity * 0.995 else int(m * dice.random()) if dice.random() < 0.15 else 0
        if m - gone:
            kept[pattern] = m - gone
        for length, n in pattern:
            left[length] = left.get(length, 0) + n * gone
    return best_fit({length: n for length, n in left.items() if n}, capacity, kept)


def paired(counts: dict[int, int], capacity: int, dice: random.Random) -> dict[Pattern, int]:
    """A starting plan: exact complements of two lengths in random order first, best fit for the rest."""
    left, plan = dict(counts), {}
    for length in dice.sample(sorted(left), len(left)):
        other = capacity - length
        times = min(left[length] // 2, left[length]) if other == length else min(left[length], left.get(other, 0)) if other > 0 else left[length]
        times = int(times * (0.6 + 0.4 * dice.random()))
        if times:
            pattern = ((length, 2),) if other == length else tuple(sorted(((x, 1) for x in (length, other) if x), reverse=True))
            plan[pattern] = plan.get(pattern, 0) + times
            for x, n in pattern:
                left[x] -= n * times
    return best_fit({length: n for length, n in left.items() if n}, capacity, plan)


def packed(plan: dict[Pattern, int]) -> bytes:
    return zlib.compress(json.dumps([[m, p] for p, m in sorted(plan.items())]).encode(), 1)


def unpacked(data: bytes) -> dict[Pattern, int]:
    return {tuple((length, n) for length, n in p): m for m, p in json.loads(zlib.decompress(data))}


def evolve(population: list[dict[Pattern, int]], counts: dict[int, int], capacity: int, search: Search, seed: int) -> list[dict[Pattern, int]]:
    dice, least = random.Random(seed), -(-sum(k * v for k, v in counts.items()) // capacity)
    score = lambda plan: fitness(plan, capacity)
    population = sorted(population, key=score)[: search.population]
    for _ in range(search.children):
        if score(population[0])[0] == least:
            break
        a, b = (min(dice.sample(population, min(2, len(population))), key=score) for _ in range(2))
        child = crossover(a, b, counts, capacity, 0.3 + 0.7 * dice.random(), search.well_filled, dice)
        if dice.random() < 0.7:
            child = mutate(child, counts, capacity, dice)
        population = sorted([*population, child], key=score)[: search.population]
    return population


def search_plan(spark, counts: dict[int, int], capacity: int, search: Search = Search()) -> dict[Pattern, int]:
    """The best plan that the islands find for a histogram of lengths up to capacity."""
    if not counts:
        return {}
    ship_code(spark)
    n = search.islands

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for island in batch["id"]:
                dice = random.Random(search.seed * 1000 + island)
                plans = [best_fit(counts, capacity), *(paired(counts, capacity, dice) for _ in range(2))]
                yield pd.DataFrame({"island": np.full(len(plans), island, np.int32), "plan": [packed(p) for p in plans]})

    def one_round(k: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            island = int(key[0])
            plans = evolve([unpacked(x) for x in sorted(rows["plan"])], counts, capacity, search, search.seed + 7919 * k + island)
            out = [(island, packed(p)) for p in plans] + [((island + 1) % n, packed(plans[0]))]
            return pd.DataFrame(out, columns=["island", "plan"]).astype({"island": "int32"})

        return run

    plans = spark.range(0, n, 1, n).mapInPandas(start, "island int, plan binary")
    for k in range(search.rounds):
        plans = plans.groupBy("island").applyInPandas(one_round(k), "island int, plan binary")

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [fitness(unpacked(x), capacity) for x in batch["plan"]]
            yield pd.DataFrame({"bins": [b for b, _ in found], "spread": [s for _, s in found], "plan": batch["plan"]})

    best = plans.mapInPandas(judged, "bins long, spread double, plan binary").orderBy("bins", "spread", "plan").limit(1).collect()
    return unpacked(best[0]["plan"])


def slots(plan: dict[Pattern, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, pieces of that length in a sequence, offset of the first)."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, m in sorted(plan.items()):
        offset = 0
        for length, n in pattern:
            rank = used.get(length, 0)
            out.append((length, rank, rank + m * n, sequence, n, offset))
            used[length] = rank + m * n
            offset += n * length
        sequence += m
    return out


def document_pieces(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document.

    A document is its ids and then end_id; a null text is empty. Documents longer
    than capacity are cut so that all pieces but the first have that length.
    """
    ship_code(df.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, pattern), np.array([end_id], "<u4")
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4", copy=False)
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                out += [(doc, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 5, kinds)], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col], df[text_col]).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, *, capacity: int = 2048, search: Search = Search(), per_part: int = 8192) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces are ranked within their length in two steps, inside hashed parts of
    about per_part pieces and by offsets of the parts, so that a length shared
    by very many pieces is spread over all parts. Identical rows are separate
    pieces; an empty table gives no rows.
    """
    spark = pieces.sparkSession
    with Scratch(spark) as scratch:
        pieces = scratch.save(pieces, "pieces")
        parts = max(64, math.ceil(pieces.count() / per_part))
        pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
        cells = settle(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
        # bounded by capacity rows
        counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
        plan = search_plan(spark, counts, capacity, search)
        before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))
        within = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32", "start")
        ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(cells, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("ranks_before"))
        places = slots(plan)
        table = spark.createDataFrame(places, "slot_length long, low long, high long, sequence long, each long, at long")
        # the plan has a bounded number of groups: two for each length at most when placed, and those that crossover keeps
        table = F.broadcast(table) if len(places) <= MOST_PLACES else table
        found = ranked.join(table, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        nth = F.col("rank") - F.col("low")
        return settle(found.select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"),
        ))


def pack_documents(df: DataFrame, *, capacity: int = 2048, search: Search = Search(), **how) -> DataFrame:
    """All documents cut into pieces and packed into sequences of at most capacity tokens.

    A null text is empty and takes one token, the end; null and repeated ids are
    documents like others; no rows give no rows.
    """
    return pack(document_pieces(df, capacity=capacity, **how), capacity=capacity, search=search)
