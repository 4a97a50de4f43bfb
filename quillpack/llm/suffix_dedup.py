"""Removal of byte strings that an earlier document has, by enhanced suffix arrays over anchored blocks.

Every string of ``length`` bytes has an anchor, the least hash among its k-grams,
so equal strings meet at equal anchors. Runs of strings with one anchor are a
block. The texts, each once, are laid out in chunks. A chunk sends its distinct
anchors to shards by ranges of hashes and gets back one bit for each: whether
another text has it. Blocks of such anchors go to the shards of their anchors,
equal ones as one row that says how often it occurs. There a suffix array with
common prefixes is scanned with a stack, which walks its tree of common-prefix
intervals, leaves that occur several times included, and reports those whose
occurrences differ in the byte on their left: maximal repeats of the blocks with
all their occurrences. What the shard sends back for a block is each repeat in it
with the least document that has it; a place in a text loses the repeat when that
document comes before its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpack.llm.store import Scratch, settle, ship_code

GRAM = 24
CHUNK_BYTES = 1 << 20
PIECE_BYTES = 1 << 20
STEP = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes, put together from hashes of 1, 2, 4, 8 and 16."""
    power = lambda n: np.uint64(pow(STEP, n, 1 << 64))
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < 16:
        h = h[:-size] * power(size) + h[size:]
        size *= 2
        if size == GRAM - 16:
            rest = h
    n = len(data) - GRAM + 1
    out = h[:n] * power(GRAM - 16) + rest[16 : 16 + n]
    return mixed(out)


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value among each ``width`` neighbours."""
    low, at, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        later = low[step:] < low[:-step]
        low, at = np.where(later, low[step:], low[:-step]), np.where(later, at[step:], at[:-step])
        size += step
    return at


def powers(n: int) -> np.ndarray:
    return np.array([pow(STEP, k, 1 << 64) for k in range(n)], np.uint64)


def blocks(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, further starts) of each run of strings with one anchor, in order of the hash.

    data holds texts one after the other that end at ``ends``; runs do not cross
    texts. Long data are done in pieces: a run cut in two is two blocks.
    """
    found = []
    for at in range(0, max(len(data) - length + 1, 0), PIECE_BYTES):
        piece = data[at : at + PIECE_BYTES + length - 1]
        hashes = gram_hashes(piece)
        anchor = least_in_windows(hashes, length - GRAM + 1)
        text = np.searchsorted(ends, np.arange(at, at + len(anchor)), "right")
        whole = np.arange(at, at + len(anchor)) + length <= ends[np.minimum(text, len(ends) - 1)]
        starts = np.flatnonzero(whole)
        if not len(starts):
            continue
        anchor, text = anchor[starts], text[starts]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(text) != 0)]))
        more = np.diff(np.concatenate([first, [len(starts)]])) - 1
        found.append((hashes[anchor[first]], at + starts[first], more))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, starts, more = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(hashes, kind="stable")
    return hashes[order], starts[order], more[order]


def firsts_of(sorted_values: np.ndarray) -> np.ndarray:
    """Position of the first of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def maximal_repeats(rows: np.ndarray, sizes: np.ndarray, times: np.ndarray, alone: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bytes in common, rows, starts) of every maximal repeat of ``length`` bytes or more.

    rows: distinct zero-padded byte strings of equal width, sizes: their true
    lengths, times: how often each occurs in the corpus, so a leaf of the interval
    tree stands for that many occurrences and is an interval of its own from two
    on. What lies left of a row's start differs among all rows and occurrences,
    as the string one byte before lies under another anchor. Rows that are alone
    under their anchor have their first suffix only: each later one has one byte
    on its left and no other row to share it with.
    """
    width = rows.shape[1]
    counts = np.maximum(sizes - length + 1, 0)
    counts[alone] = np.minimum(counts[alone], 1)
    of = np.repeat(np.arange(len(rows)), counts)
    start = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(of):
        return
    padded = np.concatenate([rows, np.zeros_like(rows)], axis=1)
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)[of, start])
    order = np.argsort(suffixes.view(f"S{width}").reshape(-1), kind="stable")
    suffixes, of, start = suffixes[order], of[order], start[order]
    rest = sizes[of] - start
    differ = suffixes[1:] != suffixes[:-1]
    common = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(rest[1:], rest[:-1]))
    before = np.where(start > 0, rows[of, np.maximum(start, 1) - 1].astype(np.int64), -1 - of)
    # the number of the last suffix of equal left bytes: an interval is diverse if this changes inside
    changed = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    # leaves that stand for several occurrences: diverse on the left at the start of a row, and not else
    for i in np.flatnonzero((start == 0) & (times[of] > 1)).tolist():
        yield int(rest[i]), of[i : i + 1], start[i : i + 1]
    lcp = np.concatenate([common, [0]])
    joined = np.flatnonzero(common >= length)
    if not len(joined):
        return
    cuts = np.flatnonzero(np.diff(joined) > 1) + 1
    for run in np.split(joined, cuts):
        stack = [(int(lcp[run[0]]), int(run[0]))]
        for i in range(int(run[0]) + 1, int(run[-1]) + 2):
            here, begin = (int(lcp[i]) if i <= run[-1] else 0), i
            while stack and stack[-1][0] > here:
                depth, begin = stack.pop()
                if changed[begin] != changed[i]:
                    yield depth, of[begin : i + 1], start[begin : i + 1]
            if here >= length and (not stack or stack[-1][0] < here):
                stack.append((here, begin))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as compressed byte planes."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return np.uint64(len(columns[0])).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, sizes = int(np.frombuffer(blob[:8], np.uint64)[0]), [np.dtype(k).itemsize for k in kinds]
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=max(1, n * sum(sizes))), np.uint8)
    out, at = [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(kind).reshape(-1))
        at += n * size
    return out


def distinct_rows(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of one of each, number of its kind by row); the last byte of each row is not zero."""
    _, first, kind = np.unique(np.ascontiguousarray(grid).view(f"S{grid.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
    return first, kind


def per_kind(kind: np.ndarray, n: int, reduce: np.ufunc, values: np.ndarray) -> np.ndarray:
    """values reduced within each of the n kinds, none of which is empty."""
    if not n:
        return values[:0]
    order = np.argsort(kind, kind="stable")
    return reduce.reduceat(values[order], np.searchsorted(kind[order], np.arange(n)))


def spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs that begin at ``first`` and have ``many`` items: number of the run and position, for each item."""
    run = np.repeat(np.arange(len(many)), many)
    return run, first[run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)


@dataclass(frozen=True)
class Plan:
    """What all steps share: the string length, the number of shards, and from how many occurrences on an anchor is split."""

    length: int
    shards: int
    hot: int

    @property
    def width(self) -> int:
        """Bytes of a block's row: the longest run under one anchor, and its size (odd, so that the last byte is not zero)."""
        return -(-(2 * self.length - GRAM + 2) // 8) * 8

    def shard_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def cuts(self, sorted_hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(shard, from, to) of sorted hashes."""
        to = self.shard_of(sorted_hashes)
        at = [*firsts_of(to).tolist(), len(to)]
        for a, b in zip(at, at[1:]):
            yield int(to[a]), a, b

    def grid(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows of the strings at starts, zero-padded, each with its size at the end."""
        out = np.zeros((len(starts), self.width), np.uint8)
        span = self.width - 2
        padded = np.concatenate([data, np.zeros(span, np.uint8)])
        for at in range(0, len(starts), 16384):
            part = np.lib.stride_tricks.sliding_window_view(padded, span)[starts[at : at + 16384]]
            out[at : at + 16384, :span] = np.where(np.arange(span) < sizes[at : at + 16384, None], part, 0)
        marked = (2 * sizes + 1).astype(">u2")
        out[:, span:] = marked.view(np.uint8).reshape(-1, 2)
        return out

    def string_hashes(self, grid: np.ndarray) -> np.ndarray:
        """A hash of the first string of each row."""
        return mixed(grid[:, : self.length].astype(np.uint64) @ powers(self.length))

    def as_items(self, grid: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(grid).view(f"V{self.width}").reshape(-1)

    def sizes(self, grid: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(grid[:, -2:]).view(">u2").reshape(-1).astype(np.int64) // 2


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)


def texts_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of h1, h2 and data, each text once in a task as far as a bounded memory of hashes goes; more would do no harm."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keep = []
        for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if key not in seen:
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(key)
                keep.append(k)
        yield batch.take(pa.array(keep, pa.int64()))


CHUNK = pa.schema([("chunk", pa.int64()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64())), ("rep", pa.list_(pa.int64())), ("size", pa.list_(pa.int64())), ("data", pa.binary())])
CHUNK_SQL = "chunk long, h1 array<long>, h2 array<long>, rep array<long>, size array<long>, data binary"


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of h1, h2, rep and data, sorted by the hashes, as chunks of about CHUNK_BYTES or one longer text."""
    number = TaskContext.get().partitionId() << 33
    rows: list[tuple] = []
    held, last = 0, None

    def full() -> pa.RecordBatch:
        h1, h2, rep, data = zip(*rows)
        return batch_of(CHUNK, [(number, h1, h2, rep, [len(x) for x in data], b"".join(data))])

    for batch in batches:
        for h1, h2, rep, data in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
            if (h1, h2) == last:
                continue
            last = h1, h2
            rows.append((h1, h2, rep, data.as_py()))
            held += len(rows[-1][3])
            if held >= CHUNK_BYTES:
                yield full()
                rows, held, number = [], 0, number + 1
    if rows:
        yield full()


def anchors(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sends the distinct anchors of each chunk to their shards: 48 bits of the hash, how often, and whether in two texts."""
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("anchors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            ends = np.cumsum(row["size"])
            hashes, starts, _ = blocks(np.frombuffer(row["data"], np.uint8), ends, plan.length)
            if not len(hashes):
                continue
            first = firsts_of(hashes)
            text = np.searchsorted(ends, starts, "right")
            many = (np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first)).astype(np.uint8)
            times = np.minimum(np.diff(np.concatenate([first, [len(hashes)]])), 65535).astype("<u2")
            short, out = hashes[first] >> np.uint64(16), []
            for shard, a, b in plan.cuts(hashes[first]):
                step = np.diff(short[a:b], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                out.append((shard, row["chunk"], pack(np.ascontiguousarray(step).view("V6").reshape(-1), times[a:b], many[a:b])))
            yield batch_of(schema, out)

    return run


def shared(plan: Plan) -> Callable[[pa.Table], pa.Table]:
    """Of one shard's anchors: a bit for each that two texts have, and one for each that has more than ``hot`` occurrences, back to the chunks."""

    def run(rows: pa.Table) -> pa.Table:
        chunk, hashes, times, many, sizes = rows.column("chunk"), [], [], [], []
        for blob in rows.column("anchors"):
            step, t, m = unpack(blob.as_py(), "V6", "<u2", "u1")
            wide = np.zeros((len(step), 8), np.uint8)
            wide[:, :6] = step.view(np.uint8).reshape(-1, 6)
            hashes.append(np.cumsum(wide.view("<u8").reshape(-1), dtype=np.uint64))
            times.append(t)
            many.append(m)
            sizes.append(len(step))
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        first = firsts_of(hashes[order])
        count = np.diff(np.concatenate([first, [len(order)]]))
        live = (count > 1) | (np.maximum.reduceat(np.concatenate(many)[order], first) > 0)
        hot = live & (np.add.reduceat(np.concatenate(times)[order], first, dtype=np.int64) > plan.hot)
        marks = np.zeros((2, len(order)), bool)
        marks[:, order] = np.repeat(np.stack([live, hot]), count, axis=1)
        cuts = np.cumsum([0, *sizes]).tolist()
        bits = [[np.packbits(x[a:b]).tobytes() if x[a:b].any() else b"" for a, b in zip(cuts, cuts[1:])] for x in marks]
        return pa.table({"of": chunk, "shard": rows.column("shard"), "live": pa.array(bits[0], pa.binary()), "hot": pa.array(bits[1], pa.binary())})

    return run


def pieces(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts the blocks of shared anchors: distinct ones to their shards, their places to a row of the chunk.

    A block of a hot anchor is cut into its strings, which are dealt by a hash of
    their own bytes, so no shard gets all the blocks of such an anchor.
    """
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("base", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            data, ends, reps = np.frombuffer(row["data"], np.uint8), np.cumsum(row["size"]), np.array(row["rep"], np.int64)
            hashes, starts, more = blocks(data, ends, plan.length)
            first = firsts_of(hashes)
            marks = np.zeros((2, len(first)), bool)
            bits = {x["shard"]: (x["live"], x["hot"]) for x in row["bits"]}
            for shard, a, b in plan.cuts(hashes[first]):
                for k, x in enumerate(bits.get(shard, ())):
                    if x:
                        marks[k, a:b] = np.unpackbits(np.frombuffer(x, np.uint8), count=b - a)
            live, hot = np.repeat(marks, np.diff(np.concatenate([first, [len(hashes)]])), axis=1)
            whole, split = np.flatnonzero(live & ~hot), np.flatnonzero(hot)
            of, at = spread(starts[split], more[split] + 1)
            starts, sizes = np.concatenate([starts[whole], at]), np.concatenate([more[whole], np.zeros(len(at), np.int64)]) + plan.length
            if not len(starts):
                continue
            grid = plan.grid(data, starts, sizes)
            hashes = np.concatenate([hashes[whole], plan.string_hashes(grid[len(whole) :])])
            one, kind = distinct_rows(grid)
            order = np.argsort(hashes[one], kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            kind, one = rank[kind], one[order]
            rep = reps[np.searchsorted(ends, starts, "right")]
            least, times = per_kind(kind, len(one), np.minimum, rep), np.minimum(np.bincount(kind, minlength=len(one)), 2).astype(np.uint8)
            out = [(None, row["chunk"], 0, pack(kind.astype("<u4"), starts.astype("<u4")))]
            for shard, a, b in plan.cuts(hashes[one]):
                out.append((shard, row["chunk"], a, pack(hashes[one[a:b]].astype("<u8"), least[a:b].astype("<i8"), times[a:b], plan.as_items(grid[one[a:b]]))))
            yield batch_of(schema, out)

    return run


def repeats(plan: Plan) -> Callable[[pa.Table], pa.Table]:
    """Of one shard's blocks: the spans of their maximal repeats with the least document that has each, back to the chunks."""
    kinds = ("<u8", "<i8", "u1", f"V{plan.width}")

    def run(rows: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py(), *kinds) for x in rows.column("data")]
        cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
        hashes, rep, times, items = (np.concatenate(c) for c in zip(*parts))
        del parts
        grid = items.view(np.uint8).reshape(-1, plan.width)
        one, kind = distinct_rows(grid)
        n = len(one)
        least, times = per_kind(kind, n, np.minimum, rep), np.minimum(per_kind(kind, n, np.add, times.astype(np.int64)), 2)
        order = np.argsort(hashes[one], kind="stable")
        under = hashes[one][order]
        first = firsts_of(under)
        alone = np.zeros(n, bool)
        group = np.diff(np.concatenate([first, [n]]))
        alone[order[first[group == 1]]] = True
        wanted = np.repeat((group > 1) | (times[order[first]] > 1), group)
        order, under = order[wanted], under[wanted]
        found: list[tuple[np.ndarray, ...]] = []
        ends = np.append(firsts_of(under)[1:], len(order))
        a = 0
        while a < len(order):  # whole anchors, about 8192 rows at a time
            b = int(ends[min(np.searchsorted(ends, a + 8192), len(ends) - 1)])
            chosen = order[a:b]
            text = grid[one[chosen]]
            sizes, reps = plan.sizes(text), least[chosen]
            text[:, -2:] = 0
            depths, ofs, starts = [], [], []
            for depth, of, start in maximal_repeats(text, sizes, times[chosen], alone[chosen], plan.length):
                depths.append(depth)
                ofs.append(of)
                starts.append(start)
            if ofs:
                many = [len(x) for x in ofs]
                of, start, depth = np.concatenate(ofs), np.concatenate(starts), np.repeat(depths, many)
                low = np.repeat(np.minimum.reduceat(reps[of], np.cumsum([0, *many[:-1]])), many)
                useful = (reps[of] > low) | (times[chosen][of] > 1)
                found.append((chosen[of][useful], start[useful], (start + depth)[useful], low[useful]))
            a = b
        empty = [np.zeros(0, np.int64)] * 4
        row, begin, end, low = (np.concatenate(c) for c in zip(*found)) if found else empty
        by_row = np.argsort(row, kind="stable")
        row, begin, end, low = row[by_row], begin[by_row], end[by_row], low[by_row]
        at, count = np.searchsorted(row, np.arange(n)), np.bincount(row, minlength=n)
        out = []
        for k, (chunk, base) in enumerate(zip(rows.column("chunk").to_pylist(), rows.column("base").to_pylist())):
            mine = kind[cuts[k] : cuts[k + 1]]
            piece, span = spread(at[mine], count[mine])
            if len(piece):
                out.append((chunk, pack((base + piece).astype("<u4"), begin[span].astype("<u2"), end[span].astype("<u2"), low[span].astype("<i8"))))
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "spans": pa.array([x[1] for x in out], pa.binary())})

    return run


def cleaned(plan: Plan, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes the spans of earlier documents out of the texts of a chunk; one row for each text that loses some."""
    schema = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("removed", pa.int64()), ("cuts", pa.int64()), ("kept_sha", pa.string()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            kind, place = unpack(row["places"], "<u4", "<u4")
            parts = [unpack(x, "<u4", "<u2", "<u2", "<i8") for x in row["spans"]]
            piece, begin, end, low = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(piece, kind="stable")
            piece, begin, end, low = piece[order], begin[order].astype(np.int64), end[order].astype(np.int64), low[order]
            n = int(max(kind.max(), piece.max())) + 1
            at, count = np.searchsorted(piece, np.arange(n)), np.bincount(piece, minlength=n)
            ends, reps = np.cumsum(row["size"]), np.array(row["rep"], np.int64)
            hit, span = spread(at[kind], count[kind])
            place = place[hit].astype(np.int64)
            text = np.searchsorted(ends, place, "right")
            earlier = low[span] < reps[text]
            place, text, span = place[earlier], text[earlier], span[earlier]
            begin, end = place + begin[span], place + end[span]
            order = np.argsort(begin, kind="stable")
            begin, end, text = begin[order], end[order], text[order]
            if not len(begin):
                continue
            reach = np.maximum.accumulate(end)
            new = np.flatnonzero(np.concatenate([[True], (begin[1:] > reach[:-1]) | (text[1:] != text[:-1])]))
            begin, end, text = begin[new], np.maximum.reduceat(end, new), text[new]
            data, out = row["data"], []
            firsts = [*firsts_of(text).tolist(), len(text)]
            for a, b in zip(firsts, firsts[1:]):
                t = int(text[a])
                to = int(ends[t])
                kept = b"".join(data[x:y] for x, y in zip([to - row["size"][t], *end[a:b].tolist()], [*begin[a:b].tolist(), to]))
                out.append((row["h1"][t], row["h2"][t], row["size"][t] - len(kept), b - a, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield batch_of(schema, out)

    return run


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, shard_bytes: int = 4 << 20, hot: int = 16384, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (with_text: also kept, the bytes left) per input row.

    Removes each byte covered by a string of ``length`` bytes that also starts in
    a document with a smaller id. Ids are whole numbers. A null text is empty; a
    row with a null id loses nothing and takes nothing from others; rows with
    equal ids take nothing from each other. No rows give no rows. Texts are told
    apart by two 64-bit hashes of different seeds.
    """
    spark = df.sparkSession
    ship_code(spark)
    if length < GRAM + 1:
        raise ValueError(f"strings have more than {GRAM} bytes")
    docs = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col], F.lit("")).cast("binary").alias("data"))
    docs = docs.select("doc_id", F.xxhash64("data").alias("h1"), F.xxhash64(F.lit(7), "data").alias("h2"), "data")
    with Scratch(spark) as scratch:
        facts = scratch.save(docs.select("doc_id", "h1", "h2", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha")), "facts")
        size = facts.agg(F.sum("n_bytes")).first()[0] or 0
        plan = Plan(length, max(16, math.ceil(size / shard_bytes)), hot)
        firsts = facts.where("doc_id is not null").groupBy(F.col("h1").alias("f1"), F.col("h2").alias("f2")).agg(F.min("doc_id").alias("rep"))
        firsts = scratch.save(firsts, "firsts")
        # each task sends a text once, so many copies are few rows; the merge join leaves them sorted by text
        texts = docs.where((F.octet_length("data") >= length) & F.col("doc_id").isNotNull()).select("h1", "h2", "data").mapInArrow(texts_once, "h1 long, h2 long, data binary")
        sorted_texts = texts.join(firsts.hint("merge"), (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).select("h1", "h2", "rep", "data")
        chunks = scratch.save(sorted_texts.mapInArrow(chunked, CHUNK_SQL), "chunks")
        sent = chunks.select("chunk", "size", "data").mapInArrow(anchors(plan), "shard int, chunk long, anchors binary")
        marks = scratch.save(sent.groupBy("shard").applyInArrow(shared(plan), "of long, shard int, live binary, hot binary"), "marks")
        bits = marks.where(F.octet_length("live") > 0).groupBy("of").agg(F.collect_list(F.struct("shard", "live", "hot")).alias("bits"))
        cut = chunks.join(bits, F.col("chunk") == F.col("of")).select("chunk", "rep", "size", "data", "bits")
        cut = scratch.save(cut.mapInArrow(pieces(plan), "shard int, chunk long, base long, data binary"), "pieces")
        scratch.drop("marks")
        spans = cut.where("shard is not null").groupBy("shard").applyInArrow(repeats(plan), "chunk long, spans binary")
        spans = scratch.save(spans, "spans")
        places = cut.where("shard is null").select(F.col("chunk").alias("p"), F.col("data").alias("places"))
        spans = spans.groupBy(F.col("chunk").alias("s")).agg(F.collect_list("spans").alias("spans"))
        hit = chunks.join(places.join(spans, F.col("p") == F.col("s")), F.col("chunk") == F.col("p")).select("h1", "h2", "rep", "size", "data", "places", "spans")
        rest = hit.mapInArrow(cleaned(plan, with_text), "c1 long, c2 long, removed long, cuts long, kept_sha string, kept binary").dropDuplicates(["c1", "c2"])
        by_text = scratch.save(firsts.join(rest, (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")), "left"), "by_text")
        # both sides are read from files, so adaptive execution can split the rows of one text
        rows = facts.join(by_text, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")), "left")
        copy = F.coalesce((F.col("doc_id") > F.col("rep")) & (F.col("n_bytes") >= length), F.lit(False))
        own = F.col("doc_id").isNotNull() & F.col("c1").isNotNull()
        out = rows.select(
            "doc_id", "n_bytes",
            F.when(copy, F.col("n_bytes")).when(own, F.col("removed")).otherwise(0).cast("long").alias("n_removed"),
            F.when(copy, 1).when(own, F.col("cuts")).otherwise(0).cast("long").alias("n_spans"),
            F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(own, F.col("kept_sha")).otherwise(F.col("sha")).alias("kept_sha256"),
            *[F.when(copy, F.lit("").cast("binary")).when(own, F.col("kept")).alias("kept")] * with_text,
        )
        return settle(out)
