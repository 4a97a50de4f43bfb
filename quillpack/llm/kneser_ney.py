"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped arrays.

Words are 64-bit hashes. Map tasks count the bigrams of a block of text with
array operations and send sorted blocks by ranges of bigram hashes, so a frequent
word is spread over all ranges. Each range becomes two files in the shared
folder: its bigram hashes, sorted, and their counts. Counts per word (raw,
continuations, followers by count) are merged the same way into sorted word
arrays. Scoring tasks map the files into memory and look up the sorted bigrams
of a block of documents at once; a task reads only the pages that it needs.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpack.llm.store import Scratch, release, settle, ship_code

MULTIPLIER = 0x9E3779B97F4A7C15
STEP = 0x100000001B3 | 1 << 45
BEGIN, END = np.uint64(1), np.uint64(2)  # the hashes of the marks around a document; words have larger ones but by chance
BLOCK_BYTES = 24 << 20
SCORE_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
WORD_COLUMNS = ("raw", "after", "total", "one", "two", "more")

_lower = np.arange(256, dtype=np.uint64)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(STEP, len(_powers), 1 << 64))])
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(MULTIPLIER) + mixed(right))


def word_hashes(data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word."""
    edges = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    firsts = np.cumsum(sizes) - sizes
    inside = np.arange(sizes.sum()) - np.repeat(firsts, sizes)
    letters = (_lower[data[~blank]] + np.uint64(1)) * powers(int(sizes.max()))[inside]
    return mixed(np.add.reduceat(letters, firsts) + sizes.astype(np.uint64)), starts


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, each text followed by END, and the number of tokens of each text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    blank = _space[data]
    words, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):  # pieces that end at a blank, as the arrays take many bytes for each of text
        end = min(at + PIECE_BYTES, len(data) - 1)
        end += int(blank[end:].argmax()) + 1
        w, s = word_hashes(data[at:end], blank[at:end])
        words.append(w)
        starts.append(s + at)
        at = end
    words, starts = np.concatenate(words), np.concatenate(starts)
    limits = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, limits)
    return np.insert(words, upto, END), np.diff(upto, prepend=0) + 1


def contexts(toks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each token, BEGIN at the start of a text."""
    before = np.concatenate([[BEGIN], toks[:-1]]).astype(np.uint64)
    before[np.cumsum(counts)[:-1]] = BEGIN
    return before


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the columns summed for each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(c[order], first) if len(keys) else c for c in columns)


def pack_columns(*columns: np.ndarray) -> bytes:
    """Byte planes of unsigned integers, compressed; the first column is sorted and stored as differences."""
    head = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T) for c in (head, *columns[1:])]
    return np.uint64([len(head), len(columns)]).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unpack_columns(blob: bytes) -> list[np.ndarray]:
    n, k = np.frombuffer(blob[:16], np.uint64).astype(int)
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[16:], max_output_size=8 * n * k), np.uint8).reshape(k, 8, n)
    columns = [np.ascontiguousarray(p.T).view("<u8").reshape(-1) for p in data]
    return [np.cumsum(columns[0], dtype=np.uint64), *columns[1:]]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of keys, so sorted keys have sorted shards."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def slices(sorted_shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    if len(sorted_shards):
        cuts = [0, *(np.flatnonzero(np.diff(sorted_shards)) + 1).tolist(), len(sorted_shards)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(sorted_shards[a]), a, b


def write_array(path: str, values: np.ndarray) -> None:
    """Written whole or not at all, so that a repeated task leaves the same file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    if not path.endswith(".keys"):  # in the least width that holds all; the number of keys tells it
        values = values.astype(np.min_scalar_type(values.max()) if len(values) else np.uint8)
    part = f"{path}.{uuid.uuid4().hex}"
    values.tofile(part)
    os.replace(part, path)


class Sorted:
    """Sorted key arrays of all shards with value columns beside them; the last ``most`` shards that were asked for are mapped."""

    def __init__(self, folder: str, name: str, shards: int, columns: tuple[str, ...], most: int = 1024):
        self.folder, self.name, self.shards, self.columns, self.most = folder, name, shards, columns, most
        self.open: dict[int, tuple] = {}

    def mapped(self, shard: int) -> tuple:
        if shard not in self.open:
            if len(self.open) >= self.most:
                del self.open[next(iter(self.open))]
            at = f"{self.folder}/{self.name}-{shard}"
            n = os.path.getsize(f"{at}.keys") // 8 if os.path.exists(f"{at}.keys") else 0
            width = lambda c: os.path.getsize(f"{at}.{c}") // n
            self.open[shard] = tuple(np.memmap(f"{at}.{c}", f"u{width(c)}", "r") if n else np.zeros(0, np.uint64) for c in ("keys", *self.columns))
        return self.open[shard]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """Values of sorted keys, zero where a key is not there."""
        out = [np.zeros(len(keys), np.int64) for _ in self.columns]
        for shard, a, b in slices(shard_of(keys, self.shards)):
            known, *values = self.mapped(shard)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[a:b]), len(known) - 1)
            here = known[at] == keys[a:b]
            for k, column in enumerate(values):
                out[k][a:b][here] = column[at[here]]
        return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of items seen once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3))


def of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


@dataclass
class Model:
    """Where the arrays are, and the few numbers for the whole corpus."""

    folder: str
    shards: int
    train_tokens: int
    vocabulary: int
    continuations: int
    bigram_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_reserve: float

    def words(self) -> Sorted:
        return Sorted(self.folder, "words", self.shards, WORD_COLUMNS)

    def bigrams(self) -> Sorted:
        return Sorted(self.folder, "bigrams", self.shards, ("n",))

    def unigram(self, after: np.ndarray) -> np.ndarray:
        if not self.continuations:
            return np.full(len(after), 1 / (self.vocabulary + 1))
        lost = np.array([0, *self.word_discounts])[np.minimum(after, 3)]
        return (after - lost) / self.continuations + self.word_reserve / self.continuations / (self.vocabulary + 1)

    def score(self, texts: list[bytes], words: Sorted, bigrams: Sorted) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, score) of each text."""
        toks, counts = tokens(texts)
        distinct, at = np.unique(toks, return_inverse=True)
        raw, after, total, one, two, more = words.find(distinct)
        unigram = self.unigram(after)
        d1, d2, d3 = self.bigram_discounts
        reserve = np.where(total > 0, (d1 * one + d2 * two + d3 * more) / np.maximum(total, 1), 1.0)
        before = contexts(toks, counts)
        ctx = np.searchsorted(distinct, np.where(before == BEGIN, END, before))
        begin = words.find(np.array([BEGIN]))
        b_total = int(begin[2][0])
        b_reserve = (d1 * begin[3][0] + d2 * begin[4][0] + d3 * begin[5][0]) / b_total if b_total else 1.0
        keys, key_at = np.unique(pair_keys(before, toks), return_inverse=True)
        seen = bigrams.find(keys)[0][key_at]
        ctx_total = np.where(before == BEGIN, b_total, total[ctx])
        ctx_reserve = np.where(before == BEGIN, b_reserve, reserve[ctx])
        lost = np.array([0, d1, d2, d3])[np.minimum(seen, 3)]
        p = np.where(ctx_total > 0, (seen - lost) / np.maximum(ctx_total, 1), 0) + ctx_reserve * unigram[at]
        base = np.log10((raw[at] + 1) / (self.train_tokens + self.vocabulary + 1))
        firsts = np.cumsum(counts) - counts
        return list(zip(counts.tolist(), np.add.reduceat((raw[at] > 0).astype(np.int64), firsts).tolist(), np.add.reduceat(base, firsts).tolist(), np.add.reduceat(np.log10(p), firsts).tolist()))


def chunks(batches: Iterator[pa.RecordBatch], column: int, bound: int) -> Iterator[tuple[list, list[bytes]]]:
    """(other columns as rows, texts) with about ``bound`` bytes of text each, for any size of batches."""
    rows, texts, held = [], [], 0
    for batch in batches:
        others = [c.to_pylist() for k, c in enumerate(batch.columns) if k != column]
        for k, text in enumerate(batch.column(column)):
            data = text.as_py() or b""
            rows.append(tuple(c[k] for c in others))
            texts.append(data)
            held += len(data) + 1
            if held >= bound:
                yield rows, texts
                rows, texts, held = [], [], 0
    if texts:
        yield rows, texts


def train(texts: DataFrame, scratch: Scratch, *, shard_bytes: int = 16 << 20) -> Model:
    """Counts the one binary column of ``texts`` and writes the arrays of the model below ``scratch``."""
    spark = texts.sparkSession
    ship_code(spark)
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]).cast("long"))).first()[0] or 0
    shards, folder = max(16, math.ceil(size / shard_bytes)), scratch.local_path("model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in chunks(batches, 0, BLOCK_BYTES):
            right, counts = tokens(block)
            left = contexts(right, counts)
            keys = pair_keys(left, right)
            order = np.argsort(keys)
            first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
            n = np.diff(np.concatenate([first, [len(keys)]])).astype(np.uint64)
            at = order[first]
            keys, left, right = keys[at], left[at], right[at]
            for shard, a, b in slices(shard_of(keys, shards)):
                by_left = a + np.argsort(left[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pack_columns(left[by_left], right[by_left], n[by_left])], pa.binary())], names=["shard", "data"])

    def merge(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        parts = [unpack_columns(x.as_py()) for x in rows.column("data")]
        left, right, n = (np.concatenate(c) for c in zip(*parts))
        del parts
        keys = pair_keys(left, right)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n, left, right, keys = np.add.reduceat(n[order], first), left[order][first], right[order][first], keys[first]
        write_array(f"{folder}/bigrams-{shard}.n", n)
        write_array(f"{folder}/bigrams-{shard}.keys", keys)
        u = lambda x: x.astype(np.uint64)
        zero = np.zeros(len(n), np.uint64)
        followers = summed(left, n, u(n == 1), u(n == 2), u(n > 2))
        # raw counts of a word are those of the bigrams that it ends, continuations the number of them
        ended = summed(right, n, u(np.ones(len(n))))
        fill = lambda k, m: [zero[:1].repeat(m)] * k
        words = summed(np.concatenate([followers[0], ended[0]]), *(np.concatenate([a, b]) for a, b in zip([*fill(2, len(followers[0])), *followers[1:]], [*ended[1:], *fill(4, len(ended[0]))])))
        out = [(to, pack_columns(*(c[a:b] for c in words)), None) for to, a, b in slices(shard_of(words[0], shards))]
        out.append((-1, None, of_counts(n)))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.list_(pa.int64())))], names=["shard", "data", "numbers"])

    def merge_words(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        keys, *columns = summed(*(np.concatenate(c) for c in zip(*(unpack_columns(x.as_py()) for x in rows.column("data")))))
        for name, values in zip(WORD_COLUMNS, columns):
            write_array(f"{folder}/words-{shard}.{name}", values)
        write_array(f"{folder}/words-{shard}.keys", keys)
        raw, after = columns[:2]
        return pa.table({"numbers": pa.array([[int(raw.sum()), int((raw > 0).sum()), int(after.sum()), *of_counts(after), int((after > 2).sum())]], pa.list_(pa.int64()))})

    counted = texts.mapInArrow(count, "shard int, data binary")
    merged = scratch.save(counted.groupBy("shard").applyInArrow(merge, "shard int, data binary, numbers array<long>"), "merged")
    release(spark)
    total = lambda df, k: [x or 0 for x in df.agg(*[F.sum(F.get("numbers", F.lit(i))) for i in range(k)]).first()]
    bigram_counts = total(merged.where("shard < 0"), 4)
    words = merged.where("shard >= 0").select("shard", "data").groupBy("shard").applyInArrow(merge_words, "numbers array<long>")
    n, v, after, n1, n2, n3, n4, more = total(words, 8)
    scratch.drop("merged")
    d = discounts([n1, n2, n3, n4])
    return Model(folder, shards, n, v, after, discounts(bigram_counts), d, d[0] * n1 + d[1] * n2 + d[2] * more)


def score_documents(df: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores all rows of df with a model of those that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (an
    add-one unigram) and score, the log10 probability of the whole text with
    its end. Null texts are empty and have one token, their end; rows whose
    held_out is null are trained on; null and repeated ids are rows like others. With nothing to learn from, every word is
    unknown and has probability 1.
    """
    spark = df.sparkSession
    ship_code(spark)
    rows = df.select(df[id_col].alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(df[text_col], F.lit("")).cast("binary").alias("data"))
    kind = df.schema[id_col].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    with Scratch(spark) as scratch:
        model = train(rows.where("not held_out").select("data"), scratch)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, bigrams = model.words(), model.bigrams()
            batches = iter(batches)
            head = next(batches, None)
            if head is None:
                return
            id_kind = head.schema.field(0).type
            for others, texts in chunks(chain([head], batches), 2, SCORE_BYTES):
                made = [(doc, out, n, known, model.train_tokens, base, score) for (doc, out), (n, known, base, score) in zip(others, model.score(texts, words, bigrams))]
                kinds = [id_kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

        return settle(rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
