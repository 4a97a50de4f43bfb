"""Byte-level BPE by a contiguous rank array per word.

A word holds its part boundaries and the merge rank of every adjacent pair in
two lists. The encoder scans the ranks for the leftmost minimum, deletes the
boundary between its two parts and refreshes the ranks on both sides, until no
pair can be merged. Words over ``long_word`` bytes use a heap with the same
order of merges, so that a text without spaces costs n log n.

Nulls count as empty texts; every row of the input gives one row.
"""

from __future__ import annotations

import functools
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillpack.llm.store import ship_code

NO_RANK = 1 << 40
FLUSH_BYTES = 8 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """A tokenizer file in memory: encode(text) gives ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pattern: str, memo: int = 400_000, long_word: int = 256):
        spec = json.loads(open(path, encoding="utf-8").read())
        of, model = byte_alphabet(), spec["model"]
        raw = {token: bytes(of[c] for c in token) for token in model["vocab"]}
        self.ids = {raw[token]: i for token, i in model["vocab"].items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        one = {i: self.ids[bytes([i])] for i in range(256) if bytes([i]) in self.ids}
        self.byte_ids = [one.get(i, -1) for i in range(256)]
        self.made = [self.ids[raw[a] + raw[b]] for a, b in pairs]
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(self.ids.values()) + 1)]
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.ids[raw[a]]].setdefault(self.ids[raw[b]], rank)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.tokens[i] = token
        self.words = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.long_word = long_word
        self.memo = Memo(self.encode_word, memo)

    def encode_word(self, word: str) -> bytes:
        data = word.encode()
        parts = [self.byte_ids[b] for b in data]
        parts = self._by_scan(parts) if len(parts) <= self.long_word else self._by_heap(parts)
        return struct.pack(f"<{len(parts)}I", *parts)

    def _by_scan(self, parts: list[int]) -> list[int]:
        rank_of, made = self.ranks, self.made
        ranks = [rank_of[a].get(b, NO_RANK) for a, b in zip(parts, parts[1:])]
        ranks.append(NO_RANK)
        while (low := min(ranks)) != NO_RANK:
            i = ranks.index(low)
            parts[i] = part = made[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of[parts[i - 1]].get(part, NO_RANK)
            if i + 1 < len(parts):
                ranks[i] = rank_of[part].get(parts[i + 1], NO_RANK)
        return parts

    def _by_heap(self, parts: list[int]) -> list[int]:
        rank_of, n = lambda a, b: self.ranks[a].get(b), len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank_of(a, b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = self.made[rank], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := rank_of(parts[left], parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p, here in zip(parts, alive) if here]

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.memo.__getitem__, self.words.findall(text)))
        out = []
        for piece in self.cut.split(text):
            if piece in self.special:
                out.append(np.array([self.special[piece]], "<u4").tobytes())
            else:
                out.extend(map(self.memo.__getitem__, self.words.findall(piece)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Bytes of the tokens, specials included, with U+FFFD for what is not UTF-8."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Memo(dict):
    """Words seen lately; it is emptied when it has grown to its bound, which changes no result."""

    def __init__(self, encode, bound: int):
        super().__init__()
        self.encode_word, self.bound = encode, bound

    def __missing__(self, word: str) -> bytes:
        ids = self.encode_word(word)
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = ids
        return ids


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(2)
def tokenizer(path: str | None, pattern: str | None) -> ByteBpe:
    return ByteBpe(path or default_path(), pattern or default_pattern())


def flushed(batches: Iterator[pa.RecordBatch], row, columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of what row(values) yields for each input row, cut at FLUSH_BYTES of variable-length data."""
    out, held = [], 0
    for batch in batches:
        for values in zip(*(batch.column(batch.schema.get_field_index(c)) for c in columns)):
            for made, weight in row(*values):
                out.append(made)
                held += weight
                if held >= FLUSH_BYTES or len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def encode_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, decode: bool = True) -> DataFrame:
    """One row per input row: its id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded text.

    Null texts count as empty; null and repeated ids stay as they are; other
    columns of the input are not carried. path and pattern name the tokenizer
    file and its word pattern and default to the public byte-level file.
    """
    ship_code(df.sparkSession)
    kind = df.schema[id_col].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.StringType())] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema = tokenizer(path, pattern), None
        for batch in batches:
            if schema is None:
                schema = pa.schema([pa.field("doc_id", batch.schema.field(0).type), pa.field("n_tokens", pa.int64()), pa.field("ids", pa.binary()), *[pa.field("decoded", pa.string())] * decode])

            def row(doc, text):
                ids = bpe.encode(text.as_py() or "")
                yield (doc.as_py(), len(ids) // 4, ids, *[bpe.decode(ids)] * decode), 2 * len(ids)

            yield from flushed(iter([batch]), row, batch.schema.names, schema)

    return df.select(df[id_col], df[text_col]).mapInArrow(run, T.StructType(fields))
