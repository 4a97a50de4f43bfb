"""Secret scans: pattern spans, and credential values that cost many guesses.

Values in a credential context are split at minimum cost into common words,
dates, repeats, keyboard walks and brute-force spans by dynamic programming over
their positions; a value whose cheapest split still takes ``strong`` powers of
ten of guesses is reported as a span of kind "guess". The programme is exact: it
has the cost with and without an open brute-force span at each position, and
repeats and walks begin and end anywhere. Words are frequent ones of passwords and
of the documents themselves, priced by their rank.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpack.llm.store import settle, ship_code

# fixed values: the base patterns and the order of their kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so as good as dropping shorter ones
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|code|phrase|key)?|pwd|pin|secret|token|auth(?:orization)?|bearer|api[_-]?key|access[_-]?key|client[_-]?secret|private[_-]?key|credentials?)"""
    r"""["']?(?:\x20*(?:[:=]|:=|=>)\x20*|\x20+is\x20+)["'`]?([^\s"'`,;<>]+)""",
    re.I | re.A,
)
HINTS = ("pass", "pwd", "pin", "secret", "token", "auth", "bearer", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "privatekey", "private_key", "private-key", "credential")

# fixed values: frequent words of passwords, most frequent first
COMMON_WORDS = """
password admin welcome letmein monkey dragon master login princess sunshine shadow football baseball
superman batman trustno iloveyou michael jordan hunter killer soccer charlie secret test guest root user
default changeme example sample dummy demo temp temporary token value none null true false string here your
my the and key pass word love hello summer winter spring autumn cheese computer internet service server
database access private public account email name company office home house mother father orange banana
purple yellow black white green silver golden flower magic tiger eagle lion horse pepper cookie ginger
""".split()
# fixed values: rows of keys on a keyboard
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
NEXT_KEYS = {(a, b) for row in KEY_ROWS for line in (row, row[::-1]) for a, b in zip(line, line[1:])}
# fixed values: dates with years of two centuries, and years alone
DATES = (
    (re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"), (8, 9, 10), 4.6),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d"), (8, 9, 10), 4.6),
    (re.compile(r"(?:19|20)\d\d"), (4,), 2.1),
)
UNITS = (1, 2, 3, 4)


def least_times(size: int) -> int:
    """How often a unit must come to count as a repeat."""
    return 3 if size == 1 else 2


def alphabet(c: str) -> float:
    return math.log10(10 if c.isascii() and c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def lowered(value: str) -> str:
    """A-Z in lower case, so that positions stay."""
    return value.translate(LOWER)


LOWER = {ord(c): ord(c.lower()) for c in string.ascii_uppercase}


class Starts:
    """Starts of segments that cost log10 of their number of steps more than what comes before them.

    Of two starts the later one can only be better at first, so those that can
    still be best are a stack with the next change at its top, and finding the
    best start of an end takes constant time on average.
    """

    def __init__(self) -> None:
        self.stack: list[tuple[int, float, float]] = []  # start in steps, cost before it, end from which the one below is better

    def overtaken(self, i: int, cost: float, below: tuple[int, float, float]) -> float:
        """The end from which the earlier start ``below`` is no worse than i."""
        if cost <= below[1]:
            return math.inf
        if cost - below[1] > 300:
            return i
        r = 10 ** (cost - below[1])
        return (r * i - below[0]) / (r - 1)

    def add(self, i: int, cost: float, end: int) -> None:
        self.settle(end)
        while self.stack:
            until = self.overtaken(i, cost, self.stack[-1])
            if until <= end:
                return
            if until < self.stack[-1][2]:
                break
            self.stack.pop()  # below it is better before it is best again
        self.stack.append((i, cost, until if self.stack else math.inf))

    def settle(self, end: int) -> None:
        while len(self.stack) > 1 and self.stack[-1][2] <= end:
            self.stack.pop()

    def best(self, end: int) -> tuple[float, int] | None:
        self.settle(end)
        if not self.stack:
            return None
        i, cost, _ = self.stack[-1]
        return cost + math.log10(end - i), i


class Words:
    """Costs of words by their rank."""

    def __init__(self, ranked: list[str]):
        self.cost: dict[str, float] = {}
        for k, word in enumerate(dict.fromkeys(ranked)):
            self.cost[word] = math.log10(k + 2)
        self.sizes = sorted({len(w) for w in self.cost})


def guess_cost(value: str, words: Words | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses for the cheapest segmentation, and its segments (kind, start, end).

    Every segment costs one digit more, which stands for the choice of its kind.
    """
    words = words or Words(COMMON_WORDS)
    n, low = len(value), lowered(value)
    best, back = [0.0] + [math.inf] * n, [(0, "")] * (n + 1)
    weight = [0.0, *accumulate(map(alphabet, value))]
    brute, opened = math.inf, 0  # the cost with an open brute-force span here, and where it began
    runs = {size: [0, [Starts() for _ in range(size)]] for size in UNITS}  # where what has that period began, and starts by their rest
    walk, walks = 0, Starts()
    for j in range(1, n + 1):
        c = alphabet(value[j - 1])
        if best[j - 1] + 1 < brute:
            brute, opened = best[j - 1] + 1, j - 1
        brute += c
        cost, kind, start = brute, "brute", opened
        for size in words.sizes:
            if size > j:
                break
            if (known := words.cost.get(low[j - size : j])) is not None:
                known += best[j - size] + 1 + (0.3 if value[j - size : j] != low[j - size : j] else 0)
                if known < cost:
                    cost, kind, start = known, "word", j - size
        if "0" <= value[j - 1] <= "9":
            for pattern, sizes, price in DATES:
                for size in sizes:
                    if size <= j and best[j - size] + price + 1 < cost and pattern.fullmatch(value, j - size, j):
                        cost, kind, start = best[j - size] + price + 1, "date", j - size
        for size, run in runs.items():
            if j > size and low[j - 1] != low[j - 1 - size]:
                run[0], run[1] = j - size, [Starts() for _ in range(size)]
            i = j - least_times(size) * size
            if i < run[0]:
                continue
            starts = run[1][j % size]
            starts.add(i // size, best[i], j // size)
            if found := starts.best(j // size):
                found_cost = found[0] + weight[j] - weight[j - size] + 1
                if found_cost < cost:
                    cost, kind, start = found_cost, "repeat", found[1] * size + j % size
        if j > 1 and (low[j - 2], low[j - 1]) not in NEXT_KEYS:
            walk, walks = j - 1, Starts()
        if j - 4 >= walk:
            walks.add(j - 4, best[j - 4], j)
            if (found := walks.best(j)) and found[0] + 2.7 < cost:
                cost, kind, start = found[0] + 2.7, "walk", found[1]
        best[j], back[j] = cost, (start, kind)
    parts, j = [], n
    while j:
        i, kind = back[j]
        parts.append((kind, i, j))
        j = i
    return best[n], parts[::-1]


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; low is the text in lower case, which only saves time."""
    out = []
    if any(x in low for x in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def guess_spans(text: str, low: str, strong: float, words: Words) -> list[tuple[int, int, int]]:
    if not any(h in low for h in HINTS):
        return []
    return [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], words)[0] >= strong]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def frequent_words(df: DataFrame, text_col: str = "text", size: int = 20_000) -> list[str]:
    """The ``size`` most frequent words of three or more letters a-z in any case, by number and then in order; counted over all rows."""
    found = F.regexp_extract_all(F.lower(df[text_col]), F.lit("[a-z]{3,20}"), F.lit(0))
    counts = settle(df.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    # the best of each partition would all go to the driver: first the range of numbers that holds enough words is found
    band = F.floor(F.log2("n") * 8)
    least = enough = 0
    for r in counts.groupBy(band.alias("band")).agg(F.count("*").alias("words")).orderBy(F.desc("band")).collect():
        least, enough = r.band, enough + r.words
        if enough >= size:
            break
    return [r.word for r in counts.where(band >= least).orderBy(F.desc("n"), "word").limit(size).collect()]


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", strong: float = 9.0, dictionary: int = 20_000, words: list[str] | None = None) -> DataFrame:
    """One row per input row: n_assign, n_access, n_hex, base_sha256 and spans over the whole text.

    Positions are code points, ends exclusive. A null or empty text has no spans;
    null and repeated ids are rows like others, and no rows give no rows. Words
    that guesses try are those given, or else the ``dictionary`` most frequent of df.
    """
    ship_code(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    known = Words([*COMMON_WORDS, *(frequent_words(df, text_col, dictionary) if words is None else words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                low = text.lower()
                base = base_spans(text, low)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                out.append((doc, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + guess_spans(text, low, strong, known))))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)], names=names)

    return df.select(df[id_col], df[text_col]).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, strong: float = 9.0, mask: str = "[SECRET]", words: Words | None = None) -> str:
    """The text with every found span replaced; spans that overlap are replaced as one."""
    low = text.lower()
    spans = sorted(base_spans(text, low) + guess_spans(text, low, strong, words or Words(COMMON_WORDS)))
    if not spans:
        return text
    merged: list[list[int]] = []
    for start, _, end in spans:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    out, at = [], 0
    for start, end in merged:
        out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def mask_secrets(df: DataFrame, *, text_col: str = "text", strong: float = 9.0, mask: str = "[SECRET]", dictionary: int = 20_000, words: list[str] | None = None) -> DataFrame:
    """df with found secrets masked in its text column; all rows and columns stay, nulls too. Words as in ``scan``."""
    ship_code(df.sparkSession)
    known = Words([*COMMON_WORDS, *(frequent_words(df, text_col, dictionary) if words is None else words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else masked(t, strong, mask, known) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(k).type) if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return df.mapInArrow(run, df.schema)
