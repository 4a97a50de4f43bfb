"""Each operator on empty tables, null and repeated ids, clashing names, empty and long texts; and whole queries against plain versions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillpack.llm import bpe, embedding_dedup, kneser_ney, line_dedup, packing, quality_rules, queries, secret_scan, simhash, simhash_documents, suffix_dedup, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
LONG = "a long text of many words that go on and on " * 4000
TEXTS = [(1, "one line\nand another line that has more than thirty characters"), (1, "one line\nand another line that has more than thirty characters"), (None, "one line"), (None, None), (2, ""), (3, LONG), (4, LONG), (5, " \n\t "), (2, "x")]
# names that operators use for columns of their own, in the input
CLASHING = ["_row", "_text", "_gone", "_of", "row", "key", "of", "h1", "fp", "chunk", "n", "part", "gone"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return rows.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING]).cache()


OPERATORS = {
    "packing": lambda d: packing.pack_documents(d),
    "lines": lambda d: line_dedup.repeated_lines(d, least=1),
    "scores": lambda d: kneser_ney.score_documents(d, F.col("doc_id") == 2),
    "secrets": lambda d: secret_scan.scan(d),
    "quality": lambda d: quality_rules.judge(d),
    "bpe": lambda d: bpe.encode_documents(d),
    "repeats": lambda d: suffix_dedup.remove_repeats(d),
    "fingerprints": lambda d: simhash.near_duplicates(d),
    "counts": lambda d: token_counts.length_histogram(token_counts.token_lengths(d)),
    "keep_good": lambda d: quality_rules.keep_good(d),
    "drop_lines": lambda d: line_dedup.drop_repeated_lines(d, least=1),
    "drop_near": lambda d: simhash_documents.drop_near_duplicates(d),
    "mask": lambda d: secret_scan.mask_secrets(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, docs, name):
    assert OPERATORS[name](docs.limit(0)).collect() == []


ONE_FOR_EACH = ["scores", "secrets", "quality", "bpe", "repeats", "fingerprints"]


@pytest.mark.parametrize("name", ONE_FOR_EACH)
def test_a_row_for_each_row(docs, name):
    got = OPERATORS[name](docs)
    key = got["_row"]["doc_id"] if name == "quality" else got["doc_id"]
    assert collections.Counter(r[0] for r in got.select(key).collect()) == collections.Counter(i for i, _ in TEXTS)


@pytest.mark.parametrize("name, kept", [("drop_lines", [(1, TEXTS[0][1]), (2, ""), (2, "x"), (3, LONG), (5, " \n\t "), (None, "one line"), (None, None)]), ("drop_near", [t for t in TEXTS if t[0] != 4 and t != (5, " \n\t ")]), ("mask", TEXTS), ("keep_good", [])])
def test_stages_keep_columns_and_rows(docs, name, kept):
    got = OPERATORS[name](docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHING)
    if name == "drop_lines":
        # rows without an id come first, so their copy of the line stays
        assert sorted(repr((r.doc_id, r.text)) for r in rows if r.doc_id != 1) == sorted(repr(t) for t in kept if t[0] != 1)
        assert {r.text for r in rows if r.doc_id == 1} == {"and another line that has more than thirty characters"}
    elif name == "keep_good":
        assert {r.doc_id for r in rows} <= {3, 4}
    else:
        assert sorted(repr((r.doc_id, r.text)) for r in rows) == sorted(map(repr, kept))


def test_repeated_ids_take_nothing_from_each_other(docs):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted((i or 0, len(t or ""), len(LONG) if i == 4 else 0) if i != 3 else (3, len(LONG), 0) for i, t in TEXTS)


@pytest.mark.parametrize("hot", [16384, 1])
def test_shared_passages_in_many_texts(spark, hot):
    dice = random.Random(4)
    words = [f"{dice.randrange(16**6):x}" for _ in range(900)]
    passage = " ".join(words[:20])
    texts = [" ".join([*dice.choices(words, k=dice.randrange(30)), passage[dice.randrange(5) :], *dice.choices(words, k=20)]) for _ in range(60)] + ["ab" * 400, "b" + "ab" * 300, passage]
    first, expected = set(), {}
    for i, t in enumerate(texts):
        data, covered = t.encode(), bytearray(len(t))
        fresh = []
        for k in range(len(data) - 49):
            if data[k : k + 50] in first:
                covered[k : k + 50] = b"\1" * 50
            else:
                fresh.append(data[k : k + 50])
        first.update(fresh)
        expected[i] = hashlib.sha256(bytes(b for b, x in zip(data, covered) if not x)).hexdigest()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    assert {r.doc_id: r.kept_sha256 for r in suffix_dedup.remove_repeats(rows, hot=hot).collect()} == expected


def exact_cost(value, words):
    """Every segment of every kind, by the definition."""
    low, n = secret_scan.lowered(value), len(value)
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        for i in range(j):
            x, y = value[i:j], low[i:j]
            prices = [sum(map(secret_scan.alphabet, x))]
            if y in words.cost:
                prices.append(words.cost[y] + (0.3 if x != y else 0))
            prices += [price for pattern, _, price in secret_scan.DATES if pattern.fullmatch(x)]
            for size in secret_scan.UNITS:
                times = len(x) // size
                if times >= secret_scan.least_times(size) and y == y[:size] * times:
                    prices.append(sum(map(secret_scan.alphabet, x[:size])) + math.log10(times))
            if len(x) >= 4 and all(p in secret_scan.NEXT_KEYS for p in zip(y, y[1:])):
                prices.append(1.7 + math.log10(len(x)))
            best[j] = min(best[j], best[i] + 1 + min(prices))
    return best[n]


def test_guess_costs_are_the_least():
    dice, words = random.Random(1), secret_scan.Words(secret_scan.COMMON_WORDS)
    atoms = ["password", "abcd", "qwert", "1111", "19870412", "2020", "Dragon", "aa", "xyxyxy", "!", "é", "12-05-1999", "asdf", "9" * 16, "abc" * 4, "ABAB", "love", "İ"]
    for _ in range(2500):
        value = "".join(dice.choice(atoms) if dice.random() < 0.6 else "".join(dice.choices("ab1!qwe", k=dice.randint(1, 4))) for _ in range(dice.randint(1, 6)))[:40]
        cost, parts = secret_scan.guess_cost(value, words)
        assert cost == pytest.approx(exact_cost(value, words), abs=1e-9), value
        assert [a for _, a, _ in parts] + [len(value)] == [0, *(b for _, _, b in parts)]
    assert secret_scan.guess_cost("1" * 13 + "19870412", words)[0] < 9


def scanned(text):
    """The base spans by a scanner of its own: character by character, the leftmost match of each kind."""
    names, out = ("password", "passwd", "secret", "token", "api_key", "apikey"), []
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    at, low = 0, "".join(c.lower() if c.isascii() else c for c in text)
    while at < len(text):
        name = next((x for x in names if low.startswith(x, at)), None)
        if name is None:
            at += 1
            continue
        k = at + len(name)
        end = None
        for quote in ([k + 1, k] if text[k : k + 1] in ("'", '"') and text[k : k + 1] else [k]):
            j = quote
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] not in (":", "=") or not text[j : j + 1]:
                continue
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] in ("'", '"') and text[j : j + 1]:
                j += 1
            stop = j
            while stop < len(text) and text[stop] in value:
                stop += 1
            if stop > j:
                end = (j, stop)
                break
        if end is None:
            at += 1
            continue
        if end[1] - end[0] >= 6:
            out.append((at, 0, end[1]))
        at = end[1]
    for kind, head, of, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            stop = at + len(head)
            if not text.startswith(head, at):
                at += 1
                continue
            while stop < len(text) and text[stop] in of:
                stop += 1
            if stop == at + len(head):
                at += 1
                continue
            if stop - at >= least:
                out.append((at, kind, stop))
            at = stop
    return out


def test_base_spans_against_a_scanner(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = [(10**6 + k, t) for k, t in enumerate(["Password = 'abcdef'", 'token":"x', "secretsecret:=abcdefg", "api_key::abcdef", "apikey= \"abc.def", "passwd  =  ==abcdef", "ſecret=abcdef", "toKen=abcdef", "AKIAAKIA" + "A" * 14, "a" * 24 + "g" + "0" * 23, "token: token: abcdefgh"])]
    rows = rows.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: r for r in secret_scan.scan(rows, dictionary=100).collect()}
    for r in rows.collect():
        spans = scanned(r.text or "")
        listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), r.doc_id
        assert set(filter(None, listed.split(","))) <= set(got[r.doc_id].spans.split(","))


def test_frequent_words(spark):
    rows = spark.createDataFrame([("The the CAT",), ("a cat sat",), (None,)], "text string")
    assert secret_scan.frequent_words(rows, size=2) == ["cat", "the"]


def test_bpe_query_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    texts = [None, "", " ", "a <|endoftext|> b", "日本語 😀", "é" * 700, LONG[:30_000]]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_bpe(spark, str(tmp_path)).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode())]
        assert got[r.doc_id] == (len(ids), *digests)


def test_histogram_columns(spark):
    lengths = [0, 3, 3, 5, 100, 100, 7000]
    rows = token_counts.length_histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    for r in rows.collect():
        within, longer = [x for x in lengths if x <= r.n_tokens], [x for x in lengths if x > r.n_tokens]
        assert (r.n_docs, r.docs_within, r.tokens_within, r.docs_longer, r.tokens_longer) == (lengths.count(r.n_tokens), len(within), sum(within), len(longer), sum(longer))
        assert (r.truncated_total, r.lost_tokens) == (sum(within) + len(longer) * r.n_tokens, sum(longer) - len(longer) * r.n_tokens)
        assert r.share_within == pytest.approx(len(within) / len(lengths))
    for r in token_counts.totals_at(rows, [0, 4, 99, 10**6]).collect():
        assert r.docs_longer == sum(x > r.context_limit for x in lengths) and r.truncated_total == sum(min(x, r.context_limit) for x in lengths)
    assert [tuple(r) for r in token_counts.totals_at(rows.limit(0), [5]).collect()] == [(5, 0, 0)]


def test_quality_measures(spark):
    text = "the cat and the dog ## ...\n- item one|two\n• the same\n• the same\nends …\n\n"
    r = quality_rules.judge(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.n_symbols, r.stop_words, r.n_lines, r.n_dup_lines) == (3, 5, 5, 1)
    assert r.ellipsis_line_share == pytest.approx(2 / 5) and r.bullet_line_share == pytest.approx(3 / 5)
    good = "the word and another word of some length " * 2 + " ".join(f"word{k}" for k in range(80))
    cases = {good: True, good.replace("the", "x").replace("and", "q").replace("of", "z"): False, good + " ###" * 40: False, " ".join("i" for _ in range(90)): False}
    got = {r._row.text: r.kept for r in quality_rules.judge(spark.createDataFrame([(t,) for t in cases], "text string")).collect()}
    assert got == cases


def test_vectors_that_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (9, [], 1), (None, [1.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False)
    assert all(got[k] == (0, k, True) for k in range(3, 10))


@pytest.mark.parametrize("hot", [1000, 1])
def test_lines_of_one_segment(spark, hot):
    """Lines that share a third: crowds of lines near each other and not, against all pairs."""
    dice = random.Random(9)
    head = "a common beginning of a line, "
    lines = [head + "".join(dice.choices("abcdef ", k=30)) + "x" for _ in range(30)]
    lines += [x[:40] + dice.choice("pqrs") + x[41:] for x in lines[:20]] + [lines[0][:35] + c + lines[0][36:50] + d + lines[0][51:] for c in "mno" for d in "uvw"]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    label = list(range(len(lines)))
    links = [(a, b) for a in range(len(lines)) for b in range(a) if apart(lines[a], lines[b]) <= 2]
    for _ in lines:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.first_doc_id for r in line_dedup.repeated_lines(rows, least=1, hot=hot).collect()}
    assert got == dict(enumerate(label))


def test_no_words_alone_are_not_sampled():
    assert re.fullmatch("[a-z ]+", " ".join(secret_scan.COMMON_WORDS))
