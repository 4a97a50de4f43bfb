"""Stages of the pipeline against plain Python on planted texts."""

import random

import corpus_pipeline


def near(a, b, width=5):
    def grams(text):
        w = text.lower().split()
        return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}

    x, y = grams(a), grams(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def test_near_duplicates_at_a_similarity_of_four_fifths(spark):
    dice = random.Random(8)
    text = lambda n: [f"w{dice.randrange(5000)}" for _ in range(n)]
    texts = []
    for n in (60, 120, 200, 400):
        for swaps in (0, 1, 2, 3, 4, 5, 6, 8, 10, 15):
            base = text(n)
            other = base[:]
            for at in dice.sample(range(n), swaps):
                other[at] = "new"
            texts += [" ".join(base), " ".join(other)]
    # a chain: each is near the next only
    chain = text(200)
    for _ in range(5):
        texts.append(" ".join(chain))
        chain = chain[12:] + text(12)
    # a group of near copies, of which some are near others but not the first
    centre = text(150)
    for _ in range(40):
        copy = centre[:]
        for at in dice.sample(range(150), dice.choice((1, 2, 3))):
            copy[at] = f"x{dice.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [texts[0], texts[5].upper(), "two words", "two words"]
    order = list(range(len(texts)))
    dice.shuffle(order)
    texts = [texts[k] for k in order]
    label = list(range(len(texts)))
    links = [(a, b) for a in range(len(texts)) for b in range(a) if near(texts[a], texts[b])]
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    # one id twice: only the text that repeats another goes
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (1000, "alone " + " ".join(text(80))), (1000, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    expected = [(i, t) for i, t in enumerate(texts) if label[i] == i] + [(None, texts[0]), rows[-2]]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, expected))


def test_short_lines_are_repeats_when_equal(spark, tmp_path):
    from quillpack.llm.queries import op2_line_dedup

    texts = ["All rights reserved.\nfirst\n \n}", "first\n\t\nAll rights reserved.\nAll rights reserveD.", "first", None, "\n", "a line of more than thirty characters\n}", "a line of more than thirty characterz\nsecond"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    first, expected = {}, {}
    for i, t in enumerate(texts):
        for k, x in enumerate((t or "").split("\n")):
            if x.strip():
                head = first.setdefault(x.replace("characterz", "characters"), (i, k))
                expected[i, k] = (*head, head != (i, k))
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.removed) for r in op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == expected
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert left == {0: texts[0], 1: "\t\nAll rights reserveD.", 3: None, 4: "\n", 5: "a line of more than thirty characters", 6: "second"}


def test_rows_without_an_id_of_their_own_lose_only_their_repeats(spark):
    known = "a line that is there twice, in two documents"
    rows = [(1, known), (None, "one of\nits own\nlines"), (None, f"another\nfirst\n{known}"), (2, f"{known}\nstays"), (2, "two of\nthem\nhere"), (None, known)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(r) for r in corpus_pipeline.lines(spark, docs, "").collect()]
    # rows without an id come first
    expected = [(None, "one of\nits own\nlines"), (None, "another\nfirst\n" + known), (None, known), (2, "stays"), (2, "two of\nthem\nhere")]
    copies = [known in t for i, t in left]
    assert sum(copies) == 1
    without = lambda found: sorted(repr((i, t.replace(f"\n{known}", ""))) for i, t in found if t != known)
    assert without(left) == without(expected)


def test_run_against_a_plain_version(spark, tmp_path):
    """All stages on planted texts: what stays, its text, and its places, worked out without the operators."""
    import numpy as np
    from quillpack.llm import fast_ids

    dice = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in "nrst"]
    sentence = lambda n: " ".join(["the", "and", "of", *(dice.choice(vocabulary) for _ in range(n))])
    base = [[sentence(60) for _ in range(4)] for _ in range(6)]
    footer = "a footer line that is found in many documents here"
    texts = {
        1: "\n".join(base[0]),
        2: "\n".join(base[1] + [footer]),
        3: "\n".join(base[2] + [footer.replace("many", "mamy")]),  # the footer, one edit away
        4: "\n".join(x.rsplit(" ", 1)[0] + " altered" for x in base[0]),  # near the first, but no line is
        5: "too short to keep",
        6: "\n".join(base[3]),
        7: "\n".join(base[3]),  # an exact copy: all its lines go
        8: "\n".join(base[4] + ["password = hunter2secretvalue"]),
        9: None,
        10: " ".join(base[5] * 40),
    }
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        return row[-1]

    kept, seen = {}, []
    for i, text in texts.items():
        w = (text or "").split()
        grams = {}
        for k in range(len(w) - 2):
            grams.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {k + d for at in grams.values() if len(at) > 1 for k in at for d in range(3)}
        if len(w) >= 50 and 2 * len(covered) <= len(w):
            kept[i] = text
    for i in list(kept):
        left = []
        for line in kept[i].split("\n"):
            if not any(line == x or min(len(line), len(x)) >= 30 and abs(len(line) - len(x)) <= 2 and distance(line, x) <= 2 for x in seen):
                left.append(line)
                seen.append(line)
        if left:
            kept[i] = "\n".join(left)
        else:
            del kept[i]
    for i in sorted(kept):
        if any(j < i and near(kept[j], kept[i]) for j in kept):
            del kept[i]
    assert set(kept) == {1, 2, 3, 6, 8}
    kept[8] = "\n".join([*base[4], "[SECRET]"])
    tokens = {i: len(fast_ids.encoder()(t)) + 1 for i, t in kept.items()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found, places = {}, {}
    for r in rows:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert found == tokens
    for parts in places.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(places) == -(-sum(tokens.values()) // 2048)
