from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from aftershock.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio):
    found, forms = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[x], x) for x in counts if near(w, x))
        form = others[0][1] if others and -others[0][0] >= ratio * n else None
        forms[w] = form
        found[w] = (form, n, len(others), counts[form] if form else None)
    rows = set()
    for w, (form, n, n_near, form_n) in found.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


def variants(rng, word, letters):
    i, kind = rng.randrange(len(word)), rng.randrange(3)
    if kind == 0:
        return word[:i] + word[i + 1 :]
    return word[:i] + rng.choice(letters) + word[i + (kind == 1) :]


@pytest.mark.parametrize(("letters", "block"), [("ab", 8192), ("abcé", 20), ("abcdefgh漢😀", 8192)])
def test_variants_equal_brute_force(spark, letters, block):
    rng = random.Random(len(letters))
    counts = Counter()
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 13)))
        counts[word] += rng.choice([2, 30, 400, 5000])
        for _ in range(6):
            word = variants(rng, word, letters)
            counts[word] += rng.choice([2, 3, 20, 30])
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    rows = [tuple(r) for r in spelling.group_variants(words, 10, block).collect()]
    assert len(rows) == len(counts)
    assert set(rows) == brute(counts, 10)


def test_forms_are_followed_to_the_last(spark):
    words = ["aaaaaaaa" + "b" * i for i in range(9)]
    rows = [(w, 3 * 10**i) for i, w in enumerate(words)]
    found = spelling.group_variants(spark.createDataFrame(rows, "word string, n long"))
    assert {r.word: r.root for r in found.collect()} == {w: words[-1] for w in words}


def test_a_hot_ending_is_split(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abcdef") for _ in range(3)) + "tions" for _ in range(200)}
    counts = {w: rng.randrange(2, 500) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    units = spelling._units(frame, 30)
    held = units.groupBy(*spelling.UNIT).count().agg({"count": "max"}).first()[0]
    assert held <= 120
    assert {tuple(r) for r in spelling.group_variants(frame, 10, 30).collect()} == brute(counts, 10)


def expected(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return brute({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}, 10)


def test_the_query_equals_brute_force(spark, tmp_path, hostile, empty):
    from aftershock.llm.queries import QUERIES

    rng = random.Random(9)
    stems = ["".join(rng.choice("abcdeÀéÿ") for _ in range(rng.randrange(5, 11))) for _ in range(60)]
    weights = [1 / (1 + i) for i in range(60)]
    rows = []
    for i in range(200):
        words = rng.choices(stems, weights, k=80)
        text = " ".join(w.upper() if rng.random() < 0.1 else w for w in words)
        rows.append((i if i % 50 else None, text))
    rows += [(7, rows[7][1]), (8, None), (9, ""), (10, "1 2 ×÷×÷×÷× ×÷×÷×÷×")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = QUERIES["op11_spelling_variants"](spark, f"{tmp_path}/a")
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == expected(rows)
    hostile.write.parquet(f"{tmp_path}/b/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in hostile.collect()])
    assert {tuple(r) for r in QUERIES["op11_spelling_variants"](spark, f"{tmp_path}/b").collect()} == want
    empty.write.parquet(f"{tmp_path}/c/documents.parquet")
    assert QUERIES["op11_spelling_variants"](spark, f"{tmp_path}/c").count() == 0
