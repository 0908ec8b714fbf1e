from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aftershock.llm import hard_negatives
from aftershock.llm.queries import QUERIES
from aftershock.llm.statements import ORACLE_SQL
from checks.compare import duck, duck_rows, spark_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10, lower=30, upper=90):
    """Rows (id, label, integer vector) to result rows."""
    found = []
    asked = {}
    for i, label, v in rows:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, (label, v)), (label, v))
    for i, (label, v) in asked.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), j, own) for j, own, w in rows if j != i]
        same = sorted((s, j) for s, j, own in scored if own == label)[:positives]
        other = sorted((s, j) for s, j, own in scored if own != label)
        for s, j in same:
            fits = [(t, o) for t, o in other if lower * -s <= 100 * -t <= upper * -s][:negatives]
            found += [(i, j, rank, o, -s, -t) for rank, (t, o) in enumerate(fits, 1)]
    return sorted(found)


def mined(frame, **options):
    got = hard_negatives.mine(frame, F.col("vec_id") % 100 == 0, **options)
    return sorted(tuple(r) for r in got.collect())


def clusters(seed, n, d, spread, centres=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(centres, d)) * 40
    rows = []
    for i in range(n):
        v = middles[rng.integers(centres)] + rng.normal(size=d) * spread
        rows.append((i, int(rng.integers(4)), [int(x) for x in np.floor(v)]))
    return rows


@pytest.mark.parametrize(("spread", "d", "options"), [(4, 16, {}), (60, 7, {"chunk": 64}), (0.2, 8, {"sample": 64, "chunk": 100})])
def test_mined_rows_equal_brute_force(spark, monkeypatch, spread, d, options):
    monkeypatch.setattr(hard_negatives, "TOGETHER", 3)
    rows = clusters(d, 1500, d, spread)
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<int>").repartition(5)
    assert mined(frame, **options) == brute(rows)


def test_cells_are_visited_in_order_and_pruned():
    rows = clusters(1, 4000, 16, 3)
    vectors = np.array([r[2] for r in rows], float)
    books = hard_negatives.Codebooks.fit(vectors, 12)
    i, first, j, second = books.assign(vectors)
    sizes = np.zeros((len(books.first), len(books.second)), np.int64)
    np.add.at(sizes, (i, j), 1)
    radii = (np.zeros(len(books.first)), np.zeros(len(books.second)))
    np.maximum.at(radii[0], i, first)
    np.maximum.at(radii[1], j, second)
    index = hard_negatives.MultiIndex(books, radii, sizes)
    (top1, low1), (top2, low2) = index.bounds(vectors[:50])
    shares = []
    for q in range(50):
        scores = vectors @ vectors[q]
        assert (scores <= top1[q, i] + top2[q, j]).all()
        assert (scores >= low1[q, i] + low2[q, j]).all()
        a, b = index.visit(top1[q], top2[q], -np.inf)
        assert len({*zip(a.tolist(), b.tolist())}) == sizes.size
        assert (np.diff(top1[q, a] + top2[q, b]) <= 1e-6).all()
        least = np.sort(scores)[-10]
        a, b = index.visit(top1[q], top2[q], least)
        assert {*zip(i[scores >= least].tolist(), j[scores >= least].tolist())} <= {*zip(a.tolist(), b.tolist())}
        shares.append(sizes[a, b].sum() / len(rows))
    assert np.mean(shares) < 0.5


def scaled(rows):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        kept.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    return kept


def test_the_query_on_hostile_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], rng.randrange(10)) for i in range(900)]
    rows += [(10_000 + i, [1.0, 0.5, 0, 0, 0, 0.25], i % 3) for i in range(300)]  # ties
    rows += [(None, [1.0] * 6, 1), (901, None, 1), (902, [1.0] * 6, None), (903, [1.0, None, 0, 0, 0, 0], 2)]
    rows += [(904, [float("nan")] * 6, 1), (1000, [float("inf"), 0, 0, 0, 0, 0], 1), (1100, [0.0] * 6, 1)]
    rows += [(100, [0.5] * 6, 3), (100, [0.5] * 6, 3), (907, [1.0] * 6, 3), (907, [1.0] * 6, 3), (1200, [-1.0] * 6, 77)]
    typed = [(i, v and [None if x is None else float(x) for x in v], label) for i, v, label in rows]
    frame = spark.createDataFrame(typed, SCHEMA).withColumns({"unit": F.lit("x"), "score": F.lit(1), "id": F.lit("y")})
    frame.repartition(4).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    got = sorted(tuple(r) for r in QUERIES["op13_hard_negatives"](spark, f"{tmp_path}/a").collect())
    assert got == brute(scaled(rows))
    frame.limit(0).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert QUERIES["op13_hard_negatives"](spark, f"{tmp_path}/b").count() == 0


def test_odd_tables(spark):
    schema = "vec_id long, label int, vector array<double>"
    few = [(0, 1, [3.0, 1.0]), (1, 1, [2.0, 2.0]), (2, 2, [2.0, 0.0])]
    longer = [(200, 1, [1.0, 1.0, 1.0]), (3, 1, [1e9, 0.0]), (4, 1, [])]
    frame = spark.createDataFrame(few + longer, schema)
    assert mined(frame) == [(0, 1, 1, 2, 8, 6)]
    assert mined(spark.createDataFrame([r for r in few if r[0]], schema)) == []
    assert mined(spark.createDataFrame([(0, 1, [2.0]), (1, 2, [2.0])], schema)) == []


def test_the_query_equals_its_statement(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op13_hard_negatives"](spark, folder)
    assert spark_rows(got) == duck_rows(duck(folder), ORACLE_SQL["op13_hard_negatives"])
