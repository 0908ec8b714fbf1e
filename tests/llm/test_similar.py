from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from aftershock.llm import multi_index, ngram_join, pitman_yor, projection_passes, shared
from aftershock.llm.shared import components
from tests.llm.conftest import LONG, changed, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def reached(ids, links):
    label = {i: i for i in ids}
    again = True
    while again:
        again = False
        for a, b in links:
            least = min(label[a], label[b])
            again |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return label


@pytest.mark.parametrize(("rounds", "finished"), [(1, 0), (3, 0), (1, 400_000), (3, 90)])
def test_components(spark, monkeypatch, rounds, finished):
    monkeypatch.setattr(shared, "FINISHED", finished)
    rng = random.Random(rounds)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    links += [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)] + [(7, 7)]
    edges = spark.createDataFrame(links, "u long, v long").repartition(7)
    got = {r.id: r.component for r in components(edges).collect()}
    want = reached({x for link in links for x in link}, links)
    assert {i: c for i, c in want.items() if i in got} == got
    assert all(want[i] == i for i in want if i not in got)


def shingles(text, size):
    words = words_of(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_similar(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    links = []
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links.append((i, j))
    return {i: len(s) for i, s in sets}, reached([i for i, _ in sets], links)


@pytest.fixture(scope="module")
def family():
    """Copies at many distances, a passage that many share, and unrelated texts."""
    rows, passage = [], prose(999, 60)
    for seed in range(12):
        text = prose(seed, 40 + 60 * seed, 10_000)
        rows += [text, text.upper()] + [changed(text, every) for every in (17, 23, 37, 61, 97, 150)]
    rows += [passage + " " + prose(100 + i, 50, 10_000) for i in range(40)]
    rows += ["a b", "A  b", "a b c", "", " ", "x y z w"]
    rng = random.Random(1)
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize(("size", "percent", "together"), [(3, 90, 1 << 26), (5, 80, 20_000), (2, 60, 0)])
def test_similar_documents_equal_brute_force(spark, family, monkeypatch, size, percent, together):
    monkeypatch.setattr(ngram_join, "CLUSTER", together)
    docs = spark.createDataFrame(family, "doc_id long, text string").repartition(3)
    got = ngram_join.similar_documents(docs, size, percent).collect()
    sizes, label = brute_similar(family, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (sizes[i], label[i]) for i, _ in family}
    assert len(got) == len(family) and len(set(label.values())) < len(family) - 20


def test_links_within_a_large_bucket_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    monkeypatch.setattr(ngram_join, "REACH", 1)
    text = prose(3, 300, 10_000)
    rng = random.Random(4)
    rows = []
    for i in range(120):
        words = text.split(" ")
        for at in rng.sample(range(300), 3):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, label = brute_similar(rows, 3, 95)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs, 3, 95).collect()}
    assert got == label


def test_pairs_looked_at_in_a_group_of_near_copies_grow_with_its_rows(spark, monkeypatch):
    made, crossings = [], ngram_join.crossings

    def counted(*args):
        out = crossings(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "crossings", counted)
    monkeypatch.setattr(ngram_join, "LEAF", 16)
    monkeypatch.setattr(ngram_join, "REACH", 2)
    text, rng, rows = prose(3, 150, 10_000), random.Random(4), []
    for i in range(600):
        words = text.split(" ")
        for at in rng.sample(range(150), rng.choice([2, 3, 3, 3, 3, 3])):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs, 3, 80).collect()}
    _, label = brute_similar(rows, 3, 80)
    assert got == label and sum(made) < 60 * len(rows)


def test_rounds_read_crowded_buckets_only(spark, monkeypatch):
    read, contested = [], ngram_join.contested

    def counted(labelled):
        sizes = labelled.groupBy("token").count().agg({"count": "min", "token": "count"}).first()
        read.append((sizes["min(count)"], sizes["count(token)"]))
        return contested(labelled)

    monkeypatch.setattr(ngram_join, "contested", counted)
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    monkeypatch.setattr(ngram_join, "REACH", 1)
    text, rng, rows = prose(3, 150, 10_000), random.Random(4), []
    for i in range(200):
        words = text.split(" ")
        for at in rng.sample(range(150), 3):
            words[at] = f"n{i}x{at}"
        rows.append((i, " ".join(words)))
    # Five versions of a text that share too little for links, some of them with all.
    for i in range(200, 300, 5):
        one = prose(i, 150, 10_000)
        rows += [(i + j, changed(one, every)) for j, every in enumerate((15, 16, 17, 18, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in ngram_join.similar_documents(docs, 3, 80).collect()}
    _, label = brute_similar(rows, 3, 80)
    assert got == label
    assert len(read) > 1 and all(least > 8 and tokens < read[0][1] for least, tokens in read[1:])


def test_similar_hostile_documents(hostile, empty):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_documents(hostile, 3, 90).collect())
    assert got[2, 4, 2] == 2 or got[2, 3, 2] == 2
    assert got[3, 0, 3] == got[4, 0, 4] == got[5, 0, 5] == 1 and got[9, 1, 9] == 1
    assert got[6, len(shingles(LONG, 3)), 6] == 1 and sum(got.values()) == hostile.count()
    assert ngram_join.similar_documents(empty).collect() == []


def cosine(a, b):
    return float(a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)))


@pytest.fixture(scope="module")
def vectors(spark):
    """Unrelated vectors, copies, scaled and near copies, and rows that take no part."""
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 24))
    rows = [v for v in base] + [base[0], base[0], 2 * base[1], -base[2]]
    rows += [base[3] + 0.1 * rng.standard_normal(24) for _ in range(60)]
    rows += [base[4 + i] + s * rng.standard_normal(24) for i in range(20) for s in (0.1, 0.3, 0.45)]
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    rows += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0]]
    ids = random.Random(3).sample(range(5000), len(rows))
    ids[10], ids[0], ids[30] = 0, 100, 200
    table = [(i, v, 1, 2) for i, v in zip(ids, rows)]
    return table, spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, h1 int")


def sound(v):
    return v is not None and len(v) == 24 and None not in v and all(map(math.isfinite, v)) and any(v)


def test_near_duplicate_vectors(vectors):
    table, frame = vectors
    own = [(i, np.array(v)) for i, v, *_ in table if sound(v)]
    links = [(i, j) for a, (i, x) in enumerate(own) for j, y in own[:a] if cosine(x, y) >= 0.9]
    label = reached([i for i, *_ in table], links)
    degree = Counter(x for link in links for x in link)
    got = projection_passes.near_duplicates(frame, 0.9).collect()
    assert len(got) == len(table)
    for row in got:
        assert (row.component_id, row.kept) == (label[row.vec_id], label[row.vec_id] == row.vec_id)
        assert row.n_links <= degree[row.vec_id]
    assert sum(r.n_links for r in got) >= 0.98 * sum(degree.values())


def test_near_duplicates_of_few_rows(spark, vectors):
    _, frame = vectors
    assert projection_passes.near_duplicates(frame.limit(0)).collect() == []
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<double>")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in projection_passes.near_duplicates(odd).collect())
    assert got == Counter({(1, 1, 1, True): 2, (None, 0, None, False): 1, (2, 0, 2, True): 1})


@pytest.mark.parametrize("least", [256, 16])
def test_all_links_of_noisy_groups_are_counted(spark, monkeypatch, least):
    """Near copies of one vector whose links no angles to a centre can prove."""
    monkeypatch.setattr(projection_passes, "LEAST_BLOCK", least)
    rng = np.random.default_rng(11)
    rows = [c + s * rng.standard_normal(24) for s in (0.05, 0.2, 0.3) for c in rng.standard_normal((1, 24)) for _ in range(300)]
    rows += rows[:3]
    vectors = np.array(rows)
    cosines = vectors @ vectors.T / np.sqrt((vectors**2).sum(1))[:, None] / np.sqrt((vectors**2).sum(1))
    degree = (cosines >= 0.9).sum(1) - 1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(5)
    got = {r.vec_id: r for r in projection_passes.near_duplicates(frame, 0.9).collect()}
    assert len(got) == len(rows)
    assert all(got[i].n_links == degree[i] for i in got if got[i].n_links or degree[i] > 3)


def test_isolated_pairs_are_found_in_tables_of_any_size(spark):
    # A window of one neighbour needs as many shared signs as one of 32 in 256,000 vectors.
    rng = np.random.default_rng(4)
    v = rng.standard_normal((8000, 32))
    v /= np.sqrt((v**2).sum(1))[:, None]
    for i in range(400):
        other = v[i + 400] - (v[i + 400] @ v[i]) * v[i]
        v[i + 400] = 0.901 * v[i] + math.sqrt(1 - 0.901**2) * other / math.sqrt(other @ other)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(4)
    found = {(r.u, r.v) for r in projection_passes.links(frame, 0.9, window=1).collect()}
    assert sum((i, i + 400) in found for i in range(400)) >= 0.97 * 400
    sizes = [projection_passes.passes_for(n, v[1000:2000], v.mean(0), 0.9) for n in (100, 10**5, 10**7, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == projection_passes.PASSES and sizes[3] > 2 * sizes[2] - sizes[1]


@pytest.mark.parametrize("background", [0.0, 0.6, 0.8])
def test_pairs_are_found_in_crowded_tables(spark, background):
    """All vectors have a cosine of about ``background`` to each other."""
    rng = np.random.default_rng(5)
    d, n = 64, 6000
    common = np.zeros(d)
    common[0] = math.sqrt(background)
    own = rng.standard_normal((n, d))
    own[:, 0] = 0
    v = common + math.sqrt(1 - background) * own / np.sqrt((own**2).sum(1))[:, None]
    for i in range(300):
        other = v[i + 300] - (v[i + 300] @ v[i]) * v[i]
        v[i + 300] = 0.902 * v[i] + math.sqrt(1 - 0.902**2) * other / math.sqrt(other @ other)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>").repartition(4)
    found = {(r.u, r.v) for r in projection_passes.links(frame, 0.9).collect()}
    assert sum((i, i + 300) in found for i in range(300)) >= 0.97 * 300
    cosines = v @ v.T / np.sqrt((v**2).sum(1))[:, None] / np.sqrt((v**2).sum(1))
    assert all(cosines[u, w] > 0.9 - 1e-6 for u, w in found)


def brute_nearest(table, query, k):
    own = [(i, np.array(v)) for i, v, *_ in table if sound(v)]
    at = dict(own)[query]
    return sorted((float(np.sqrt(((at - v) ** 2).sum())), i) for i, v in own if i != query)[:k]


def test_nearest_of_small_tables_are_exact(vectors):
    from pyspark.sql import functions as F

    table, frame = vectors
    got = multi_index.nearest(frame, F.col("vec_id") % 100 == 0, k=10, recall=1.0).collect()
    queries = {i for i, v, *_ in table if i % 100 == 0 and sound(v)}
    assert {r.query_id for r in got} == queries and len(queries) >= 3
    hits = 0
    for query in queries:
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == query)
        want = brute_nearest(table, query, 10)
        assert [r for r, *_ in own] == list(range(1, 11))
        assert [s for *_, s in own] == sorted(s for *_, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in want})
        for _, i, score in own:
            assert math.isclose(score, dict((b, a) for a, b in brute_nearest(table, query, 999))[i], rel_tol=1e-12)
    assert hits >= 0.9 * 10 * len(queries)


def test_nearest_with_few_or_no_vectors(spark, vectors):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [0.0, 1.0]), (None, [1.0, 1.0]), (8, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.nearest(frame, F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, round(r.score, 9)) for r in got] == [(1, 5, round(math.sqrt(2), 9)), (2, 7, round(math.sqrt(2), 9))]
    assert multi_index.nearest(vectors[1].limit(0), F.col("vec_id") >= 0).collect() == []


def test_recall_and_share_of_a_larger_table(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    centres = rng.standard_normal((30, 16)) * 3
    rows = [(i, (centres[i % 30] + rng.standard_normal(16)).tolist()) for i in range(3000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = multi_index.nearest(frame, F.col("vec_id") % 100 == 0, k=10, sample=1000).collect()
    hits = sum(
        len({r.vec_id for r in got if r.query_id == q} & {i for _, i in sorted((float(((np.array(rows[q][1]) - np.array(v)) ** 2).sum()), i) for i, v in rows if i != q)[:10]})
        for q in range(0, 3000, 100)
    )
    assert hits >= 0.9 * 300
    sample = np.array([v for _, v in rows[:1000]])
    index = multi_index.MultiIndex.fit(sample, 64, 0.97, 10)
    assert index.share < 0.5


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(0)
    index = multi_index.MultiIndex(2, np.zeros((6, 1)), np.zeros((5, 1)), 1.0)
    for wanted in (1, 10, 40, 10_000):
        first, second, sizes = rng.random(6), rng.random(5), rng.integers(0, 5, (6, 5))
        got = index.traverse(first, second, sizes, wanted)
        order = sorted((first[i] + second[j], i, j) for i in range(6) for j in range(5))
        held, want = 0, set()
        for _, i, j in order:
            if held >= wanted:
                break
            want.add((i, j))
            held += sizes[i, j]
        assert set(zip(*map(np.ndarray.tolist, np.nonzero(got)))) == want


def test_stirling_numbers_and_tables():
    logs = pitman_yor.log_stirling(0.5, 5)
    # Seatings of 3 customers with discount 0.5: one table 0.5 * 1.5, two tables 0.5 + 1.
    assert np.allclose(np.exp(logs[3, 1:4]), [0.75, 1.5, 1.0])
    rng = np.random.default_rng(0)
    tables = pitman_yor.seat(np.full(20_000, 3), np.full(20_000, 2.0), 0.5, rng)
    weights = np.array([0.75 * 2, 1.5 * 4, 1.0 * 8])
    assert np.allclose(np.bincount(tables, minlength=4)[1:] / 20_000, weights / weights.sum(), atol=0.02)
    many = pitman_yor.seat(np.array([0, 1, 10_000_000]), np.array([1.0, 1.0, 5.0]), 0.8, rng)
    assert many[0] == 0 and many[1] == 1 and 1 < many[2] <= 10_000_000


@pytest.mark.parametrize("customers", [65, 1000, 1500])
@pytest.mark.parametrize(("discount", "opening"), [(0.8, 1.0), (0.8, 20.0), (0.5, 20.0), (0.3, 5000.0)])
def test_tables_of_large_dishes_follow_their_weights(customers, discount, opening):
    t = np.arange(1, customers + 1)
    exact = pitman_yor.log_stirling(discount, 1500)[customers, 1 : customers + 1]
    got = pitman_yor.log_seatings(np.full(customers, customers), t, discount) + math.lgamma(customers + 1)
    assert np.allclose(got, exact, rtol=0, atol=1e-5)
    weights = np.exp(exact + t * math.log(opening) - (exact + t * math.log(opening)).max())
    weights /= weights.sum()
    mean = (weights * t).sum()
    deviation = math.sqrt((weights * (t - mean) ** 2).sum())
    rng = np.random.default_rng(2)
    drawn = pitman_yor.seat(np.full(4000, customers), np.full(4000, opening), discount, rng)
    assert abs(drawn.mean() - mean) < 5 * deviation / math.sqrt(4000)
    assert abs(drawn.std() - deviation) < 0.1 * deviation


def expected(rows, learn):
    texts = {i: words_of(t) + [None] for i, t in rows}
    counts = Counter(w for i, _ in rows if learn(i) for w in texts[i])
    total = sum(counts.values())
    base = lambda w: math.log10((counts[w] + 1) / (total + len(counts) + 1))
    return {i: (len(t), sum(counts[w] > 0 for w in t), total, sum(map(base, t))) for i, t in texts.items()}


def test_scores_beat_the_unigram_model_on_held_out_texts(spark):
    rng = random.Random(5)
    after = {f"w{i}": [f"w{rng.randrange(200)}" for _ in range(4)] for i in range(200)}
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(200)}"]
        while len(words) < 80:
            words.append(rng.choice(after[words[-1]]))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    from pyspark.sql import functions as F

    got = pitman_yor.score_texts(docs, F.col("doc_id") % 5 != 0).collect()
    want = expected(rows, lambda i: i % 5 != 0)
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in got} == {i: w[:3] for i, w in want.items()}
    assert all(math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9) for r in got)
    held = [r for r in got if r.doc_id % 5 == 0]
    per_token = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert per_token > 0.5


def test_every_word_is_a_context_of_its_own(spark):
    """2,500 equally rare words that each determine the next: more contexts than any fixed number of restaurants."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    after = list(range(2500))
    rng.shuffle(after)
    texts = []
    for i in range(1000):
        words = [rng.randrange(2500)]
        while len(words) < 40:
            words.append(after[words[-1]])
        texts.append((i, " ".join(f"w{w}" for w in words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    held = pitman_yor.score_texts(docs, F.col("doc_id") % 5 != 0).filter("doc_id % 5 = 0").collect()
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 2.2


@pytest.mark.parametrize("bucket", [2_000_000, 120])
def test_chances_of_all_words_add_up_to_one(spark, tmp_path, monkeypatch, bucket):
    """Every context is asked for every word, in one bucket and in many, and answers with a distribution."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(pitman_yor, "BUCKET", bucket)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(18)]
    rows = [(True, " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(18)], k=rng.randrange(30)))) for _ in range(60)]
    every = [*vocabulary, "unknown"]
    rows += [(False, f"{a} {b}") for a in every for b in every] + [(False, x) for x in ("", *every)]
    spark.createDataFrame(rows, "learn boolean, text string").repartition(3).write.parquet(f"{tmp_path}/texts")
    block, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    docs = spark.read.parquet(f"{tmp_path}/texts").select("learn", "text", F.xxhash64(block).alias("block"), row.alias("row"))
    _, tokens = pitman_yor._sizes(docs)
    buckets = max(1, -(-tokens // bucket))
    kept = "bucket int, cells binary, words binary, blocks array<long>, parts array<long>, asked array<binary>"
    collected = pitman_yor._requests(docs, buckets).groupBy("bucket").applyInArrow(pitman_yor._collected, kept).checkpoint()
    parent = totals = None
    for _ in range(3):
        parent, totals = pitman_yor._seated(collected, parent, totals)
    assert parent.words == 19 and (buckets > 5) == (bucket == 120)
    of_words = totals.collect()
    whole = parent.chance(np.array([r["customers"] for r in of_words]), np.array([r["tables"] for r in of_words])).sum()
    assert math.isclose(whole + parent.chance(0, 0), 1, rel_tol=1e-12)
    asked = {(r.bucket, b, p): a for r in collected.collect() for b, p, a in zip(r.blocks, r.parts, r.asked)}
    chances = {}
    for r in pitman_yor._answers(collected, parent, totals).collect():
        request = pitman_yor.Asked.read(asked[r.bucket, r.block, r.part])
        logs = np.frombuffer(r.logs, "<f4").astype(float)
        for context, word, log in zip(np.repeat(request.contexts, request.entries).tolist(), request.word.tolist(), logs.tolist()):
            assert chances.setdefault((context, word), log) == log
    mass = Counter()
    for (context, _), log in chances.items():
        mass[context] += 10**log
    # 18 words, one that is unknown, the start; after each of them all words, the unknown one and the end.
    assert len(mass) == 20 and len(chances) == 20 * 20
    # Logs travel as floats of 32 bits.
    assert all(math.isclose(m, 1, rel_tol=2e-6) for m in mass.values())


def test_chances_equal_a_direct_computation():
    rng = np.random.default_rng(1)
    words = np.arange(30, dtype=np.uint64) * np.uint64(7)
    cells = [(c, w) for c in range(4) for w in range(30) if rng.random() < 0.5]
    context, word = (np.array(x) for x in zip(*cells))
    bucket = pitman_yor.Bucket(np.arange(4, dtype=np.uint64), context, word, rng.integers(1, 40, len(cells)))
    assert (pitman_yor.Bucket.read(pitman_yor.Bucket(bucket.contexts, context, words[word], bucket.count).pack(), words).word == word).all()
    parent = pitman_yor.Parent(90, 40, (0.7, 0.6), 30)
    customers, root_tables = np.full(30, 3), np.append(np.full(10, 2), np.ones(20))
    above = parent.chance(customers, root_tables)
    *_, tables = bucket.sweeps(above, 0.7, [1], 5)
    assert ((1 <= tables) & (tables <= bucket.count)).all()
    all_count, all_tables = bucket.totals(bucket.count), bucket.totals(tables)
    for c in range(4):
        count = {w: n for x, w, n in zip(context, word, bucket.count) if x == c}
        seated = {w: t for x, w, t in zip(context, word, tables) if x == c}
        total = 0.0
        for w in range(30):
            top = (3 - 0.6 * root_tables[w] + (1 + 0.6 * 40) / 31) / (1 + 90)
            direct = (count.get(w, 0) - 0.7 * seated.get(w, 0) + (1 + 0.7 * sum(seated.values())) * top) / (1 + sum(count.values()))
            got = pitman_yor.chance_in(0.7, count.get(w, 0), seated.get(w, 0), all_count[c], all_tables[c], above[w])
            assert math.isclose(got, direct, rel_tol=1e-12)
            total += direct
        unknown = (1 + 0.7 * sum(seated.values())) * ((1 + 0.6 * 40) / 31) / 91 / (1 + sum(count.values()))
        assert math.isclose(total + unknown, 1, rel_tol=1e-9)


def test_buckets_stay_where_they_are(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    spark.createDataFrame([(i, prose(i, 60)) for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    plans, answers = [], pitman_yor._answers

    def seen(*args):
        plans.append(answers(*args)._jdf.queryExecution().executedPlan().toString())
        return answers(*args)

    monkeypatch.setattr(pitman_yor, "_answers", seen)
    monkeypatch.setattr(pitman_yor, "BUCKET", 300)
    scored = pitman_yor.score_texts(spark.read.parquet(f"{tmp_path}/docs"), F.col("doc_id") % 5 != 0)
    assert scored.count() == 40
    moved = [line for line in plans[0].splitlines() if "Exchange hashpartitioning(bucket" in line]
    assert len(moved) == 1 and not [t for t in spark.catalog.listTables() if t.name.startswith("placed_")]


def test_requests_are_packed_small_and_read_back():
    rng = np.random.default_rng(2)
    words, contexts = (np.sort(rng.integers(0, 2**64, n, np.uint64)) for n in (5000, 2000))
    entries = rng.integers(1, 9, 2000)
    for widest in (3, 2**31, 2**40):
        asked = pitman_yor.Asked(contexts, entries, rng.choice(words, entries.sum()), rng.integers(0, widest, entries.sum()))
        back = pitman_yor.Asked.read(asked.pack())
        assert all((getattr(back, n) == getattr(asked, n)).all() for n in ("contexts", "entries", "word", "count"))
    none = pitman_yor.Asked(*[np.zeros(0, np.int64)] * 4)
    assert [len(x) for x in vars(pitman_yor.Asked.read(none.pack())).values()] == [0] * 4
    # Hashes in order, one after the other, take less than their eight bytes.
    assert len(pitman_yor.Asked(words, np.ones(5000), words, np.ones(5000)).pack()) < 7 * 2 * 5000


def test_blocks_hold_as_many_rows_as_their_tokens_allow(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(i, prose(i, 9)) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs, sizes, seated, scores = spark.read.parquet(f"{tmp_path}/docs"), [], [], []
    requests, seat = pitman_yor._requests, pitman_yor.seat

    def counted(*args):
        out = requests(*args)
        sizes.append(out.select("block").distinct().count())
        return out

    monkeypatch.setattr(pitman_yor, "_requests", counted)
    for block in (2_000_000, 10_000):
        monkeypatch.setattr(pitman_yor, "BLOCK", block)
        scores.append({r.doc_id: r.score for r in pitman_yor.score_texts(docs, F.col("doc_id") % 7 != 2).collect()})
    # A text has ten tokens.
    assert sizes == [1, 3] and len(scores[0]) == 3000
    assert all(math.isclose(s, scores[1][i], rel_tol=1e-6) for i, s in scores[0].items())

    def seen(customers, *args):
        seated.append(customers)
        return seat(customers, *args)

    monkeypatch.setattr(pitman_yor, "seat", seen)
    count = np.array([1, 5, 1, 2])
    bucket = pitman_yor.Bucket(np.arange(2, dtype=np.uint64), np.array([0, 0, 1, 1]), np.arange(4), count)
    for tables in bucket.sweeps(np.full(4, 0.2), 0.5, [1], 3):
        assert (tables[[0, 2]] == 1).all() and (tables <= count).all()
    assert [x.tolist() for x in seated] == [[5, 2]] * 3


def test_scores_of_hostile_documents(hostile, empty):
    from pyspark.sql import functions as F

    rows = [(r.doc_id, r.text) for r in hostile.collect()]
    got = pitman_yor.score_texts(hostile, F.col("doc_id") != 7).collect()
    want = expected([(i, t) for i, t in rows], lambda i: i not in (7, None))
    assert len(got) == len(rows)
    for row in got:
        assert row.n_tokens == want[row.doc_id][0] and row.n_known == want[row.doc_id][1]
        assert math.isfinite(row.score) and row.score < 0
    assert pitman_yor.score_texts(empty, F.lit(True)).collect() == []
    untaught = pitman_yor.score_texts(hostile, F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known) for r in untaught} == {(0, 0)}
