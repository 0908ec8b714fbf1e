"""The corpus pipeline against a Python version of every stage."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from aftershock.llm import poisson_mix, site_lines, toxicity
from aftershock.llm.word_ids import tokenizer_path
from tests.llm.conftest import changed, prose
from tests.llm.test_similar import brute_similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOUL = ["scumbag", "filthwit", "grubface"]


def corpus():
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(260):
        lines = [prose(i * 7 + j, 25, 10**6) for j in range(3)]
        if i % 6 == 0:
            lines.insert(1, "All rights reserved by the editors.")
        if i % 9 == 0:
            words = lines[2].split(" ")
            lines[2] = " ".join(w for pair in zip(words, rng.choices(FOUL, k=len(words))) for w in pair)
            labels.append((i, 1))
        elif i % 4 == 0:
            labels.append((i, 0))
        rows.append((i, "\n".join(lines), "en", f"src{min(i % 7, 2)}", 0))
    rows += [(1000 + i, changed(rows[20 + i][1], 60), "en", "src0", 0) for i in range(12)]
    rows += [(2000 + i, rows[50][1], "en", f"src{i}", 0) for i in range(4)]
    rows += [(3000, None, "en", "src1", None), (3001, "", "de", None, 0), (3002, " \n ", None, "src1", 3)]
    rows += [(None, prose(77, 40, 10**6), "en", "src2", 1), (None, None, None, None, None), (20, rows[20][1], "en", "src0", 0)]
    rows += [(3003, "z" * 40_000, "en", "src0", 40_000), (3004, prose(3, 9000, 10**6), "en", "src2", 1)]
    return rows, labels


def without_lines(rows):
    pages = {(r[3] or "", r[1]) for r in rows if r[1] is not None}
    totals = Counter(site for site, _ in pages)
    holders = Counter((site, line) for site, text in pages for line in set(text.split("\n")) if line.strip(" "))
    kept = []
    for i, text, lang, source, _ in rows:
        if text is not None:
            site, lines = source or "", text.split("\n")

            def common(line):
                long = len(line.strip(" ")) - len(line.replace(" ", "")) >= site_lines.LONG_WORDS - 1
                ratio = site_lines.LONG_RATIO if long else site_lines.MAX_RATIO
                return holders[site, line] >= site_lines.LEAST_HOLDERS and holders[site, line] > ratio * totals[site]

            stay = [x for x in lines if not common(x)]
            size = lambda some: sum(len(x) for x in some if x.strip(" "))
            if 2 * size(stay) >= size(lines):
                text = "\n".join(stay)
        kept.append((i, text, lang, source, None if text is None else len(text)))
    return kept


def mixed(rows):
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += len(row[1] or "")
    wanted = {s: n**poisson_mix.ALPHA if n else 0.0 for s, n in sizes.items()}
    found = []
    for row in rows:
        n = sizes[row[3]]
        rate = wanted[row[3]] / sum(wanted.values()) * sum(sizes.values()) / n if n else 1.0
        who = str(row[0]) if row[0] is not None else "~" + hashlib.md5((row[1] or "").encode()).hexdigest()
        assert rate <= poisson_mix.PART_MEAN
        u = int(hashlib.md5(f"{poisson_mix.SEED}:{who}:1".encode()).hexdigest()[:13], 16) / 2**52
        p = reached = math.exp(-rate)
        copies = 0
        while reached <= u:
            copies += 1
            p *= rate / copies
            reached += p
        found += [row] * copies
    return found


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_every_stage_equals_its_python_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_duplicates", "mix", "pack"]
    rows, labels = corpus()

    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = [model.scores(pa.array([r[1]], pa.string()))[0] for r in rows]
    expected = [r for r, s in zip(rows, scores) if s < corpus_pipeline.TOXIC]
    got = stages["toxicity"](spark, docs, folder).checkpoint()
    assert rows_of(got) == sorted(expected, key=repr)
    toxic = {i for i, t in labels if t}
    gone = {r[0] for r in rows} - {r[0] for r in expected}
    assert len(toxic & gone) >= 0.9 * len(toxic) and not gone - toxic - {r[0] for r in rows if r[0] and r[0] >= 1000}

    expected = without_lines(expected)
    got = stages["line_dedup"](spark, got, folder).checkpoint()
    assert rows_of(got) == sorted(expected, key=repr)
    assert not any("All rights reserved" in (r[1] or "") for r in expected if r[0] is not None and r[0] < 1000)

    sizes, label = brute_similar([(r[0], r[1]) for r in expected if r[0] is not None], 5, 80)
    expected = [r for r in expected if r[0] is None or label[r[0]] == r[0]]
    got = stages["near_duplicates"](spark, got, folder).checkpoint()
    assert rows_of(got) == sorted(expected, key=repr)
    assert not {2000, 2001, 2002, 2003} & {r[0] for r in expected}

    expected = mixed(expected)
    got = stages["mix"](spark, got, folder).checkpoint()
    assert rows_of(got) == sorted(expected, key=repr)

    library = Tokenizer.from_file(tokenizer_path())
    wanted = Counter((r[0], (*library.encode(r[1] or "", add_special_tokens=False).ids, 1)) for r in expected)
    pieces = stages["pack"](spark, got, folder).toPandas()
    texts, open_ = Counter(), {}
    for piece in pieces.sort_values(["sequence_id", "offset"]).itertuples():
        own = np.frombuffer(piece.ids, "<u4").tolist()
        key = None if piece.doc_id != piece.doc_id else int(piece.doc_id)
        held = open_.pop(key, []) if piece.start else []
        assert len(held) == piece.start
        if len(held) + len(own) == piece.doc_tokens:
            texts[key, (*held, *own)] += 1
        else:
            open_[key] = held + own
    assert not open_ and texts == wanted


def test_the_whole_run_and_what_it_leaves_behind(spark, folder):
    before = spark.read.parquet(f"{folder}/documents.parquet").count()
    packed = corpus_pipeline.run(spark, folder)
    assert packed.count() > 0 and packed.agg({"doc_tokens": "max"}).first()[0] > 10_000
    assert spark.read.parquet(f"{folder}/documents.parquet").count() == before
    shared = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    files = shared.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not [s for s in files.listStatus(shared) if s.getPath().getName().startswith("corpus-")]


def test_empty_documents_and_labels(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{folder}/documents.parquet").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
