from __future__ import annotations

import random

import pytest

from aftershock.llm import piece_counts
from aftershock.llm.word_ids import tokenizer_path
from tests.llm.conftest import prose

MODEL = tokenizer_path(piece_counts.MODEL)


def library(text):
    return len(piece_counts.encoder(MODEL).encode(text or ""))


def long_texts():
    rng = random.Random(3)
    letters = "abcdeé ßñ漢字\n\t  ᚠ😀<s></s>▁"
    yield prose(1, 3000)
    yield "a" * 5000  # no two chunks agree
    yield "ab " * 2000 + "a" * 3000 + " tail words here" * 50
    yield "漢字テキスト" * 500
    yield "😀" * 900
    yield " " * 4000
    yield "x" + "\n" * 3000
    for _ in range(25):
        yield "".join(rng.choice(letters) for _ in range(rng.randrange(200, 3000)))
    for _ in range(10):
        yield "".join(rng.choice(["the ", "th", "e", "ing", "tion ", "un", "0", "00", "̀"]) for _ in range(1200))


@pytest.mark.parametrize(("chunk", "overlap"), [(256, 16), (64, 8), (1000, 40)])
def test_counts_of_spliced_texts_are_those_of_the_library(spark, chunk, overlap):
    texts = list(long_texts())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counted = piece_counts.count_tokens(docs, MODEL, chunk=chunk, overlap=overlap, limit=700)
    for row in counted.collect():
        text = texts[row.doc_id]
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), library(text)), row.doc_id
        assert row.over_limit == (row.n_tokens > 700)
    assert counted.count() == len(texts)


def test_texts_without_common_boundary_are_widened(spark):
    texts = spark.createDataFrame([("same", "a" * 5000), ("words", prose(5, 900))], "digest string, text string")
    totals = piece_counts.spliced_totals(piece_counts.encode_chunks(texts, MODEL, 257, 16))
    assert {r.digest: r.proven for r in totals.collect()} == {"same": False, "words": True}
    got = {r.digest: r.n_tokens for r in piece_counts.count_long(texts, MODEL, 257, 16).collect()}
    assert got == {"same": library("a" * 5000), "words": library(prose(5, 900))}


def test_counts_of_hostile_rows(hostile, empty):
    counted = piece_counts.count_tokens(hostile, MODEL, chunk=4096, overlap=64)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counted.collect())
    rows = hostile.select("doc_id", "text").collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()), library(r.text)) for r in rows)
    assert got == want
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert piece_counts.count_tokens(empty, MODEL).count() == 0


def test_the_query_on_the_given_table(spark):
    from aftershock.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op12_resync_counts"](spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        n = library(row.text)
        assert got.pop(row.doc_id) == (len((row.text or "").encode()), n, n > 4096)
    assert not got
