from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aftershock.llm import byte_words, huffman_ids, packing, word_ids
from tests.llm.conftest import prose

TOKENIZER = word_ids.tokenizer_path()
WORDS = word_ids.word_ids(TOKENIZER)
TEXTS = [None, "", " ", "\n\n", "It's <|endoftext|> x <|ENDOFTEXT|>", "ΣΊΣΥΦΟΣ İ", "é Å.", "a\tb\x1cc", "!!!!!!!!! a!!!!!!!!!"]


def library(text):
    return WORDS.tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"])) | st.text(" \n.a'é<|>'sßÀ3"), max_size=6))
def test_ids_are_those_of_the_library(texts):
    column = pa.array([*texts, *TEXTS], pa.string())
    ids, limits, _ = WORDS.encode(column)
    for i, text in enumerate(column.to_pylist()):
        assert ids[limits[i] : limits[i + 1]].tolist() == library(text)


def test_long_texts_are_cut_at_spaces_only(monkeypatch):
    texts = [prose(1, 500), "", "y" * 300, prose(2, 30)]
    monkeypatch.setattr(word_ids, "slices", lambda d, l, s: byte_words.slices(d, l, s, 64))
    ids, limits, _ = WORDS.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(limits, limits[1:])] == [library(t) for t in texts]


def brute_cost(places, costs, window):
    best = [0] + [10**9] * (len(places) - 1)
    for i in range(1, len(places)):
        for j in range(i):
            size = places[i] - places[j]
            exact = size & (size - 1) == 0 and 8 * size >= window
            if size <= window:
                pad = 0 if exact else window - size
                best[i] = min(best[i], best[j] + pad + costs[i] + packing.OPENING)
    return best[-1]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(300):
        window = int(rng.choice([4, 8, 16, 13]))
        places = np.cumsum(np.append([0], rng.integers(1, window + 1, rng.integers(1, 25))))
        costs = np.append([0], rng.integers(0, 6, len(places) - 1))
        cuts = [0, *packing.best_cuts(places, costs, window)]
        cost = 0
        for a, b in zip(cuts, cuts[1:]):
            size = int(places[b] - places[a])
            exact = size & (size - 1) == 0 and 8 * size >= window
            cost += (0 if exact else window - size) + costs[b] + packing.OPENING
        assert cost == brute_cost(places.tolist(), costs.tolist(), window)


@pytest.mark.parametrize("window", [16, 2048])
def test_pieces_cover_every_document_once(spark, hostile, window):
    pieces = [r.asDict() for r in packing.pack(hostile, TOKENIZER, window).collect()]
    want = sorted(((r.doc_id is None, r.doc_id or 0), library(r.text) + [1]) for r in hostile.collect())
    docs, open_docs = [], {}
    for piece in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        ids = np.frombuffer(piece["ids"], "<u4").tolist()
        held = open_docs.setdefault(piece["doc_id"], [])
        assert piece["start"] == len(held)
        held += ids
        if len(held) == piece["doc_tokens"]:
            docs.append(((piece["doc_id"] is None, piece["doc_id"] or 0), open_docs.pop(piece["doc_id"])))
    assert not open_docs and sorted(docs) == want
    sequences = {}
    for piece in pieces:
        sequences.setdefault(piece["sequence_id"], []).append((piece["offset"], len(piece["ids"]) // 4, piece["padded"]))
    for held in sequences.values():
        size = 0
        for offset, length, padded in sorted(held):
            assert offset == size
            size += length
        assert size <= padded <= window and (padded == window or size & (size - 1) == 0)


def test_packing_keeps_the_order_of_rows_and_pads_little(spark):
    docs = spark.createDataFrame([(i, prose(i, 20 + 37 * i % 900)) for i in range(400)], "doc_id long, text string").coalesce(1)
    pieces = packing.pack(docs, TOKENIZER).orderBy("sequence_id", "offset").collect()
    assert [p.doc_id for p in pieces] == sorted(p.doc_id for p in pieces)
    padded = {p.sequence_id: p.padded for p in pieces}
    tokens = sum(len(p.ids) // 4 for p in pieces)
    assert sum(padded.values()) - tokens < 0.03 * tokens


def test_packing_of_nothing(empty):
    assert packing.pack(empty, TOKENIZER).collect() == []


def test_code_lengths_are_optimal_and_limited():
    assert huffman_ids.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]
    lengths = huffman_ids.code_lengths(np.array([5, 9, 12, 13, 16, 45]))
    assert lengths.tolist() == [4, 4, 3, 3, 3, 1]
    limited = huffman_ids.code_lengths(np.array([2**i for i in range(40)]))
    assert limited.max() == 16 and sum(2.0 ** -int(x) for x in limited) == 1
    with pytest.raises(ValueError):
        huffman_ids.code_lengths(np.ones(5, int), longest=2)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=2000), st.integers(1, 300))
def test_blocks_decode_to_what_was_encoded(ids, step):
    ids = np.array(ids, np.int64)
    code = huffman_ids.Code(huffman_ids.code_lengths(np.bincount(ids, minlength=1)))
    _, checkpoints, payload = code.encode(ids, step)
    assert code.decode(payload, checkpoints, len(ids), step).tolist() == ids.tolist()


def test_files_hold_all_documents_in_order(spark, hostile, tmp_path):
    huffman_ids.write_ids(hostile, f"{tmp_path}/ids", TOKENIZER)
    read = huffman_ids.read_ids(spark, f"{tmp_path}/ids").orderBy("start").collect()
    assert [(r.doc_id is not None, r.doc_id) for r in read] == sorted((r.doc_id is not None, r.doc_id) for r in read)
    want = sorted((r.doc_id or 0, zlib.crc32(np.array(library(r.text) + [2], "<u4").tobytes())) for r in hostile.collect())
    assert sorted((r.doc_id or 0, zlib.crc32(r.ids)) for r in read) == want
    start = 0
    for row in read:
        assert row.start == start
        start += len(row.ids) // 4


def test_files_of_nothing(spark, empty, tmp_path):
    huffman_ids.write_ids(empty, f"{tmp_path}/none", TOKENIZER)
    assert huffman_ids.read_ids(spark, f"{tmp_path}/none").collect() == []


def test_known_words_are_found_again_whatever_their_places():
    rng = np.random.default_rng(1)
    known = word_ids.KnownWords()
    known.places = 8
    known.hashes, known.looks, known.numbers = np.zeros(8, np.uint64), np.zeros((3, 8), np.uint64), np.zeros(8, np.int64)
    hashes = rng.permutation(np.arange(1, 1001).astype(np.uint64) * np.uint64(8))  # all ask for the same places at first
    looks = rng.integers(0, 9, (3, 1000)).astype(np.uint64)
    for at in range(0, 1000, 100):
        some = slice(at, at + 100)
        assert (known.find(hashes[some], looks[:, some]) == known.ABSENT).all()
        known.add(hashes[some], looks[:, some], np.arange(at, at + 100))
        assert (known.find(hashes[: at + 100], looks[:, : at + 100]) == np.arange(at + 100)).all()
    assert known.size == 1000 and 4 * known.size <= 3 * known.places
    assert (known.find(hashes, looks + np.uint64(1)) == known.OTHER).all()


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(word_ids, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    fresh = word_ids.WordIds(TOKENIZER)
    for _ in range(2):
        for text in ("one two six", "ten", "six two one, ten"):
            ids, _, _ = fresh.encode(pa.array([text]))
            assert ids.tolist() == library(text)
