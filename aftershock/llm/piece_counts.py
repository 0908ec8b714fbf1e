"""Token counts of texts, huge ones by overlapping chunks that are spliced where their tokens agree."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.llm.shared import small_batches, stored

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
# Bytes of a chunk, and by how many it reaches over each of its two cuts.
CHUNK = 1 << 15
OVERLAP = 128
# Where some cut of a text has no common boundary, overlaps (and chunks, if need be) grow by this.
WIDER = 8
# Bytes that the library encodes at once; its ids take some twenty times that.
SLICE = 1 << 20
BOUNDARIES = "array<struct<cut: int, at: long, before: int, after: int, rank: long>>"
CHUNKS = f"digest string, chunk int, chunks int, n long, heads {BOUNDARIES}, tails {BOUNDARIES}"
BOUNDARY_TYPE = pa.struct(
    [("cut", pa.int32()), ("at", pa.int64()), ("before", pa.int32()), ("after", pa.int32()), ("rank", pa.int64())]
)


@lru_cache(maxsize=1)
def encoder(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def splits(path: str) -> bool:
    """Whether chunks of a text can be spliced: byte-pair merges over the text as it stands."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    plain = {model.SentencePiece.NORMAL, model.SentencePiece.BYTE, model.SentencePiece.CONTROL, model.SentencePiece.UNKNOWN}
    normal = model.normalizer_spec
    return (
        model.trainer_spec.model_type == model.trainer_spec.BPE
        and not model.trainer_spec.treat_whitespace_as_suffix
        and not normal.precompiled_charsmap
        and not normal.remove_extra_whitespaces
        and {p.type for p in model.pieces} <= plain
    )


def tokens_of(path: str, texts: list[str]) -> np.ndarray:
    """Tokens of each text, a few texts at a time."""
    library, counts, some, size = encoder(path), [], [], 0
    for i, text in enumerate(texts):
        some.append(text)
        size += len(text)
        if size >= SLICE or i == len(texts) - 1:
            counts.extend(map(len, library.encode(some, num_threads=1)))
            some, size = [], 0
    return np.array(counts, np.int64)


def boundaries(pieces, low: int, high: int, first: int, cut: int) -> list[dict]:
    """Where a token ends and another begins, strictly between two byte offsets of the text.

    ``first`` is the offset of the chunk; ``rank`` counts its tokens before the boundary. Tokens of
    no bytes (all but the last of those that spell out a character) make no boundary.
    """
    at, end = 0, len(pieces)
    while at < end:  # the first token that ends after ``low``
        middle = (at + end) // 2
        at, end = (middle + 1, end) if pieces[middle].end + first <= low else (at, middle)
    found = []
    for i in range(at, len(pieces) - 1):
        left, right = pieces[i], pieces[i + 1]
        if left.end + first >= high:
            break
        if left.begin < left.end == right.begin < right.end:
            found.append({"cut": cut, "at": left.end + first, "before": left.id, "after": right.id, "rank": i + 1})
    return found


def whole_characters(raw: bytes) -> tuple[int, str]:
    """The chunk without the parts of characters at its ends, and the bytes left out at its beginning."""
    skipped = 0
    while skipped < min(3, len(raw)) and raw[skipped] & 0xC0 == 0x80:
        skipped += 1
    return skipped, raw[skipped:].decode("utf-8", "ignore")


def count_tokens(
    docs: DataFrame,
    model: str,
    limit: int = LIMIT,
    key: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """The tokens of every whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``).

    Counts are those of sentencepiece for the whole text, without begin and end tokens. Texts of
    up to ``chunk`` bytes are encoded as they are. Longer ones are cut every ``chunk`` bytes; a
    chunk reaches ``overlap`` bytes over its cuts, is encoded with offsets wherever Spark puts it,
    and is spliced with the next one at a boundary of both.

    A boundary is proven if both chunks have the same token before it and the same after it. Greedy
    byte-pair merging never crosses such a place: two neighbouring tokens of an encoding are
    what merging makes of their two strings alone, whatever stands around them, and a sequence
    of which every two neighbours have that property is the encoding of its text. The spliced
    sequence consists of neighbours that some chunk has. Where a cut has no such boundary, the
    text is encoded anew with overlaps ``WIDER`` times as wide, in the end as one chunk. Models
    that merge otherwise, or change the text first, encode whole texts.

    A NULL or empty text has no bytes and no tokens. Rows that repeat an id or have none are rows
    of their own. Copies of a long text are encoded once. No row gives no row; other columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    size = F.octet_length("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(tokens_of(model, batch.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["doc_id", "n_bytes", "n_tokens"])

    sized = rows.select("doc_id", size.cast("long").alias("n_bytes"), "text")
    if splits(model):
        short = sized.filter(size <= chunk).mapInArrow(encode, "doc_id long, n_bytes long, n_tokens long")
        long = sized.filter(size > chunk).withColumn("digest", F.sha2("text", 256))
        counts = count_long(long.select("digest", "text"), model, chunk, overlap)
        spliced = long.drop("text").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
        counted = short.unionByName(spliced)
    else:
        counted = sized.mapInArrow(encode, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def count_long(texts: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """Rows (digest, n_tokens) for the distinct texts of rows (digest, text)."""
    done: DataFrame | None = None
    while True:
        chunks = stored(encode_chunks(texts, model, chunk, overlap))
        totals = spliced_totals(chunks)
        done = _with(done, totals.filter("proven").select("digest", "n_tokens"))
        failed = totals.filter("NOT proven").select("digest")
        if failed.isEmpty():
            return done
        texts = texts.join(failed, "digest", "left_semi")
        overlap *= WIDER
        chunk = max(chunk, 4 * overlap)


def _with(done: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if done is None else done.unionByName(more)


def cut_column(text: Column, chunk: int, overlap: int) -> Column:
    """All chunks of a text as an array of (offset, bytes)."""
    raw = text.cast("binary")
    last = F.greatest(F.lit(0), F.floor((F.octet_length(text) - 1) / chunk)).cast("int")

    def one(i: Column) -> Column:
        start = F.greatest(F.lit(0), i * chunk - overlap)
        return F.struct(
            start.cast("long").alias("first"),
            F.substring(raw, start + 1, (i + 1) * chunk + overlap - start).alias("raw"),
        )

    return F.transform(F.sequence(F.lit(0), last), one)


def encode_chunks(texts: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """A row per chunk of the distinct texts: its tokens, and the boundaries around the cuts before and after it."""
    cuts = texts.select("digest", cut_column(F.col("text"), chunk, overlap).alias("cuts"))
    rows = cuts.select("digest", F.size("cuts").alias("chunks"), F.posexplode("cuts").alias("chunk", "cut"))
    rows = rows.select("digest", "chunk", "chunks", "cut.first", "cut.raw")
    # Deals the chunks of a text out to all tasks, and leaves one of equal chunks.
    rows = rows.groupBy("digest", "chunk").agg(*[F.first(c).alias(c) for c in ("chunks", "first", "raw")])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(model)
        for batch in batches:
            for row in range(batch.num_rows):
                digest, k, of, first, raw = (batch.column(c)[row].as_py() for c in range(5))
                skipped, text = whole_characters(raw)
                pieces = library.encode(text, return_type="proto").pieces
                begin = first + skipped
                heads = boundaries(pieces, k * chunk - overlap, k * chunk + overlap, begin, k) if k else []
                cut = (k + 1) * chunk
                tails = boundaries(pieces, cut - overlap, cut + overlap, begin, k + 1) if k + 1 < of else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([digest]),
                        pa.array([k], pa.int32()),
                        pa.array([of], pa.int32()),
                        pa.array([len(pieces)], pa.int64()),
                        pa.array([heads], pa.list_(BOUNDARY_TYPE)),
                        pa.array([tails], pa.list_(BOUNDARY_TYPE)),
                    ],
                    ["digest", "chunk", "chunks", "n", "heads", "tails"],
                )

    return rows.mapInArrow(encode, CHUNKS)


def spliced_totals(chunks: DataFrame) -> DataFrame:
    """Rows (digest, n_tokens, proven): the first proven boundary of each cut drops what stands on its far sides."""
    same = ["digest", "cut", "at", "before", "after"]
    tails = chunks.select("digest", "n", F.inline("tails"))
    tails = tails.select(*same, (F.col("n") - F.col("rank")).alias("beyond"))
    heads = chunks.select("digest", F.inline("heads")).withColumnRenamed("rank", "ahead")
    common = tails.join(heads, same)
    chosen = common.groupBy("digest", "cut").agg(F.min_by(F.col("beyond") + F.col("ahead"), "at").alias("twice"))
    spliced = chosen.groupBy("digest").agg(F.count(F.lit(1)).alias("cuts"), F.sum("twice").alias("twice"))
    totals = chunks.groupBy("digest").agg(F.sum("n").alias("n"), F.max("chunks").alias("chunks"))
    both = totals.join(spliced, "digest", "left")
    return both.select(
        "digest",
        (F.col("n") - F.coalesce("twice", F.lit(0))).alias("n_tokens"),
        (F.coalesce("cuts", F.lit(0)) == F.col("chunks") - 1).alias("proven"),
    )
