"""Token ids in binary files: canonical length-limited Huffman codes in independent blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aftershock.llm.shared import small_batches, stored
from aftershock.llm.word_ids import word_ids

END_ID = 2
# Longest code in bits: two bytes, so a table of 2**16 entries decodes any code in one step.
LONGEST = 16
# Ids after which a block is closed at the next document's end.
BLOCK = 1 << 16
# Ids between two checkpoints of a block.
STEP = 256
STAGED = "part int, block long, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, ids binary"
BLOCKS = STAGED.removesuffix("ids binary") + "bits long, checkpoints array<long>, payload binary"
READ = "doc_id long, start long, ids binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits of each symbol's code (0 for a count of 0), of least total under the limit (package-merge)."""
    symbols = np.flatnonzero(counts)
    if len(symbols) > 2**longest:
        raise ValueError(f"{len(symbols)} symbols do not fit codes of {longest} bits")
    lengths = np.zeros(len(counts), np.uint8)
    if len(symbols) < 2:
        lengths[symbols] = 1
        return lengths
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    weights = counts[order].astype(np.float64 if counts.sum() >= 2**62 else np.int64)
    levels, row = [], np.zeros(0, weights.dtype)
    for _ in range(longest):
        merged = np.concatenate([weights, row])
        sort = np.argsort(merged, kind="stable")
        merged = merged[sort]
        levels.append(sort < len(weights))
        pairs = len(merged) // 2
        row = merged[: 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
    taken = 2 * len(order) - 2
    for own in levels[::-1]:
        singles = int(own[:taken].sum())
        lengths[order[:singles]] += 1
        taken = 2 * (taken - singles)
    return lengths


@dataclass(frozen=True)
class Code:
    """The canonical code of given lengths: codes rise with length, then with the symbol."""

    lengths: np.ndarray

    @cached_property
    def symbols(self) -> np.ndarray:
        used = np.flatnonzero(self.lengths)
        return used[np.argsort(self.lengths[used], kind="stable")]

    @cached_property
    def codes(self) -> np.ndarray:
        codes = np.zeros(len(self.lengths), np.uint64)
        sizes = self.lengths[self.symbols].astype(np.int64)
        # Each code is the sum of the shares of the codes before it.
        shares = np.int64(1) << (LONGEST - sizes)
        codes[self.symbols] = (np.cumsum(shares) - shares) >> (LONGEST - sizes)
        return codes

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length by the next 16 bits."""
        sizes = self.lengths[self.symbols].astype(np.int64)
        repeats = np.int64(1) << (LONGEST - sizes)
        symbols, lengths = np.zeros(2**LONGEST, np.uint32), np.ones(2**LONGEST, np.int64)
        total = int(repeats.sum())
        symbols[:total], lengths[:total] = np.repeat(self.symbols, repeats), np.repeat(sizes, repeats)
        return symbols, lengths

    def encode(self, ids: np.ndarray, step: int = STEP) -> tuple[int, np.ndarray, bytes]:
        """Bits, bit offsets of every ``step``-th id, and the bytes (32-bit big-endian words)."""
        if not len(ids):
            return 0, np.zeros(0, np.int64), b""
        sizes = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word = starts >> 5
        shifted = self.codes[ids] << (64 - (starts & 31) - sizes).astype(np.uint64)
        # Codes are shorter than a word, so some code begins in every word.
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(int(word[-1]) + 2, np.uint64)
        words[:-1] = np.add.reduceat(shifted >> np.uint64(32), first)
        words[1:] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        return int(ends[-1]), starts[::step], words.astype(">u4").tobytes()

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int, step: int = STEP) -> np.ndarray:
        """All ids; the stretches between checkpoints are decoded side by side."""
        if not n:
            return np.zeros(0, np.uint32)
        symbols, lengths = self.table
        words = np.frombuffer(payload, ">u4").astype(np.uint64)
        words = np.concatenate([words, np.zeros(2, np.uint64)])
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((step, len(at)), np.uint32)
        limit = (len(words) - 2) * 32
        for i in range(step):
            at = np.minimum(at, limit)
            peek = (pairs[at >> 5] >> (48 - (at & 31)).astype(np.uint64)) & np.uint64(0xFFFF)
            out[i] = symbols[peek]
            at = at + lengths[peek]
        return out.T.ravel()[:n]


def _width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 2**16 else "<u4"


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text"
) -> None:
    """Write the ids of all documents, each ended by ``end_id``, in ascending order of their keys.

    ``path/code`` has a row (id, bits) per id that occurs, ``path/blocks`` the coded blocks in
    order. A block holds whole documents, at least ``BLOCK`` ids but for the last of its part;
    its row has the ids and sizes of the documents, the bit offset of every ``STEP``-th id and
    the code words. A part is a range of keys, written by one task; a block's ``start`` counts
    the ids of its part before it.

    Texts are tokenized once, after they have been dealt out by ranges of keys. Repeated keys
    are ordered by a hash of their texts, which also spreads a key that owns many rows. A NULL
    key comes first; a NULL or empty text is the end id alone; no document gives empty tables.
    What comes to the driver has at most a row per id of the vocabulary.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = max(word_ids(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
    kind = "<u2" if vocabulary <= 2**16 else "<u4"

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer), np.array([end_id], kind)
        part, block, start, size = TaskContext.get().partitionId(), 0, 0, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            packed = pa.compress(np.concatenate(held).tobytes(), codec="zstd", asbytes=True)
            row = [part, block, start, size, keys, [len(x) for x in held], packed]
            return _row(STAGED_TYPES, row)

        for batch in batches:
            ids, limits, _ = words.encode(batch.column(1))
            ids, limits = ids.astype(kind), limits.tolist()
            for doc_id, a, b in zip(batch.column(0).to_pylist(), limits, limits[1:]):
                keys.append(doc_id)
                held.append(np.concatenate([ids[a:b], end]))
                size += b - a + 1
                if size >= BLOCK:
                    yield close()
                    block, start, size, keys, held = block + 1, start + size, 0, [], []
        if held:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = (F.col("doc_id"), F.xxhash64("text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # A checkpoint keeps the partitions and so the order of the blocks.
    staged = stored(ranged.mapInArrow(tokenize, STAGED))

    def unpacked(batch: pa.RecordBatch, i: int) -> np.ndarray:
        size = batch.column("n_tokens")[i].as_py() * np.dtype(kind).itemsize
        return np.frombuffer(pa.decompress(batch.column("ids")[i].as_buffer(), size, codec="zstd"), kind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total += np.bincount(unpacked(batch, i), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    sums = staged.select("n_tokens", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for row in sums.collect():
        counts[row.id] = row.n
    code = Code(code_lengths(counts))
    used = [(int(i), int(code.lengths[i])) for i in np.flatnonzero(code.lengths)]
    spark.createDataFrame(used, "id long, bits int").coalesce(1).write.parquet(f"{path}/code")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bits, checkpoints, payload = code.encode(unpacked(batch, i))
                row = [batch.column(c)[i].as_py() for c in range(6)]
                yield _row(BLOCK_TYPES, [*row, bits, checkpoints, payload])

    staged.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of :func:`write_ids`: doc_id, start (ids of all documents before it) and ids (32-bit, binary).

    Blocks are decoded independently of each other; sums over one row per part place them.
    """
    code_rows = spark.read.parquet(f"{path}/code").collect()  # at most one row per id of the vocabulary
    lengths = np.zeros(max([0, *(r.id for r in code_rows)]) + 1, np.uint8)
    for row in code_rows:
        lengths[row.id] = row.bits
    code = Code(lengths)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    placed = blocks.join(parts.select("part", before.alias("before")), "part")
    placed = placed.select((F.col("before") + F.col("start")).alias("start"), *BLOCK_TYPES.names[3:])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, n, keys, sizes, _, checkpoints, payload = (batch.column(c)[i] for c in range(7))
                places = checkpoints.values.to_numpy()
                ids = code.decode(payload.as_buffer(), places, n.as_py()).astype("<u4").tobytes()
                limits = np.cumsum([0, *sizes.as_py()])
                texts = [ids[4 * a : 4 * b] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]
                columns = [keys.values, pa.array(limits[:-1] + start.as_py()), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])

    return placed.mapInArrow(decode, READ)


STAGED_TYPES = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int64()),
        ("start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
        ("ids", pa.binary()),
    ]
)
BLOCK_TYPES = pa.schema(
    [
        *list(STAGED_TYPES)[:-1],
        ("bits", pa.int64()),
        ("checkpoints", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def _row(types: pa.Schema, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, types)], schema=types)
