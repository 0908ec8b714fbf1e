"""Spelling variants: words one edit away from a much more frequent word, by a bit-sliced position index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.llm.shared import stored

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# How many times as frequent a form is at least.
RATIO = 10
# Words of a unit of work on either side; larger groups are compared block by block.
BLOCK = 8192
# Words indexed together, where units are small.
SLAB = 1024
# Machine words of a table of bits that are worked on at once.
TOGETHER = 1 << 18
UNIT = ["size", "side", "affix", "indexed_block", "asked_block"]
FOUND = "word string, near long, best_n long, best string"


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, run): maximal runs of letters, with A-Z in lower case. A NULL text has none."""
    lowered = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    found = F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))
    return docs.select(F.col(key).alias("doc_id"), F.explode(found).alias("run"))


def vocabulary(words: DataFrame, word: str = "word", least_size: int = 7, least_n: int = 2) -> DataFrame:
    """Rows (word, n): the distinct words of at least ``least_size`` code points and ``least_n`` occurrences."""
    counted = words.filter(F.length(word) >= least_size).groupBy(F.col(word).alias("word"))
    return counted.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def group_variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for the distinct words of rows (word, n).

    Words are near if they differ by one inserted, deleted or replaced code point; ``n_near``
    counts the near words. The form is the most frequent of them (ties: the first in order of
    code points) if it is at least ``ratio`` times as frequent as the word, else NULL. The root is where
    following forms ends, the word itself if it has none.

    Of two near words, either the first or the last half of the shorter one's letters is the same in both:
    words meet in the groups of those halves. A group larger than ``block`` is compared
    block against block, so no task holds more than two blocks at a time; nothing is left out.
    A word has one row, as :func:`vocabulary` gives it; NULL takes no part; no word gives no row.
    """
    words = stored(words.filter("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    near = _units(words, block).mapInArrow(_compare, FOUND).groupBy("word")
    near = near.agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("rank"), "best")).alias("most")
    )
    all_words = words.join(near, "word", "left")
    is_form = -F.col("most.rank") >= ratio * F.col("n")
    formed = stored(
        all_words.select(
            "word",
            F.when(is_form, F.col("most.best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, -F.col("most.rank")).alias("form_n"),
        )
    )
    links = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = formed.agg(F.max("n")).first()[0] or 0
    roots = formed.join(_ends(links, _longest_chain(most, ratio)), "word", "left")
    return roots.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _longest_chain(most: int, ratio: int) -> int:
    """Forms that can follow each other when counts grow ``ratio`` times with each."""
    steps, n = 0, ratio
    while n <= most:
        steps, n = steps + 1, n * max(2, ratio)
    return steps


def _ends(links: DataFrame, longest: int) -> DataFrame:
    """Where following ``links`` (word, root) ends; each step doubles the distance covered."""
    reach = 1
    while reach < longest:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = links.join(further, "root", "left")
        links = stored(moved.select("word", F.coalesce("further", "root").alias("root")))
        reach *= 2
    return links


def _units(words: DataFrame, block: int) -> DataFrame:
    """The words in all groups they belong to, by blocks, a unit of work after the other within partitions.

    A group holds the words of ``size`` and of one code point more that share half of ``size`` letters.
    """
    size = F.length("word")
    sizes = F.explode(F.array(size, size - 1)).alias("size")
    sided = words.select("word", "n", sizes).select("*", F.explode(F.array(F.lit("first"), F.lit("last"))).alias("side"))
    half = F.floor(F.col("size") / 2).cast("int")
    affix = F.when(F.col("side") == "first", F.substring("word", F.lit(1), half)).otherwise(F.expr("right(word, size div 2)"))
    members = sided.withColumn("affix", affix)
    group = ["size", "side", "affix"]
    large = members.groupBy(*group).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > block)
    large = large.select(*group, F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    members = members.join(large, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    every, own = F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")

    def place(indexed_block, asked_block, indexed, asked):
        return F.struct(
            indexed_block.alias("indexed_block"), asked_block.alias("asked_block"), indexed.alias("indexed"), asked.alias("asked")
        )

    yes, no = F.lit(True), F.lit(False)
    asking = F.transform(every, lambda k: place(k, own, k == own, yes))
    indexed = F.transform(F.filter(every, lambda k: k != own), lambda k: place(own, k, yes, no))
    rows = members.select("word", "n", *group, F.explode(F.concat(asking, indexed)).alias("place"))
    rows = rows.select(*group, "place.*", "word", "n").repartition(*UNIT)
    # Within a unit the first word of a set of bits is the most frequent one.
    return rows.sortWithinPartitions(*UNIT, F.desc("n"), "word")


@dataclass(frozen=True)
class PositionIndex:
    """Bits of words: ``at[p][i]`` has those with ``letters[i]`` at position p; letter 0 stands after
    their ends, and the last row, of no word, is for letters that occur in none."""

    letters: np.ndarray
    at: list[np.ndarray]
    width: int

    @classmethod
    def of(cls, codes: np.ndarray) -> PositionIndex:
        letters = np.unique(np.append(codes, 0))
        none = np.zeros((1, len(codes)), bool)
        at = [_bits(np.vstack([codes[:, p] == letters[:, None], none])) for p in range(codes.shape[1])]
        return cls(letters, at, at[0].shape[1])

    def near(self, codes: np.ndarray, members: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each asked word, which of its ``members`` differ by one replaced, deleted or inserted letter.

        All indexed words are followed at once through the asked word: those without an error so
        far, and those with one error of each kind, whose letters stand level, one before or
        one after. Also returns the members that share as many first letters as ``halves`` says.
        """
        numbers = np.searchsorted(self.letters, codes)
        known = numbers < len(self.letters)
        known &= self.letters[np.minimum(numbers, len(self.letters) - 1)] == codes
        tables = self.at
        numbers[~known] = len(self.letters)
        exact = members.copy()
        replaced, deleted, inserted, begun = (np.zeros_like(members) for _ in range(4))
        for p in range(codes.shape[1] - 1):
            letter = numbers[:, p]
            here = halves == p
            begun[here] = exact[here]
            same, after = tables[p][letter], tables[p + 1][letter]
            running = exact & ~tables[p][0]
            live = np.where(codes[:, p] != 0, ~np.uint64(0), np.uint64(0))[:, None]
            replaced = (replaced & same) | (running & ~same & live)
            deleted = (deleted & tables[p - 1][letter] if p else deleted) | (exact & live)
            inserted = (inserted | running) & after
            exact &= same
        return replaced, deleted, inserted, begun


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words, the first flag in the lowest bit."""
    rows, n = flags.shape
    padded = np.zeros((rows, -(-n // 64) * 8), np.uint8)
    packed = np.packbits(flags, axis=1, bitorder="little")
    padded[:, : packed.shape[1]] = packed
    return padded.view("<u8")


def _codes(words: list[str], extra: int = 2) -> np.ndarray:
    """Code points of words as rows, 0 after their ends."""
    sizes = np.array([len(w) for w in words])
    codes = np.zeros((len(words), int(sizes.max()) + extra), np.uint32)
    inside = np.arange(codes.shape[1]) < sizes[:, None]
    codes[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of near words and the most frequent of them, for words that have any in a unit."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*held, batch])
        if not table.num_rows:
            continue
        unit = _unit_numbers(table)
        # The last unit may go on in the next batch.
        whole = int(np.searchsorted(unit, unit[-1]))
        yield from _slabs(table.slice(0, whole), unit[:whole])
        held = table.slice(whole).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield from _slabs(table, _unit_numbers(table))


def _slabs(table: pa.Table, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Units of more than a word, some together."""
    company = np.bincount(unit)[unit] > 1
    table, unit = table.filter(pa.array(company)), unit[company]
    start = 0
    while start < len(unit):
        end = min(start + SLAB, len(unit))
        end = int(np.searchsorted(unit, unit[end - 1], side="right"))
        yield from _slab(table.slice(start, end - start), unit[start:end])
        start = end


def _unit_numbers(table: pa.Table) -> np.ndarray:
    """Rising numbers of the units of sorted rows."""
    new = np.zeros(table.num_rows, bool)
    for name in UNIT:
        column = table.column(name).combine_chunks()
        new[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False), bool)
    return np.cumsum(new)


def _slab(table: pa.Table, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
    words = table.column("word").to_pylist()
    n = table.column("n").to_numpy()
    size = table.column("size").to_numpy()
    last = np.array(table.column("side").to_pylist()) == "last"
    indexed = np.flatnonzero(table.column("indexed").to_numpy())
    asked = np.flatnonzero(table.column("asked").to_numpy())
    if not len(indexed) or not len(asked):
        return
    codes = _codes(words)
    lengths = np.array([len(w) for w in words])
    index = PositionIndex.of(codes[indexed])
    step = max(1, TOGETHER // index.width)
    for at in range(0, len(asked), step):
        some = asked[at : at + step]
        members = _bits(unit[some][:, None] == unit[indexed])
        replaced, deleted, inserted, begun = index.near(codes[some], members, size[some] // 2)
        longer = (lengths[some] > size[some])[:, None]
        near = np.where(longer, deleted, replaced | inserted)
        # Pairs that share the first half as well have met in its group.
        near &= np.where(last[some][:, None], ~begun, ~np.uint64(0))
        counts = np.bitwise_count(near).sum(1).astype(np.int64)
        hit = np.flatnonzero(counts)
        if not len(hit):
            continue
        word = (near[hit] != 0).argmax(1)
        bits = near[hit, word]
        best = indexed[word * 64 + np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([words[i] for i in some[hit]]),
                pa.array(counts[hit]),
                pa.array(n[best]),
                pa.array([words[i] for i in best]),
            ],
            ["word", "near", "best_n", "best"],
        )
