"""Language-model scores from a hierarchical Pitman-Yor model of words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.llm.byte_words import BASE, LOWER_ASCII, WHITE, mixed, word_hashes
from aftershock.llm.shared import release, scratch, small_batches, stored, text_buffer

# Tokens, on average, of the rows of a file that ask for their words together, and tokens per bucket of words.
BLOCK = 2_000_000
BUCKET = 2_000_000
# Gibbs sweeps to settle the tables of a restaurant, and sweeps whose predictions are averaged.
SETTLE, AVERAGED = 3, 4
ROUNDS = 2
SEED = 3
STRENGTH = 1.0
# Customers of a dish up to which weights of its tables come from a table of Stirling numbers, beyond it from an integral.
EXACT = 1024
# Points of that integral.
NODES = 128
END = np.uint64(0x3C6EF372FE94F82B)
START = np.uint64(0xA54FF53A5F1D36F1)


@lru_cache(maxsize=8)
def log_stirling(discount: float, size: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: seatings of c customers at t tables."""
    table = np.full((size + 1, size + 1), -np.inf)
    table[0, 0] = 0.0
    for c in range(size):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + table[c, 1 : c + 2]
        table[c + 1, 1 : c + 2] = np.logaddexp(table[c, : c + 1], stay)
    return table


def _log1p(x: np.ndarray) -> np.ndarray:
    """Logarithm of 1 + x for complex x; NumPy's loses the digits of a small x."""
    return 0.5 * np.log1p(x.real * (2 + x.real) + x.imag**2) + 1j * np.arctan2(x.imag, 1 + x.real)


def log_seatings(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """Logarithms of S(c, t) / c! for pairs of customers and tables, minus infinity outside 1 <= t <= c.

    S(c, t) * t! / c! is the coefficient of x**c in ((1 - (1 - x)**d) / d)**t. With
    x = exp(-z), Cauchy's integral is taken along a parabola around z <= 0 that passes the
    saddle point, or along a line across it. Its points converge exponentially.
    """
    out = np.full(len(tables), -np.inf)
    alone = tables == customers
    out[alone] = [-lgamma(c + 1) for c in customers[alone].tolist()]
    inside = np.flatnonzero((tables >= 1) & (tables < customers))
    for part in np.array_split(inside, len(inside) // 4096 + 1):
        c, t = customers[part].astype(np.float64), tables[part].astype(np.float64)
        low, high = np.full(len(t), -80.0), np.full(len(t), np.log(60.0))
        for _ in range(50):
            middle = (low + high) / 2
            mu = np.exp(middle)
            rest = np.where(mu < 1, np.log(-np.expm1(-mu)), np.log1p(-np.exp(-np.maximum(mu, 0.5))))
            above = np.log(t * discount) - mu + (discount - 1) * rest - np.log(-np.expm1(discount * rest)) > np.log(c)
            low, high = np.where(above, middle, low), np.where(above, high, middle)
        mu = np.maximum(np.exp((low + high) / 2), 1 / c)
        reach = np.minimum(np.sqrt(40 / (min(1.0, 2 * (1 - discount)) * c * mu)), 10.0)
        # Where tables are many, the integrand is a bell curve across the line.
        line = mu > 1
        x = np.exp(-mu[line])
        spread = c[line] * (1 + (1 - discount) * x / (1 - x) - c[line] / t[line])
        reach[line] = np.minimum(np.pi, 9 / np.sqrt(np.maximum(spread, 1e-9))) / (2 * mu[line])
        turn = 1j * (np.arange(NODES) + 0.5) / NODES * reach[:, None]
        along = np.where(line[:, None], 1, 1 + turn)
        z = mu[:, None] * np.where(line[:, None], 1 + 2 * turn, along**2)
        rest = np.where(z.real < 1, np.log(-np.expm1(-z)), _log1p(-np.exp(-np.where(z.real < 1, 1, z))))
        logs = t[:, None] * np.log(-np.expm1(discount * rest) / discount) + c[:, None] * z + np.log(2j * mu[:, None] * along)
        top = logs.real.max(1)
        total = np.exp(logs - top[:, None]).imag.sum(1) * reach / (NODES * np.pi)
        out[part] = top + np.log(np.maximum(total, 1e-300)) - np.array([lgamma(x + 1) for x in t.tolist()])
    return out


def _drawn(customers: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables drawn with weights S(c, t) * opening**t, which are log-concave in t.

    The hat is flat around the mode and goes on with the slopes at a deviation from it.
    """
    price = np.log(opening)
    weight = lambda t, rows=slice(None): log_seatings(customers[rows], t, discount) + t * price[rows]
    # The mode is near opening * (1 - (1 - x)**d) / d where opening * x * (1 - x)**(d - 1) = c.
    low, high = np.full(len(customers), -80.0), np.full(len(customers), 700.0)
    for _ in range(60):
        middle = (low + high) / 2
        mu = np.exp(np.minimum(middle, 6.5))
        above = price - mu + (discount - 1) * np.log(-np.expm1(-mu)) > np.log(customers)
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    rest = np.log(-np.expm1(-np.exp(np.minimum(low, 6.5))))
    mode = np.clip(opening * -np.expm1(discount * rest) / discount, 1, customers).astype(np.int64)
    best = weight(mode)
    for sign in (1, -1):
        step, open_rows = np.ones(len(mode), np.int64), np.arange(len(mode))
        while len(open_rows):
            ahead = mode[open_rows] + sign * step[open_rows]
            found = weight(ahead, open_rows)
            better = found > best[open_rows]
            up = open_rows[better]
            mode[up], best[up] = ahead[better], found[better]
            # Steps double while they go up, and start again until a single one does not.
            ended = ~better & (step[open_rows] == 1)
            step[open_rows] = np.where(better, step[open_rows] * 2, 1)
            open_rows = open_rows[~ended]
    bend = 2 * best - weight(mode - 1) - weight(mode + 1)
    wide = np.maximum(1, np.ceil(1 / np.sqrt(np.maximum(bend, 1e-12)))).astype(np.int64)
    left, right = mode - wide, mode + wide
    ends, slopes = [], []
    for end, inner in ((left, left + 1), (right, right - 1)):
        at = weight(end)
        with np.errstate(invalid="ignore"):
            slopes.append(np.where(np.isfinite(at), np.minimum(at - weight(inner), -1e-9), -1.0))
        ends.append(at)
    mass = np.stack([np.exp(at - best) / -np.expm1(slope) for at, slope in zip(ends, slopes)] + [(right - left - 1).astype(np.float64)])
    share = np.cumsum(mass / mass.sum(0), axis=0)
    drawn = np.zeros(len(mode), np.int64)
    todo = np.arange(len(mode))
    while len(todo):
        side = (rng.random(len(todo)) > share[:2, todo]).sum(0)
        away = [rng.geometric(-np.expm1(slope[todo])) - 1 for slope in slopes]
        between = left[todo] + 1 + (rng.random(len(todo)) * (right - left - 1)[todo]).astype(np.int64)
        t = np.choose(side, [left[todo] - away[0], right[todo] + away[1], between])
        hat = np.choose(side, [ends[0][todo] + away[0] * slopes[0][todo], ends[1][todo] + away[1] * slopes[1][todo], best[todo]])
        taken = np.log(rng.random(len(todo))) < weight(t, todo) - hat
        drawn[todo[taken]] = t[taken]
        todo = todo[~taken]
    return drawn


def seat(customers: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, given its customers and the weight of opening a further table for it.

    A Gibbs draw of all customers of a dish at once: the number of tables t has the weight
    S(c, t) * opening**t, with S the seatings of c customers. Up to ``EXACT`` customers the
    weights of all t are computed; beyond it, t is drawn by rejection from the same weights.
    """
    tables = np.minimum(customers, 1)
    logs = log_stirling(discount)
    opening = np.maximum(opening, 1e-300)
    for c in np.unique(customers[(customers > 1) & (customers <= EXACT)]).tolist():
        rows = np.flatnonzero(customers == c)
        t = np.arange(1, c + 1)
        for part in np.array_split(rows, len(rows) * c // 4_000_000 + 1):
            weights = logs[c, 1 : c + 1] + np.log(opening[part])[:, None] * t
            tables[part] = 1 + np.argmax(weights + rng.gumbel(size=weights.shape), axis=1)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        tables[many] = _drawn(customers[many], opening[many], discount, rng)
    return tables


@dataclass(frozen=True)
class Parent:
    """Totals of the restaurant that all contexts share, of one seating, and what follows from the counts."""

    customers: int
    tables: int
    discounts: tuple[float, float]  # contexts, parent
    words: int  # distinct training words

    def base(self) -> float:
        return 1.0 / (self.words + 1)

    def fresh(self) -> float:
        """Weight of opening a further table for a word."""
        return (STRENGTH + self.discounts[1] * self.tables) * self.base()

    def chance(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Chance of words with these customers and tables; adds up to 1 over all words and one unknown word."""
        return (customers - self.discounts[1] * tables + self.fresh()) / (STRENGTH + self.customers)


def chance_in(discount: float, count, tables, all_count, all_tables, parent):
    """Chance of words in a context of which ``count`` and ``tables`` are theirs; adds up to 1 if ``parent`` does."""
    return (count - discount * tables + (STRENGTH + discount * all_tables) * parent) / (STRENGTH + all_count)


@dataclass
class Bucket:
    """Contexts with all the words that follow them in training; cells are sorted by context and word."""

    contexts: np.ndarray  # hashes, sorted
    context: np.ndarray  # of each cell, an index into contexts
    word: np.ndarray  # a hash in payloads, else a place among the bucket's words
    count: np.ndarray

    @classmethod
    def of(cls, payloads: list[bytes]) -> Bucket:
        """Training counts of all blocks added up."""
        parts = [Asked.read(p) for p in payloads]
        contexts = np.concatenate([np.repeat(p.contexts, p.entries) for p in parts])
        word = np.concatenate([p.word for p in parts])
        count = np.concatenate([p.count for p in parts]).astype(np.int64)
        held = count > 0
        contexts, word, count = contexts[held], word[held], count[held]
        order = np.lexsort((word, contexts))
        contexts, word, count = contexts[order], word[order], count[order]
        first = np.flatnonzero(np.append(True, (contexts[1:] != contexts[:-1]) | (word[1:] != word[:-1]))[: len(word)])
        count = np.add.reduceat(count, first) if len(first) else count
        distinct, context = np.unique(contexts[first], return_inverse=True)
        return cls(distinct, context, word[first], count)

    def pack(self) -> bytes:
        sizes = np.bincount(self.context, minlength=len(self.contexts))
        return Asked(self.contexts, sizes, self.word, self.count).pack()

    @classmethod
    def read(cls, raw: bytes, words: np.ndarray) -> Bucket:
        asked = Asked.read(raw)
        context = np.repeat(np.arange(len(asked.contexts)), asked.entries)
        return cls(asked.contexts, context, np.searchsorted(words, asked.word), asked.count.astype(np.int64))

    def totals(self, of_cells: np.ndarray) -> np.ndarray:
        """Sums by context, and a 0 for a context that is unknown."""
        return np.bincount(self.context, weights=of_cells, minlength=len(self.contexts) + 1).astype(np.int64)

    def sweeps(self, parent: np.ndarray, discount: float, seed: list[int], sweeps: int) -> Iterator[np.ndarray]:
        """Tables of the cells after each sweep, given the parent's chances of the bucket's words."""
        rng = np.random.default_rng(seed)
        tables = np.minimum(self.count, 1)
        # A cell with one customer always has one table.
        several = np.flatnonzero(self.count > 1)
        context, count, above = self.context[several], self.count[several], parent[self.word[several]]
        for _ in range(sweeps):
            others = self.totals(tables)[context] - tables[several]
            tables = tables.copy()
            tables[several] = seat(count, (STRENGTH + discount * others) * above, discount, rng)
            yield tables


@dataclass
class Asked:
    """Contexts with words after them: entries per context, and each entry's word and training count."""

    contexts: np.ndarray
    entries: np.ndarray
    word: np.ndarray
    count: np.ndarray

    def pack(self) -> bytes:
        words, place = np.unique(self.word.astype("<u8"), return_inverse=True)
        place = place.astype("<u2" if len(words) <= 1 << 16 else "<u4")
        count = self.count.astype("<u4") if self.count.max(initial=0) < 2**32 else self.count.astype("<u8")
        arrays = (self.contexts.astype("<u8"), self.entries.astype("<u4"), words, place, count)
        head = np.array([len(self.contexts), len(words), len(place), place.itemsize, count.itemsize], "<u8").tobytes()
        # Steps between neighbours, byte by byte: sorted hashes and places are a fifth smaller so.
        raw = b"".join(np.diff(a, prepend=a.dtype.type(0)).view("u1").reshape(-1, a.itemsize).T.tobytes() for a in arrays)
        return head + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def read(cls, packed: bytes) -> Asked:
        n, k, m, narrow, width, size = np.frombuffer(packed, "<u8", 6).tolist()
        raw = pa.decompress(packed[48:], size, codec="zstd", asbytes=True)
        at, out = 0, []
        for kind, items in (("<u8", n), ("<u4", n), ("<u8", k), (f"<u{narrow}", m), (f"<u{width}", m)):
            width = np.dtype(kind).itemsize
            steps = np.frombuffer(raw, "u1", items * width, at).reshape(width, items).T.copy().view(kind).ravel()
            out.append(np.cumsum(steps, dtype=kind))
            at += items * width
        contexts, entries, words, place, count = out
        return cls(contexts, entries, words[place], count)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words with an end after each text, the texts' limits, and the words' contexts.

    A context is the word before, or ``START`` at the start of a text.
    """
    data, limits = text_buffer(column)
    hashes, upto = word_hashes(LOWER_ASCII[data], limits, WHITE)
    words = np.insert(hashes, upto[1:], END)
    upto = upto + np.arange(len(upto))
    context = np.append(START, words[:-1])[: len(words)]
    context[upto[:-1]] = START
    return words, upto, context


def entries_of(words: np.ndarray, context: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, context, word), sorted, and the entry of each token."""
    keys = mixed(words + mixed(context) * np.uint64(BASE))
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    bucket = ((mixed(context[first]) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((words[first], context[first], bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return bucket[order], context[first][order], words[first][order], rank[which]


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """The numbers of training tokens and of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt, every = 0, 0
        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False)
            sizes = np.diff(tokens(batch.column(0))[1])
            every += int(sizes.sum())
            learnt += int(sizes[learn].sum())
        yield pa.RecordBatch.from_arrays([pa.array([learnt]), pa.array([every])], ["learnt", "every"])

    sums = docs.select("text", "learn").mapInArrow(run, "learnt long, every long").agg(F.sum("learnt"), F.sum("every")).first()
    return sums[0] or 0, sums[1] or 0


def _requests(docs: DataFrame, buckets: int) -> DataFrame:
    """For every part of a block and every bucket: the contexts and the words after them, with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ask() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            learn = rows.column("learn").combine_chunks().to_numpy(zero_copy_only=False)
            words, limits, context = tokens(rows.column("text").combine_chunks())
            bucket, context, words, which = entries_of(words, context, buckets)
            counts = np.bincount(which[np.repeat(learn, np.diff(limits))], minlength=len(words))
            numbers = np.unique(bucket)
            edges = np.searchsorted(bucket, np.append(numbers, buckets))
            payloads = []
            for a, b in zip(edges[:-1], edges[1:]):
                distinct, sizes = np.unique(context[a:b], return_counts=True)
                payloads.append(Asked(distinct, sizes, words[a:b], counts[a:b]).pack())
            block, part = rows.column("block")[0].as_py(), rows.column("row")[0].as_py()
            n = len(numbers)
            columns = [pa.array(numbers, pa.int32()), pa.array([block] * n, pa.int64()), pa.array([part] * n, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(payloads, pa.binary())], ["bucket", "block", "part", "asked"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    if held and held[0].column(0)[0].as_py() != blocks[a]:
                        yield ask()
                        held.clear()
                    held.append(batch.slice(a, b - a))
        if held:
            yield ask()

    rows = docs.select("block", "row", "learn", "text")
    return rows.mapInArrow(run, "bucket int, block long, part long, asked binary")


def _collected(asked: pa.Table) -> pa.Table:
    """One row per bucket: its training counts, the words that occur, and all requests to be answered."""
    payloads = asked.column("asked").to_pylist()
    words = np.unique(np.concatenate([np.unique(Asked.read(payload).word) for payload in payloads]))
    return pa.table(
        {
            "bucket": asked.column("bucket").slice(0, 1),
            "cells": pa.array([Bucket.of(payloads).pack()], pa.binary()),
            "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
            "blocks": pa.array([asked.column("block").to_pylist()], pa.list_(pa.int64())),
            "parts": pa.array([asked.column("part").to_pylist()], pa.list_(pa.int64())),
            "asked": pa.array([payloads], pa.list_(pa.binary())),
        }
    )


STATISTICS = "word long, count long, customers long, ones long, twos long"
TOTALS = "word long, count long, customers long, tables long"


def _statistics(words: np.ndarray, bucket: Bucket, tables: np.ndarray) -> pa.Table:
    """Counts and tables by word, and a row without a word for the cells with one and with two customers."""
    used = np.unique(bucket.word)
    sums = [np.bincount(bucket.word, weights=c)[used].astype(np.int64) if len(used) else used for c in (bucket.count, tables)]
    none = np.zeros(len(used), np.int64)
    cells = [int((bucket.count == n).sum()) for n in (1, 2)]
    columns = [
        pa.array([*words.view("<i8")[used].tolist(), None], pa.int64()),
        *(pa.array(np.append(x, y)) for x, y in zip((*sums, none, none), (0, 0, *cells))),
    ]
    return pa.Table.from_arrays(columns, [c.split()[0] for c in STATISTICS.split(", ")])


def _word_totals(buckets: DataFrame, totals: DataFrame) -> DataFrame:
    """For each bucket a row per word that occurs in it, with the word's totals, 0 for unknown ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), number), pa.int32()), pa.array(words)], ["bucket", "word"])

    held = buckets.select("bucket", "words").mapInArrow(run, "bucket int, word long")
    none = F.lit(0).cast("long")
    counts = [F.coalesce(c, none).alias(c) for c in ("count", "customers", "tables")]
    return held.join(totals, "word", "left").select("bucket", "word", *counts)


def _placed(words: np.ndarray, given: pa.Table) -> list[np.ndarray]:
    """Counts, customers and tables of a bucket's words, by their places."""
    place = np.searchsorted(words, given.column("word").to_numpy().view(np.uint64))
    columns = [np.zeros(len(words), np.int64) for _ in range(3)]
    for column, name in zip(columns, ("count", "customers", "tables")):
        column[place] = given.column(name).to_numpy()
    return columns


def _seated(buckets: DataFrame, parent: Parent | None, totals: DataFrame | None) -> tuple[Parent, DataFrame]:
    """The parent after a seating of all contexts: a table per cell at first, then by sweeps of Gibbs sampling.

    A bucket keeps its contexts' cells whole, so their totals are its own; of the others it only knows
    the parent's chances, those of the last seating. The tables it opens are the customers of the
    parent, added up by word in a distributed table, where the words' own tables are drawn. Only
    sums over all words come back.
    """

    def run(held: pa.Table, given: pa.Table | None = None) -> pa.Table:
        out = []
        for number, raw, packed in zip(*(held.column(c).to_pylist() for c in ("bucket", "cells", "words"))):
            words = np.frombuffer(packed, "<u8")
            bucket = Bucket.read(raw, words)
            tables = np.minimum(bucket.count, 1)
            if given is not None:
                _, customers, root_tables = _placed(words, given)
                *_, tables = bucket.sweeps(parent.chance(customers, root_tables), parent.discounts[0], [SEED, number], SETTLE)
            out.append(_statistics(words, bucket, tables))
        return pa.concat_tables(out)

    cells = buckets.select("bucket", "cells", "words")
    if totals is None:
        sums = cells.mapInArrow(lambda batches: (x for b in batches for x in run(pa.Table.from_batches([b])).to_batches()), STATISTICS)
    else:
        met = _word_totals(buckets, totals).groupBy("bucket")
        sums = cells.groupBy("bucket").cogroup(met).applyInArrow(run, STATISTICS)
    sums = stored(sums.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("count", "customers", "ones", "twos")]))
    known = sums.filter("word IS NOT NULL")
    if parent is None:
        share = lambda ones, twos: float(np.clip(ones / max(1, ones + 2 * twos), 0.05, 0.95))
        own = sums.filter("word IS NULL").agg(F.sum("ones"), F.sum("twos")).first()
        n, *dishes = known.agg(F.count(F.lit(1)), *[F.count(F.when(F.col("customers") == i, 1)) for i in (1, 2)]).first()
        parent = Parent(0, n, (share(own[0] or 0, own[1] or 0), share(*dishes)), n)
    discount, fresh = parent.discounts[1], parent.fresh()

    def seat_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([SEED, TaskContext.get().partitionId()])
        for batch in batches:
            customers = batch.column(2).to_numpy()
            tables = seat(customers, np.full(len(customers), fresh), discount, rng)
            columns = [*batch.columns, pa.array(tables.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in TOTALS.split(", ")])

    # Stored: the parent's totals and the words' tables have to come from the same draw.
    totals = stored(known.select("word", "count", "customers").mapInArrow(seat_words, TOTALS))
    customers, tables = totals.agg(F.sum("customers"), F.sum("tables")).first()
    return Parent(customers or 0, tables or 0, parent.discounts, parent.words), totals


ANSWERS = "bucket int, block long, part long, logs binary, known binary"


def _answers(buckets: DataFrame, parent: Parent, totals: DataFrame) -> DataFrame:
    """For every request: log10 of the averaged chance of each entry, and the training count of its word.

    Every averaged chance is that of one seating: a context's totals are the sums of its cells in the same
    sweep, and the parent's chances are those of one table of words, so the chances of a
    context add up to 1. Chances are linear in the tables, so their mean is that of the mean tables.
    """
    discount = parent.discounts[0]

    def run(held: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        columns = (held.column(c).to_pylist() for c in ("bucket", "cells", "words", "blocks", "parts", "asked"))
        for number, raw, packed, blocks, parts, asked in zip(*columns):
            words = np.frombuffer(packed, "<u8")
            counts, customers, root_tables = _placed(words, given)
            above = parent.chance(customers, root_tables)
            bucket = Bucket.read(raw, words)
            all_count, own = bucket.totals(bucket.count), np.append(bucket.count, 0)
            summed = np.zeros(len(bucket.count), np.int64)
            for sweep, tables in enumerate(bucket.sweeps(above, discount, [SEED, number], SETTLE + AVERAGED)):
                if sweep >= SETTLE:
                    summed += tables
            all_tables, own_tables = bucket.totals(summed) / AVERAGED, np.append(summed, 0) / AVERAGED
            logs, known = [], []
            for packed_request in asked:
                word, cell, context = _places(bucket, Asked.read(packed_request), words)
                chance = chance_in(discount, own[cell], own_tables[cell], all_count[context], all_tables[context], above[word])
                logs.append(np.log10(chance).astype("<f4").tobytes())
                known.append(counts[word].astype("<i8").tobytes())
            raw_known = [len(k).to_bytes(8, "little") + pa.compress(k, codec="zstd", asbytes=True) for k in known]
            columns = [
                pa.array([number] * len(asked), pa.int32()),
                pa.array(blocks, pa.int64()),
                pa.array(parts, pa.int64()),
                pa.array(logs, pa.binary()),
                pa.array(raw_known, pa.binary()),
            ]
            out.append(pa.Table.from_arrays(columns, [c.split()[0] for c in ANSWERS.split(", ")]))
        return pa.concat_tables(out)

    met = _word_totals(buckets, totals).groupBy("bucket")
    return buckets.groupBy("bucket").cogroup(met).applyInArrow(run, ANSWERS)


def _places(bucket: Bucket, asked: Asked, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, cell and context of each entry; the last place for cells and contexts unknown in training."""
    place = np.searchsorted(bucket.contexts, asked.contexts)
    found = place < len(bucket.contexts)
    found[found] = bucket.contexts[place[found]] == asked.contexts[found]
    context = np.repeat(np.where(found, place, len(bucket.contexts)), asked.entries)
    word = np.searchsorted(words, asked.word)
    width = len(words) + 1
    keys, wanted = bucket.context * width + bucket.word, context * width + word
    cell = np.searchsorted(keys, wanted)
    hit = cell < len(keys)
    hit[hit] = keys[cell[hit]] == wanted[hit]
    return word, np.where(hit, cell, len(keys)), context


def score_texts(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score all texts with a model learnt from the rows that meet ``learn``.

    Returns doc_id, n_tokens, n_known (tokens whose word occurs in training), train_tokens,
    base_score (add-one unigram) and score, both sums of log10 chances. Tokens are words (A-Z
    lower-cased, split at ASCII white space) and an end after each text.

    The model is a hierarchical Pitman-Yor process: every training word and the start of a text
    are a restaurant for the next word; a word unknown in training leads to the parent alone.
    Restaurants share a parent, whose
    base is uniform over the training words and one unknown word. Discounts follow from the
    counts. Tables are seated by Gibbs sampling, all customers of a dish at a time, and the
    chances after ``AVERAGED`` sweeps are averaged. The chances of a context add up to 1.

    Contexts are dealt out to buckets with all the words after them, so a restaurant is in one
    place; the parent is a distributed table of words. Rows of a file form blocks of about ``BLOCK`` tokens, which
    bring a context and its words once, with counts: a frequent word costs a bucket a row per block. The
    answers meet the texts again by block.
    Words are told apart by 64-bit hashes. A NULL text is empty, a NULL ``learn`` false; rows
    that repeat an id are texts of their own; without training rows all words are unknown.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = [
        F.col(key).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    ]
    file = F.xxhash64("_metadata.file_path").alias("file")
    row = F.col("_metadata.row_index").alias("row")
    try:
        rows = docs.select(*own, file, row)
    except AnalysisException:  # not read from files: stored, so that rows have places
        with scratch(spark, "texts") as path:
            docs.select(*own).write.parquet(path)
            return stored(_scored(spark.read.parquet(path).select("*", file, row)))
    return _scored(rows)


@contextmanager
def _placed_rows(frame: DataFrame, key: str) -> Iterator[DataFrame]:
    """The frame as a table bucketed by ``key`` in the shared folder, dropped at the end.

    What is grouped with it by the key moves to its rows, which stay where they are. Fewer parts than
    those of a shuffle would have them moved as well.
    """
    spark = frame.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark, "placed") as path:
        name = f"placed_{uuid.uuid4().hex}"
        writer = frame.write.format("parquet").bucketBy(parts, key).option("compression", "uncompressed")
        try:
            writer.option("path", path).saveAsTable(name)
            yield spark.table(name)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _scored(rows: DataFrame) -> DataFrame:
    train_tokens, every = _sizes(rows)
    buckets = max(1, -(-every // BUCKET))
    together = max(1, BLOCK * rows.count() // max(1, every))
    rows = rows.withColumn("block", F.xxhash64("file", F.floor(F.col("row") / together)))
    asked = _requests(rows, buckets).groupBy("bucket")
    kept = "bucket int, cells binary, words binary, blocks array<long>, parts array<long>, asked array<binary>"
    with _placed_rows(asked.applyInArrow(_collected, kept), "bucket") as collected:
        release(rows.sparkSession)
        parent = totals = None
        for _ in range(ROUNDS + 1):
            parent, totals = _seated(collected, parent, totals)
            release(rows.sparkSession)
        answers = stored(_answers(collected, parent, totals))
    release(rows.sparkSession)
    vocabulary = parent.words

    def finish(texts: pa.Table, given: pa.Table) -> pa.Table:
        texts = texts.sort_by("row")
        given = given.sort_by([("part", "ascending"), ("bucket", "ascending")]).to_pydict()
        row = texts.column("row").to_numpy()
        parts = np.unique(given["part"])
        edges = np.append(np.searchsorted(row, parts), len(row))
        out = []
        for part, a, b in zip(parts.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
            some = texts.slice(a, b - a)
            own = [i for i, p in enumerate(given["part"]) if p == part]
            logs = np.frombuffer(b"".join(given["logs"][i] for i in own), "<f4").astype(np.float64)
            known = np.concatenate([_unpacked(given["known"][i]) for i in own])
            words, limits, context = tokens(some.column("text").combine_chunks())
            _, _, _, which = entries_of(words, context, buckets)
            counts = known[which]
            base = np.log10((counts + 1) / (train_tokens + vocabulary + 1))
            starts = limits[:-1]
            out.append(
                pa.table(
                    {
                        "doc_id": some.column("doc_id"),
                        "n_tokens": np.diff(limits),
                        "n_known": np.add.reduceat((counts > 0).astype(np.int64), starts),
                        "train_tokens": np.full(b - a, train_tokens),
                        "base_score": np.add.reduceat(base, starts),
                        "score": np.add.reduceat(logs[which], starts),
                    }
                )
            )
        return pa.concat_tables(out)

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    together = rows.select("block", "row", "doc_id", "text").groupBy("block").cogroup(answers.groupBy("block"))
    return together.applyInArrow(finish, schema)


def _unpacked(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], size, codec="zstd", asbytes=True), "<i8")
