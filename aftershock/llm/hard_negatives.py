"""Hard negatives by an inverted multi-index with bounds on inner products."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aftershock.llm.shared import stored
from aftershock.llm.vectors import matrix

# Rows on which the codebooks are fitted, at most, and which give the first bounds of scores.
SAMPLE = 8192
# Rows of a cell, on average; sample rows of a centroid, at least.
CELL = 64
BACKING = 16
ROUNDS = 8
# Rows of a unit of work, and questions answered together.
CHUNK = 2048
TOGETHER = 256
# Scores of vectors no longer than this are exact in doubles.
LONGEST = float(1 << 26)
FAR = 1 << 60
UNITS = (
    "unit int, chunk int, asks boolean, id long, label long, cell int, vector array<int>, cells binary, "
    "low array<long>, high array<long>"
)
HITS = "anchor_id long, window int, id long, score long"


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    lower: int = 30,
    upper: int = 90,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
    sample: int = SAMPLE,
    chunk: int = CHUNK,
) -> DataFrame:
    """The best rows of other labels that score between ``lower`` and ``upper`` percent of a positive.

    ``vector`` holds integers; the score of two rows is their inner product; higher ones come first, ties
    by the smaller id. Anchors are the rows meeting ``anchors``; an anchor's positives are its first
    ``positives`` other rows of the same label. Returns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score and negative_score: for each anchor and positive the first ``negatives`` rows of
    other labels whose score is in the window; fewer, if there are no more. All results are exact.

    The halves of the vectors are quantised with codebooks of their own, fitted on at most ``sample`` rows
    (those with the smallest hashes of their ids); a cell is a pair of centroids, and every row
    is in one. A centroid's bound on a half score includes the radius of its rows. An anchor visits
    cells in order of their summed bounds, with a heap, and stops where these fall below a score
    that enough sample rows reach in its window: beyond it no row can be among the best. Cells
    whose rows all score above the window are passed over.

    Rows without id, label or vector, with a NULL or non-finite component, of another dimension
    than the most frequent one or longer than 2**26 (whose scores no double holds exactly) take no part; zero
    vectors do. Rows that repeat an id are rows of their own, but never the anchor's
    others; of a repeated anchor the smallest label and vector ask. No row, no anchor or no
    positive gives no row.

    A unit of work is a chunk of the rows of one first-half centroid, held in memory, past which the
    anchors that reach it stream.
    """
    spark = rows.sparkSession
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= LONGEST))
    square = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    given = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & sound & (square <= LONGEST**2))
    given = given.select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).try_cast("array<int>").alias("vector"),
        anchors.alias("asks"),
    )
    given = given.filter(F.size("vector") > 0)
    dimension = F.size("vector").alias("dimensions")
    common = given.groupBy(dimension).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dimensions").first()
    if common is None:
        return spark.createDataFrame([], RESULT)
    given = given.filter(F.size("vector") == common.dimensions)
    drawn = given.select("id", "label", "vector").orderBy(F.xxhash64("id"), "id", "label", "vector").limit(sample)
    known = Known.of(drawn.collect())  # at most ``sample`` rows
    books = Codebooks.fit(known.vectors, math.ceil(math.sqrt(common.n / CELL)))
    index = MultiIndex.of(given.select("vector"), books)

    asked = given.filter("asks").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("asking"))
    asked = asked.select("id", "asking.*")
    search = Search(given, index, chunk)

    def ask_positives(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, batch: pa.RecordBatch) -> tuple:
        return known.least(ids, labels, vectors, True, positives, [(-FAR, FAR)] * len(ids))[:, None], np.full((len(ids), 1), FAR)

    found = search.run(asked, ask_positives, True, positives)
    score = F.col("score")
    links = stored(
        found.select(
            "anchor_id",
            "rank",
            F.col("id").alias("positive_id"),
            score.alias("positive_score"),
            (-_hundredths(-lower * score)).alias("low"),
            _hundredths(upper * score).alias("high"),
        )
    )
    windows = links.filter("low <= high").groupBy(F.col("anchor_id").alias("id"))
    windows = windows.agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("windows"))

    def ask_negatives(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, batch: pa.RecordBatch) -> tuple:
        lows = np.full((len(ids), positives), FAR)
        highs = np.full((len(ids), positives), -FAR)
        for i, own in enumerate(batch.column(3).to_pylist()):
            for w in own:
                lows[i, w["rank"] - 1], highs[i, w["rank"] - 1] = w["low"], w["high"]
        for w in range(positives):
            lows[:, w] = known.least(ids, labels, vectors, False, negatives, list(zip(lows[:, w], highs[:, w])))
        return lows, highs

    best = search.run(asked.join(windows, "id"), ask_negatives, False, negatives)
    best = best.select(
        "anchor_id",
        (F.col("window") + 1).alias("window"),
        F.col("rank").alias("place"),
        F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    mined = links.withColumnRenamed("rank", "window").join(best, ["anchor_id", "window"])
    return mined.select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def _hundredths(x: Column) -> Column:
    """The whole hundredths of integers, rounded down."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Known:
    """The sample's rows, of which some score is reached for sure."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Known:
        vectors = np.array([r.vector for r in rows], np.float64)
        return cls(np.array([r.id for r in rows]), np.array([r.label for r in rows]), vectors)

    def least(self, ids, labels, vectors, same: bool, k: int, windows: list[tuple[int, int]]) -> np.ndarray:
        """For each question, a score that its ``k`` best rows in the window are not below."""
        least = np.array([low for low, _ in windows], np.int64)
        if len(self.ids) < k:
            return least
        lows, highs = (np.array(x, np.float64)[:, None] for x in zip(*windows))
        for at in range(0, len(ids), TOGETHER):
            some = slice(at, at + TOGETHER)
            scores = vectors[some] @ self.vectors.T
            fits = ((labels[some][:, None] == self.labels) == same) & (ids[some][:, None] != self.ids)
            scores[~fits | (scores < lows[some]) | (scores > highs[some])] = -np.inf
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            sure = np.isfinite(kth)
            least[some][sure] = kth[sure].astype(np.int64)
        return least


@dataclass(frozen=True)
class Codebooks:
    """Centroids of the vectors' halves."""

    first: np.ndarray
    second: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, centroids: int) -> Codebooks:
        k = max(1, min(centroids, len(sample) // BACKING))
        half = (sample.shape[1] + 1) // 2
        return cls(_centroids(sample[:, :half], k), _centroids(sample[:, half:], k))

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return vectors[:, :half], vectors[:, half:]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """The centroid of each half, and the distance from it."""
        found = []
        for part, centroids in zip(self.halves(vectors), (self.first, self.second)):
            nearest = ((centroids**2).sum(1) - 2 * part @ centroids.T).argmin(1)
            found += [nearest, np.sqrt(((part - centroids[nearest]) ** 2).sum(1))]
        return tuple(found)


def _centroids(vectors: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's algorithm, beginning with vectors spread evenly over the sorted distinct ones."""
    distinct = np.unique(vectors, axis=0)
    centroids = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)]
    for _ in range(ROUNDS):
        nearest = ((centroids**2).sum(1) - 2 * vectors @ centroids.T).argmin(1)
        sizes = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks with the radius around each centroid and the rows of each cell."""

    books: Codebooks
    radii: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray

    @classmethod
    def of(cls, vectors: DataFrame, books: Codebooks) -> MultiIndex:
        d = books.first.shape[1] + books.second.shape[1]

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes = np.zeros((len(books.first), len(books.second)), np.int64)
            radii = [np.zeros(len(books.first)), np.zeros(len(books.second))]
            for batch in batches:
                i, first, j, second = books.assign(matrix(batch.column(0), d))
                np.add.at(sizes, (i, j), 1)
                np.maximum.at(radii[0], i, first)
                np.maximum.at(radii[1], j, second)
            at = np.nonzero(sizes)
            none = np.zeros(len(at[0]))
            yield _measured(2, at[0], at[1], sizes[at], none)
            for half in (0, 1):
                own = np.arange(len(radii[half]))
                yield _measured(half, own, own, own * 0, radii[half])

        sizes = np.zeros((len(books.first), len(books.second)), np.int64)
        radii = (np.zeros(len(books.first)), np.zeros(len(books.second)))
        measured = vectors.mapInArrow(measure, "half int, i int, j int, n long, radius double").groupBy("half", "i", "j")
        # At most a row per cell and per centroid.
        for row in measured.agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():
            if row.half == 2:
                sizes[row.i, row.j] = row.n
            else:
                radii[row.half][row.i] = row.radius
        return cls(books, radii, sizes)

    def bounds(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half, the highest and lowest score that rows of each centroid can have."""
        found = []
        for part, centroids, radius in zip(self.books.halves(vectors), (self.books.first, self.books.second), self.radii):
            middle = part @ centroids.T
            spread = np.sqrt((part**2).sum(1))[:, None] * radius
            slack = 1e-9 * (np.abs(middle) + spread) + 1e-6  # for rounding
            found.append((middle + spread + slack, middle - spread - slack))
        return found

    def visit(self, first: np.ndarray, second: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Cells by falling sum of their halves' bounds, as long as that is not below ``least``."""
        rows, columns = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
        a, b = first[rows].tolist(), second[columns].tolist()
        heap, visited = [(-a[0] - b[0], 0, 0)], []
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound < least:
                break
            visited.append((rows[i], columns[j]))
            if j + 1 < len(b):
                heapq.heappush(heap, (-a[i] - b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-a[i + 1] - b[0], i + 1, 0))
        at = np.array(visited, np.int64).reshape(-1, 2)
        return at[:, 0], at[:, 1]


def _measured(half: int, i: np.ndarray, j: np.ndarray, n: np.ndarray, radius: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(i), half, np.int32), i.astype(np.int32), j.astype(np.int32), n, radius]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["half", "i", "j", "n", "radius"])


@dataclass(frozen=True)
class Search:
    """Questions put to the rows of the cells that their bounds allow."""

    rows: DataFrame
    index: MultiIndex
    chunk: int

    def run(self, asked: DataFrame, ask, same: bool, k: int) -> DataFrame:
        """The ``k`` best rows (anchor_id, window, rank, id, score) of each question and window.

        ``ask`` gives lowest and highest scores, a column per window; rows have the question's
        label or, unless ``same``, another one.
        """
        index, chunk = self.index, self.chunk
        sizes = index.sizes
        chunks = np.maximum(1, -(-sizes.sum(1) // chunk))
        d = index.books.first.shape[1] + index.books.second.shape[1]

        def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = TaskContext.get().partitionId()
            for batch in batches:
                unit, _, cell, _ = index.books.assign(matrix(batch.column(2), d))
                part = (at + np.arange(len(unit))) % chunks[unit]
                at += len(unit)
                yield _units(unit, part, False, batch.column(0), batch.column(1), cell, batch.column(2))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                vectors = matrix(batch.column(2), d)
                lows, highs = ask(ids, labels, vectors, batch)
                (top1, low1), (top2, low2) = index.bounds(vectors)
                for q in range(len(ids)):
                    open_ = lows[q] <= highs[q]
                    if not open_.any():
                        continue
                    i, j = index.visit(top1[q], top2[q], float(lows[q][open_].min()))
                    top, bottom = top1[q, i] + top2[q, j], low1[q, i] + low2[q, j]
                    wanted = (top[:, None] >= lows[q]) & (bottom[:, None] <= highs[q]) & open_
                    reached = np.zeros(sizes.shape, bool)
                    reached[i, j] = wanted.any(1) & (sizes[i, j] > 0)
                    units = [(u, c) for u in np.flatnonzero(reached.any(1)).tolist() for c in range(chunks[u])]
                    if not units:
                        continue
                    n = len(units)
                    unit = np.array([u for u, _ in units])
                    row = pa.array([0] * n)
                    yield _units(
                        unit,
                        np.array([c for _, c in units]),
                        True,
                        batch.column(0)[q : q + 1].take(row),
                        batch.column(1)[q : q + 1].take(row),
                        None,
                        batch.column(2)[q : q + 1].take(row),
                        [np.packbits(reached[u]).tobytes() for u in unit],
                        [lows[q].tolist()] * n,
                        [highs[q].tolist()] * n,
                    )

        entries = self.rows.select("id", "label", "vector").mapInArrow(enter, UNITS)
        # Few rows with much work each: dealt out by number, which AQE leaves as it is.
        tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        probes = asked.repartition(tasks, "id").mapInArrow(probe, UNITS)
        place = ["unit", "chunk"]
        together = entries.unionByName(probes).repartition(*place).sortWithinPartitions(*place, "asks")

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _answers(batches, d, len(index.books.second), same, k)

        found = together.mapInArrow(answer, HITS)
        order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _units(unit, chunk, asks, ids, labels, cell, vectors, cells=None, low=None, high=None) -> pa.RecordBatch:
    n, long_list = len(unit), pa.list_(pa.int64())
    columns = [
        pa.array(unit, pa.int32()),
        pa.array(chunk, pa.int32()),
        pa.array([asks] * n),
        ids,
        labels,
        pa.nulls(n, pa.int32()) if cell is None else pa.array(cell, pa.int32()),
        vectors,
        pa.nulls(n, pa.binary()) if cells is None else pa.array(cells, pa.binary()),
        pa.nulls(n, long_list) if low is None else pa.array(low, long_list),
        pa.nulls(n, long_list) if high is None else pa.array(high, long_list),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in UNITS.split(", ")])


def _answers(batches: Iterator[pa.RecordBatch], d: int, cells: int, same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Streams the questions of a unit past its rows, which stand before them."""
    unit: tuple[int, int] | None = None
    entered: list[pa.RecordBatch] = []
    held: Entries | None = None
    for batch in batches:
        units, chunks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        asks = batch.column(2).to_numpy(zero_copy_only=False)
        new = (np.diff(units) != 0) | (np.diff(chunks) != 0) | (np.diff(asks.astype(int)) != 0)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if unit != (units[a], chunks[a]):
                unit, entered, held = (units[a], chunks[a]), [], None
            if not asks[a]:
                entered.append(batch.slice(a, b - a))
                continue
            if held is None:
                held = Entries.of(entered, d)
            for at in range(a, b, TOGETHER):
                yield from held.answer(batch.slice(at, min(TOGETHER, b - at)), d, cells, same, k)


@dataclass(frozen=True)
class Entries:
    """The rows of a unit."""

    ids: np.ndarray
    labels: np.ndarray
    cells: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, batches: list[pa.RecordBatch], d: int) -> Entries:
        if not batches:
            none = np.zeros(0, np.int64)
            return cls(none, none, none, np.zeros((0, d)))
        ids, labels, cells = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in (3, 4, 5))
        return cls(ids, labels, cells, np.concatenate([matrix(b.column(6), d) for b in batches]))

    def answer(self, asked: pa.RecordBatch, d: int, cells: int, same: bool, k: int) -> Iterator[pa.RecordBatch]:
        if not len(self.ids):
            return
        ids, labels = asked.column(3).to_numpy(), asked.column(4).to_numpy()
        scores = matrix(asked.column(6), d) @ self.vectors.T
        flags = np.frombuffer(b"".join(asked.column(7).to_pylist()), np.uint8).reshape(len(ids), -1)
        fits = np.unpackbits(flags, axis=1, count=cells).astype(bool)[:, self.cells]
        fits &= ((labels[:, None] == self.labels) == same) & (ids[:, None] != self.ids)
        lows, highs = (asked.column(c).flatten().to_numpy().reshape(len(ids), -1) for c in (8, 9))
        last = min(k, scores.shape[1]) - 1
        for window in range(lows.shape[1]):
            low, high = lows[:, window, None], highs[:, window, None]
            own = np.where(fits & (scores >= low) & (scores <= high), scores, -np.inf)
            kth = -np.partition(-own, last, axis=1)[:, last, None]
            rows, columns = np.nonzero((own >= kth) & np.isfinite(own))
            if not len(rows):
                continue
            order = np.lexsort((self.ids[columns], -own[rows, columns], rows))
            rows, columns = rows[order], columns[order]
            best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            rows, columns = rows[best], columns[best]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[rows]),
                    pa.array(np.full(len(rows), window, np.int32)),
                    pa.array(self.ids[columns]),
                    pa.array(own[rows, columns].astype(np.int64)),
                ],
                ["anchor_id", "window", "id", "score"],
            )
