"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aftershock.llm.vectors import lists, matrix, takes_part

# Vectors on which the codebooks and the reach are fitted, at most; all are indexed.
SAMPLE = 8192
TRIALS = 256
# Centroids of a codebook at least; more follow from the vectors, so that a cell holds about so many of them.
CENTROIDS = 64
CELL = 64
# Vectors of the sample that a centroid is fitted on at least.
BACKING = 16
ROUNDS = 10
# Share of the true neighbours that the traversal has to reach.
RECALL = 0.97
# Rows of a unit of work: vectors of a first-half centroid, and queries.
CHUNK = 4096
QUERIES = 32768
TOGETHER = 512
ENTRIES = "unit int, chunk int, cell int, vec_id long, vector array<double>"
PROBES = "unit int, chunk int, block int, query_id long, cells binary, vector array<double>"
HITS = "query_id long, vec_id long, score double"


def _squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (vectors**2).sum(1)[:, None] - 2 * vectors @ centroids.T + (centroids**2).sum(1)


def _centroids(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's algorithm from vectors spread evenly over the sample."""
    distinct = np.unique(vectors, axis=0)
    centroids = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)]
    for _ in range(rounds):
        nearest = _squares(vectors, centroids).argmin(1)
        sizes = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, vectors)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of the vectors' halves, and the share of vectors that a query has to reach."""

    dimensions: int
    first: np.ndarray
    second: np.ndarray
    share: float

    @classmethod
    def fit(cls, sample: np.ndarray, centroids: int, recall: float, k: int) -> MultiIndex:
        """The share is the least that holds ``recall`` of the neighbours of trial vectors in the sample."""
        half = (sample.shape[1] + 1) // 2
        index = cls(
            sample.shape[1], _centroids(sample[:, :half], centroids), _centroids(sample[:, half:], centroids), 1.0
        )
        if len(sample) < 2 * k:
            return index
        trials = np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)
        away = _squares(sample[trials], sample)
        away[np.arange(len(trials)), trials] = np.inf
        near = np.argpartition(away, k, axis=1)[:, :k]
        own = index.assign(sample)
        by_first, by_second = index.distances(sample[trials])
        cell = by_first[:, own[0]] + by_second[:, own[1]]
        needed = (cell[:, None, :] <= np.take_along_axis(cell, near, 1)[:, :, None]).mean(2)
        return cls(index.dimensions, index.first, index.second, float(np.quantile(needed, recall)))

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = (self.dimensions + 1) // 2
        return _squares(vectors[:, :half], self.first), _squares(vectors[:, half:], self.second)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by_first, by_second = self.distances(vectors)
        return by_first.argmin(1), by_second.argmin(1)

    def traverse(self, by_first: np.ndarray, by_second: np.ndarray, sizes: np.ndarray, wanted: int) -> np.ndarray:
        """Cells in order of summed distance, until they hold ``wanted`` vectors, as a table of flags."""
        rows, columns = np.argsort(by_first, kind="stable").tolist(), np.argsort(by_second, kind="stable").tolist()
        d1, d2 = by_first[rows].tolist(), by_second[columns].tolist()
        reached = np.zeros(sizes.shape, bool)
        heap, done, held = [(d1[0] + d2[0], 0, 0)], [-1] * len(rows), 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            reached[rows[i], columns[j]] = True
            held += int(sizes[rows[i], columns[j]])
            done[i] = j
            # A pair is opened by whichever of the two before it is traversed last.
            if i + 1 < len(rows) and done[i + 1] == j - 1:
                heapq.heappush(heap, (d1[i + 1] + d2[j], i + 1, j))
            if j + 1 < len(columns) and (i == 0 or done[i - 1] >= j + 1):
                heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
        return reached


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    centroids: int | None = None,
    recall: float = RECALL,
    sample: int = SAMPLE,
) -> DataFrame:
    """The ``k`` nearest other vectors found for each row meeting ``queries``, by Euclidean distance.

    Returns query_id, rank (from 1), vec_id and score (the distance in double precision);
    nearest first, ties to the smaller id. Both halves of the vectors are quantised with
    codebooks of their own; a cell is a pair of centroids. A query's cells are traversed in
    order of summed centroid distance, with a heap, until they hold the share of all vectors
    that the fit found necessary for ``recall``; all their entries are ranked by the exact
    distance. Codebooks and share are fitted on at most ``sample`` vectors (those with the
    smallest hashes of their ids); every vector is indexed. Without ``centroids`` their number grows
    with the square root of the vectors, as far as the sample can back them.

    Vectors that are NULL, empty, zero or have NULL or non-finite components take no part, nor do
    those of another dimension than the most frequent one or with a NULL id. Rows that repeat
    an id are candidates of their own; of a repeated query the smallest vector counts. A table
    without such vectors gives no row; with fewer others than ``k`` all are returned.

    A unit of work is a chunk of the vectors of one first-half centroid and a block of
    queries, so a centroid that owns most vectors is many units.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(takes_part(F.col(vector)) & F.col(key).isNotNull())
    rows = rows.select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asks")
    )
    dimension = F.size("vector").alias("dimensions")
    common = rows.groupBy(dimension).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dimensions").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vector") == common.dimensions)
    hashed = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample)
    drawn = np.array([r.vector for r in hashed.select("vector").collect()])  # at most ``sample`` vectors
    if centroids is None:
        centroids = max(CENTROIDS, min(ceil(sqrt(common.n / CELL)), len(drawn) // BACKING))
    index = MultiIndex.fit(drawn, centroids, recall, k)
    d = index.dimensions

    def sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(index.first), len(index.second)), np.int64)
        for batch in batches:
            np.add.at(total, index.assign(matrix(batch.column(0), d)), 1)
        at = np.nonzero(total)
        columns = [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])]
        yield pa.RecordBatch.from_arrays(columns, ["unit", "cell", "n"])

    sizes = np.zeros((len(index.first), len(index.second)), np.int64)
    counted = rows.select("vector").mapInArrow(sizes_of, "unit int, cell int, n long")
    for row in counted.groupBy("unit", "cell").agg(F.sum("n").alias("n")).collect():  # at most a row per cell
        sizes[row.unit, row.cell] = row.n
    chunks = np.maximum(1, -(-sizes.sum(1) // CHUNK))
    wanted = max(k + 1, int(np.ceil(index.share * sizes.sum())))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for batch in batches:
            values = matrix(batch.column(1), d)
            unit, cell = index.assign(values)
            chunk = (at + np.arange(len(values))) % chunks[unit]
            at += len(values)
            columns = [pa.array(x, pa.int32()) for x in (unit, chunk, cell)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(0), lists(values)], names(ENTRIES))

    asked = rows.filter("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    # Few rows with much work each: dealt out by number, which AQE leaves as it is.
    asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id")
    blocks = max(1, -(-rows.filter("asks").count() // QUERIES))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column(1), d)
            by_first, by_second = index.distances(values)
            for i, query in enumerate(batch.column(0).to_pylist()):
                reached = index.traverse(by_first[i], by_second[i], sizes, wanted)
                units = [(u, c) for u in np.flatnonzero(reached.any(1)) for c in range(chunks[u])]
                flags = [np.packbits(reached[u]).tobytes() for u, _ in units]
                columns = [
                    pa.array([u for u, _ in units], pa.int32()),
                    pa.array([c for _, c in units], pa.int32()),
                    pa.array([query % blocks] * len(units), pa.int32()),
                    pa.array([query] * len(units), pa.int64()),
                    pa.array(flags, pa.binary()),
                    lists(np.repeat(values[i : i + 1], len(units), 0)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names(PROBES))

    entries = rows.select("vec_id", "vector").mapInArrow(enter, ENTRIES)
    entries = entries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    probes = asked.mapInArrow(probe, PROBES)
    together = probes.groupBy("unit", "chunk", "block").cogroup(entries.groupBy("unit", "chunk", "block"))

    def rank(asking: pa.Table, entered: pa.Table) -> pa.Table:
        return _rank(asking, entered, d, k)

    found = together.applyInArrow(rank, HITS)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def _rank(asking: pa.Table, entered: pa.Table, d: int, k: int) -> pa.Table:
    """The ``k`` nearest entries of a unit for each query that reached their cells."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if asking.num_rows and entered.num_rows:
        ids, cells = entered.column("vec_id").to_numpy(), entered.column("cell").to_numpy()
        values = matrix(entered.column("vector").combine_chunks(), d)
        for at in range(0, asking.num_rows, TOGETHER):
            some = asking.slice(at, TOGETHER)
            queries = matrix(some.column("vector").combine_chunks(), d)
            query_ids = some.column("query_id").to_numpy()
            flags = np.frombuffer(b"".join(some.column("cells").to_pylist()), np.uint8).reshape(len(queries), -1)
            open_cells = np.unpackbits(flags, axis=1).astype(bool)[:, cells]
            away = np.maximum(_squares(queries, values), 0.0)
            scale = (queries**2).sum(1)[:, None] + (values**2).sum(1)
            away[~open_cells | (query_ids[:, None] == ids)] = np.inf
            last = min(k, away.shape[1]) - 1
            kth = np.partition(away, last, axis=1)[:, last : last + 1]
            # Rounding of the quick distances must not decide; exact ones do.
            rows, columns = np.nonzero((away <= kth + 1e-9 * (1 + scale)) & np.isfinite(away))
            exact = np.sqrt(((queries[rows] - values[columns]) ** 2).sum(1))
            order = np.lexsort((ids[columns], exact, rows))
            rows, columns, exact = rows[order], columns[order], exact[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            best = place < k
            found.append((query_ids[rows[best]], ids[columns[best]], exact[best]))
    columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, t) for t in (int, int, float)]
    types = (pa.int64(), pa.int64(), pa.float64())
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=names(HITS))
