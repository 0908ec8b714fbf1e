"""Toxicity by non-negative positive-unlabelled learning over hashed words and word beginnings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.llm.byte_words import slices, span_hashes, spans, table
from aftershock.llm.shared import small_batches, stored, text_buffer

# Features are numbers of this many bits.
BITS = 20
# Bytes of a word that make a feature, besides the whole word.
BEGINNINGS = (4, 5, 6)
# Documents to learn from, at most: confirmed ones, and others.
CONFIRMED = 4000
OTHERS = 12000
# Features kept, at most; the least confirmed documents that hold one, and the least standard
# errors by which its share of them is above that of the others. Only features that speak for
# a toxic text are kept: the weak ones that speak against it add up in long texts.
KEPT = 4096
LEAST = 3
SURE = 4.0
SPACES = table(*(c for c in range(0x80) if not chr(c).isalnum()))
LOWER = np.array([ord(chr(c).lower()) if c < 0x80 else c for c in range(256)], np.uint8)


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        """Chance of being toxic for each text."""
        weights = np.zeros(1 << BITS)
        weights[self.features] = self.weights
        rows, features = present(column, weights != 0)
        margin = self.bias + np.bincount(rows, weights=weights[features], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def present(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of the texts, of the ``wanted`` features only if given."""
    data, limits = text_buffer(column)
    data = LOWER[data]
    found = []
    for a, b in slices(data, limits, SPACES):
        part, inner = data[a:b], limits[(limits >= a) & (limits <= b)] - a
        starts, ends = spans(part, inner, SPACES)
        row = np.searchsorted(limits, starts + a, side="right") - 1
        for size in (*BEGINNINGS, 0):
            long = ends - starts > size if size else ends > starts
            begin = starts[long]
            hashes = span_hashes(part, begin, begin + size if size else ends[long])
            feature = ((hashes + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
            of_row = row[long]
            if wanted is not None:
                hit = wanted[feature]
                feature, of_row = feature[hit], of_row[hit]
            found.append(np.unique(of_row << BITS | feature))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit(rows: np.ndarray, columns: np.ndarray, confirmed: np.ndarray, n: int, prior: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of the classifier with the least non-negative risk.

    ``rows`` and ``columns`` are the ones of a 0/1 matrix, ``confirmed`` marks its positive rows,
    the others are unlabelled, a share ``prior`` of them positive. The risk is
    ``prior * P(+) + max(0, U(-) - prior * P(-))`` with a sigmoid loss; where the second part is
    negative it has been overfitted, and the step goes against it. Steps are Adam's over all rows;
    weights stay non-negative, so that no amount of harmless text hides a toxic word.
    """
    weights, bias = np.zeros(n), 0.0
    positive = confirmed.astype(np.float64) / max(1, confirmed.sum())
    unlabelled = (~confirmed).astype(np.float64) / max(1, (~confirmed).sum())
    mean, square = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        margin = bias + np.bincount(rows, weights=weights[columns], minlength=len(confirmed))
        chance = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        slope = chance * (1 - chance)
        negative = (unlabelled * chance).sum() - prior * (positive * chance).sum()
        by_negative = (unlabelled - prior * positive) * slope
        pull = by_negative - prior * positive * slope if negative >= 0 else -by_negative
        gradient = np.append(np.bincount(columns, weights=pull[rows], minlength=n) + 1e-6 * weights, pull.sum())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
        weights, bias = np.maximum(weights - move[:-1], 0.0), bias - move[-1]
    return weights, float(bias)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    confirmed: int = CONFIRMED,
    others: int = OTHERS,
) -> Model:
    """Learn from ``docs``: those that ``labels`` (key, label) confirms, and others as unlabelled text.

    A document is confirmed if some label is 1. All others are unlabelled, also those labelled
    0: of them none is positive, of those without a label the same share as of the labelled
    ones, which gives the class prior.

    At most ``confirmed`` and ``others`` documents are learnt from, those with the smallest
    hashes of their ids; one row of an id. Features are chosen by how much more often
    confirmed documents hold them. All work but the last fit, over at most that many rows of at most ``KEPT``
    features, is distributed. Without any confirmed document nothing is toxic.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    ids = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct()
    ids = stored(ids.join(known, "id", "left").select("id", "label", F.xxhash64("id").alias("order")))
    ones, zeros, free = ids.agg(*[F.count(F.when(c, 1)) for c in (F.col("label") >= 1, F.col("label") < 1, F.col("label").isNull())]).first()
    if not ones:
        return Model(np.zeros(0, np.int64), np.zeros(0), -20.0)
    prior = ones / (ones + zeros) * free / max(1, zeros + free)
    mark = F.coalesce(F.col("label") >= 1, F.lit(False)).alias("confirmed")
    is_one = F.col("label") >= 1
    chosen = ids.filter(is_one).orderBy("order", "id").limit(confirmed).select("id", mark).unionByName(
        ids.filter(~F.coalesce(is_one, F.lit(False))).orderBy("order", "id").limit(others).select("id", mark)
    )
    # At most confirmed + others rows of two numbers.
    chosen = F.broadcast(stored(chosen))
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(chosen, "id")
    sample = texts.mapInArrow(_features, "id long, confirmed boolean, features binary")
    sample = stored(sample.groupBy("id", "confirmed").agg(F.min("features").alias("features")))
    p, u = sample.agg(*[F.count(F.when(c, 1)) for c in (F.col("confirmed"), ~F.col("confirmed"))]).first()

    counted = sample.mapInArrow(_document_counts, "feature long, p long, u long").groupBy("feature")
    counted = counted.agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share = (F.col("p") + F.col("u")) / float(p + u)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / p + 1 / max(1, u)))
    sure = ((F.col("p") + 0.5) / (p + 1) - (F.col("u") + 0.5) / (u + 1)) / error
    best = counted.withColumn("sure", sure).filter((F.col("sure") >= SURE) & (F.col("p") >= LEAST)).orderBy(F.desc("sure"), "feature").limit(KEPT)
    features = np.array(sorted(r.feature for r in best.select("feature").collect()), np.int64)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, columns, marks, n = [], [], [], 0
        for batch in batches:
            marks.extend(batch.column(0).to_pylist())
            for own in batch.column(1):
                own = np.frombuffer(own.as_buffer(), np.int32)
                columns.append(np.searchsorted(features, own))
                rows.append(np.full(len(columns[-1]), n))
                n += 1
        weights, bias = fit(np.concatenate(rows), np.concatenate(columns), np.array(marks), len(features), prior)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()]), pa.array([bias])], ["weights", "bias"])

    def known_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(2)]
            own = [x[np.isin(x, features)].tobytes() for x in own]
            columns = [batch.column(0), batch.column(1), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    reduced = sample.mapInArrow(known_only, sample.schema).repartition(1).sortWithinPartitions("id")
    row = reduced.select("confirmed", "features").mapInArrow(learn, "weights array<double>, bias double").first()
    return Model(features, np.array(row.weights), row.bias)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, features = present(batch.column(1))
        limits = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        raw = features.astype(np.int32)
        own = [raw[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(own, pa.binary())], ["id", "confirmed", "features"]
        )


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for mark, own in zip(batch.column(1).to_pylist(), batch.column(2)):
            totals[0 if mark else 1][np.frombuffer(own.as_buffer(), np.int32)] += 1
    used = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(t[used]) for t in totals)], ["feature", "p", "u"])


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """Adds the chance of being toxic (0 to 1). A NULL or empty text gets that of a text without any
    known feature; every row is scored on its own; a column called ``to`` is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop(to)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.scores(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, to])

    return docs.mapInArrow(run, schema)
