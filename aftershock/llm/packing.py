"""Order-preserving packing of documents into windows of tokens."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.llm.shared import small_batches
from aftershock.llm.word_ids import tokenizer_path, word_ids

WINDOW = 2048
END_ID = 1
# What a cut costs, in tokens of padding: at the end of a sentence, and inside one.
SENTENCE_CUT = 4
TRUNCATION = 64
# What a further window costs: short ones of a power of two need no padding but are no aim.
OPENING = 32
# Cuts inside a sentence are offered at this distance where it is longer than twice that.
STRIDE = 128
# Tokens planned at once; the last window of a plan is open and goes into the next one.
PLANNED = 1 << 20
# Sequence ids of a partition start at its number times this.
SEQUENCES = 1 << 40
SCHEMA = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, ids binary, padded long"


def best_cuts(places: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """Cuts (indexes into ``places``, the last included) of least padding plus cut costs.

    ``places`` are the sorted offsets where a cut may be, beginning with 0. A window is padded
    to its full size unless its length is a power of two (from an eighth of the window on,
    shorter ones are not looked for). ``best[i]`` is the least cost of cutting at
    ``places[i]``: the minimum of ``best[j] + places[j]`` over the reach of the window, from a
    monotone queue, or a window of a power of two.
    """
    exact: dict[int, list[int]] = {}
    size = 1
    while size < window:
        if 8 * size >= window:
            at = np.searchsorted(places, places - size)
            hits = np.flatnonzero((places >= size) & (places[np.minimum(at, len(places) - 1)] == places - size))
            for i, j in zip(hits.tolist(), at[hits].tolist()):
                exact.setdefault(i, []).append(j)
        size *= 2
    spots, extra = places.tolist(), (costs + OPENING).tolist()
    best, back = [0] * len(spots), [0] * len(spots)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (value, place, index), values rising
    for i in range(1, len(spots)):
        place = spots[i]
        while queue[0][1] < place - window:
            queue.popleft()
        value, _, j = queue[0]
        least = value + window - place
        for k in exact.get(i, ()):
            if best[k] < least:
                least, j = best[k], k
        least += extra[i]
        best[i], back[i] = least, j
        value = least + place
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, place, i))
    cuts, i = [], len(spots) - 1
    while i:
        cuts.append(i)
        i = back[i]
    return cuts[::-1]


@dataclass
class Packer:
    """Takes documents one after another and gives the pieces of finished windows."""

    window: int
    first_sequence: int
    sequence: int = 0
    ids: list[np.ndarray] = field(default_factory=list)
    docs: list[tuple[int | None, int, int]] = field(default_factory=list)  # id, ids before the buffer, all ids
    places: list[np.ndarray] = field(default_factory=list)
    costs: list[np.ndarray] = field(default_factory=list)
    held: int = 0

    def add(self, doc_id: int | None, ids: np.ndarray, stops: np.ndarray) -> None:
        places = np.append(stops[(stops > 0) & (stops < len(ids) - 1)], len(ids))
        costs = np.full(len(places), SENTENCE_CUT, np.int64)
        costs[-1] = 0
        gaps = places.copy()
        gaps[1:] -= places[:-1]
        stride = max(1, min(STRIDE, self.window // 2))
        wide = np.flatnonzero(gaps > 2 * stride)
        inner = [np.arange(places[i] - gaps[i] + stride, places[i] - stride // 2, stride) for i in wide]
        if inner:
            inner = np.concatenate(inner)
            places, costs = np.append(places, inner), np.append(costs, np.full(len(inner), TRUNCATION))
            order = np.argsort(places, kind="stable")
            places, costs = places[order], costs[order]
        self.docs.append((doc_id, self.held, len(ids)))
        self.places.append(places + self.held)
        self.costs.append(costs)
        self.ids.append(ids)
        self.held += len(ids)

    def take(self, last: bool) -> pa.RecordBatch:
        """Pieces of the planned windows; unless it is the last plan, the final window is kept back."""
        ids = np.concatenate(self.ids)
        places = np.concatenate([[0], *self.places])
        costs = np.concatenate([[0], *self.costs])
        cuts = places[best_cuts(places, costs, self.window)]
        if not last:
            cuts = cuts[:-1]
        done = int(cuts[-1]) if len(cuts) else 0
        starts = np.array([d[1] for d in self.docs])
        edges = np.unique(np.concatenate([[0], cuts, np.clip(starts, 0, done)]))
        begin, end = edges[:-1], edges[1:]
        window_starts = np.concatenate([[0], cuts])
        window = np.searchsorted(cuts, begin, side="right")
        doc = np.searchsorted(starts, begin, side="right") - 1
        filled = np.diff(window_starts)
        padded = np.where(np.bitwise_count(filled.astype(np.uint64)) == 1, filled, self.window)
        raw = ids.astype("<u4", copy=False).tobytes()
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs[i][0] for i in doc], pa.int64()),
                pa.array(begin - starts[doc], pa.int64()),
                pa.array([self.docs[i][2] for i in doc], pa.int64()),
                pa.array(window + self.first_sequence + self.sequence, pa.int64()),
                pa.array(begin - window_starts[window], pa.int64()),
                pa.array([raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), end.tolist())], pa.binary()),
                pa.array(padded[window], pa.int64()),
            ],
            ["doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids", "padded"],
        )
        self.sequence += len(cuts)
        open_docs = [i for i, (_, start, size) in enumerate(self.docs) if start + size > done]
        first = open_docs[0] if open_docs else len(self.docs)
        rest = places > done
        self.docs = [(d, start - done, size) for d, start, size in self.docs[first:]]
        self.ids = [ids[done:].copy()]
        self.places, self.costs = [places[rest] - done], [costs[rest]]
        self.held -= done
        return batch


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pack all documents, in the order of their rows, into sequences of at most ``window`` ids.

    Returns a row per piece: doc_id, start (ids of the document before the piece), doc_tokens
    (all ids of the document, its end id included), sequence_id, offset (in the sequence,
    gapless from 0), ids (little-endian unsigned 32-bit) and padded (the sequence's length when
    padded: ``window``, or its own length where that is a power of two).

    Each partition is packed on its own, in one pass and with bounded memory: nothing is
    shuffled, and a partition leaves at most one window open. Cuts are planned for about
    ``PLANNED`` ids at a time by dynamic programming over the ends of documents and sentences
    (and places inside long sentences), see :func:`best_cuts`.

    A NULL or empty text is a document of the end id alone. A NULL id stays NULL; rows with the
    same id are documents of their own. No row gives no row. Other columns are ignored.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        packer = Packer(window, TaskContext.get().partitionId() * SEQUENCES)
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            ids, limits, stops = words.encode(batch.column(1))
            of_text = np.searchsorted(stops, limits)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                own = stops[of_text[i] : of_text[i + 1]] - limits[i]
                packer.add(doc_id, np.concatenate([ids[limits[i] : limits[i + 1]], end]), own)
                if packer.held >= PLANNED:
                    yield packer.take(last=False)
        if packer.held:
            yield packer.take(last=True)

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


