"""Similarity join on word n-grams: prefixes, and R-tree leaves of group counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aftershock.llm.byte_words import BASE, LOWER_ASCII, WHITE, mixed, word_hashes
from aftershock.llm.shared import components, copies, release, salt, small_batches, stored, text_buffer

# Counters of shingle frequencies: a table of fixed size that orders shingles roughly by rarity.
COUNTERS = 22
CHUNK = 16
# Groups per document: a power of two, with about this many shingles each.
PER_GROUP = 4
LEAST_GROUPS, MOST_GROUPS = 8, 1 << 16
# Points of an R-tree leaf.
LEAF = 64
LEAVES = ["token", "leaf", "low", "high", "first", "last", "ids", "sizes", "components", "earlier", "points"]
# Rounds in which points of a crowded bucket meet those of the leaves beside theirs.
ROUNDS = 2
# Crowded buckets of a point that are known where others of them are compared, at most.
EARLIER = 32
# Neighbours compared in the first step, and shared shingles of a point under which it has neighbours.
REACH = 8
FIRST = 8
SALTS = 16
# Bytes of sets that are brought together for verification, at most.
CLUSTER = 64 << 20
# Rows of two numbers that are broadcast, at most.
SMALL = 200_000
FEATURES = "doc_id long, n long, s1 long, s2 long, prefix array<long>, counts binary"


class Similarity:
    """Jaccard similarity of at least ``share`` percent, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: int) -> int:
        """Shingles of which similar sets share one, whatever the order."""
        return n - (self.percent * n + 99) // 100 + 1

    def from_place(self, a, at_a, b, at_b):
        """Whether sets of these sizes can be similar if their first common shingle has these places in their orders."""
        return 1 + np.minimum(a - at_a - 1, b - at_b - 1) >= self.overlap(a, b)

    def overlap(self, a, b):
        """The least intersection of similar sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def sizes(self, a, b):
        return (100 * np.minimum(a, b)) >= self.percent * np.maximum(a, b)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Each text's distinct shingles of so many words, as sorted hashes; a shorter text is one shingle."""
    data, limits = text_buffer(column)
    hashes, upto = word_hashes(LOWER_ASCII[data], limits, WHITE)
    factors = [np.uint64(pow(BASE, 2 * i + 1, 2**64)) for i in range(words)]
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i, factor in enumerate(factors):
        rolled += hashes[i : i + len(rolled)] * factor
    rolled = mixed(rolled)
    sets = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = sum(int(h) * int(f) for h, f in zip(hashes[a:b], factors)) + (b - a) * 0x51ED270B
            sets.append(mixed(np.array([whole % 2**64], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def group_counts(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall in each group, by their leading bits; half as many groups are sums of pairs."""
    groups = LEAST_GROUPS
    while groups < MOST_GROUPS and groups * PER_GROUP < len(shingles):
        groups *= 2
    which = (shingles >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64)
    return np.bincount(which, minlength=groups)


def packed(counts: np.ndarray) -> bytes:
    """One byte per group, or two where a count needs them; the first byte says which."""
    width = 1 if counts.max() < 1 << 8 else 2
    return bytes([width]) + np.minimum(counts, (1 << 16) - 1).astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(groups, -1).sum(1, dtype=np.int64)


def at_most(a: np.ndarray, b: np.ndarray) -> int:
    """A bound on the intersection: the sum over groups of the smaller counts."""
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


def rarity(docs: DataFrame, words: int) -> np.ndarray:
    """A level per counter (0-255) that rises with the number of shingles that fall on it, over all documents.

    Any order that all documents share makes prefixes right; this one keeps common shingles
    out of them. The table has a fixed size and is all that comes to the driver.
    """
    size = 1 << CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.uint32)
        for batch in batches:
            sets = shingle_sets(batch.column(0), words)
            hashes = np.concatenate([np.zeros(0, np.uint64), *sets])
            total += np.bincount((hashes >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=len(total)).astype(np.uint32)
        parts = [i for i in range(len(total) // size) if total[i * size : (i + 1) * size].any()]
        raw = [pa.compress(total[i * size : (i + 1) * size].tobytes(), codec="zstd", asbytes=True) for i in parts]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(raw, pa.binary())], ["part", "raw"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(pa.decompress(raw.as_buffer(), size * 4, codec="zstd"), np.uint32)
                totals[part] = totals.get(part, 0) + counts.astype(np.uint64)
        levels = [np.minimum(255, 6 * np.log2(t.astype(np.float64) + 1)).astype(np.uint8).tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.int32()), pa.array(levels, pa.binary())], ["part", "raw"]
        )

    schema = "part int, raw binary"
    summed = docs.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema)
    levels = np.zeros(1 << COUNTERS, np.uint8)
    for row in summed.collect():
        levels[row.part * size : (row.part + 1) * size] = np.frombuffer(row.raw, np.uint8)
    return levels


def members(docs: DataFrame, words: int) -> DataFrame:
    """Size and digest of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            digests = np.array([_digest(own) for own in sets], np.int64).reshape(-1, 2)
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, digests.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "s1", "s2"])

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long")


def _digest(own: np.ndarray) -> list[int]:
    """Two sums over the set, equal for equal sets."""
    return [int(x.sum(dtype=np.uint64).view(np.int64)) for x in (own, mixed(own + np.uint64(BASE)))]


def features(docs: DataFrame, words: int, similar: Similarity, levels: np.ndarray) -> DataFrame:
    """Size, digest, prefix and group counts of every document's set."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            digests, prefixes, counts = [], [], []
            for own in sets:
                level = levels[(own >> np.uint64(64 - COUNTERS)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[: similar.prefix(len(own)) if len(own) else 0]
                prefixes.append(own[order].view(np.int64))
                digests.append(_digest(own))
                counts.append(packed(group_counts(own)) if len(own) else b"")
            flat = np.concatenate([np.zeros(0, np.int64), *prefixes])
            limits = np.cumsum([0, *map(len, prefixes)])
            columns = [
                batch.column(0),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([x[0] for x in digests], pa.int64()),
                pa.array([x[1] for x in digests], pa.int64()),
                pa.ListArray.from_arrays(pa.array(limits, pa.int32()), pa.array(flat)),
                pa.array(counts, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "s1", "s2", "prefix", "counts"])

    return docs.mapInArrow(run, FEATURES)


def shared_prefixes(points: DataFrame, similar: Similarity) -> DataFrame:
    """Rows (token, n, id) that have a row of the same token and a similar size beside them.

    Rows are sorted by token and size over all partitions, so a token that many documents
    share is many tasks' work. Those at the ends of a partition are kept. A token that just two
    rows share is most often chance: such rows stay only if the token's places in both prefixes
    leave room for a link, were it the first one they share. If it is not, the first one keeps them.
    """
    order = ["token", "n", "id"]
    rows = points.select(F.posexplode("prefix").alias("place", "token"), "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            token, n, place = (rows.column(c).to_numpy() for c in (0, 1, 3))
            same = token[1:] == token[:-1]
            near = same & similar.sizes(n[1:], n[:-1])
            # Two rows between others of the batch: what lies beyond it is not known.
            alone = np.zeros(len(same), bool)
            alone[1:-1] = same[1:-1] & ~same[:-2] & ~same[2:]
            near &= ~alone | similar.from_place(n[1:], place[1:], n[:-1], place[:-1])
            keep = np.append(near, False) | np.append(False, near)
            if first:
                keep[0], first = True, False
            # The last row waits for the next batch; what was seen of it is remembered as a kept row.
            if held is not None and held_kept:
                keep[0] = True
            held_kept = bool(keep[-1])
            held = rows.slice(rows.num_rows - 1).to_batches()[0]
            yield from rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1])).select(order).to_batches()
        if held is not None:
            yield held.select(order)

    ranged = rows.select(*order, "place").repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, "token long, n long, id long")


def neighbours(rows: DataFrame, similar: Similarity) -> DataFrame:
    """Pairs at most ``REACH`` apart in a token's order of points whose bound allows a link."""
    order = ["token", "n", "counts", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: deque[tuple] = deque(maxlen=REACH)
        for batch in batches:
            us, vs = [], []
            for token, n, raw, own in zip(*(batch.column(c).to_pylist() for c in range(4))):
                point = unpacked(raw)
                if last and last[-1][0] != token:
                    last.clear()
                for _, other_n, other, other_id in last:
                    if similar.sizes(n, other_n) and at_most(point, other) >= similar.overlap(n, other_n):
                        us.append(min(own, other_id))
                        vs.append(max(own, other_id))
                last.append((token, n, point, own))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    ranged = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, "u long, v long").filter("u <> v").distinct()


def contested(labelled: DataFrame) -> DataFrame:
    """The rows of tokens that several components share; a token of more than a leaf's points is crowded."""
    ends = [F.min("component").alias("a"), F.max("component").alias("b"), (F.count(F.lit(1)) > LEAF).alias("crowded")]
    several = stored(labelled.groupBy("token").agg(*ends).filter("a <> b").select("token", "crowded"))
    rows = labelled.withColumn("salt", salt(F.col("id"), SALTS)).join(copies(several, SALTS), ["token", "salt"])
    return rows.select("token", "n", "id", "component", "crowded")


def still_contested(labelled: DataFrame) -> DataFrame:
    """``contested`` for tokens of at most a leaf's points each: none is a large group, so their rows come together."""
    bucket = Window.partitionBy("token")
    ends = {"a": F.min("component").over(bucket), "b": F.max("component").over(bucket), "crowded": F.lit(False)}
    return labelled.withColumns(ends).filter("a <> b").drop("a", "b")


def labelled_by(rows: DataFrame, labels: DataFrame) -> DataFrame:
    rows = rows.select("token", "n", "id").join(labels, "id", "left")
    return rows.withColumn("component", F.coalesce("component", "id"))


def with_earlier(rows: DataFrame) -> DataFrame:
    """Rows with the smaller ones of their points' first ``EARLIER`` crowded tokens.

    Two points that share one of these have been compared there.
    """
    tokens = F.array_sort(F.collect_set(F.when(F.col("crowded"), F.col("token"))))
    known = rows.groupBy("id", "n").agg(F.slice(tokens, 1, EARLIER).alias("known"))
    return rows.join(known, ["id", "n"]).withColumn("earlier", F.filter("known", lambda x: x < F.col("token"))).drop("known")


def leaves(rows: DataFrame) -> DataFrame:
    """R-tree leaves: up to ``LEAF`` points of a token, with the ranges of their sizes and components."""
    order = ["token", "n", "counts", "id"]

    def leaf(number: int, held: list[tuple]) -> pa.RecordBatch:
        points = [unpacked(row[2]) for row in held]
        groups = min(map(len, points))
        points = np.array([folded(p, groups) for p in points])
        points = points.astype("u1" if points.max() < 1 << 8 else "<u4")
        head = np.array([groups, points.itemsize], "<u4").tobytes()
        raw = head + pa.compress(points.tobytes(), codec="zstd", asbytes=True)
        own = [row[4] for row in held]
        values = [held[0][0], number, held[0][1], held[-1][1], min(own), max(own)]
        values += [[row[i] for row in held] for i in (3, 1, 4, 5)] + [raw]
        types = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 3 + [pa.list_(pa.list_(pa.int64())), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], LEAVES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 33, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if held and (held[0][0] != row[0] or len(held) == LEAF):
                    yield leaf(number, held)
                    number, held = number + 1, []
                held.append(row)
        if held:
            yield leaf(number, held)

    ranged = rows.select(*order, "component", "earlier").repartitionByRange(*order).sortWithinPartitions(*order)
    types = ["long"] * 6 + ["array<long>"] * 3 + ["array<array<long>>", "binary"]
    return ranged.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(LEAVES, types)))


def crossings(found: DataFrame, similar: Similarity, apart: int | None = None) -> DataFrame:
    """Pairs of different components whose bound allows a link, from pairs of leaves whose boxes do.

    A pair comes from the first crowded bucket it shares, as far as its points know, and may come
    again from others. With ``apart``, leaves meet only the two leaves that are so many places
    further, and a point brings only its closest one there.
    """
    left, right = (found.select(*[F.col(c).alias(f"{side}_{c}") for c in found.columns]) for side in "ab")
    sizes = (100 * F.col("a_high") >= similar.percent * F.col("b_low")) & (
        100 * F.col("b_high") >= similar.percent * F.col("a_low")
    )
    one = F.greatest("a_last", "b_last") == F.least("a_first", "b_first")
    places = F.col("b_leaf") - F.col("a_leaf")
    beside = places >= 0 if apart is None else places.between(apart, apart + 1)
    meet = (F.col("a_token") == F.col("b_token")) & beside & sizes & ~one
    names = ["low", "ids", "sizes", "components", "points", "earlier"]
    pairs = left.join(right, meet).select("a_leaf", "b_leaf", *[f"{side}_{c}" for side in "ab" for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                leaf_a, leaf_b, *sides = (batch.column(c)[i] for c in range(14))
                low_a, ids_a, sizes_a, components_a, points_a = _points(*sides[:5])
                low_b, ids_b, sizes_b, components_b, points_b = _points(*sides[6:11])
                # The corners of the leaves' boxes bound all their pairs.
                if at_most(points_a.max(0), points_b.max(0)) < similar.overlap(low_a, low_b):
                    continue
                groups = min(points_a.shape[1], points_b.shape[1])
                points_a, points_b = (p.reshape(len(p), groups, -1).sum(2, dtype=np.int32) for p in (points_a, points_b))
                fits = similar.sizes(sizes_a[:, None], sizes_b) & (components_a[:, None] != components_b)
                bound = np.array([np.minimum(point, points_b).sum(1) for point in points_a])
                least = similar.overlap(sizes_a[:, None], sizes_b)
                fits &= bound >= least
                if apart is not None:
                    fits = _closest(fits, bound - least)
                elif leaf_a == leaf_b:
                    fits = np.triu(fits)
                at_a, at_b = np.nonzero(fits)
                if apart is None and len(at_a):
                    known_a, known_b = ([set(x) for x in side.as_py()] for side in (sides[5], sides[11]))
                    new = [known_a[a].isdisjoint(known_b[b]) for a, b in zip(at_a.tolist(), at_b.tolist())]
                    at_a, at_b = at_a[new], at_b[new]
                us.append(np.minimum(ids_a[at_a], ids_b[at_b]))
                vs.append(np.maximum(ids_a[at_a], ids_b[at_b]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return pairs.mapInArrow(run, "u long, v long")


def _closest(fits: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Of the pairs that fit, those that have the most to spare in their row or column."""
    spare = np.where(fits, spare, -1)
    best = np.zeros_like(fits)
    best[np.arange(len(fits)), spare.argmax(1)] = True
    best[spare.argmax(0), np.arange(fits.shape[1])] = True
    return best & fits


def _points(low, ids, sizes, components, raw) -> tuple:
    ids, sizes, components = (x.values.to_numpy() for x in (ids, sizes, components))
    raw = raw.as_py()
    groups, width = np.frombuffer(raw, "<u4", 2).tolist()
    points = pa.decompress(raw[8:], len(ids) * groups * width, codec="zstd", asbytes=True)
    return low.as_py(), ids, sizes, components, np.frombuffer(points, f"<u{width}").reshape(-1, groups)


def verified(pairs: DataFrame, docs: DataFrame, words: int, similar: Similarity) -> DataFrame:
    """The pairs whose sets are similar. Sets are taken from the texts of the documents concerned.

    Pairs fall into clusters, whose documents are brought together once. Clusters whose sets
    take more than ``CLUSTER`` bytes are checked pair by pair, in any number of tasks.
    """
    clusters = stored(components(pairs))
    wanted = F.broadcast(clusters) if clusters.count() <= SMALL else clusters
    # Texts move, not sets: they take less than half the space.
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id").select("id", "component", "text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [s.astype("<u8").tobytes() for s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "shingles"])

    sizes = docs.select(F.col("doc_id").alias("id"), F.length("text").alias("size")).join(wanted, "id")
    # A shingle takes 8 bytes and at least two characters of its text.
    large = sizes.groupBy("component").agg(F.sum("size").alias("size")).filter(F.col("size") * 4 > CLUSTER)
    large = stored(large.select("component"))
    placed = pairs.join(clusters.withColumnRenamed("id", "u"), "u").select(F.col("component").alias("cluster"), "u", "v")

    def check_cluster(members: pa.Table, asked: pa.Table) -> pa.Table:
        held = dict(zip(members.column("id").to_pylist(), shingle_sets(members.column("text").combine_chunks(), words)))
        u, v = asked.column("u").to_pylist(), asked.column("v").to_pylist()
        keep = [_alike(held[a], held[b], similar) for a, b in zip(u, v)]
        return asked.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(c)] for c in (2, 3))
            keep = [_alike(a, b, similar) for a, b in zip(*sets)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = "u long, v long"
    if large.isEmpty():
        return texts.groupBy("component").cogroup(placed.groupBy("cluster")).applyInArrow(check_cluster, links)
    of_pairs = large.withColumnRenamed("component", "cluster")
    small_texts, small = texts.join(large, "component", "left_anti"), placed.join(of_pairs, "cluster", "left_anti")
    together = small_texts.groupBy("component").cogroup(small.groupBy("cluster")).applyInArrow(check_cluster, links)
    big_texts, big = texts.join(large, "component", "left_semi"), placed.join(of_pairs, "cluster", "left_semi")
    big_sets = stored(big_texts.select("id", "text").mapInArrow(sets_of, "id long, shingles binary"))
    first, second = (big_sets.select(F.col("id").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "uv")
    both = big.join(first, "u").join(second, "v").select("u", "v", "u_set", "v_set")
    return together.unionByName(both.mapInArrow(check, links))


def _alike(a: np.ndarray, b: np.ndarray, similar: Similarity) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= similar.percent * (len(a) + len(b) - shared)


def similar_documents(
    docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Two documents link if the Jaccard similarity of their sets of shingles (``words`` words, A-Z
    lower-cased, split at ASCII white space) is at least ``percent`` percent. A document with
    fewer words has its whole sequence as one shingle; one without words or text has an empty
    set and links with nothing. All links that join components are found:

    Documents with equal sets are one point. Similar sets share a shingle of their prefixes (in
    one order for all documents, by rarity); rows of a shingle are its bucket. Points of a
    bucket are group counts of the sets, and the sum of the smaller counts bounds an
    intersection. First, neighbours in the buckets' sorted order are verified and united, which
    settles groups of copies with few comparisons. In buckets of many points and several components,
    points then meet the closest ones of the leaves beside theirs, as long as that unites any.
    Then all other pairs of a bucket are looked
    at between its components: their points are packed into R-tree leaves, pairs of leaves whose
    boxes rule out a link are skipped, and the pairs that remain are verified on their sets.

    Rows that repeat an id are documents of their own in all but verification, where any row of
    the id counts. A NULL id gets a NULL component unless a document with an equal set has an
    id. Shingles are told apart by 64-bit hashes. An empty table gives an empty one; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    similar = Similarity(percent)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = features(docs, words, similar, rarity(docs, words)).filter("n > 0 AND doc_id IS NOT NULL")
    points = found.groupBy("s1", "s2", "n").agg(
        F.min("doc_id").alias("id"), F.first("prefix").alias("prefix"), F.first("counts").alias("counts")
    )
    points = stored(points)
    del found
    release(docs.sparkSession)
    counts = points.select("id", "counts").dropDuplicates(["id"])
    shared = stored(shared_prefixes(points, similar))
    release(docs.sparkSession)
    # A few shingles of each point are enough to unite groups of copies; the rest of the work finds all pairs.
    own = Window.partitionBy("id").orderBy("token")
    some = shared.withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= FIRST).drop("nth")
    near = stored(neighbours(some.join(counts, "id"), similar))
    release(docs.sparkSession)
    links = stored(verified(near, docs, words, similar))
    release(docs.sparkSession)
    labels = stored(components(links))

    rest = stored(contested(labelled_by(shared, labels)))
    release(docs.sparkSession)
    quiet, crowd = rest.filter("NOT crowded"), rest.filter("crowded")
    before = labels
    nothing = F.array().cast("array<long>").alias("earlier")
    for turn in range(ROUNDS):
        if crowd.isEmpty():
            break
        bare = crowd.select("token", "n", "id", "component", nothing)
        close = crossings(stored(leaves(bare.join(counts, "id"))), similar, 2 * turn).distinct()
        more = stored(verified(stored(close), docs, words, similar))
        release(docs.sparkSession)
        if more.isEmpty():
            break
        links = stored(links.unionByName(more))
        labels = stored(components(links))
        crowd = stored(contested(labelled_by(crowd, labels)))
        release(docs.sparkSession)
    if labels is not before:
        # The rounds read crowded buckets only; what they united is taken out of the others once.
        quiet = still_contested(labelled_by(quiet, labels))
        rest = stored(quiet.unionByName(crowd))
        release(docs.sparkSession)
    packed_leaves = stored(leaves(with_earlier(rest).join(counts, "id")))
    release(docs.sparkSession)
    others = stored(crossings(packed_leaves, similar).distinct())
    del packed_leaves
    release(docs.sparkSession)
    if not others.isEmpty():
        links = links.unionByName(verified(others, docs, words, similar))
        labels = stored(components(stored(links)))

    classes = points.select("s1", "s2", "n", "id").join(labels, "id", "left")
    classes = stored(classes.select("s1", "s2", "n", F.coalesce("component", "id").alias("component")))
    rows = members(docs, words).withColumn("salt", salt(F.col("doc_id"), SALTS))
    rows = rows.join(copies(classes, SALTS), ["s1", "s2", "n", "salt"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
