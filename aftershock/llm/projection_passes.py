"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, pi

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aftershock.llm.shared import components, copies, salt, stored
from aftershock.llm.vectors import matrix, takes_part

# Passes at least; more follow from the vectors and their number, see passes_for.
PASSES = 16
# Vectors on which the number of passes is measured, at most.
SAMPLE = 2048
MEAN_SCALE = float(1 << 30)
WINDOW = 32
# Share of the isolated pairs right at the threshold that some pass has to bring together.
RECALL = 0.99
# Random hashes (signs of projections) in a sort key.
HASHES = 63
SEED = 5
SALTS = 16
# Angles to a component's centre are counted in so many bins up to the threshold.
ANGLES = 1024
# Blocks of a component, and the vectors that a block holds at least and at most.
BLOCKS = 64
LEAST_BLOCK, LARGEST_BLOCK = 256, 16_384
# Cosines computed at a time.
CELLS = 4_000_000
# Rows of a range of the sorted order, at least: neighbours reach over one seam only.
RANGE = 16 * WINDOW
KEYS = "dimensions int, pass int, hash long, id long, vector "
FOUND = "u long, v long, part int, first boolean, dimensions int, pass int, id long, vector "


def means(vectors: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each dimension, how many vectors (id, vector) there are and the mean of the normalised ones.

    Components are added up as whole numbers, so that the mean does not depend on the order of the rows.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths())
            for d in np.unique(sizes).tolist():
                values = _normalised(matrix(batch.column(0).take(pa.array(np.flatnonzero(sizes == d))), d))
                totals[d] = totals.get(d, 0) + np.rint(values * MEAN_SCALE).astype(np.int64).sum(0)
                counts[d] = counts.get(d, 0) + len(values)
        for d, total in totals.items():
            columns = [pa.array([x] * d, t) for x, t in ((d, pa.int32()), (counts[d], pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(range(d), pa.int32()), pa.array(total)], ["d", "n", "at", "total"])

    summed = vectors.select("vector").mapInArrow(add, "d int, n long, at int, total long")
    found: dict[int, tuple[int, np.ndarray]] = {}
    # A row per component of each dimension.
    for row in summed.groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        n, mean = found.setdefault(row.d, (row.n, np.zeros(row.d)))
        mean[row["at"]] = row.total / MEAN_SCALE / n
    return found


def _normalised(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt((values**2).sum(1))[:, None]


def _agreement(cosines: np.ndarray) -> np.ndarray:
    """The chance that vectors of such cosines lie on the same side of a random plane."""
    return 1 - np.arccos(np.clip(cosines, -1, 1)) / pi


def passes_for(n: int, sample: np.ndarray, mean: np.ndarray, cosine: float, window: int = WINDOW) -> int:
    """Passes that bring a pair at the threshold into one window with a chance of ``RECALL``, measured on a sample.

    Hashes are signs of what is left of the normalised vectors without their ``mean``. For each
    vector of the sample a partner right at the threshold is made, towards another vector of
    the sample. The pair's angle gives the chance of a common sign, and the chances of the
    vector with all others of the sample tell how many first signs it has to share with one
    until a window holds all that do, among ``n`` vectors. Vectors that link with it do not
    crowd it. There is no upper limit.
    """
    if len(sample) < 3 or n <= window:
        return PASSES
    unit = _normalised(sample)
    rest = _normalised(unit - mean + 1e-300)
    others = unit[np.roll(np.arange(len(unit)), 1)]
    aside = others - (others * unit).sum(1)[:, None] * unit
    length = np.sqrt((aside**2).sum(1))
    usable = length > 1e-6
    if not usable.any():
        return PASSES
    partner = cosine * unit + np.sqrt(1 - cosine**2) * aside / np.maximum(length, 1e-6)[:, None]
    together = _agreement((rest * _normalised(partner - mean + 1e-300)).sum(1))
    crowd = _agreement(rest @ rest.T)
    crowd[unit @ unit.T >= cosine] = 0
    signs, shared = np.full(len(unit), HASHES), np.ones_like(crowd)
    for b in range(1, HASHES):
        shared *= crowd
        fits = (n * shared.mean(1) <= window) & (signs == HASHES)
        signs[fits] = b
        if (signs < HASHES).all():
            break
    missed = 1 - np.clip(together[usable] ** signs[usable], 1e-9, 1 - 1e-9)
    passes = PASSES
    while (missed**passes).mean() > 1 - RECALL:
        passes += max(1, passes // 16)
    return passes


def _keys(batches: Iterator[pa.RecordBatch], passes: int, mean_of: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    planes: dict[tuple[int, int], np.ndarray] = {}
    weights = 1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        sizes = np.asarray(batch.column(1).value_lengths())
        for d in np.unique(sizes).tolist():
            rows = batch.take(pa.array(np.flatnonzero(sizes == d)))
            values = _normalised(matrix(rows.column(1), d)) - mean_of[d]
            for p in range(passes):
                if (d, p) not in planes:
                    planes[d, p] = np.random.default_rng([SEED, d, p]).standard_normal((d, HASHES))
                hashes = (values @ planes[d, p] >= 0) @ weights
                same = [pa.array(np.full(len(values), x), pa.int32()) for x in (d, p)]
                columns = [*same, pa.array(hashes), rows.column(0), rows.column(1)]
                yield pa.RecordBatch.from_arrays(columns, ["dimensions", "pass", "hash", "id", "vector"])


def _linked(ids: np.ndarray, values: np.ndarray, window: int, cosine: float, seam: int | None = None) -> tuple:
    """Pairs of rows at most ``window`` apart with at least that cosine; across ``seam`` only if given."""
    norms = np.sqrt((values**2).sum(1))
    found_u, found_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(window, len(ids) - 1) + 1):
        cosines = np.einsum("ij,ij->i", values[:-step], values[step:]) / (norms[:-step] * norms[step:])
        hit = np.flatnonzero(cosines >= cosine)
        if seam is not None:
            hit = hit[(hit < seam) & (hit + step >= seam)]
        found_u.append(ids[hit])
        found_v.append(ids[hit + step])
    u, v = np.concatenate(found_u), np.concatenate(found_v)
    return np.minimum(u, v), np.maximum(u, v)


def _pairs(u: np.ndarray, v: np.ndarray, vectors: pa.DataType) -> pa.RecordBatch:
    n = len(u)
    empty = [pa.nulls(n, t) for t in (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), vectors)]
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *empty], [c.split()[0] for c in FOUND.split(", ")])


def _seam(rows: pa.Table, first: bool) -> pa.RecordBatch:
    n = rows.num_rows
    columns = [
        pa.nulls(n, pa.int64()),
        pa.nulls(n, pa.int64()),
        pa.array([TaskContext.get().partitionId()] * n, pa.int32()),
        pa.array([first] * n),
        *(rows.column(c).combine_chunks() for c in ("dimensions", "pass", "id", "vector")),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])


def _runs(rows: pa.Table) -> Iterator[tuple[int, int, int]]:
    """Stretches of one dimension and pass: begin, end, dimension."""
    d, p = rows.column("dimensions").to_numpy(), rows.column("pass").to_numpy()
    edges = np.flatnonzero((np.diff(d) != 0) | (np.diff(p) != 0)) + 1
    for a, b in zip([0, *edges], [*edges, len(d)]):
        if b > a:
            yield int(a), int(b), int(d[a])


def links(vectors: DataFrame, cosine: float, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """Distinct pairs u < v of (id, vector) rows found with at least that cosine.

    In each pass the rows are sorted by a key of ``HASHES`` random signs, one after the other,
    and compared with their ``window`` next ones. The sorted order of all passes is dealt out
    in ranges; the ends of neighbouring ranges are compared in a second step. Without
    ``passes`` their number follows from the rows by :func:`passes_for`. Vectors travel as they are,
    floats or doubles; cosines are computed in doubles.
    """
    spark = vectors.sparkSession
    middle = means(vectors)
    rows = sum(n for n, _ in middle.values())
    if passes is None:
        drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()  # at most ``SAMPLE`` vectors
        passes = PASSES
        for d, (n, mean) in middle.items():
            sample = np.array([r.vector for r in drawn if len(r.vector) == d], np.float64).reshape(-1, d)
            passes = max(passes, passes_for(n, sample, mean, cosine, window))
    kind = vectors.schema["vector"].dataType.simpleString()
    mean_of = {d: mean for d, (_, mean) in middle.items()}
    hashed = vectors.mapInArrow(lambda batches: _keys(batches, passes, mean_of), KEYS + kind)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(ranges * 4, rows * passes // RANGE))
    order = ["dimensions", "pass", "hash", "id"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        first_done = False
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            old = held.num_rows if held is not None else 0
            rows = pa.concat_tables([held, rows]) if old else rows
            for a, b, d in _runs(rows):
                ids, values = rows.column("id").to_numpy()[a:b], matrix(rows.column("vector").slice(a, b - a).combine_chunks(), d)
                u, v = _linked(ids, values, window, cosine)
                yield _pairs(u, v, rows.schema.field("vector").type)
            if not first_done:
                yield _seam(rows.slice(0, window), True)
                first_done = True
            held = rows.slice(max(0, rows.num_rows - window))
        if held is not None:
            yield _seam(held, False)

    ranged = hashed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = stored(ranged.mapInArrow(compare, FOUND + kind))
    ends = found.filter("u IS NULL").drop("u", "v")
    parts = ends.select("part").distinct()
    # A row per range: few.
    numbered = parts.withColumn("number", F.row_number().over(Window.orderBy("part")))
    seam = F.when(F.col("first"), F.col("number") - 1).otherwise(F.col("number"))
    ends = ends.join(numbered, "part").withColumn("seam", seam)

    def across(rows: pa.Table) -> pa.Table:
        before = rows.filter(pa.compute.invert(rows.column("first")))
        after = rows.filter(rows.column("first"))
        key = lambda t: (t.column("dimensions")[0].as_py(), t.column("pass")[0].as_py())
        none, vector = np.zeros(0, np.int64), rows.schema.field("vector").type
        out = [_pairs(none, none, vector)]
        if before.num_rows and after.num_rows:
            last = list(_runs(before))[-1]
            start = list(_runs(after))[0]
            before, after = before.slice(last[0]), after.slice(0, start[1])
            if key(before) == key(after):
                both = pa.concat_tables([before, after])
                values = matrix(both.column("vector").combine_chunks(), last[2])
                out.append(_pairs(*_linked(both.column("id").to_numpy(), values, window, cosine, before.num_rows), vector))
        return pa.Table.from_batches(out).select(["u", "v"])

    ordered = ends.select("seam", "first", "dimensions", "pass", "id", "vector", F.col("number"))
    seams = ordered.groupBy("seam").applyInArrow(across, "u long, v long")
    return found.filter("u IS NOT NULL").select("u", "v").unionByName(seams).filter("u <> v").distinct()


def near_duplicates(
    vectors: DataFrame,
    cosine: float = 0.9,
    key: str = "vec_id",
    vector: str = "embedding",
    passes: int | None = None,
    window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links counts other vectors that link directly, with a cosine (in double precision) of at
    least ``cosine``; component_id is the smallest id reachable by links, kept whether that is
    the vector itself. Equal vectors are first reduced to classes, which are compared by
    :func:`links`; the links found in all passes are united to components.

    A group of many near copies has more links than windows can show. So the passes only find
    the components, and all links inside a component are counted by :func:`_counted`.

    Vectors that are NULL, empty, zero or have NULL or non-finite components link with nothing,
    nor do those with a NULL id or of different dimensions. Rows that repeat an id or a vector
    are vectors of their own. An empty table gives an empty one; other columns are ignored.
    """
    sound = takes_part(F.col(vector)) & F.col(key).isNotNull()
    floats = vectors.schema[vector].dataType.simpleString() == "array<float>"
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"),
        F.when(sound, F.xxhash64(F.lit(1), F.col(vector))).alias("h1"),
        F.when(sound, F.xxhash64(F.lit(2), F.col(vector))).alias("h2"),
        F.when(sound, F.col(vector) if floats else F.col(vector).cast("array<double>")).alias("vector"),
    )
    classes = rows.filter("h1 IS NOT NULL").groupBy("h1", "h2")
    classes = classes.agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    # Different vectors under one repeated id are one place in the graph.
    classes = stored(classes)
    found = stored(links(classes.select("id", "vector"), cosine, passes, window))
    labels = components(found)

    per_class = _counted(classes.join(labels, "id"), cosine)
    per_class = classes.select("h1", "h2", "id", "n").join(stored(per_class), ["h1", "h2"], "left")
    per_class = stored(
        per_class.select(
            "h1",
            "h2",
            F.coalesce("component", "id").alias("component"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
        )
    )
    members = rows.select("vec_id", "h1", "h2").withColumn("salt", salt(F.col("vec_id"), SALTS))
    members = members.join(copies(per_class, SALTS), ["h1", "h2", "salt"], "left")
    component = F.coalesce("component", "vec_id")
    return members.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _counted(linked: DataFrame, cosine: float) -> DataFrame:
    """A row (h1, h2, component, links) per class: exact counts of the other vectors of its component that link.

    ``linked`` has the columns h1, h2, id, n, vector and component. A component is cut into blocks in
    the order of the angles to its smallest member, and blocks are compared with each other as
    matrices, each pair of blocks in a place of its own. Two angles to the centre bound the
    angle between vectors by their sum and their difference: pairs of blocks that link
    throughout are counted as wholes, pairs that cannot link are left out. A block of a
    component of m vectors holds m / ``BLOCKS`` of them within ``LEAST_BLOCK`` and
    ``LARGEST_BLOCK``, so a vector travels about ``BLOCKS`` times, or m / ``LARGEST_BLOCK`` if
    that is more.
    """
    centres = linked.filter("id = component").groupBy("component").agg(F.min("vector").alias("centre"))
    spread = linked.withColumn("salt", salt(F.col("id"), SALTS)).join(copies(centres, SALTS), ["component", "salt"])
    dot = _dot("vector", "centre") / (F.sqrt(_dot("vector", "vector")) * F.sqrt(_dot("centre", "centre")))
    bins = F.floor(F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))) / (acos(cosine) / ANGLES) + 1e-6)
    placed = stored(spread.select("h1", "h2", "component", "n", "vector", bins.cast("int").alias("bin")))

    # A row per bin that occurs: few for any component.
    held = placed.groupBy("component", "bin").agg(F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("component")
    size = F.least(F.greatest(F.ceil(F.sum("rows").over(whole) / BLOCKS), F.lit(LEAST_BLOCK)), F.lit(LARGEST_BLOCK))
    held = held.select("component", "bin", "rows", (F.sum("rows").over(whole.orderBy("bin")) - F.col("rows")).alias("before"), size.alias("size"))
    at = F.col("before") + F.pmod(F.xxhash64(F.lit(SEED), "h1"), F.col("rows"))
    blocked = placed.withColumn("salt", salt(F.col("h2"), SALTS)).join(copies(held, SALTS), ["component", "bin", "salt"])
    blocked = stored(blocked.select("h1", "h2", "component", "n", "vector", "bin", F.floor(at / F.col("size")).alias("block")))

    blocks = blocked.groupBy("component", "block").agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.sum("n").alias("n"))
    first = blocks.select("component", F.col("block").alias("a"), F.col("high").alias("a_high"), F.col("n").alias("a_n"))
    second = blocks.select("component", F.col("block").alias("b"), "low", F.col("high").alias("b_high"), F.col("n").alias("b_n"))
    # Bins are a bin wide and rounded down: the sum of two angles is never taken for less, the difference never for more.
    pairs = first.join(second, "component").filter((F.col("a") <= F.col("b")) & (F.col("low") - F.col("a_high") <= ANGLES + 1))
    pairs = stored(pairs.withColumn("sure", F.col("a_high") + F.col("b_high") <= ANGLES - 2))

    sure = pairs.filter("sure").select("component", F.col("a").alias("block"), F.col("b_n").alias("certain"))
    mirrored = pairs.filter("sure AND a < b").select("component", F.col("b").alias("block"), F.col("a_n").alias("certain"))
    own = pairs.filter("a = b").select("component", F.col("a").alias("block"), F.when(F.col("sure"), 1).otherwise(0).alias("own"))
    sure = sure.unionByName(mirrored).groupBy("component", "block").agg(F.sum("certain").alias("certain"))
    certain = blocked.select("h1", "h2", "component", "block", "n").join(own, ["component", "block"]).join(sure, ["component", "block"], "left")
    # A vector is no link of its own.
    certain = certain.select("h1", "h2", "component", (F.coalesce("certain", F.lit(0)) - F.col("own") * F.col("n")).alias("links"))

    wanted = pairs.filter("NOT sure").select("component", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    meeting = blocked.drop("bin").join(wanted, ["component", "block"])
    meeting = meeting.select("component", "a", "b", "block", "h1", "h2", "n", "vector")
    meeting = meeting.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "block")
    compared = meeting.mapInArrow(lambda batches: _compared(batches, cosine), "h1 long, h2 long, component long, links long")
    return certain.unionByName(compared).groupBy("h1", "h2", "component").agg(F.sum("links").alias("links"))


def _compared(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Links of the rows of each (component, a, b): between blocks a and b, or within a if they are the same."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        columns = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
        edges = [0, *(np.flatnonzero((np.diff(columns, axis=0) != 0).any(1)) + 1).tolist(), len(columns)]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                own = tuple(columns[start].tolist())
                if held and own != key:
                    yield _compare(held, cosine)
                    held = []
                held.append(batch.slice(start, end - start))
                key = own
    if held:
        yield _compare(held, cosine)


def _compare(held: list[pa.RecordBatch], cosine: float) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    component, a, b, block, h1, h2, n = (rows.column(c).to_numpy() for c in range(7))
    vectors = rows.column(7).combine_chunks()
    values = matrix(vectors, len(vectors[0]))
    norms = np.sqrt((values**2).sum(1))
    # Rows are sorted by block; within one block they meet themselves.
    cut = int(np.searchsorted(block, a[0], side="right"))
    begin = 0 if a[0] == b[0] else cut
    n = n.astype(np.float64)
    links = np.zeros(len(n))
    step = max(1, CELLS // (len(n) - begin))
    for start in range(0, cut, step):
        end = min(cut, start + step)
        hit = values[start:end] @ values[begin:].T / (norms[start:end, None] * norms[begin:]) >= cosine
        hit = hit.astype(np.float64)
        if begin == 0:
            hit[np.arange(end - start), np.arange(start, end)] = 0
        else:
            links[begin:] += n[start:end] @ hit
        links[start:end] += hit @ n[begin:]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, component, links.astype(np.int64))], ["h1", "h2", "component", "links"])


def _dot(a: str, b: str):
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
