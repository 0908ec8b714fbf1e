"""What the operators share: stored steps, salts, row groups and connected components."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.session import scratch as scratch
from aftershock.session import shared_dir

LOCAL_EDGES = 2_000_000
# Edges that one task finishes; more are contracted in rounds of joins first.
FINISHED = 400_000
MAX_ROUNDS = 60


def stored(frame: DataFrame) -> DataFrame:
    """Compute a frame once, into the shared checkpoint folder, and cut its lineage."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


# Bytes of texts that come to a Python worker at once.
BATCH = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in batches of a few MB; it counts rows alone up to 64 MB.

    A worker holds a batch several times over, so this bounds its memory however long the texts
    are. A smaller setting stays.
    """
    now = int(re.match(r"-?\d+", spark.conf.get(BATCH_SETTING, str(64 << 20))).group())
    if not 0 < now <= BATCH:
        spark.conf.set(BATCH_SETTING, str(BATCH))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that have been stored.

    It does so when the driver's garbage is collected, which can be long after a chain of
    large steps has filled the disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def salt(by: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")


def copies(frame: DataFrame, salts: int) -> DataFrame:
    """One copy of each row per salt, for the small side of a salted join."""
    return frame.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (u, v): a row (id, component) per id on an edge.

    The component is the smallest id that can be reached. Each round first replaces the edges
    of a partition by a spanning forest of them (union-find over at most ``LOCAL_EDGES`` edges
    at a time), points every id to its smallest neighbour, follows those pointers to their
    roots and contracts the edges to the roots. A hub with many edges costs no task more than
    its share: forests shrink it before each shuffle, and minima combine on the map side. What
    is left when at most ``FINISHED`` edges are is finished in one task.
    """
    edges = _forest(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    edges = stored(edges.filter("u <> v").distinct())
    labels: DataFrame | None = None
    for _ in range(MAX_ROUNDS):
        left = edges.count()
        if not left:
            break
        if left <= FINISHED:
            ends = edges.repartition(1).mapInArrow(_local_labels, "id long, root long")
            labels = stored(ends if labels is None else _follow(labels, stored(ends)))
            break
        both = edges.select(F.col("u").alias("id"), F.col("v").alias("near")).unionByName(
            edges.select(F.col("v").alias("id"), F.col("u").alias("near"))
        )
        parents = both.groupBy("id").agg(F.min("near").alias("near"))
        parents = stored(parents.select("id", F.least("id", "near").alias("root")))
        parents = _roots(parents)
        labels = parents if labels is None else stored(_follow(labels, parents))
        moved = _renamed(_renamed(edges, parents, "u"), parents, "v").filter("u <> v")
        moved = moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        edges = stored(_forest(moved).distinct())
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    if labels is None:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return labels.select("id", F.col("root").alias("component"))


def _renamed(edges: DataFrame, parents: DataFrame, end: str) -> DataFrame:
    names = parents.select(F.col("id").alias(end), F.col("root").alias("to"))
    return edges.join(names, end).withColumn(end, F.col("to")).drop("to")


def _follow(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """Labels of former rounds, brought to the roots of this one."""
    step = parents.select(F.col("id").alias("root"), F.col("root").alias("further"))
    old = labels.join(step, "root", "left").select("id", F.coalesce("further", "root").alias("root"))
    return old


def _roots(parents: DataFrame) -> DataFrame:
    """Pointers followed to their ends; each step doubles the distance covered."""
    for _ in range(MAX_ROUNDS):
        step = parents.select(F.col("id").alias("root"), F.col("root").alias("further"))
        # Only roots that are no ends are looked up, so hubs join with nothing.
        step = step.filter("root <> further")
        open_ends = parents.join(step, "root", "left")
        parents_next = stored(open_ends.select("id", F.coalesce("further", "root").alias("root"), "further"))
        done = parents_next.filter("further IS NOT NULL").isEmpty()
        parents = parents_next.select("id", "root")
        if done:
            return parents
    raise RuntimeError("pointers did not settle")


def _forest(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_local_forest, "u long, v long")


def _local_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = pa.Table.from_batches(_local_forest(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    roots = forest.column("u").unique()
    ids = pa.concat_arrays([forest.column("v").combine_chunks(), roots])
    ends = pa.concat_arrays([forest.column("u").combine_chunks(), roots])
    yield pa.RecordBatch.from_arrays([ids, ends], ["id", "root"])


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        pairs = [(find(x), x) for x in parent]
        pairs = [(a, b) for a, b in pairs if a != b]
        parent.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["u", "v"]
        )

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > LOCAL_EDGES:
            yield flush()
    if parent:
        yield flush()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the row limits in them; NULL is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    _, offsets, data = column.buffers()
    limits = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(limits):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[limits[0] : limits[-1]], limits - limits[0]
