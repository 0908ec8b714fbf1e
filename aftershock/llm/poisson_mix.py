"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.llm.shared import copies, stored

SEED = 11
ALPHA = 0.5
SALTS = 32
# Sources up to which their table (a few hundred bytes each) is broadcast, so that texts move only once.
FEW_SOURCES = 10_000
# A rate is split into independent parts of at most this mean: exp(-mean) must not vanish.
PART_MEAN = 32.0
BITS = 52


def unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 over the parts."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *texts))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") / float(2**BITS)


def identity(key: Column, text: Column) -> Column:
    """What a document's number is drawn from: its id, or the digest of its text where it has none."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def source_rates(docs: DataFrame, source: str, text: str, weights: dict[str, float] | None, alpha: float) -> DataFrame:
    """(source, rate): how often a document of the source is wanted, so that shares of text follow the weights.

    Without ``weights`` the target share of a source goes with its size to the power ``alpha``.
    A source that ``weights`` does not name gets none; one without any text keeps its documents
    about once each.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("size")
    )
    if weights is None:
        wanted = F.pow("size", F.lit(float(alpha)))
    else:
        named = [F.lit(x) for pair in weights.items() for x in (str(pair[0]), float(pair[1]))]
        wanted = F.coalesce(F.element_at(F.create_map(*named), F.coalesce("source", F.lit(""))), F.lit(0.0))
    sizes = sizes.withColumn("wanted", F.when(F.col("size") > 0, wanted).otherwise(0.0))
    whole = sizes.agg(F.sum("size").alias("all_size"), F.sum("wanted").alias("all_wanted"))
    rate = F.col("wanted") / F.col("all_wanted") * F.col("all_size") / F.col("size")
    # One row of totals: bounded.
    return sizes.join(F.broadcast(whole)).select(
        "source", F.when(F.col("size") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(1.0).alias("rate")
    )


def poisson_steps(mean: Column) -> Column:
    """The distribution function of a Poisson variable at 0, 1, 2 … until it is 1 but for rounding."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 12).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("steps"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(
            p.alias("p"), F.concat(state["steps"], F.array(F.element_at(state["steps"], -1) + p)).alias("steps")
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["steps"])


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = ALPHA,
    seed: int = SEED,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Repeat every document a Poisson number of times, so that sources reach their weights, and shuffle.

    Adds ``rate`` (the source's mean number of copies) and ``copy`` (from 1). The number is
    the Poisson distribution with that mean, inverted at a hash of seed and id, so a run can be
    repeated and a document's number does not depend on others of its source. Rates over
    ``PART_MEAN`` are drawn as a sum of equal parts, which has the same distribution.

    The result's rows are in random order: dealt by a hash of seed, id and copy, and sorted by
    it within each partition. A NULL source is a source of its own; a document without an id is drawn
    by its text; rows with the same id, or without one and with the same text, get the same
    number; a NULL text has size 0. An empty table gives an empty one. Input columns ``rate`` and
    ``copy`` are replaced.

    The table of sources is broadcast while it has at most ``FEW_SOURCES`` rows, else joined by
    source and salt, so that the rows of a large source spread.
    """
    rates = source_rates(docs, source, text, weights, alpha).withColumn(
        "parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int")
    )
    rates = rates.withColumn("steps", poisson_steps(F.col("rate") / F.col("parts")))
    rates = stored(rates.withColumnRenamed("source", "of"))
    kept = [c for c in docs.columns if c not in ("rate", "copy")]
    rows = docs.select(
        F.struct(*[F.col(c) for c in kept]).alias("row"),
        identity(F.col(key), F.col(text)).alias("who"),
        # By place: rows of one id may be many.
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"),
    )
    same = F.col(f"row.{source}").eqNullSafe(F.col("of"))
    if rates.count() <= FEW_SOURCES:
        matched = rows.join(F.broadcast(rates), same)
    else:
        rates = copies(rates, SALTS)
        matched = rows.join(rates, same & (rows["salt"] == rates["salt"]))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")),
        F.lit(0),
        lambda n, part: n + F.size(F.filter("steps", lambda x: x <= unit(seed, F.col("who"), part))),
    )
    repeated = matched.select("row", "who", rows["salt"], "rate", drawn.alias("n")).filter("n > 0")
    repeated = repeated.select("row", "who", "salt", "rate", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    order = F.xxhash64(F.lit(seed), F.col("who"), F.col("copy"))
    shuffled = repeated.withColumn("order", order).repartition("order", "salt").sortWithinPartitions("order")
    return shuffled.select(*[F.col(f"row.{c}").alias(c) for c in kept], "rate", "copy")
