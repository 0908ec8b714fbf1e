"""The registered queries of the operators, and DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.llm import (
    hard_negatives,
    huffman_ids,
    multi_index,
    ngram_join,
    packing,
    piece_counts,
    pitman_yor,
    poisson_mix,
    projection_passes,
    site_lines,
    spelling,
    toxicity,
    url_boost,
)
from aftershock.llm.shared import fold_of, scratch, stored
from aftershock.llm.statements import ORACLE_SQL as ORACLE_SQL
from aftershock.llm.word_ids import tokenizer_path

# The rules of the URL query.
RULES = [
    url_boost.Rule("block", "net", "/"),
    url_boost.Rule("allow", "example.net", "/en/"),
    url_boost.Rule("block", "example.com", "/de/"),
    url_boost.Rule("allow", "org", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "padded",
    )


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt outside the held-out fold, scored everywhere."""
    held_out = fold_of(F.col("doc_id"), 7) == 2
    scored = pitman_yor.score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), *scored.columns[1:])


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed by the square root of their sizes."""
    mixed = poisson_mix.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.withColumns({"rate": F.round("rate", 9), "copy": F.col("copy").cast("long")})


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_boost.judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, read back, and the files removed."""
    with scratch(spark, "ids") as path:
        huffman_ids.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path())
        digest = huffman_ids.read_ids(spark, path).select(
            "doc_id",
            "start",
            (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
            F.crc32("ids").alias("ids_crc32"),
        )
        return stored(digest)


def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = site_lines.drop_site_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "source", "lines", "dropped", "text")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt outside the held-out fold, scored everywhere."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs.filter(~held_out), labels.filter(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted)


def op10_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_passes.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all texts, of which every 31st or so occurrence loses a letter."""
    runs = spelling.runs(table(spark, sf_dir, "documents"))
    run, size = F.col("run"), F.length("run")
    hashed = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), run).cast("binary"))
    place = (hashed % size).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, size))
    word = F.when(hashed % 31 == 0, shorter).otherwise(run).alias("word")
    # Shorter runs make no word of seven letters; saves hashing them.
    words = spelling.vocabulary(runs.filter(size >= 7).select(word), least_size=7, least_n=2)
    return spelling.group_variants(words, ratio=10)


def op12_resync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(piece_counts.MODEL))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label changed, components in whole 256ths."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # The floor of NaN would be 0, that of an infinity the greatest long.
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    scaled = F.transform("embedding", lambda x: F.when(finite(x), F.floor(256 * x.cast("double")).cast("double")))
    rows = rows.select("vec_id", label.alias("label"), scaled.alias("vector"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, lower=30, upper=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_pitman_yor": op2_pitman_yor,
    "op3_poisson_mix": op3_poisson_mix,
    "op4_url_verdicts": op4_url_verdicts,
    "op5_huffman_ids": op5_huffman_ids,
    "op6_site_lines": op6_site_lines,
    "op7_multi_index": op7_multi_index,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_nnpu_toxicity": op9_nnpu_toxicity,
    "op10_projection_dedup": op10_projection_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_resync_counts": op12_resync_counts,
    "op13_hard_negatives": op13_hard_negatives,
}
