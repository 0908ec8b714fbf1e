"""A training corpus from raw documents, stage by stage.

Every stage gives an empty table for an empty one. Documents without id or text, with empty
texts and with repeated ids pass through like others; what each stage does with them is
stated there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.llm import ngram_join, packing, poisson_mix, site_lines, toxicity
from aftershock.llm.shared import scratch, stored
from aftershock.llm.word_ids import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.5
# Scores, near duplicates and packing are no SQL.
ORACLE_SQL: str | None = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from all labels, takes for toxic go.

    Each row is scored by its own text, so rows of one id may go their own ways. A NULL or empty text
    has the score of a text without any known word, and stays unless that alone is toxic.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every row stays, a NULL text as NULL with NULL characters."""
    kept = site_lines.drop_site_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similar five-word shingles (0.8) the one with the smallest id stays.

    Documents without words or id stay; rows that repeat an id stay or go together.
    """
    groups = ngram_join.similar_documents(docs, words=5, percent=80)
    gone = groups.filter("n_shingles > 0 AND component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources go by the square root of their sizes, in random order.

    Rows of one id, or without one and of one text, are repeated alike.
    """
    return poisson_mix.mix_sources(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, in the order of the mixed documents; a NULL text is an empty document."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", one_of_each),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written and read again.

    What is written goes when the last result is stored.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark, "corpus") as folder:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return stored(STAGES[-1][1](spark, docs, sf_dir))
