"""The corpus pipeline: raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
A stage's output is written as Parquet and read again before the next, so a lost executor costs a stage at most.
Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns are treated as the operators'
own docstrings say; extra columns stay with their rows up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import exact, language, mixing, packing, simhash
from brindle.llm.common import held_out, shared_folder
from brindle.llm.queries import tokenizer_file

#: A text whose n-grams are further than this from every profile has no known language.
LEAST_LANGUAGE_SCORE = 0.2


#: What goes to Python at once: a batch of whole texts is held on both sides of each task.
BATCH_BYTES = 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text has a language; those without letters or near no profile go."""
    in_small_batches(spark)
    profiles = language.learn(docs, ~held_out(F.col("doc_id"), 4, 2))
    if not profiles.names:  # nothing to learn from, nothing to reject by but the want of letters
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language.labelled(docs, profiles)
    return found.where((F.col("lang") != language.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of equal texts."""
    return exact.first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: sets of five-word shingles with similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source comes to its target of words."""
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts and packs all documents into windows of 4096 tokens."""
    in_small_batches(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]
#: Language profiles, components, Newton steps and tokenizers are beyond SQL: tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
