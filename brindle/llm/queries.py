"""The thin opN_ queries: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

import importlib.util
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import capfilters, exact


def tokenizer_file(name: str) -> str:
    """A file of the installed public vocabularies; operators take any path."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.common import held_out
    from brindle.llm.language import identify, learn

    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    return identify(docs, learn(docs, ~out), ["doc_id"]).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.pii import digest, find

    return digest(find(table(spark, sf_dir, "documents")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.exact import groups

    return groups(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.capfilters import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.pages import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.common import held_out
    from brindle.llm.quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 5, 0))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_personal_data": op3_personal_data,
    "op4_token_counts": op4_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_mixing": op7_mixing,
    "op8_html": op8_html,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
}
ORACLE_SQL: dict[str, str] = {"op5_exact_dedup": exact.ORACLE, "op6_embedding_dedup": capfilters.ORACLE}
