"""Rollouts as relations: routing of failures, critic rows, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from brindle.functions.text import payload
from brindle.operators.ordering import last_token_offsets

MAX_CONTEXT = 512


def final_status(status: Column, response: Column, critic_tokens: Column, most: int = MAX_CONTEXT) -> Column:
    """FAILED for what was truncated, has no payload, or is too long for the critic."""
    return F.when((status == "TRUNCATED") | payload(response).isNull() | (critic_tokens > most), F.lit("FAILED")).otherwise(status)


def scorable(status: Column, response: Column) -> Column:
    return (status == "COMPLETED") & payload(response).isNotNull()


def overlong(logprobs: Column, most: int) -> Column:
    """Responses longer than asked for pass, flagged."""
    return logprobs > most


def critic_rows(df: DataFrame, tokens: str, vector: str, keys: list[str]) -> DataFrame:
    """Rows with critic tokens, those in place of the actor's: lengths anew, no response, empty masks, nothing else."""
    return df.where(F.col(tokens).isNotNull()).select(
        *keys, F.col(tokens).alias("tokens"), F.size(tokens).cast("long").alias("total_length"), F.lit(0).cast("long").alias("response_length"),
        F.array().cast("array<int>").alias("loss_mask"), F.col(vector).alias(vector),
    )


def rank_min_truncate(df: DataFrame, rank: str, order: str, micro: int) -> DataFrame:
    """Cut every rank to the smallest rank's rows, rounded down to whole micro-batches; ``global_rows`` is what stays.

    A smallest rank below one micro-batch is an error. Rows are ranked by ranges of an integer ``order``, so a rank of any
    size is no one task's.
    """
    sizes = {r[rank]: r["n"] for r in df.groupBy(rank).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return df.withColumn("global_rows", F.lit(0).cast("long"))
    least = min(sizes.values()) // micro * micro
    if not least:
        raise ValueError(f"the smallest rank has {min(sizes.values())} rows, fewer than a micro-batch of {micro}")
    placed = last_token_offsets(df.withColumn("_one", F.lit(1)), [rank], order, "_one").drop("_one")
    return placed.where(F.col("last_index") < least).drop("last_index").withColumn("global_rows", F.lit(least * len(sizes)).cast("long"))


def strided(df: DataFrame, part: str, ranks: int, name: str = "target_rank") -> DataFrame:
    """Target rank i takes source parts i, i + ranks, ...; ``place`` is the part's turn there."""
    return df.withColumn(name, F.pmod(F.col(part), F.lit(ranks)).cast("long")).withColumn("place", F.floor(F.col(part) / ranks).cast("long"))


def repartitioned(df: DataFrame, part: str, order: str, ranks: int, scalars: list[str] = (), name: str = "target_rank") -> DataFrame:
    """The rows of source parts 0..n-1 as target ranks hold them: the lists of parts i, i + ranks, ... laid end to end.

    ``position`` is a row's place in its target's list. ``scalars`` are one value a part; a target keeps its first part's.
    More targets than parts are an error. Rows are numbered by ranges of an integer ``order``.
    """
    parts = df.agg(F.count_distinct(part)).first()[0]
    if ranks > parts:
        raise ValueError(f"{ranks} targets for {parts} parts")
    dealt = strided(df, part, ranks, name)
    sizes = dealt.groupBy(name, "place").agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in scalars])
    turns = W.Window.partitionBy(name).orderBy("place")
    starts = sizes.select(name, "place", (F.sum("_n").over(turns) - F.col("_n")).alias("_start"), *[F.first(c).over(turns.rowsBetween(W.Window.unboundedPreceding, 0)).alias(c) for c in scalars])
    placed = last_token_offsets(dealt.drop(*scalars).withColumn("_one", F.lit(1)), [part], order, "_one").drop("_one")
    return placed.join(starts, [name, "place"]).withColumn("position", F.col("_start") + F.col("last_index")).drop("_start", "last_index")


def ranges(df: DataFrame, index: str, total: int, parts: int, name: str = "part") -> DataFrame:
    """Contiguous ranges of total div parts, the remainder to the last."""
    if total < parts:
        raise ValueError(f"{total} rows do not fill {parts} parts")
    each = total // parts
    return df.withColumn(name, F.least(F.floor(F.col(index) / each), F.lit(parts - 1)).cast("long"))


def endpoints(df: DataFrame, index: str, n: int) -> DataFrame:
    return df.withColumn("endpoint", F.pmod(F.col(index), F.lit(n)).cast("long"))


def group_copies(df: DataFrame, group: str, n: int) -> DataFrame:
    """``n`` samples of each prompt: ``group_index`` counts prompts, ``sample_index`` all samples."""
    each = df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return each.withColumn("group_index", F.col(group)).withColumn("sample_index", F.col(group) * n + F.col("copy"))


def micro_batches(df: DataFrame, index: str, size: int) -> DataFrame:
    return df.withColumn("batch", F.floor(F.col(index) / size).cast("long"))
