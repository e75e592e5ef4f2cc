"""Enrichment joins: last row wins on the build side, misses are routed, match rates are enforced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import sha256
from brindle.sources.shared import written

#: The least share of rows that an exact-key join must match.
LEAST_MATCH = 0.95


def last_wins(build: DataFrame, keys: list[str], ordinal: str, value: str) -> DataFrame:
    """One value per key: the one with the greatest ordinal. Combines before the shuffle, so hot keys are cheap."""
    return build.groupBy(*keys).agg(F.max_by(value, ordinal).alias(value))


def cache_union(caches: list[DataFrame], order: str, text: str, value: str) -> DataFrame:
    """Caches as one table of (key, value): later caches win, then later rows; keys are hashes of the text."""
    parts = [c.select(sha256(F.col(text)).alias("key"), F.struct(F.lit(i).alias("cache"), F.col(order).alias("row")).alias("ordinal"), F.col(value).alias(value)) for i, c in enumerate(caches)]
    return last_wins(reduce(DataFrame.unionByName, parts), ["key"], "ordinal", value)


def cache_lookup(rows: DataFrame, text: str, cache: DataFrame, value: str) -> DataFrame:
    """Every row with the cached value of its text, null on a miss."""
    keyed = rows.withColumn("_key", sha256(F.col(text)))
    return keyed.join(cache.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")


def cache_misses(rows: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """The rows whose text no cache has: what is left for the provider."""
    keyed = rows.withColumn("_key", sha256(F.col(text)))
    return keyed.join(cache.select(F.col("key").alias("_key")), "_key", "left_anti").drop("_key")


def exact_key_join(rows: DataFrame, prior: DataFrame, keys: list[str], ordinal: str, value: str, least: float | None = LEAST_MATCH) -> DataFrame:
    """Inner join with a prior output; below ``least`` matched rows it raises before anything is handed on.

    The join is worked out once, all rows marked, as a table in the shared folder; the rate is counted there.
    """
    last = last_wins(prior, keys, ordinal, value)
    if least is None:
        return rows.join(last, keys, "inner")
    marked = written(rows.join(last.withColumn("_hit", F.lit(True)), keys, "left"), "joined")
    n = marked.agg(F.count("_hit").alias("matched"), F.count(F.lit(1)).alias("rows")).first()
    if not n["rows"] or n["matched"] / n["rows"] < least:
        raise ValueError(f"only {n['matched']} of {n['rows']} rows match; at least {least:.0%} must")
    return marked.where("_hit").drop("_hit")


def match_rate(rows: DataFrame, prior: DataFrame, keys: list[str]) -> DataFrame:
    marked = rows.join(prior.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    return marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count("_hit").alias("n_matched")).withColumn("rate", F.col("n_matched") / F.col("n_rows"))


def members(rows: DataFrame, bucket: DataFrame, key: str) -> DataFrame:
    return rows.join(bucket.select(key), key, "left_semi")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def best_prefix(keys: DataFrame, targets: DataFrame, key: str, target: str, prefixes: list[str]) -> DataFrame:
    """The prefix whose removal makes most distinct keys targets; the first in order on a tie; '' always competes."""
    seen = keys.agg(*[F.coalesce(F.max(F.col(key).startswith(p)), F.lit(False)).alias(f"p{i}") for i, p in enumerate(prefixes)]).first()
    tried = [(i, p) for i, p in enumerate(prefixes) if not p or seen[i]]
    bare = [F.struct(F.lit(i).alias("ordinal"), F.lit(p).alias("prefix"), F.when(F.col(key).startswith(p), F.substring(F.col(key), F.lit(len(p) + 1), F.length(key))).otherwise(F.col(key)).alias("_bare")) for i, p in tried]
    mapped = keys.select(key).distinct().select(F.explode(F.array(*bare)).alias("x")).select("x.*").distinct()
    hits = mapped.join(targets.select(F.col(target).alias("_bare")).distinct().withColumn("_hit", F.lit(1)), "_bare", "left")
    counts = hits.groupBy("ordinal", "prefix").agg(F.count("_hit").alias("n_matched"))
    best = F.struct(F.col("n_matched"), -F.col("ordinal"))
    return counts.agg(F.max_by("prefix", best).alias("prefix"), F.max("n_matched").alias("n_matched"))


def coalesced(hit: Column, fresh: Column) -> Column:
    return F.coalesce(hit, fresh)
