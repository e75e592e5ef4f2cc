"""Marker sites in token sequences, and vectors put there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def sites(tokens: Column, marker, left, right) -> Column:
    """Positions from 0 of the marker between its two neighbours; the ends of a sequence never are."""
    at = F.transform(tokens, lambda t, i: F.when((t == F.lit(marker)) & (i > 0) & (i < F.size(tokens) - 1), i))
    inner = F.filter(at, lambda i: i.isNotNull())
    return F.filter(inner, lambda i: (F.element_at(tokens, i) == F.lit(left)) & (F.element_at(tokens, i + 2) == F.lit(right)))


def exploded_sites(df: DataFrame, key: str, tokens: str, marker, left, right) -> DataFrame:
    """(key, position, nth): one row a site, counted from 0 over all rows in the order of the key."""
    found = df.select(key, F.posexplode(sites(F.col(tokens), marker, left, right)).alias("_i", "position"))
    counts = df.select(key, F.size(sites(F.col(tokens), marker, left, right)).cast("long").alias("_n"))
    before = W.Window.orderBy("_b").rowsBetween(W.Window.unboundedPreceding, -1)
    # running totals by blocks of keys: only block totals meet in one task
    block = F.floor(F.col(key) / 4096)
    totals = counts.groupBy(block.alias("_b")).agg(F.sum("_n").alias("_t"))
    totals = totals.select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    inside = W.Window.partitionBy("_b").orderBy(key).rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.withColumn("_b", block).withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(totals, "_b").select(key, (F.col("_start") + F.col("_in")).alias("_from"))
    return found.join(starts, key).select(key, F.col("position").cast("long").alias("position"), (F.col("_from") + F.col("_i")).cast("long").alias("nth"))


def injected(found: DataFrame, vectors: DataFrame, nth: str, vector: str, check: bool = True) -> DataFrame:
    """Sites with the vectors they get, in order; unequal numbers are an error."""
    if check:
        sites_n, vectors_n = found.count(), vectors.count()
        if sites_n != vectors_n:
            raise ValueError(f"{sites_n} sites but {vectors_n} vectors")
    return found.join(vectors.select(F.col(nth).alias("nth"), vector), "nth")


def neighbours(df: DataFrame, tokens: str, marker) -> DataFrame:
    """What stands left and right of each marker, and how often; one row where all sites agree."""
    t = F.col(tokens)
    at = F.filter(F.transform(t, lambda x, i: F.when(x == F.lit(marker), i)), lambda i: i.isNotNull())
    pairs = F.transform(at, lambda i: F.struct(F.when(i > 0, F.element_at(t, F.when(i > 0, i).otherwise(1))).alias("left"), F.when(i < F.size(t) - 1, F.element_at(t, F.when(i < F.size(t) - 1, i + 2).otherwise(1))).alias("right")))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count(F.lit(1)).alias("n_sites"))
