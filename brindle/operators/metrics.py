"""Reconstruction and reward metrics as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators.ordering import values_at

PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def by_component(df: DataFrame, vector: Column) -> DataFrame:
    return df.select(F.posexplode(vector).alias("component", "x")).withColumn("component", F.col("component").cast("long"))


def mean_vector(df: DataFrame, vector: str) -> DataFrame:
    return by_component(df, V.doubles(F.col(vector))).groupBy("component").agg(F.avg("x").alias("mean"))


def raw_variance_baseline(df: DataFrame, vector: str, scale: float | None) -> DataFrame:
    """Mean over components of the population variance of the scaled vectors."""
    each = by_component(df, V.scaled(F.col(vector), scale)).groupBy("component").agg(F.var_pop("x").alias("v"))
    return each.agg(F.avg("v").alias("baseline"))


def mean_norm_baseline(df: DataFrame, vector: str, scale: float | None) -> DataFrame:
    """Mean squared distance, by component, of scaled vectors to their mean scaled again."""
    parts = by_component(df, V.scaled(F.col(vector), scale))
    sums = parts.groupBy("component").agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("q"))
    # the mean over rows of (x - c m)^2 is q - 2 c m m + c^2 m m, with c = scale / |m|: one pass over the vectors
    length = F.sqrt(F.sum(F.col("m") * F.col("m")))
    c = F.lit(1.0) if scale is None else F.lit(float(scale)) / F.greatest(length, F.lit(V.TINY))
    return sums.agg((F.avg("q") - 2 * c * F.avg(F.col("m") * F.col("m")) + c * c * F.avg(F.col("m") * F.col("m"))).alias("baseline"))


def capped(df: DataFrame, order: str, most: int = 50_000) -> DataFrame:
    """The first rows in file order, which the baselines read at most."""
    return df.orderBy(order).limit(most)


def explained(pairs: DataFrame, pred: str, gold: str, scale: float | None) -> DataFrame:
    """FVE: 1 less the mean squared error over the mean squared distance of golds to their own mean (not scaled again)."""
    spread = raw_variance_baseline(pairs, gold, scale).scalar()
    error = pairs.agg(F.avg(V.mse(F.col(pred), F.col(gold), scale)).alias("error")).withColumn("spread", spread)
    return error.withColumn("fve", 1 - F.col("error") / F.col("spread"))


def critic_sums(pairs: DataFrame, group: str, pred: str, gold: str, scale: float | None, baseline: float | None) -> DataFrame:
    """Sums a micro-batch: loss, norms, scale, share explained; sums, so that they add up over batches."""
    loss = V.mse(F.col(pred), F.col(gold), scale)
    n = F.count(F.lit(1))
    out = [F.coalesce(F.sum("_loss"), F.lit(0.0)).alias("loss"), F.sum("_p").alias("pred_norm"), F.sum("_g").alias("gold_norm"), (n * F.lit(-1.0 if scale is None else float(scale))).alias("mse_scale"), n.alias("n")]
    if baseline:
        out.append(((1 - F.avg("_loss") / F.lit(float(baseline))) * n).alias("fve"))
    return pairs.select(group, loss.alias("_loss"), V.norm(F.col(pred)).alias("_p"), V.norm(F.col(gold)).alias("_g")).groupBy(group).agg(*out)


def reward_summary(df: DataFrame, reward: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles, between ranks in proportion, of the rewards that are known."""
    x = F.col(reward)
    row = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    n = row.first()["n"]
    places = {p: p * (n - 1) for p in PERCENTILES} if n else {}
    at = values_at(df, reward, sorted({r for place in places.values() for r in (math.floor(place), math.ceil(place))}))
    for p in PERCENTILES:
        found = None
        if p in places:
            low, high, part = float(at[math.floor(places[p])]), float(at[math.ceil(places[p])]), places[p] % 1
            found = low if part == 0 else low * (1 - part) + high * part
        row = row.withColumn(f"p{round(100 * p)}", F.lit(found).cast("double"))
    return row


def group_counts(df: DataFrame, group: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct(group).alias("n_groups")).withColumn("per_group", F.expr("n_samples div n_groups"))


def advantages(df: DataFrame, group: str, reward: str) -> DataFrame:
    """Rewards less their group's mean over its deviation; 0 where a group does not vary. A group is one prompt's
    samples, so aggregate and join rather than gather."""
    stats = df.groupBy(group).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_std"))
    return df.join(stats, group).withColumn("advantage", F.when(F.col("_std") > V.TINY, (F.col(reward) - F.col("_mean")) / F.col("_std")).otherwise(0.0)).drop("_mean", "_std")


def ratio_metrics(df: DataFrame, new: str, old: str) -> DataFrame:
    """Importance ratios of log-probabilities: r, |r - 1| and (r - 1) - log r."""
    delta = F.col(new) - F.col(old)
    return df.withColumn("tis", F.exp(delta)).withColumn("tis_abs", F.abs(F.exp(delta) - 1)).withColumn("tis_k3", F.exp(delta) - 1 - delta)


def path_agreement(df: DataFrame, a: str, b: str, key: str, first: int = 32, least: int = 4, tolerance: float = 0.10) -> DataFrame:
    """Whether two scoring paths agree on the first rows: greatest relative deviation within the tolerance; null below
    ``least`` rows."""
    head = df.orderBy(key).limit(first)
    off = F.abs(F.col(a) / F.col(b) - 1)
    out = head.agg(F.count(F.lit(1)).alias("n"), F.avg(off).alias("mean_deviation"), F.max(off).alias("max_deviation"))
    return out.withColumn("agree", F.when(F.col("n") >= least, F.col("max_deviation") <= tolerance))


def absmax_scale(df: DataFrame, key: str, vector: str, top: float = 448.0) -> DataFrame:
    """The quantisation scale of each row (channel) and of the whole (tensor)."""
    peak = F.array_max(F.transform(V.doubles(F.col(vector)), lambda x: F.abs(x)))
    rows = df.select(key, (F.greatest(peak, F.lit(V.TINY)) / top).alias("channel_scale"))
    return rows.withColumn("tensor_scale", rows.agg(F.max("channel_scale")).scalar())


def block_scales(df: DataFrame, row: str, vector: str, block: int, top: float = 448.0) -> DataFrame:
    """The quantisation scale of each ``block`` x ``block`` tile of a matrix given as rows: the tile's greatest absolute value
    over ``top``. Tiles at the edges are padded with zeros, which change no maximum; a tile of zeros has scale 0."""
    cells = df.select(F.floor(F.col(row) / block).alias("tile_row"), F.posexplode(V.doubles(F.col(vector))).alias("at", "x"))
    return cells.groupBy("tile_row", F.floor(F.col("at") / block).alias("tile_column")).agg((F.max(F.abs("x")) / top).alias("scale"))
