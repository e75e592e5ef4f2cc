"""Order, ranks and permutations that no single task has to work out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Leading hex digits of a hash that deal rows to buckets of global ranks: 65,536 buckets.
DIGITS = 4


def keyed_hash(seed: int | str, *parts: Column) -> Column:
    """SHA-256 of ``seed|part|part...``: an order that depends on a row's own key alone."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def ranked(df: DataFrame, bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the rank of each row from 0 in the order of (bucket, order).

    Rows are ranked within their bucket in parallel; only the bucket sizes meet in one task, so ``bucket`` should be a
    non-decreasing function of the order with few values (a hash prefix, an id divided by thousands).
    """
    dealt = df.withColumn("_bucket", bucket)
    sizes = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = W.Window.orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(W.Window.partitionBy("_bucket").orderBy(*order)) - 1
    return dealt.withColumn("_local", local).join(starts, "_bucket").withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).drop("_bucket", "_start", "_local")


def hash_ranked(df: DataFrame, hashed: Column, name: str = "rank", ties: list[Column] | None = None) -> DataFrame:
    """The rank of each row in the order of a hex hash."""
    return ranked(df.withColumn("_hash", hashed), F.substring("_hash", 1, DIGITS), [F.col("_hash"), *(ties or [])], name).drop("_hash")


def id_ranked(df: DataFrame, key: str, name: str = "rank", wide: int = 4096) -> DataFrame:
    """The rank of each row in the order of an integer key."""
    return ranked(df, F.floor(F.col(key) / wide), [F.col(key)], name)


def keyed_sample(positions: DataFrame, group: list[str], position: str, seed: int, n: int) -> DataFrame:
    """At most ``n`` rows of each group without replacement; a group's rows depend on its own keys and the seed alone.

    ``sample_order`` is the place in the sample, from 0. Catalyst limits groups before and after the shuffle.
    """
    order = W.Window.partitionBy(*group).orderBy(keyed_hash(seed, *[F.col(g) for g in group], F.col(position)), F.col(position))
    return positions.withColumn("sample_order", (F.row_number().over(order) - 1).cast("long")).where(F.col("sample_order") < n)


def document_split(docs: DataFrame, key: str, seed: int, fractions: dict[str, float]) -> DataFrame:
    """(key, bucket) for the distinct keys: hash order cut at the running fractions, the remainder to the last bucket."""
    if any(f < 0 for f in fractions.values()) or abs(sum(fractions.values()) - 1) > 1e-6:
        raise ValueError("fractions must be non-negative and sum to 1")
    distinct = docs.select(key).distinct()
    placed = hash_ranked(distinct, keyed_hash(seed, F.col(key)), "_place", [F.col(key)])
    total = distinct.agg(F.count(F.lit(1))).scalar()
    names = list(fractions)
    # sizes are cut one by one, as whole documents
    bucket, upto = F.lit(names[-1]), F.lit(0).cast("long")
    edges = []
    for name in names[:-1]:
        upto = upto + F.floor(total * F.lit(float(fractions[name])))
        edges.append((name, upto))
    for name, edge in reversed(edges):
        bucket = F.when(F.col("_place") < edge, F.lit(name)).otherwise(bucket)
    return placed.select(key, bucket.alias("bucket"))


def permutation(df: DataFrame, key: str, seed: int | str, dataset_id: str, name: str = "new_position") -> DataFrame:
    """A permutation of whole rows: the new position of each, keyed by seed, dataset and the row's own key."""
    return hash_ranked(df, keyed_hash(f"{seed}|{dataset_id}", F.col(key)), name, [F.col(key)])


def bundle_permutation(df: DataFrame, key: str, bundle: list[str], seed: int | str, dataset_id: str) -> DataFrame:
    """Move the columns ``bundle``, all by one permutation; the others stay where they are. Rows are numbered in the order of
    an integer key, or of a text's hash."""
    whole = df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    here = id_ranked(df, key, "_at") if whole else hash_ranked(df, keyed_hash("at", F.col(key)), "_at", [F.col(key)])
    there = hash_ranked(df.select(F.col(key).alias("_from"), *bundle), keyed_hash(f"{seed}|{dataset_id}|activ", F.col("_from")), "_at", [F.col("_from")])
    return here.drop(*bundle).join(there.drop("_from"), "_at").drop("_at").select(*df.columns)


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int, name: str = "position") -> DataFrame:
    """The order of an epoch, always from the original keys, so repeating an epoch repeats its order."""
    return hash_ranked(df, keyed_hash(seed + epoch, F.col(key)), name, [F.col(key)])


def cursor(draws: DataFrame, index: str, size: int) -> DataFrame:
    """Where the draws of an endless cursor fall: epoch and place, from the running index."""
    return draws.withColumn("epoch", F.floor(F.col(index) / size).cast("long")).withColumn("place", F.pmod(F.col(index), F.lit(size)).cast("long"))


def at_ranks(df: DataFrame, value: str, key: str, start: int, n: int) -> DataFrame:
    """The rows at ranks start .. start + n - 1 in the order of ``value`` descending, nulls last, then an integer key.

    Counts by distinct value, in buckets between approximate quantiles, tell which values the ranks fall on; only
    their rows are ranked, by value and block of keys. No task sorts the table, however many rows tie.
    """
    cuts = df.agg(F.percentile_approx(value, [i / 256 for i in range(1, 256)], 2000)).first()[0] or []
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>"), lambda c: c > F.col(value)))
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", F.when(F.col(value).isNull(), 1 << 20).otherwise(above))
    before = W.Window.orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.groupBy("_bucket").agg(F.sum("_n").alias("_t")).select("_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    inside = W.Window.partitionBy("_bucket").orderBy(F.desc_nulls_last(value)).rowsBetween(W.Window.unboundedPreceding, -1)
    placed = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, "_bucket").select(F.col(value).alias("_value"), (F.col("_start") + F.col("_in")).alias("_from"), "_n")
    hit = placed.where((F.col("_from") < start + n) & (F.col("_from") + F.col("_n") > start))
    rows = df.join(hit, df[value].eqNullSafe(hit["_value"]))
    rows = ranked(rows, F.struct(F.col("_from"), F.floor(F.col(key) / 4096)), [F.col("_from"), F.col(key)], "_rank")
    first = hit.agg(F.min("_from")).scalar()
    return rows.where((F.col("_rank") + first).between(start, start + n - 1)).select(*df.columns)


def values_at(df: DataFrame, value: str, ranks: list[int]) -> dict[int, object]:
    """The values at some ranks, from 0 in ascending order, nulls left out.

    Counts by distinct value, in buckets between approximate quantiles, tell which values the ranks fall on: exact, and no
    task holds or sorts all values. The driver gets a row for each rank at most.
    """
    known = df.where(F.col(value).isNotNull()).select(value)
    cuts = known.agg(F.percentile_approx(value, [i / 256 for i in range(1, 256)], 2000)).first()[0] or []
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(value))) if cuts else F.lit(0)
    counts = known.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", below)
    before = W.Window.orderBy("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.groupBy("_bucket").agg(F.sum("_n").alias("_t")).select("_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    inside = W.Window.partitionBy("_bucket").orderBy(value).rowsBetween(W.Window.unboundedPreceding, -1)
    placed = counts.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, "_bucket").select(F.col(value).alias("_value"), (F.col("_start") + F.col("_in")).alias("_from"), "_n")
    hit = F.lit(False)
    for r in ranks:
        hit = hit | ((F.col("_from") <= r) & (F.col("_from") + F.col("_n") > r))
    rows = placed.where(hit).collect()
    return {r: row["_value"] for r in ranks for row in rows if row["_from"] <= r < row["_from"] + row["_n"]}


def top_middle_bottom(df: DataFrame, reward: str, key: str, top: int, middle: int, bottom: int) -> DataFrame:
    """Rows at the top, around the middle and at the bottom by reward, each in the first section that has it."""
    total = df.count()
    ends = df.orderBy(F.desc_nulls_last(reward), F.col(key)).limit(top).select(key, F.lit(0).alias("s"))
    lows = df.orderBy(F.asc_nulls_first(reward), F.desc(key)).limit(bottom).select(key, F.lit(2).alias("s"))
    mids = at_ranks(df, reward, key, max(0, total // 2 - middle // 2), middle).select(key, F.lit(1).alias("s"))
    picked = ends.union(mids).union(lows).groupBy(key).agg(F.min("s").alias("s"))
    names = F.when(F.col("s") == 0, "top").when(F.col("s") == 1, "middle").otherwise("bottom")
    return df.join(picked, key).withColumn("section", names).drop("s")


def contiguous(shards: DataFrame, start: str = "start", length: str = "length") -> DataFrame:
    """Shards in order with whether each begins where the one before ends."""
    before = W.Window.orderBy(start)
    gap = F.col(start) - F.lag(F.col(start) + F.col(length)).over(before)
    return shards.withColumn("gap", F.coalesce(gap, F.lit(0)).cast("long")).withColumn("contiguous", F.col("gap") == 0)


def last_token_offsets(df: DataFrame, group: list[str], order: str, length: str, wide: int = 4096) -> DataFrame:
    """The index of each sequence's last token when a group's sequences are laid end to end, in the order of an integer.

    A group is summed up by ranges of ``wide`` numbers, and each range starts where those before it end, so that a group
    of any size is no one task's.
    """
    dealt = df.withColumn("_range", F.floor(F.col(order) / wide))
    sums = dealt.groupBy(*group, "_range").agg(F.sum(length).alias("_sum"))
    before = W.Window.partitionBy(*group).orderBy("_range").rowsBetween(W.Window.unboundedPreceding, -1)
    names = [f"_g{i}" for i in range(len(group))]
    starts = sums.select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_r")
    for g, n in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    placed = dealt.join(starts, same).drop("_r", *names)
    upto = W.Window.partitionBy(*group, "_range").orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
    return placed.withColumn("last_index", (F.col("_start") + F.sum(length).over(upto) - 1).cast("long")).drop("_range", "_start")


def first_by_key(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Of rows alike in ``keys``, the first by ``ordinal``: an ordered distinct, which combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("_row")).select(*keys, "_row.*").select(*df.columns)
