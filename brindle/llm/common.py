"""What the operators of this subpackage share: written tables, components, salted ranks, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from brindle.sources.shared import discard, shared_folder, tidy, written  # noqa: F401

#: What counts as white space in texts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"\x20\x09-\x0D"


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct: whatever they are called, they clash with no column that an operator adds."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(sortable(f.dataType) for f in kind)
    return isinstance(kind, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder, F.lit(False)) & doc_id.isNotNull()


def arrow_rows(batches: Iterator, rows: int = 512, most: int = 1 << 23) -> Iterator:
    """Slices of at most ``rows`` rows and ``most`` bytes (a longer row is a slice of its own), so that what Python holds
    at once stays small."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            while part.num_rows > 1 and part.nbytes > most:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components by contraction.

    ``edges``: columns a, b of one comparable type. Returns (node, root), root the smallest node of the component,
    one row for each node that has an edge to another. Each round maps every node to its smallest neighbour, follows
    two pointers and rewrites the edges; rounds go on until no edge is left, about log(n) of them. Hot nodes are
    only aggregated (with map-side combination) and joined, never gathered.
    """
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-edges")
    roots = None
    while not live.isEmpty():
        both = live.select(F.col("b").alias("x"), F.col("a").alias("y")).union(live.select(F.col("a").alias("x"), F.col("a").alias("y")))
        up = written(both.groupBy("x").agg(F.min("y").alias("y")), f"{tag}-up")
        for _ in range(2):
            jump = written(up.join(up.select(F.col("x").alias("y"), F.col("y").alias("z")), "y", "left").select("x", F.coalesce("z", "y").alias("y")), f"{tag}-up")
            discard(up)
            up = jump
        left, right = up.select(F.col("x").alias("a"), F.col("y").alias("p")), up.select(F.col("x").alias("b"), F.col("y").alias("q"))
        moved = live.join(left, "a").join(right, "b").where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        moved = written(moved, f"{tag}-edges")
        step = up.select(F.col("x").alias("root"), F.col("y").alias("to"))
        if roots is None:
            rooted = written(up.select(F.col("x").alias("node"), F.col("y").alias("root")), f"{tag}-roots")
        else:
            rooted = written(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"{tag}-roots")
            discard(roots)
        discard(live)
        discard(up)
        live, roots = moved, rooted
    if roots is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def salted_rank(df: DataFrame, keys: list[str], order: list[str], salt: Column, rank: str = "rank", per_bucket: int = 1000, weight: Column | None = None) -> DataFrame:
    """Add ``rank``: 0, 1, ... within ``keys``, a key's rows dealt by ``salt`` over count / per_bucket buckets.

    No task ranks more than about ``per_bucket`` rows of one key, however hot it is: each bucket starts where the
    buckets before it end. Ranks follow the bucket, then ``order`` (which should tell all rows of a bucket apart).
    With a ``weight``, a row stands for so many and gets the rank of its first. Nulls in ``keys`` are a key of their own.
    Columns of ``df`` must not begin with ``_salted_``.
    """
    one = F.lit(1) if weight is None else weight
    names = [f"_salted_k{i}" for i in range(len(keys))]
    as_names = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]

    def alike(left: DataFrame) -> Column:
        on = F.lit(True)
        for k, n in zip(keys, names, strict=True):
            on = on & left[k].eqNullSafe(F.col(n))
        return on

    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_salted_n")).where(F.col("_salted_n") > per_bucket)
    sizes = sizes.select(*as_names, F.ceil(F.col("_salted_n") / per_bucket).alias("_salted_buckets"))
    dealt = df.join(sizes, alike(df), "left").withColumn("_salted_bucket", F.coalesce(F.pmod(salt, F.col("_salted_buckets")), F.lit(0))).drop("_salted_buckets", *names)
    totals = dealt.groupBy(*keys, "_salted_bucket").agg(F.sum(one).alias("_salted_n"))
    before = W.Window.partitionBy(*keys).orderBy("_salted_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = totals.select(*as_names, F.col("_salted_bucket").alias("_salted_b"), F.coalesce(F.sum("_salted_n").over(before), F.lit(0)).alias("_salted_start")).where("_salted_start > 0")
    ranked = dealt.join(starts, (dealt["_salted_bucket"] == F.col("_salted_b")) & alike(dealt), "left")
    within = W.Window.partitionBy(*keys, "_salted_bucket").orderBy(*order)
    local = F.row_number().over(within) - 1 if weight is None else F.coalesce(F.sum(one).over(within.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn(rank, (F.coalesce("_salted_start", F.lit(0)) + local).cast("long")).drop("_salted_start", "_salted_bucket", "_salted_b", *names)
