"""Token embeddings as relations: lookup, injection at marked sites, unstacking, windows, size-bounded packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.vectors import doubles
from brindle.operators.ordering import keyed_hash


def embedded(tokens: DataFrame, token: str, table: DataFrame, key: str, vector: str, scale: float = 1.0) -> DataFrame:
    """Each token's vector times ``scale``; tokens that the table lacks are an error when read."""
    found = tokens.join(table.select(F.col(key).alias(token), F.col(vector).alias("_v")), token, "left")
    known = F.when(F.col("_v").isNotNull(), F.transform(doubles(F.col("_v")), lambda x: x * scale)).otherwise(F.raise_error(F.concat(F.lit("no vector for token "), F.col(token).cast("string"))).cast("array<double>"))
    return found.withColumn("vector", known).drop("_v")


def injected_embeddings(rows: DataFrame, keys: list[str], sites: DataFrame, vector: str = "vector", by: str = "embedding") -> DataFrame:
    """The rows' vectors, those of the sites in their place where a row is one; the input stays as it is."""
    put = sites.select(*keys, doubles(F.col(by)).alias("_put"))
    return rows.join(put, keys, "left").withColumn("is_site", F.col("_put").isNotNull()).withColumn(vector, F.coalesce("_put", vector)).drop("_put")


def unstacked(df: DataFrame, key: str, stacked: str, layers: int) -> DataFrame:
    """One row a layer of a stacked vector whose length the layers divide."""
    part = F.size(stacked) / F.lit(layers)
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(layers - 1).cast("long")))
    rows = df.select(key, stacked, part.cast("int").alias("_n"), at.alias("layer"))
    return rows.select(key, "layer", F.slice(stacked, (F.col("layer") * F.col("_n") + 1).cast("int"), F.col("_n")).alias("part"))


def window_start(seed: int, key: Column, length: Column, wide: int) -> Column:
    """A start from 0 drawn by the row's own key, such that a window of ``wide`` fits; null where none does."""
    draw = F.conv(F.substring(keyed_hash(seed, key), 1, 8), 16, 10).cast("long")
    return F.when(length >= wide, F.pmod(draw, length - wide + 1)).cast("long")


def token_windows(df: DataFrame, key: str, tokens: str, wide: int, seed: int) -> DataFrame:
    """A contiguous window of tokens of each row that is long enough, for calibration."""
    start = window_start(seed, F.col(key), F.size(tokens), wide)
    return df.withColumn("start", start).where("start IS NOT NULL").withColumn("window", F.slice(tokens, (F.col("start") + 1).cast("int"), wide))


def greedy_files(df: DataFrame, group: str, key: str, size: str, most: int) -> DataFrame:
    """Items of a group, in order, into files of at most ``most``; an item beyond that has a file of its own.

    A file is closed by the item that no longer fits, so the order decides and items are gone through one by one, a group
    streaming through a task in sorted order: nothing of it is gathered but the file's number and what it holds so far.
    """
    import pyarrow as pa

    schema = T.StructType([df.schema[group], df.schema[key], T.StructField("file", T.LongType())])

    def run(batches):
        now, file, used = None, 0, 0
        for part in batches:
            files = []
            for own, z in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if (own,) != now:
                    now, file, used = (own,), 0, 0
                elif used and used + z > most:
                    file, used = file + 1, 0
                used += z
                files.append(file)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(files, pa.int64())], names=schema.names)

    rows = df.select(group, key, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_z"))
    # by a hash of the group: by the group itself a join before may have dealt them already, and split large ones
    return rows.repartition(F.xxhash64(group)).sortWithinPartitions(group, key).mapInArrow(run, schema)


def sequence_slice(rows: DataFrame, position: str, start: int, length: int) -> DataFrame:
    """The part of embedded sequences that one of several holders has, ``local`` counted from its start; sites stay numbered
    over whole sequences, so that injection before or after the cut is the same."""
    return rows.where(F.col(position).between(start, start + length - 1)).withColumn("local", F.col(position) - start)


def packed_rows(df: DataFrame, group: str, order: str, tokens: str, pad, wide: str) -> DataFrame:
    """Sequences padded to the width of their batch, with masks, and where each begins and ends when those of a batch are
    laid end to end without padding."""
    from brindle.operators.ordering import last_token_offsets

    sized = df.withColumn("length", F.size(tokens).cast("long"))
    placed = last_token_offsets(sized, [group], order, "length")
    ends = F.col("last_index") + 1
    mask = F.concat(F.array_repeat(F.lit(1), F.size(tokens)), F.array_repeat(F.lit(0), (F.col(wide) - F.size(tokens)).cast("int")))
    filled = F.concat(F.col(tokens), F.array_repeat(F.lit(pad), (F.col(wide) - F.size(tokens)).cast("int")))
    return placed.withColumn("padded", filled).withColumn("mask", mask).withColumn("begins", ends - F.col("length")).withColumn("ends", ends).drop("last_index")
