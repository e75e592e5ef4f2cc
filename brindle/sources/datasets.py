"""Datasets: corpora by position, shards, and writing with the metadata beside."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brindle.operators.contracts import require, require_slice
from brindle.operators.ordering import id_ranked


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan would use fewer, as with one small file; otherwise as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus_slice(corpus: DataFrame, key: str, start: int, length: int, name: str = "row_index") -> DataFrame:
    """Rows start .. start + length - 1 in the order of an integer key; beyond the corpus is an error."""
    require_slice(start, length)
    total = corpus.count()
    require(start + length <= total, f"slice [{start}, {start + length}) reaches beyond {total} rows")
    return id_ranked(corpus, key, name).where(F.col(name).between(start, start + length - 1))


def merge_shards(shards: list[tuple[DataFrame, dict]]) -> DataFrame:
    """Union of the shards of one extraction in order of their slices.

    Parameters other than the slice must be equal, all stages ``base``, slices must follow each other without gap,
    and rows must be as many as recorded.
    """
    require(bool(shards), "no shards")
    ordered = sorted(shards, key=lambda s: s[1]["start"])
    own = {"start", "length", "row_count"}
    first = {k: v for k, v in ordered[0][1].items() if k not in own}
    at = ordered[0][1]["start"]
    for _, p in ordered:
        rest = {k: v for k, v in p.items() if k not in own}
        require(rest == first, f"shards differ: {rest} and {first}")
        require(p.get("stage") == "base", f"stage {p.get('stage')!r} is not base")
        require(p["start"] == at, f"a shard starts at {p['start']}, not at {at}")
        at = p["start"] + p["length"]
    names = {tuple(df.columns) for df, _ in ordered}
    require(len(names) == 1, f"columns differ: {names}")
    merged = reduce(DataFrame.unionByName, [df for df, _ in ordered])
    total, expected = merged.count(), sum(p["row_count"] for _, p in ordered)
    require(total == expected, f"{total} rows, {expected} recorded")
    return merged


def scanned(df: DataFrame, fn: Callable, schema: str | StructType, rows: int = 4096, most: int = 16 << 20) -> DataFrame:
    """``fn`` over a table's Arrow batches of at most ``rows`` rows and ``most`` bytes (a longer row is a batch of its own):
    what a worker holds at once is bounded, whatever the files' row groups."""

    def run(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows)
                while part.num_rows > 1 and part.nbytes > most:
                    part = part.slice(0, part.num_rows // 2)
                yield fn(part)
                at += part.num_rows

    return df.mapInArrow(run, schema)
