"""Pairs within cells, block by block, without emitting them.

Near-duplicate operators deal items to cells so that linked items share one. A cell may hold a third of all items,
so it is never one task's: its items are dealt by hash into blocks of about ``BLOCK``, and each pair of blocks is a
group of its own. Groups stream through Python in sorted order; one group (at most about two blocks) is in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 2048


def grouped(cells: DataFrame, cell: str, salt: Column, fn: Callable, schema: T.StructType, useful: Column | None = None, block: int = BLOCK, payload: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Give each pair of blocks of each cell of two or more rows to ``fn(batches)``.

    ``cells``: rows with a column ``cell``; ``salt`` must be one value for equal items. ``useful``: an aggregate that
    must hold of a cell. ``payload``: what the comparison needs beside the cells, joined by column ``by`` once the cells of
    a single row are gone. ``fn`` gets Arrow batches sorted by (cell, _i, _j), ``_block`` the row's own block; in a group
    (cell, i, j) with i < j only pairs across the two blocks count, with i = j those inside.
    """
    sizes = cells.groupBy(cell).agg(F.count(F.lit(1)).alias("_n"), (F.lit(True) if useful is None else useful).alias("_useful"))
    sizes = sizes.where("_n > 1 AND _useful").select(F.col(cell).alias("_cell"), F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    rows = cells.join(sizes, F.col(cell) == F.col("_cell")).drop("_cell").withColumn("_block", F.pmod(salt, F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.when(F.col("_blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))))
    rows = rows.withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other")).drop("_blocks", "_other")
    rows = rows if payload is None else rows.join(payload, by)
    return rows.repartition(cell, "_i", "_j").sortWithinPartitions(cell, "_i", "_j").mapInArrow(fn, schema)


def whole_groups(batches: Iterator, keys: list[str]) -> Iterator:
    """Tables that hold whole groups of rows with equal keys: the last group of a batch waits for the next."""
    import pyarrow as pa

    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if kept is None else pa.concat_tables([kept, part]).combine_chunks()
        last = [part.column(k)[-1] for k in keys]
        same = np.ones(part.num_rows, dtype=bool)
        for k, v in zip(keys, last, strict=True):
            same &= part.column(k).to_numpy() == v.as_py()
        first = part.num_rows - int(same.sum())
        kept = part.slice(first)
        if first:
            yield part.slice(0, first)
    if kept is not None:
        yield kept


def runs(columns: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(start, end) of each run of equal rows."""
    if len(columns[0]):
        change = np.zeros(len(columns[0]) - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change) + 1
        yield from zip(np.r_[0, cuts], np.r_[cuts, len(columns[0])], strict=True)


def pairs_of_small(spans: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y), row numbers x < y of all pairs within each run of at most ``most`` rows, for all runs at once."""
    size = spans[:, 1] - spans[:, 0]
    end = np.repeat(np.where(size <= most, spans[:, 1], 0), size)
    for d in range(1, most):
        x = np.flatnonzero(np.arange(len(end)) + d < end)
        if not len(x):
            return
        yield x, x + d


def forest(linked: Callable[[int, np.ndarray], np.ndarray], n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among items 0..n-1; ``linked(i, rest)`` says which of ``rest`` i is
    linked to. Each item is compared with those not yet reached only, so a dense group costs little more than n."""
    edges, rest = [], np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            if hit.any():
                edges += [(i, int(j)) for j in rest[hit]]
                queue += rest[hit].tolist()
                rest = rest[~hit]
    return edges


def stars(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """(root, item) for the pairs (x, y) among n items: every item that has a pair with the least of its component."""
    label, last = np.arange(n), None
    while last is None or (label != last).any():
        last = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
    item = np.flatnonzero(label != np.arange(n))
    return np.stack([label[item], item], axis=1)
