"""Packing of documents into token windows by best-fit decreasing.

Overlong documents are first cut into full windows. The remainders are packed by best-fit decreasing: longest first,
each into the open window with the least room that still holds it, found in a segment tree indexed by remaining
capacity. Lengths are integers up to the window, so the packing is worked out on the histogram of lengths (at most
``window`` rows, whatever the data) and written down as runs: "items a..b of length L go k to a window from window w
on, at offset o". Documents then find their place by their rank among the pieces of their length; ranks are salted,
so a length that a third of all pieces share is not ranked by one task. The packing is the one best-fit decreasing
gives over all documents at once, not by shard.

Defined results: a null or empty text has the end token alone; a very long text is cut as it is encoded, in one row of 4
bytes a token; pieces of equal length are ordered by id, start and
checksum, so ties are broken alike in reruns and repeated rows get places of their own; an empty table gives an
empty table; columns other than the id and the text are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import arrow_rows, salted_rank, written
from brindle.llm.tokens import loaded, shipped


class CapacityTree:
    """Segment tree over remaining capacities: which have an open window, and the least such from a bound on."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, value: bool) -> None:
        at = capacity + self.leaves
        self.open[at] = value
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.leaves
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, items, first window, items a window, offset) for ``counts`` pieces of each length.

    Equal pieces fill a window as long as it is the tightest, so windows with the same room are served as one lot.
    Between two visits the room of a window more than halves, which bounds the runs by the window, not by the data.
    """
    tree, lots, runs, new = CapacityTree(window), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            lots.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = window, window // length
                first, n = new, -(-left // each)
                new += n
            else:
                each = room // length
                first, n = lots[room].pop()
                if not lots[room]:
                    tree.set(room, False)
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, window - room))
                put(room - each * length, first, full)
                first, n, rank, left = first + full, n - full, rank + full * each, left - full * each
            if left and n:
                runs.append((length, rank, left, first, left, window - room))
                put(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            put(room, first, n)
    return runs


def cut(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens and, if asked for, the ids themselves."""
    import pyarrow as pa

    source = shipped(docs, vocabulary)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))
    last, step = end.to_bytes(4, "little"), 4 * window

    def run(batches):
        ids_of = loaded(source.value).ids
        for part in arrow_rows(batches):
            rows: list[list] = [[] for _ in range(4)]
            owner, kept = [], []
            for i, text in enumerate(part.column(1)):
                ids = ids_of(text.as_py()) + last
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    owner.append(i)
                    for column, value in zip(rows, (at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4), strict=True):
                        column.append(value)
                    if with_ids:
                        kept.append(np.frombuffer(piece, "<i4"))
            columns = [part.column(0).take(pa.array(owner, pa.int64()))] + [pa.array(c, pa.int64()) for c in rows]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if with_ids else []), names=schema.names)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end: int = 2, with_ids: bool = False) -> DataFrame:
    """Every piece of :func:`cut` with its sequence_id and its offset there."""
    import pyarrow as pa

    pieces = written(cut(docs, vocabulary, id_col, text_col, window, end, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = np.array(best_fit_decreasing(counts, window) or np.zeros((0, 6)), dtype=np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    plan = docs.sparkSession.sparkContext.broadcast(runs)
    names = pieces.columns
    # pieces alike in all columns are ranked as one with a weight: an id that a third of all rows share is no one task's
    alike = pieces.groupBy(*names).agg(F.count(F.lit(1)).alias("_many"))
    ranked = salted_rank(alike, ["length"], [id_col, "start", "ids_crc32", "doc_tokens"], F.xxhash64(id_col, "start", "ids_crc32", "doc_tokens"), "_rank", weight=F.col("_many"))
    ranked = ranked.withColumn("_rank", F.explode(F.sequence(F.col("_rank"), F.col("_rank") + F.col("_many") - 1)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        table = plan.value
        wide = max(1, int(table[:, 1].max(initial=0)) + 1, max(counts.values(), default=1) + 1)
        starts = table[:, 0] * wide + table[:, 1]
        for part in batches:
            length, rank = (part.column(c).to_numpy() for c in ("length", "_rank"))
            run = table[np.searchsorted(starts, length * wide + rank, side="right") - 1]
            nth = rank - run[:, 1]
            extra = [pa.array(run[:, 3] + nth // run[:, 4], pa.int64()), pa.array(run[:, 5] + nth % run[:, 4] * length, pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + extra, names=schema.names)

    return ranked.select(*names, "_rank").mapInArrow(place, schema)
