"""Streams of samples: bounded micro-batches through a scorer, resumable enrichment, cursors that survive."""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.ordering import id_ranked
from brindle.sources.storage import Files


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, every: str | None = None, size: int | None = None, key: str | None = None):
    """Score each micro-batch and write it once.

    A batch is flushed when its time is up (``every``, the trigger's interval) or it is full: what has come by then is
    scored in calls of at most ``size`` rows, in the order of ``key``, so that a backlog makes more calls and no larger
    ones. A scorer that raises fails the query, and the batch is replayed from the checkpoint. A batch writes its own
    folder, so a replay replaces what a failed attempt left.
    """

    def each(batch: DataFrame, number: int) -> None:
        if size is None:
            scorer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
            return
        placed = f"{out}/_placed/batch={number}"
        id_ranked(batch, key, "_place").write.mode("overwrite").parquet(placed)
        rows = batch.sparkSession.read.parquet(placed)
        for start in range(0, rows.count(), size):
            part = rows.where(F.col("_place").between(start, start + size - 1)).drop("_place")
            scorer(part).write.mode("overwrite" if start == 0 else "append").parquet(f"{out}/batch={number}")
        Files(batch.sparkSession).delete(placed)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest_by_key(stream: DataFrame, key: str, order: str, late: str, time: str) -> DataFrame:
    """The last row of each key within the watermark: last write wins."""
    whole = F.struct(*[F.col(c) for c in stream.columns if c not in (key, order)])
    return stream.withWatermark(time, late).groupBy(key).agg(F.max_by(whole, order).alias("row"))


def content(df: DataFrame) -> list[Column]:
    """What rows hold, as sums that don't depend on their order: how many, and the halves of a hash of all columns (nulls
    and the columns' names among it). Two rows that swap places cancel nothing, repeated ones count."""

    def plain(f: T.StructField) -> Column:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        return F.to_json(c) if "map<" in f.dataType.simpleString() else c

    parts = [x for f in df.schema for x in (F.lit(f.name), plain(f).isNull(), plain(f))]
    h = F.xxhash64(*parts) if parts else F.lit(0).cast("long")
    half = lambda x: F.coalesce(F.sum(x.cast("decimal(20,0)")), F.lit(0)).cast("string")
    return [F.count(F.lit(1)).alias("n"), half(h.bitwiseAND(0xFFFFFFFF)).alias("low"), half(F.shiftright(h, 32)).alias("high")]


def chunk_name(i: int, parameters: dict, digest) -> str:
    told = json.dumps([parameters, *([digest["n"], digest["low"], digest["high"]] if digest else [0])], sort_keys=True, default=str)
    return f"chunk_{i:08d}_{hashlib.sha256(told.encode()).hexdigest()[:16]}"


def resumable(rows: DataFrame, key: str, chunks: int, work: Callable[[DataFrame], DataFrame], folder: str, parameters: dict) -> DataFrame:
    """Run ``work`` chunk by chunk, keep what is complete, redo the rest; chunks are dealt by the key's hash.

    A chunk is named by the parameters and by what its rows hold in every column, found in one pass over all of them, so
    neither another chunk size nor changed rows reuse one.
    """
    spark, files, done = rows.sparkSession, Files(rows.sparkSession), []
    dealt = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(chunks))
    digests = {r["chunk"]: r for r in rows.groupBy(dealt.alias("chunk")).agg(*content(rows)).collect()}
    for i in range(chunks):
        path = f"{folder}/{chunk_name(i, {**parameters, 'chunks': chunks, 'key': key}, digests.get(i))}"
        if not files.exists(f"{path}/_SUCCESS"):
            work(rows.where(dealt == i)).write.mode("overwrite").parquet(path)
        done.append(path)
    return spark.read.parquet(*done)


class Refreshed:
    """A table that changes beside a stream (embeddings, a cache): read anew when its files have, looked at every
    ``least`` seconds at most. Call it once a batch; what it returns stays what it was while the batch runs."""

    def __init__(self, spark: SparkSession, path: str, least: float = 1.0, now: Callable[[], float] = time.monotonic) -> None:
        self.spark, self.path, self.least, self.now = spark, path, least, now
        self.looked, self.seen, self.table, self.reads = -math.inf, None, None, 0

    def __call__(self) -> DataFrame:
        if self.table is None or self.now() - self.looked >= self.least:
            self.looked, files = self.now(), Files(self.spark).stamps(self.path)
            if self.table is None or files != self.seen:
                self.seen, self.reads = files, self.reads + 1
                self.table = self.spark.read.parquet(self.path)
        return self.table


class Mailbox:
    """One slot: who puts last wins, who looks sees the latest or nothing; a batch of a stream puts its last row by order."""

    def __init__(self) -> None:
        self.held = None

    def put(self, value) -> None:
        self.held = value

    def get(self):
        return self.held

    def put_latest(self, batch: DataFrame, order: str) -> None:
        last = batch.agg(F.max_by(F.struct(*batch.columns), order).alias("row")).first()["row"]
        if last is not None:
            self.put(last)


class Cursor:
    """Where an endless feed stands; epochs follow from the offset. Saved beside the checkpoint, restored or refused."""

    def __init__(self, size: int, copies: int = 1) -> None:
        self.size, self.copies, self.offset, self.epoch, self.groups = size, copies, 0, 0, 0

    def take(self, n: int) -> list[tuple[int, int]]:
        """(epoch, place) of the next ``n`` prompts; past the end the rest comes from the next epoch, once."""
        if n > self.size:
            raise ValueError("more prompts than an epoch holds")
        head = [(self.epoch, i) for i in range(self.offset, min(self.offset + n, self.size))]
        left = n - len(head)
        if left:
            self.epoch += 1
            head += [(self.epoch, i) for i in range(left)]
            self.offset = left
        else:
            self.offset += n
        self.groups += n
        return head

    def give_back(self, n: int) -> None:
        """Aborted prompts: back within the epoch, never before its start."""
        self.offset = max(0, self.offset - n)

    def save(self, spark: SparkSession, path: str) -> None:
        Files(spark).write(path, json.dumps(vars(self)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cursor:
        state = json.loads(Files(spark).read(path))
        cursor = cls(state["size"], state["copies"])
        vars(cursor).update(state)
        return cursor
