"""Exact duplicates by deterministic block naming, with DataFrame functions only.

Every text is normalised (each run of white space becomes one space) and cut into blocks of ``BLOCK`` code points.
Distinct blocks are sorted into integer names; then adjacent names are paired and the distinct pairs sorted into new
names, until each document has one. Names are ranks in sorted order within a hash-dealt bucket, so equal names mean
equal blocks at every level: no identity rests on a hash. Level and name together are the identity of a text.

Blocks travel once, distinct ones only, combined before the shuffle: they are grouped by (hash, block), which shows
whether a hash stands for one block or several; afterwards a block is its hash and its rank among the blocks of that
hash. Further rounds move a few numbers a document, and only for documents of several blocks.

Defined results: null counts as empty, empty texts are equal; very long texts are as many blocks as they need; the row with the smallest id stays; rows repeated
under one id are members of the group, and the first of them stays for all; a null id never stays beside an id; an
empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from brindle.llm.common import sortable, whole_row, written

BLOCK, BUCKETS = 4096, 1 << 16
#: Runs that are not yet a single space.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), RUNS, " ")


def named(pairs: DataFrame) -> DataFrame:
    """(a, b, name) for the distinct pairs: the bucket and the rank of the pair in the bucket's sorted order."""
    dealt = pairs.select("a", "b").distinct().withColumn("_bucket", F.pmod(F.xxhash64("a", "b"), F.lit(BUCKETS)))
    rank = F.row_number().over(W.Window.partitionBy("_bucket").orderBy("a", "b"))
    return dealt.select("a", "b", (F.shiftleft("_bucket", 40) + rank).alias("name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, sha, copies, level, name): one row per distinct id and text, ``copies`` how many rows it stands for."""
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    blocks = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    cells = texts.select(F.explode(blocks).alias("block")).select(hashed(F.col("block")).alias("h"), "block").distinct()
    cells = written(cells.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "cells")
    rows = texts.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), blocks.alias("blocks"))
    rows = rows.select("id", "sha", F.size("blocks").alias("left"), F.posexplode("blocks").alias("pos", "block")).withColumn("h", hashed(F.col("block")))
    shared = cells.where("n > 1").select("h")
    if shared.isEmpty():
        rows = rows.select("id", "sha", "left", "pos", F.col("h").alias("a"), F.lit(1).alias("b"))
    else:  # several blocks of one hash: told apart by their place in sorted order
        some = texts.select(F.explode(blocks).alias("block")).withColumn("h", hashed(F.col("block"))).join(shared, "h", "left_semi").distinct()
        some = some.select("h", "block", F.dense_rank().over(W.Window.partitionBy("h").orderBy("block")).alias("r"))
        rows = rows.join(some, ["h", "block"], "left").select("id", "sha", "left", "pos", F.col("h").alias("a"), F.coalesce("r", F.lit(1)).alias("b"))
    rows = written(rows.groupBy("id", "sha", "left", "pos", "a", "b").agg(F.count(F.lit(1)).alias("copies")), "blocks")
    names = named(cells.select(F.col("h").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("b")))
    most = rows.agg(F.max("left")).first()[0] or 1
    out, level = None, 0
    while True:
        rows = rows.join(names, ["a", "b"]).select("id", "sha", "copies", "left", "pos", "name")
        if most > 1:
            rows = written(rows, f"level{level}")
        done = rows.where("left = 1").select("id", "sha", "copies", F.lit(level).alias("level"), "name")
        out = done if out is None else out.union(done)
        if most <= 1:
            return out
        odd = F.pmod("pos", F.lit(2))
        rows = rows.where("left > 1").groupBy("id", "sha", "copies", F.ceil(F.col("left") / 2).cast("int").alias("left"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(odd == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(odd == 1, F.col("name"))), F.lit(0)).alias("b")
        )
        rows, most, level = written(rows, f"pairs{level}"), -(-most // 2), level + 1
        names = named(rows)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    found = written(identities(docs, id_col, text_col, block, hashed), "identities")
    # written first: the join can then split a group of many copies, which an aggregate beside it would forbid
    sizes = written(found.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size")), "sizes")
    each = found.join(sizes, ["level", "name"]).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return each.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def text_sha(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def repeated_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id): the ids of two rows or more, null among them. Combined before the shuffle."""
    return docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")


def only(docs: DataFrame, stays: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id and text are in ``stays`` (id, sha); of rows repeated under
    one id and text, the first by the order of the other columns (of those that have an order).

    Where no id is repeated, ids tell the rows and texts are not looked at.
    """
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).alias("own"))
    several = written(repeated_ids(docs, id_col), "repeated")
    if several.isEmpty():
        return rows.join(stays.select("id").hint("merge"), F.col("own").eqNullSafe(F.col("id")), "left_semi").select("row.*")
    among = lambda how: rows.join(several, F.col("own").eqNullSafe(F.col("id")), how)
    single = among("left_anti").join(stays.select("id"), F.col("own").eqNullSafe(F.col("id")), "left_semi").select("row")
    hashed = among("left_semi").withColumn("hash", text_sha(F.col("row")[text_col]))
    hashed = hashed.join(stays, F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("sha")), "left_semi")
    order = [F.col("row")[f.name] for f in docs.schema if f.name not in (id_col, text_col) and sortable(f.dataType)]
    first = hashed.groupBy("own", "hash").agg(F.min_by("row", F.struct(*order, F.col("row")[text_col])).alias("row"))
    return single.union(first.select("row")).select("row.*")


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay."""
    kept = groups(docs, id_col, text_col).where("kept")
    return only(docs, kept.select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")), id_col, text_col)


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
"""
