"""Near-duplicate vectors by spherical-cap filters.

A code is a random rotation and, for each half of the rotated space, a book of random unit vectors; a filter direction
is a pair of them, so a book's square of directions costs two small tables. A vector is list-decoded: from the best
words of each half it finds the directions whose cap holds it, the cap's height set so that a number of directions of
each of ``CODES`` codes exceed it. Vectors that share a filter are compared, by cosine in double precision. Books grow
with the root of the number of vectors, so that cells stay as small as they are, and the list is the shortest by which
random pairs at the threshold share a filter with probability ``RECALL`` (nearer ones almost surely); both are worked
out from the number and the width alone. Books end at ``BOOK`` words: beyond some millions of vectors cells grow again.

Equal vectors are one class first, so copies cost nothing. Filters that the same vectors share bring the same pairs
together, so one of them is kept. Cells are compared block by block in memory; a link counts in the first kept filter
that both vectors have, so nothing is counted twice and no pair leaves its task: what leaves are a number of links for
each vector and a spanning forest.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; vectors
of different widths do not link; repeated rows link with each other; a null id takes part, and is a component id only
where no member has one; an empty table gives an empty table; columns other than id and vector are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import arrow_rows, components, written
from brindle.llm.links import forest, grouped, pairs_of_small, runs, whole_groups

CODES, SEED = 4, 20
#: Words of a book at least and at most, directions for each vector, the share of pairs at the threshold to be found, and
#: the longest list of a code.
LEAST_BOOK, BOOK, SPARSE, RECALL, LONGEST = 128, 8192, 32, 0.985, 40
#: Runs of up to this many rows are compared all at once; larger ones run by run, in blocks of about BLOCK.
SMALL, BLOCK = 16, 1024


class ProductCodes:
    """The codes for vectors of one width."""

    def __init__(self, width: int, words: int = 512, listed: int = 5, codes: int = CODES) -> None:
        self.width, self.words, self.listed, half = width, words, min(listed, words), -(-width // 2)
        self.half, self.codes = half, []
        for c in range(codes):
            rng = np.random.default_rng([SEED, width, c])
            turn = np.linalg.qr(rng.normal(size=(2 * half, 2 * half)))[0][:width]
            book = rng.normal(size=(2, words, half))
            self.codes.append((turn, book / np.linalg.norm(book, axis=2, keepdims=True)))

    def decode(self, units: np.ndarray) -> np.ndarray:
        """The filters of each unit vector, a sorted row each."""
        k, rows, out = self.listed, np.arange(len(units))[:, None], []
        for c, (turn, book) in enumerate(self.codes):
            turned = units @ turn
            scores = [turned[:, : self.half] @ book[0].T, turned[:, self.half :] @ book[1].T]
            best = [np.argpartition(-s, k - 1, axis=1)[:, :k] for s in scores]
            sums = (scores[0][rows, best[0]][:, :, None] + scores[1][rows, best[1]][:, None, :]).reshape(len(units), -1)
            pick = np.argpartition(-sums, k - 1, axis=1)[:, :k]
            out.append((c * self.words + best[0][rows, pick // k]) * self.words + best[1][rows, pick % k])
        return np.sort(np.concatenate(out, axis=1), axis=1).astype(np.int32)


def book_of(n: int) -> int:
    """The words of a book for ``n`` vectors: a power of two."""
    return min(BOOK, max(LEAST_BOOK, 1 << math.ceil(math.log2(max(1, SPARSE * n)) / 2)))


def at_cosine(width: int, n: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at a cosine."""
    rng = np.random.default_rng([SEED, width, n])
    x, y = rng.normal(size=(2, n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * y / np.maximum(1e-300, np.linalg.norm(y, axis=1, keepdims=True))


@functools.lru_cache(maxsize=64)
def fitted(width: int, words: int, threshold: float, pairs: int = 600) -> ProductCodes:
    """The codes for a width with the shortest list that finds ``RECALL`` of random pairs at the threshold."""
    if width < 2:
        return ProductCodes(width, words, 1)
    x, y = at_cosine(width, pairs, threshold)
    low, high = 1, min(LONGEST, words)
    while low < high:
        middle = (low + high) // 2
        codes = ProductCodes(width, words, middle)
        found = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(codes.decode(x), codes.decode(y), strict=True)])
        low, high = (low, middle) if found >= RECALL else (middle + 1, high)
    return ProductCodes(width, words, low)


def normed(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    raw = raw.astype(np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)  # no overflow in the norm
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def seen_before(mine: np.ndarray, theirs: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether two rows of filters share one that comes before ``cell``."""
    found = np.zeros(len(mine), dtype=bool)
    open_, t = np.arange(len(mine)), 0
    while len(open_) and t < mine.shape[1]:
        value = mine[open_, t]
        open_ = open_[value < cell[open_]]  # rows are sorted: what follows is not before the cell either
        value = mine[open_, t]
        hit = (theirs[open_] == value[:, None]).any(axis=1)
        found[open_[hit]] = True
        open_, t = open_[~hit], t + 1
    return found


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])


def compare(threshold: float):
    """Of each group of vectors that share a filter: (a, null, n) what links add to a vector, (a, b, 0) a forest."""
    import pyarrow as pa

    def matrix(part, name: str) -> np.ndarray:
        return part.column(name).combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)

    def one_width(part):
        cell, i, j, block, cid, many = (part.column(c).to_numpy() for c in ("cell", "_i", "_j", "_block", "cid", "many"))
        units, kept = normed(matrix(part, "v")), part.column("kept").combine_chunks()
        each = kept.value_lengths().to_numpy()
        filters = np.full((len(cid), each.max(initial=0) + 1), np.iinfo(np.int64).max)
        filters[np.repeat(np.arange(len(cid)), each), np.arange(each.sum()) - np.repeat(each.cumsum() - each, each)] = kept.flatten().to_numpy()
        spans = np.array(list(runs([cell, i, j])), dtype=np.int64).reshape(-1, 2)
        gained, edges = np.zeros(len(cid), dtype=np.int64), []

        def count(x, y):
            new = ~seen_before(filters[x], filters[y], cell[x])
            np.add.at(gained, x[new], many[y[new]])
            np.add.at(gained, y[new], many[x[new]])

        for x, y in pairs_of_small(spans, SMALL):
            ok = (i[x] == j[x]) | (block[x] != block[y])
            x, y = x[ok], y[ok]
            ok = np.einsum("ij,ij->i", units[x], units[y]) >= threshold
            count(x[ok], y[ok])
            edges.append(np.stack([x[ok], y[ok]], axis=1))
        for start, stop in spans[spans[:, 1] - spans[:, 0] > SMALL]:
            near = units[start:stop] @ units[start:stop].T >= threshold
            if i[start] != j[start]:
                near &= block[start:stop, None] != block[None, start:stop]
            near[np.diag_indices(stop - start)] = False
            x, y = np.nonzero(np.triu(near))
            for at in range(0, len(x), 1 << 18):
                count(start + x[at : at + (1 << 18)], start + y[at : at + (1 << 18)])
            edges.append(np.array(forest(lambda k, rest, near=near: near[k, rest], stop - start), dtype=np.int64).reshape(-1, 2) + start)
        pairs = np.concatenate(edges) if edges else np.zeros((0, 2), dtype=np.int64)
        some = np.flatnonzero(gained)
        a = np.concatenate([cid[some], cid[pairs[:, 0]]])
        b = pa.array(np.concatenate([np.zeros(len(some), dtype=np.int64), cid[pairs[:, 1]]]), mask=np.arange(len(a)) < len(some))
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([gained[some], np.zeros(len(pairs), dtype=np.int64)]))], names=LINKS.names)

    def run(batches):
        for part in whole_groups(batches, ["cell", "_i", "_j"]):
            width = part.column("cell").to_numpy() >> 40
            for start, stop in runs([width]):  # cells of one width stand together: the width leads the number
                yield one_width(part.slice(start, stop - start))

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept."""
    import pyarrow as pa

    # single precision stays so on its way, which halves what is moved; products are taken in double
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) or vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), False)
    kind = T.FloatType() if single else T.DoubleType()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(T.ArrayType(kind)).alias("v"))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(good, F.lit(False)), F.col("v")))
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    schema = T.StructType([T.StructField("cid", T.LongType()), T.StructField("many", T.LongType()), T.StructField("v", T.ArrayType(kind)), T.StructField("filters", T.ArrayType(T.IntegerType()))])
    arrow = pa.float32() if single else pa.float64()

    books = {r["width"]: book_of(r["n"]) for r in classes.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()}

    def decode(batches):
        for part in arrow_rows(batches, 256):
            widths: dict[int, list[int]] = {}
            lists = part.column(2)
            for at, n in enumerate(lists.value_lengths().to_pylist()):
                widths.setdefault(n, []).append(at)
            for n, at in widths.items():
                raw = lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, n)
                filters = fitted(n, books[n], threshold).decode(normed(raw))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(list(raw), pa.list_(arrow)), pa.array(list(filters), pa.list_(pa.int32()))], names=schema.names)

    decoded = written(classes.select("cid", "many", "v").mapInArrow(decode, schema), "decoded")
    cells = decoded.select(F.explode("filters").alias("filter"), F.size("v").cast("long").alias("width"), "cid")
    cells = cells.select((F.shiftleft("width", 40) + F.col("filter")).alias("cell"), "cid")  # vectors of another width meet elsewhere
    half = lambda shift: F.sum(F.shiftrightunsigned(F.xxhash64("cid"), shift).bitwiseAND(0x7FFFFFFF))
    several = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), half(0).alias("low"), half(33).alias("high")).where("n > 1")
    several = written(several.groupBy("n", "low", "high").agg(F.min("cell").alias("cell")).select("cell"), "several")
    cells = written(cells.join(several, "cell"), "shared")
    lists = cells.groupBy("cid").agg(F.sort_array(F.collect_list("cell")).alias("kept"))  # as many as a vector has filters at most
    payload = written(decoded.select("cid", "many", "v").join(lists, "cid"), "payload")
    found = written(grouped(cells, "cell", F.xxhash64("cid"), compare(threshold), LINKS, block=BLOCK, payload=payload, by="cid"), "links")
    roots = components(found.where("b IS NOT NULL").select("a", "b"), "vectors")
    gained = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("gained"))
    known = classes.join(gained, "cid", "left").join(roots, classes["cid"] == roots["node"], "left")
    known = known.select("v", "least", (F.coalesce("gained", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    known = written(known, "known")
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("v").alias("_v"), "n_links", "component_id")
    each = rows.join(known, rows["v"] == known["_v"], "left")
    alone = F.col("_v").isNull()
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return each.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.l > 0 AND b.l > 0 AND list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.9),
r AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT k.b AS vec_id, r.root FROM r JOIN k ON k.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM k GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
