"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments: the Manhattan distance of two
embeddings is at most the Hamming distance of the fingerprints. Embeddings are cut into ``groups`` equal parts; of two
fingerprints within ``radius`` bits, some part is within radius // groups (pigeonhole), so the grid join looks up, for
each part, the cells that close: every fingerprint stands in its own cell and in those one or more steps *down*, and
meets those steps apart. Pairs of a cell then pass the bound on the whole embedding and the exact bit count.

Nothing is lost: the bound and the pigeonhole are exact, no cell is capped. Nothing grows with the square of a group
of copies: fingerprints are distinct before the join, cells are compared block by block in memory, and of the links of
a cell only a spanning forest leaves it, which is all that components need.

Defined results: a text without words has fingerprint zero and links like any other; null texts count as empty; very
long texts are hashed whole, a part at a time; fingerprints alike are one, so ties and copies share a component; a
null id takes part, and is never a component id unless no member has one; repeated rows share a component; an empty
table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import arrow_rows, components, tidy, written
from brindle.llm.exact import only, repeated_ids, text_sha
from brindle.llm.links import forest, grouped, pairs_of_small, runs, stars, whole_groups

SEED = 42
#: Bytes of a text whose words are taken apart at once, and where parts may end.
PART, BLANK = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")
SPACES = re.compile(rb"[\x20\x09-\x0D]+")
#: Cells of up to this many rows give all their links, larger ones a spanning forest of them.
SMALL = 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Majority of each bit over the XXH64 of all shingles of ``shingle`` words, A-Z in lower case, repeats included."""
    return int(majority(hashed_shingles(text, shingle)))


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that most of some 64-bit hashes have."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0]


def hashed_shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of all shingles, repeats included, of the whole sequence where it is shorter. Words are taken apart part by
    part, so a very long text costs little more than 8 bytes a shingle."""
    import xxhash

    hashed = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
    text, at, words, found = text or b"", 0, [], []
    while at < len(text):
        m = BLANK.search(text, at + PART) if len(text) - at > PART else None
        words += text[at : m.start() if m else len(text)].lower().split()
        at = m.start() if m else len(text)
        if len(words) >= shingle:
            parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
            found.append(np.fromiter(map(hashed, parts), dtype="<u8", count=len(words) - shingle + 1))
            words = words[len(words) - shingle + 1 :]
    if not found:
        return np.fromiter([hashed(b" ".join(words))] if words else [], dtype="<u8")
    return found[0] if len(found) == 1 else np.concatenate(found)


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """The columns ``keep`` and the fingerprint, as a signed 64-bit integer, of every row's whole text."""
    import pyarrow as pa

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.LongType())])

    def run(batches):
        for part in arrow_rows(batches):
            texts = part.column(len(keep))
            found = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found)], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").cast("binary").alias("_text")).mapInArrow(run, schema)


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the two-bit segments, packed two bits each."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the differences of two packed embeddings, segment by segment."""
    low, high, ones = np.uint64(0x3333333333333333), np.uint64(0x8888888888888888), np.uint64(0x1111111111111111)
    total = np.zeros(np.broadcast(a, b).shape, dtype=np.uint64)
    for shift in (np.uint64(0), np.uint64(2)):
        # each nibble holds 0..2; with 8 added it never borrows from the next: 8 + x - y, from 6 to 10
        d = (((a >> shift) & low) | high) - ((b >> shift) & low)
        total += np.bitwise_count(d & ones)  # 7 and 9
        total += np.uint64(2) * np.bitwise_count((d >> np.uint64(1)) & ~d & ones)  # 6 and 10
    return total


def descents(packed: np.ndarray, groups: int, most: int):
    """(cell, steps, row) for each part of each embedding and each way of at most ``most`` unit steps down."""
    wide = 64 // groups
    for g in range(groups):
        part = (packed >> np.uint64(wide * g)) & np.uint64((1 << wide) - 1)
        stack = [(part, np.arange(len(part)), 0, 0)]
        while stack:
            cell, row, first, steps = stack.pop()
            yield cell | np.uint64(g << 40), steps, row
            for i in range(first, wide // 2) if steps < most else ():
                has = (cell >> np.uint64(2 * i)) & np.uint64(3) > 0
                if has.any():
                    stack.append((cell[has] - np.uint64(1 << (2 * i)), row[has], i, steps + 1))


def links(distinct: DataFrame, radius: int = 3, groups: int = 2, fp: str = "fp") -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within ``radius`` bits: every link of a small cell, a spanning
    forest of the links of a larger one."""
    import pyarrow as pa

    if not 2 <= groups <= 32 or 64 % groups:
        raise ValueError("groups must divide 64 into parts of at most 32 bits")
    most = radius // groups

    def deal(batches):
        for part in arrow_rows(batches, 4096):
            own = part.column(0).to_numpy()
            for cell, steps, row in descents(popcounts(own.view(np.uint64)), groups, most):
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(np.full(len(row), steps, dtype=np.int32)), pa.array(own[row])], names=["cell", "steps", "fp"])

    def compare(batches):
        for part in whole_groups(batches, ["cell", "_i", "_j"]):
            cell, steps, own, block, i, j = (part.column(c).to_numpy() for c in ("cell", "steps", "fp", "_block", "_i", "_j"))
            bits = own.view(np.uint64)
            packed = popcounts(bits)

            def near(x, y, steps=steps, block=block, i=i, j=j, packed=packed, bits=bits):
                ok = (steps[x] + steps[y] <= most) & ((i[y] == j[y]) | (block[x] != block[y]))
                ok &= manhattan(packed[x], packed[y]) <= radius
                return ok & (np.bitwise_count(bits[x] ^ bits[y]) <= radius)

            spans = np.array(list(runs([cell, i, j])), dtype=np.int64).reshape(-1, 2)
            small = spans[:, 1] - spans[:, 0] <= SMALL
            left, right = [], []
            for x, y in pairs_of_small(spans, SMALL):
                ok = near(x, y)
                left.append(x[ok])
                right.append(y[ok])
            for start, stop in spans[~small]:
                pairs = np.array(forest(lambda k, rest, s=start, near=near: near(s + k, s + rest), stop - start), dtype=np.int64).reshape(-1, 2) + start
                left.append(pairs[:, 0])
                right.append(pairs[:, 1])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(own[np.concatenate(left)]), pa.array(own[np.concatenate(right)])], names=["a", "b"])

    cells = written(distinct.select(F.col(fp).alias("fp")).mapInArrow(deal, "cell long, steps int, fp long"), "cells")
    # two that meet take at most ``most`` steps together, so one of them takes at most half
    return grouped(cells, "cell", F.xxhash64("fp"), compare, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]), F.min("steps") <= most // 2)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, groups: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, fp (signed 64-bit), component_id (the smallest id of the component)."""
    prints = written(fingerprints(docs, [id_col], text_col, shingle), "prints")
    least = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "least")
    roots = components(links(least, radius, groups), "simhash")
    linked = least.join(roots, least["fp"] == roots["node"]).select("fp", "least", "root")
    linked = linked.select("fp", "root").join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    alone = least.join(roots, least["fp"] == roots["node"], "left_anti").select("fp", F.col("least").alias("component_id"))
    # one row a fingerprint, written first: the join with all documents can then split a fingerprint of many copies
    of = written(linked.union(alone), "of")
    return prints.join(of, "fp").select(id_col, "fp", "component_id")


# Near-duplicates by similarity: fingerprints and rare shingles propose, shingle sets decide.

#: Fingerprints this far apart are compared, by a grid of as many parts, all of them: what copies with few changes are.
#: A wider reach needs cells of fewer segments, whose rows grow with the square of the documents.
REACH, PARTS = 3, 2
#: Bounds on similarities are loosened by this much, for rounding.
SLACK = 1e-9
#: More pairs than this for each item of a cell come as stars of what they connect, which is verified as a group: all
#: pairs of it, so that no link is lost, and none of them leaves its task.
DENSE = 1
#: Shingles are counted in 2 ** ``BUCKETS`` buckets of their hashes, which travel in blocks of 2 ** ``BLOCK``.
BUCKETS, BLOCK = 22, 16


PROPOSED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("dense", T.BooleanType())])


def thinned(x: np.ndarray, y: np.ndarray, start: int, stop: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The pairs of a cell's rows start..stop as they are where they are few, else the stars of what they connect; and which."""
    if len(x) <= DENSE * len(np.unique(np.concatenate([x, y]))):
        return x, y, False
    order = start + np.argsort(node[start:stop], kind="stable")  # the least node is the root, in every cell
    back = np.empty(stop - start, dtype=np.int64)
    back[order - start] = np.arange(stop - start)
    star = stars(back[x - start], back[y - start], stop - start)
    return order[star[:, 0]], order[star[:, 1]], True


def proposals(a: list[np.ndarray], b: list[np.ndarray], dense: list[np.ndarray]):
    """A batch of the distinct proposals, columns as in PROPOSED."""
    import pyarrow as pa

    rows = np.unique(np.stack([*(np.concatenate(v) for v in (a, b)), np.concatenate(dense).astype(np.int64)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2] == 1)], names=PROPOSED.names)


def candidates(texts: DataFrame, reach: int = REACH, groups: int = PARTS) -> DataFrame:
    """(a, b, dense): nodes of ``texts`` (node, fp) whose fingerprints are within ``reach`` bits, all of them.

    Pairs of a cell that has few of them come as they are. Where a cell has many, as among thousands of near copies,
    come the stars of its components, marked dense: what they connect is to be verified as a group.
    """
    import pyarrow as pa

    wide = 64 // groups
    most = reach // groups

    def deal(batches):
        for part in arrow_rows(batches, 4096):
            node, own = part.column(0).to_numpy(), part.column(1).to_numpy()
            for cell, steps, row in descents(popcounts(own.view(np.uint64)), groups, most):
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(np.full(len(row), steps, dtype=np.int8)), pa.array(own[row]), pa.array(node[row])], names=["cell", "steps", "fp", "node"])

    def near(part):
        cell, steps, own, node, block, i, j = (part.column(c).to_numpy() for c in ("cell", "steps", "fp", "node", "_block", "_i", "_j"))
        bits = own.view(np.uint64)
        place = (popcounts(bits) >> (np.uint64(wide) * (cell.view(np.uint64) >> np.uint64(40)))) & np.uint64((1 << wide) - 1)
        for start, stop in runs([cell, i, j]):
            at = [start + np.flatnonzero(steps[start:stop] == s) for s in range(most + 1)]
            xs, ys = [], []
            for s in range(most + 1):
                for t in range(s, most + 1 - s):
                    left, right = at[s], at[t]
                    for k in range(0, len(left) if len(right) else 0, 256):
                        x = left[k : k + 256]
                        hit = np.bitwise_count(bits[x, None] ^ bits[None, right]) <= reach
                        if s == t:
                            hit &= x[:, None] < right[None, :]
                        px, py = np.nonzero(hit)
                        xs.append(x[px])
                        ys.append(right[py])
            if not xs:
                continue
            x, y = np.concatenate(xs), np.concatenate(ys)
            # a pair meets where neither has stepped down along with the other, and within or across its blocks
            ok = ((steps[x] == 0) | (place[x] != place[y])) & ((i[x] == j[x]) | (block[x] != block[y]))
            yield x[ok], y[ok], start, stop, node

    def compare(batches):
        for part in whole_groups(batches, ["cell", "_i", "_j"]):
            a, b, dense = [], [], []
            for x, y, start, stop, node in near(part):
                x, y, kind = thinned(x, y, start, stop, node)
                a.append(node[x])
                b.append(node[y])
                dense.append(np.full(len(x), kind))
            if a:
                yield proposals(a, b, dense)

    cells = written(texts.select("node", "fp").mapInArrow(deal, "cell long, steps byte, fp long, node long"), "cells")
    return grouped(cells, "cell", F.xxhash64("node"), compare, PROPOSED, F.min("steps") <= most // 2)


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct XXH64 of the shingles."""
    return np.unique(hashed_shingles(text, shingle)).view(np.int64)


def shingle_levels(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """How common the shingles of each bucket of hashes are: the log of the number of times that a document of ``docs``, of
    all of them, has a shingle there, rounded down.

    They only order shingles, the rare before the common: any order that is one for all texts finds all pairs, so what
    shares a bucket decides how many texts meet in vain and nothing else. Each task counts in an array, so a common shingle
    is nobody's burden; 4 MB come back and go to all executors, whatever the documents.
    """
    import pyarrow as pa

    size = 1 << BLOCK

    def run(batches):
        counts, waiting, held = np.zeros(1 << BUCKETS, dtype=np.int32), [], 0
        for part in arrow_rows(batches):
            for t in part.column(0):
                waiting.append((np.unique(hashed_shingles(t.as_py(), shingle)) >> np.uint64(64 - BUCKETS)).astype(np.int32))
                held += len(waiting[-1])
                if held >= 1 << 20:
                    counts += np.bincount(np.concatenate(waiting), minlength=len(counts)).astype(np.int32)
                    waiting, held = [], 0
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=len(counts)).astype(np.int32)
        full = [k for k in range(len(counts) // size) if counts[k * size : (k + 1) * size].any()]
        packed = [pa.compress(counts[k * size : (k + 1) * size], codec="zstd", asbytes=True) for k in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    def add(batches):
        total = {}
        for part in batches:
            for k, packed in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                counts = np.frombuffer(pa.decompress(packed.as_buffer(), 4 * size, codec="zstd"), dtype=np.int32)
                total[k] = total.get(k, 0) + counts.astype(np.int64)
        for k, counts in total.items():
            level = np.log2(np.maximum(counts, 1)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "level"])

    texts = docs.select(F.col(text_col).cast("string").cast("binary").alias("_text"))
    parts = texts.mapInArrow(run, "block int, counts binary").repartition("block")
    levels = np.zeros(1 << BUCKETS, dtype=np.int8)
    with tidy(docs.sparkSession):
        for row in parts.mapInArrow(add, "block int, level binary").collect():
            levels[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["level"], dtype=np.int8)
    return levels


def prefix(h: np.ndarray, least: float, levels: np.ndarray | None = None) -> np.ndarray:
    """Of the sorted distinct shingles of a text, rare ones first, as many that no text with a similarity of ``least`` lacks
    them all: two such texts share one that stands in the prefix of both."""
    if not len(h):
        return h
    if levels is not None:
        h = h[np.argsort(levels[h >> np.uint64(64 - BUCKETS)], kind="stable")]
    return h[: len(h) - math.ceil(least * len(h) - SLACK) + 1]


def sketches(docs: DataFrame, keep: list[str], text_col: str, shingle: int, least: float = 0.8, levels: np.ndarray | None = None) -> DataFrame:
    """The columns ``keep``, a digest of the words, the fingerprint of the distinct shingles, how many they are, and the
    prefix of them. Repeats don't count, as they don't in the similarity that decides."""
    import hashlib

    import pyarrow as pa

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("words", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("fp", "n")), T.StructField("rare", T.ArrayType(T.LongType()))])

    def run(batches):
        for part in arrow_rows(batches):
            rows, words, rare = np.zeros((part.num_rows, 2), dtype=np.int64), [], []
            for k, t in enumerate(part.column(len(keep))):
                text = t.as_py() or b""
                h = np.unique(hashed_shingles(text, shingle))
                rows[k] = majority(h).view(np.int64), len(h)
                words.append(hashlib.blake2b(SPACES.sub(b" ", text.lower().strip()), digest_size=16).digest())
                rare.append(prefix(h, least, levels).view(np.int64))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(words, pa.binary()), *(pa.array(rows[:, c]) for c in range(2)), pa.array(rare, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").cast("binary").alias("_text")).mapInArrow(run, schema)


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many items each pair of some sets shares, by products of slices of their incidence matrix."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    key, column = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, np.int64), return_inverse=True)
    row, both = np.repeat(np.arange(len(sets)), size), np.zeros((len(sets), len(sets)), dtype=np.float32)
    more = np.flatnonzero(np.bincount(column, minlength=len(key)) > 1)  # an item of one set is shared by none
    place = np.full(len(key), -1)
    place[more] = np.arange(len(more))
    column = place[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, len(more) + 2048, 2048))
    for k in range(len(cuts) - 1):
        part = np.zeros((len(sets), 2048), dtype=np.float32)
        part[row[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]] - 2048 * k] = 1
        both += part @ part.T
    return both


def sharing(nodes: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(a, b, dense): the pairs of ``nodes`` (node, n, rare) that fingerprints don't propose, by an exact prefix join.

    Pairs with a similarity of ``least`` share a shingle in both their prefixes. Shingles that stand in the prefixes of
    the same texts bring the same pairs together, so one of them is enough. Of what meets come the pairs that sizes and
    prefixes allow (see :func:`plausible`), which small cells leave for later; in cells with many such pairs, as among
    thousands of near copies, the stars of what they connect, marked dense: that is verified as a group. Pairs inside a
    dense group of ``found`` are left out: they are verified with their group anyway.
    """
    import pyarrow as pa

    cells = nodes.select(F.explode("rare").alias("cell"), "node")
    half = lambda shift: F.sum(F.shiftrightunsigned(F.xxhash64("node"), shift).bitwiseAND(0x7FFFFFFF))
    # most shingles are of one text only; counts combine before the shuffle, so a shingle of all texts is nobody's burden
    many = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("many"), half(0).alias("low"), half(33).alias("high")).where("many > 1")
    many = written(many.groupBy("many", "low", "high").agg(F.min("cell").alias("cell")).select("cell", "many"), "many")
    cells = written(cells.join(many, "cell"), "repeated")
    roots = components(found.where("dense").select("a", "b"), "dense").withColumnRenamed("node", "member")
    cells = cells.join(roots, F.col("node") == F.col("member"), "left").select("cell", "node", "many", F.coalesce("root", "node").alias("root"))
    cells = written(cells.join(nodes.select("node", "n"), "node"), "shared")

    def few(batches):
        for part in whole_groups(batches, ["cell", "_i", "_j"]):
            cell, node, root, n = (part.column(c).to_numpy() for c in ("cell", "node", "root", "n"))
            a, b = [], []
            for x, y in pairs_of_small(np.array(list(runs([cell])), dtype=np.int64).reshape(-1, 2), SMALL):
                ok = (root[x] != root[y]) & (np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - SLACK)
                a.append(node[x[ok]])
                b.append(node[y[ok]])
            if a:
                yield proposals(a, b, [np.zeros(len(x), dtype=bool) for x in a])

    def dense(batches):
        for part in whole_groups(batches, ["cell", "_i", "_j"]):
            cell, i, j, block, node, root, n = (part.column(c).to_numpy() for c in ("cell", "_i", "_j", "_block", "node", "root", "n"))
            sets = part.column("rare").combine_chunks()
            a, b, kinds = [], [], []
            for start, stop in runs([cell, i, j]):
                own = [np.asarray(sets[k].values) for k in range(start, stop)]
                left = n[start:stop] - np.array([len(s) for s in own])
                size, other = n[start:stop, None], n[None, start:stop]
                ok = shared(own) >= least / (1 + least) * (size + other) - SLACK - np.maximum(left[:, None], left[None, :])
                ok &= (np.minimum(size, other) >= least * np.maximum(size, other) - SLACK) & (root[start:stop, None] != root[None, start:stop])
                if i[start] != j[start]:
                    ok &= block[start:stop, None] != block[None, start:stop]
                x, y = np.nonzero(np.triu(ok, 1))
                x, y, kind = thinned(start + x, start + y, start, stop, node)
                a.append(node[x])
                b.append(node[y])
                kinds.append(np.full(len(x), kind))
            if a:
                yield proposals(a, b, kinds)

    apart = F.min("root") < F.max("root")
    small = grouped(cells.where(F.col("many") <= SMALL), "cell", F.xxhash64("node"), few, PROPOSED, apart)
    large = grouped(cells.where(F.col("many") > SMALL), "cell", F.xxhash64("node"), dense, PROPOSED, apart, block=512, payload=nodes.select("node", "rare"), by="node")
    return small.union(large)


def plausible(found: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs of ``found`` (a, b, dense) but those, of the sparse, whose sizes or prefixes rule a similarity of ``least`` out.

    Up to the end of the prefix that ends first, two sets share what the prefixes share; behind it, at most what is left
    of that set. So a prefix, a fifth of a set, tells most unlike texts that share a passage before any set is moved.
    """
    import pyarrow as pa

    def bounded(batches):
        for part in arrow_rows(batches, 2048):
            a, b, n, m, x, y = part.columns
            n, m = n.to_numpy(), m.to_numpy()
            own, other = x.value_lengths().to_numpy(), y.value_lengths().to_numpy()
            ok = np.minimum(n, m) >= least * np.maximum(n, m) - SLACK
            need = least / (1 + least) * (n + m) - SLACK - np.maximum(n - own, m - other)
            for k in np.flatnonzero(ok):
                ok[k] = len(np.intersect1d(np.asarray(x[k].values), np.asarray(y[k].values), assume_unique=True)) >= need[k]
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], names=["a", "b"])

    left, right = nodes.select(F.col("node").alias("a"), "n", F.col("rare").alias("x")), nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("rare").alias("y"))
    pairs = found.where("NOT dense").join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y")
    return pairs.mapInArrow(bounded, "a long, b long").withColumn("dense", F.lit(False)).union(found.where("dense"))


def similar(x: np.ndarray, y: np.ndarray) -> float:
    """The Jaccard similarity of two sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarities of all pairs of some sets."""
    both, size = shared(sets), np.array([len(s) for s in sets])
    both[np.diag_indices(len(sets))] = size
    return both / np.maximum(1, size[:, None] + size[None, :] - both)


def verified(found: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between nodes whose shingle sets are similar; ``found``: a, b, dense; ``sets``: node, set."""
    import pyarrow as pa

    edge = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def pairs(batches):
        for part in arrow_rows(batches, 256):
            a, b, x, y = part.columns
            ok = np.array([similar(np.asarray(u.values), np.asarray(v.values)) >= least for u, v in zip(x, y, strict=True)], dtype=bool)
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(ok)), b.filter(pa.array(ok))], names=["a", "b"])

    def groups_(batches):
        for part in whole_groups(batches, ["cell", "_i", "_j"]):
            cell, i, j, block, own = (part.column(c).to_numpy() for c in ("cell", "_i", "_j", "_block", "node"))
            sets_ = part.column("set").combine_chunks()
            for start, stop in runs([cell, i, j]):
                near = similarities([np.asarray(sets_[k].values) for k in range(start, stop)]) >= least
                if i[start] != j[start]:
                    near &= block[start:stop, None] != block[None, start:stop]
                star = stars(*np.nonzero(np.triu(near, 1)), stop - start)
                yield pa.RecordBatch.from_arrays([pa.array(own[start + star[:, 0]]), pa.array(own[start + star[:, 1]])], names=["a", "b"])

    sparse = found.where("NOT dense").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    dense = components(found.where("dense").select("a", "b"), "dense").select(F.col("root").alias("cell"), "node")
    dense = grouped(dense, "cell", F.xxhash64("node"), groups_, edge, block=512, payload=sets, by="node")
    return sparse.select("a", "b", "x", "y").mapInArrow(pairs, edge).union(dense)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates, with all columns of ``docs``: the one with the smallest id, null ids last.

    Near-duplicates are texts whose sets of word shingles have a Jaccard similarity of ``least`` or more, and groups what
    they connect. Fingerprints propose copies with few changes, a prefix join on rare shingles adds all pairs that they
    miss, and the sets of the texts proposed decide, exactly: what stays depends on the texts alone, neither on the order
    or partitions of the rows nor on what else shares a cell. Texts of equal words are one. A very long text is one row of
    8 bytes a word while its set is compared.
    """
    import pyarrow as pa

    several = not repeated_ids(docs, id_col).isEmpty()
    sha = text_sha(F.col(text_col)) if several else F.lit("")  # where ids tell the rows, they do
    narrow = docs.select(F.col(id_col).alias("id"), sha.alias("sha"), F.col(text_col).cast("string").alias("text"))
    prints = sketches(narrow, ["id", "sha"], "text", shingle, least, shingle_levels(narrow, "text", shingle))
    prints = written(prints.withColumn("node", F.monotonically_increasing_id()), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")
    alike = prints.groupBy("words").agg(first, F.count(F.lit(1)).alias("many")).where("many > 1")
    alike = written(alike.select("words", F.col("first.node").alias("stays")), "alike")
    gone = written(prints.join(alike, "words").where("node <> stays").select("node"), "gone")
    nodes = prints.join(gone, "node", "left_anti")
    proposed = written(candidates(nodes.select("node", "fp")), "candidates")
    more = written(sharing(nodes.select("node", "n", "rare"), proposed, least), "sharing")
    found = written(proposed.union(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dense").distinct(), "found")
    found = written(plausible(found, nodes, least), "plausible")
    ends = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
    wanted = written(prints.select("node", "id", "sha").join(ends, "node").select("node", F.col("id").alias("_id"), F.col("sha").alias("_sha")), "wanted")

    def gather(batches):
        for part in arrow_rows(batches, 256):
            sets = [shingles(t.as_py(), shingle) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    # as many ids as the documents give, so not for broadcast, however few
    texts = narrow.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")))
    if several:  # rows repeated under one id and text: one text for its node
        texts = texts.groupBy("node").agg(F.min("text").alias("text"))
    sets = written(texts.select("node", F.col("text").cast("binary").alias("text")).mapInArrow(gather, "node long, set array<long>"), "sets")
    roots = components(written(verified(found, sets, least), "verified"), "simhash")
    rooted = prints.select("node", "id", "sha").join(gone, "node", "left_anti").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha")).alias("first"))
    return only(docs, written(stays.select("first.id", "first.sha"), "stays"), id_col, text_col)
