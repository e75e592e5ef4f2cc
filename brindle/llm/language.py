"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams (1 to 3 characters, words framed by blanks) in rank order.
A document is ranked the same way over its whole text; its out-of-place distance to a profile is the sum over its
own n-grams of how far each is from its rank in the profile, a fixed penalty where it is absent. The nearest
profile wins. n-grams are exact: three code points of 21 bits are one integer, nothing is hashed.

Profiles are learned from at most about ``per_language`` documents of each language, dealt by a hash of the id (a
documented bound on labelled rows; rows without an id teach nothing) and of the ``languages`` most common labels (a bound
too); predictions read every whole text and nothing else.

Very long texts are read whole, a part at a time. Defined results: null texts and texts without a letter are ``und`` with score 0; ties between languages go to the
name first in code point order; repeated rows get the same answer; without any labelled row all is ``und``; an empty
table gives an empty table; other columns, clashing names among them, are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from brindle.llm.common import arrow_rows, whole_row

UNDETERMINED = "und"
#: n-grams a profile keeps, n-grams of a document that are ranked, labelled documents a language, and languages at most.
PROFILE, RANKED, PER_LANGUAGE, LANGUAGES = 400, 300, 4000, 10_000
#: Characters of a text that are taken apart at once.
PART = 1 << 17
_FOLD: list[np.ndarray] = []


def folded() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case if it belongs in a word (letters and marks), else a blank; is it a letter."""
    if not _FOLD:
        fold, letter = np.full(0x110000, 32, dtype=np.int64), np.zeros(0x110000, dtype=bool)
        for cp in range(0x110000):
            kind = unicodedata.category(c := chr(cp))
            if kind[0] in "LM":
                low = c.lower()
                fold[cp], letter[cp] = ord(low) if len(low) == 1 else cp, kind[0] == "L"
        _FOLD.extend((fold, letter))
    return _FOLD[0], _FOLD[1]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts, from several such."""
    if len(keys) == 1:
        return keys[0], counts[0]
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(back, np.concatenate(counts), minlength=len(found)).astype(np.int64)


def grams(text: str | None, part: int = PART) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct n-grams of a text and their counts; None without a letter. Memory is that of ``part`` characters."""
    if not text:
        return None
    fold, letter = folded()
    seen, keys, counts = False, [], []
    last = np.array([32])  # the folded characters that the next n-grams may begin with: two at most
    for at in range(0, len(text), part):
        raw = np.frombuffer(text[at : at + part].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        seen = seen or bool(letter[raw].any())
        own = fold[raw]
        a = np.concatenate([last, own, [32]] if at + part >= len(text) else [last, own])
        blank = a == 32
        fresh = np.arange(len(a)) >= len(last)
        stays = ~(blank & np.roll(blank, 1)) | ~fresh
        a, fresh = a[stays], fresh[stays]
        one, two, three = a << 42, (a[:-1] << 42) | (a[1:] << 21), (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
        # a gram within one word and its two blanks: no blank inside, no lone blank; counted where its end is new
        keep = [one[(a != 32) & fresh], two[fresh[1:]], three[(a[1:-1] != 32) & fresh[2:]]]
        k, c = np.unique(np.concatenate(keep), return_counts=True)
        keys, counts = ([k], [c]) if not keys else [[x] for x in summed([*keys, k], [*counts, c])]
        last = a[-2:]
    return (keys[0], counts[0]) if seen else None


def ranked(text: str | None, most: int) -> np.ndarray | None:
    """The most frequent n-grams in rank order, ties by code points."""
    found = grams(text)
    if found is None:
        return None
    keys, counts = found
    if len(keys) > most:  # all that could be among the first
        at = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= at], counts[counts >= at]
    return keys[np.argsort(-counts, kind="stable")][:most]


class Profiles:
    """All profiles as one table: sorted n-grams by language, a rank in each cell."""

    def __init__(self, rows: list[tuple[str, int, int]]) -> None:
        """``rows``: language, n-gram, rank from 0."""
        self.names = sorted({r[0] for r in rows})
        self.keys = np.array(sorted({r[1] for r in rows}), dtype=np.int64)
        self.ranks = np.full((len(self.keys) + 1, len(self.names)), PROFILE, dtype=np.int64)
        column = {n: i for i, n in enumerate(self.names)}
        for name, key, rank in rows:
            self.ranks[np.searchsorted(self.keys, key), column[name]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, RANKED)
        if own is None or not self.names:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.keys, own)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        ranks = self.ranks[at]
        away = np.where(ranks == PROFILE, PROFILE, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.names[best], float(1 - away[best] / (PROFILE * len(own)))


def learn(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Profiles:
    """Profiles from the labelled rows for which ``learnable`` holds.

    Counts by language come first; each language then gives its rows whose id hashes below per_language / count, about
    ``per_language`` in expectation. n-grams are counted in Python, added up by batch, and summed by Spark. The driver
    gets PROFILE rows a language.
    """
    import pyarrow as pa

    labelled = docs.where(learnable & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = labelled.groupBy(F.col(lang_col).alias("lang")).count()
    share = F.broadcast(counts.orderBy(F.desc("count"), "lang").limit(languages).select(F.col("lang").alias("_l"), (F.lit(float(per_language)) / F.col("count")).alias("_share")))
    # 53 bits of the hash as a fraction in [0, 1)
    draw = F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string")), 11) / F.lit(float(1 << 53))
    picked = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), draw.alias("_draw")).join(share, F.col("lang") == F.col("_l")).where("_draw < _share").select("lang", "text")

    def count(batches):
        for part in arrow_rows(batches, 256):
            by: dict[str, list] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if (found := grams(text)) is not None:
                    by.setdefault(lang, []).append(found)
            for lang, found in by.items():
                keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                sums = np.bincount(inverse, np.concatenate([c for _, c in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(sums)], names=["lang", "gram", "n"])

    summed = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = F.row_number().over(W.Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = summed.select("lang", "gram", (first - 1).alias("rank")).where(F.col("rank") < PROFILE).collect()
    return Profiles([(r["lang"], r["gram"], r["rank"]) for r in rows])


def labelled(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """(row, lang, score): every row of ``docs``, or its columns ``keep``, as a struct, with the language of its whole text
    and a score from 0 to 1.

    The score is 1 less the distance as a share of the greatest possible one. The profiles go to all executors: PROFILE
    numbers a language.
    """
    import pyarrow as pa

    shipped = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select(whole_row(docs if keep is None else docs.select(*keep)).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        predict = shipped.value.predict
        for part in arrow_rows(batches):
            found = [predict(t.as_py()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str], text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with the language of its whole text and its score, see :func:`labelled`."""
    return labelled(docs, profiles, keep, text_col).select("row.*", F.col("lang").alias(lang), F.col("score").alias(score))
