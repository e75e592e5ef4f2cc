"""What a user plugs in by dotted path: extractors, completion providers, tokenizers, storages; deterministic stubs."""

from __future__ import annotations

import importlib
import json
import math
import re
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.meta import Checkpoint
from brindle.operators.contracts import require


def load_class(path: str) -> type:
    """``package.module:Class`` or ``package.module.Class``; anything but a class is an error."""
    module, _, name = path.replace(":", ".").rpartition(".")
    require(bool(module), f"{path!r} names no module")
    found = getattr(importlib.import_module(module), name, None)
    require(isinstance(found, type), f"{path!r} is not a class")
    return found


def load_callable(path: str) -> Callable:
    """``package.module:function``; what can't be called is an error."""
    module, _, name = path.replace(":", ".").rpartition(".")
    require(bool(module), f"{path!r} names no module")
    found = getattr(importlib.import_module(module), name, None)
    require(callable(found), f"{path!r} can't be called")
    return found


#: What a training run may bring along by dotted path: functions, but for what is a class.
ROLES = ("generate", "reward", "loss", "rollout", "source", "actor")


def wired(paths: dict[str, str]) -> dict[str, Callable]:
    """The functions and classes that a configuration names, each under its role; unknown roles are an error."""
    unknown = sorted(set(paths) - set(ROLES))
    require(not unknown, f"unknown roles {unknown}; there are {list(ROLES)}")
    return {role: load_class(path) if role in ("source", "actor") else load_callable(path) for role, path in paths.items()}


def keyword_arguments(text: str | None, forbidden: tuple[str, ...] = ("model_name",)) -> dict:
    """Arguments given as a JSON object; names that the pipeline sets itself are refused."""
    found = json.loads(text) if text else {}
    require(isinstance(found, dict), "arguments must be a JSON object")
    require(not set(forbidden) & set(found), f"{sorted(set(forbidden) & set(found))} is set by the pipeline")
    return found


class Extractor(Protocol):
    def tokens(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame: ...

    def attach(self, rows: DataFrame, doc_id: str, pos: str, depths: list[int]) -> DataFrame: ...


class Provider(Protocol):
    def complete(self, rows: DataFrame, text: str, into: str) -> DataFrame: ...


class Tokenizer(Protocol):
    def ids(self, text: str) -> list[int]: ...


class TableExtractor:
    """Tokens by white space, vectors looked up in a table by a rule over document, position and depth."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
        self.vectors, self.key, self.vector = vectors, key, vector

    def tokens(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        return docs.select(doc_id, F.split(text, r"\s+").alias("tokens"))

    def attach(self, rows: DataFrame, doc_id: str, pos: str, depths: list[int]) -> DataFrame:
        n = self.vectors.agg(F.count(F.lit(1))).scalar()
        for depth in depths:
            at = F.pmod(F.crc32(F.col(doc_id).cast("string")) * 7 + F.col(pos) * 13 + depth * 17, n)
            side = self.vectors.select(F.col(self.key).alias("_at"), F.col(self.vector).alias(Checkpoint.at(depth).column))
            rows = rows.withColumn("_at", at).join(side, "_at").drop("_at")
        return rows


class LayerwiseExtractor:
    """An extractor made of one for each depth, which must see the same tokens: those of the first count, another's that
    differ are an error when the row is read."""

    def __init__(self, by_depth: dict[int, Extractor]) -> None:
        require(bool(by_depth), "no extractors")
        self.by_depth = dict(sorted(by_depth.items()))

    def tokens(self, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
        first, *rest = [e.tokens(docs, doc_id, text) for e in self.by_depth.values()]
        for n, other in enumerate(rest, 1):
            first = first.join(other.select(doc_id, F.col("tokens").alias(f"_t{n}")), doc_id)
            same = F.when(F.col("tokens") == F.col(f"_t{n}"), F.col("tokens")).otherwise(F.raise_error(F.concat(F.lit("extractors see different tokens in "), F.col(doc_id).cast("string"))).cast("array<string>"))
            first = first.withColumn("tokens", same).drop(f"_t{n}")
        return first

    def attach(self, rows: DataFrame, doc_id: str, pos: str, depths: list[int]) -> DataFrame:
        missing = [d for d in depths if d not in self.by_depth]
        require(not missing, f"no extractor for depths {missing}")
        for depth in depths:
            rows = self.by_depth[depth].attach(rows, doc_id, pos, [depth])
        return rows


class EchoProvider:
    """Answers made of the text itself, as a column: two list items of its first and last words."""

    def complete(self, rows: DataFrame, text: str, into: str) -> DataFrame:
        words = F.split(text, r"\s+")
        line = lambda w: F.array_join(w, " ")
        raw = F.concat(F.lit("<analysis>\n1. **Starts:** "), line(F.slice(words, 1, 8)), F.lit("\n2. **Ends:** "), line(F.slice(F.reverse(words), 1, 8)), F.lit("\n</analysis>"))
        return rows.withColumn(into, raw)


def batched(df: DataFrame, column: str, into: str, kind: T.DataType, fn: Callable[[list], list], batch: int, check: Callable[[list], None] = lambda found: None) -> DataFrame:
    """``fn`` from a list of a column's values to as many results, batch by batch in the executors. Rows travel whole, so
    results stay with their row, whatever the order."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    at = df.columns.index(column)
    schema = T.StructType([*df.schema.fields, T.StructField(into, kind)])
    arrow = to_arrow_schema(schema).field(len(df.columns)).type

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                given = part.column(at).to_pylist()
                found = fn(given)
                if len(found) != len(given):
                    raise ValueError(f"{len(given)} rows, {len(found)} results")
                check(found)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, arrow)], names=schema.names)

    return df.mapInArrow(run, schema)


def patient(fn: Callable[[list], list], transient: tuple[type[BaseException], ...], tries: int, wait: float) -> Callable[[list], list]:
    """``fn``, tried again after a transient failure, with twice the wait each time; other failures and the last raise."""

    def call(given: list) -> list:
        for n in range(tries):
            try:
                return fn(given)
            except transient:
                if n == tries - 1:
                    raise
                time.sleep(wait * 2**n)
        raise AssertionError

    return call


class CallableProvider:
    """A plain function from texts to answers, called batch by batch in the executors; None gives a row up.

    ``fn`` must return as many answers as it gets texts and no empty ones. ``transient`` failures are tried again, others
    fail the task, which Spark retries. ``concurrency`` bounds the calls that run at once in the whole cluster: rows are
    dealt over so many tasks. ``settings`` tell providers apart where answers are kept.
    """

    def __init__(self, fn, batch: int = 64, *, concurrency: int | None = None, transient: tuple[type[BaseException], ...] = (TimeoutError, ConnectionError), tries: int = 4, wait: float = 1.0, settings: dict | None = None) -> None:
        self.fn, self.batch, self.concurrency, self.settings = patient(fn, transient, tries, wait), batch, concurrency, settings or {}

    def complete(self, rows: DataFrame, text: str, into: str) -> DataFrame:
        def no_empty(found: list) -> None:
            if any(x == "" for x in found):
                raise ValueError("an answer is empty")

        dealt = rows if self.concurrency is None else rows.repartition(self.concurrency)
        return batched(dealt, text, into, T.StringType(), self.fn, self.batch, no_empty)


def reconstruct(df: DataFrame, text: str, into: str, fn: Callable[[list[str]], list[list[float]]], width: int, batch: int = 64) -> DataFrame:
    """The critic's boundary: a vector of ``width`` for each text; another width or a component that is no number is an error."""

    def whole(found: list) -> None:
        for v in found:
            if v is None or len(v) != width or not all(math.isfinite(x) for x in v):
                raise ValueError(f"expected {width} finite components")

    return batched(df, text, into, T.ArrayType(T.FloatType()), fn, batch, whole)


def generate(df: DataFrame, vector: str, into: str, fn: Callable[[list[list[float]]], list[str]], batch: int = 64) -> DataFrame:
    """The actor's boundary: a text for each vector; None is an error, for a vector always has one."""

    def told(found: list) -> None:
        if any(x is None for x in found):
            raise ValueError("a vector without a text")

    return batched(df, vector, into, T.StringType(), fn, batch, told)


class WordTokenizer:
    """A tokenizer over a growing vocabulary of words and single characters outside them, for tests and stubs."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def ids(self, text: str) -> list[int]:
        return [self.known.setdefault(t, len(self.known)) for t in re.findall(r"\w+|[^\w\s]", text)]


def find_marker(tokenizer: Tokenizer, first: int = 0x3200, last: int = 0x33FF) -> tuple[str, int]:
    """The first character of the range that is one token by itself."""
    for cp in range(first, last + 1):
        if len(ids := tokenizer.ids(chr(cp))) == 1:
            return chr(cp), ids[0]
    raise ValueError("no single-token marker")


_MARKERS: dict[str, tuple[str, int]] = {}


def marker_of(tokenizer: Tokenizer, name: str) -> tuple[str, int]:
    """The marker of a tokenizer, looked for once by its name. One that no longer holds is an error."""
    if name not in _MARKERS:
        _MARKERS[name] = find_marker(tokenizer)
    marker, at = _MARKERS[name]
    require(tokenizer.ids(marker) == [at], f"the tokenizer {name!r} gives {tokenizer.ids(marker)} for its marker, not [{at}]")
    return marker, at


def runtime_settings(spark, tokenizer: Tokenizer, *, explicit: str | None = None, model_dir: str | None = None, dataset: str | None = None, unknown: int | None = None):
    """The metadata that a run goes by, from where it is to be looked for, checked against the tokenizer in use."""
    from brindle.meta import source_of
    from brindle.sources.storage import META, Files, read_meta

    files = Files(spark)
    meta = read_meta(spark, source_of(explicit, model_dir, dataset, lambda folder: files.exists(f"{folder}/{META}")))
    verify_tokens(meta, tokenizer, unknown)
    return meta


def embedding_scale(architecture: str, width: int) -> float:
    """What token embeddings are multiplied by: the root of the width where the architecture says so."""
    return math.sqrt(width) if architecture.lower().startswith(("gemma", "t5")) else 1.0


def stable_suffix(tokenizer: Tokenizer, tail: str) -> list[int]:
    """The tokens of a template's tail but its first, which may merge with what stands before; two at least."""
    ids = tokenizer.ids(tail)[1:]
    require(len(ids) >= 2, "the template's tail is too short for a stable suffix")
    return ids


def canonical_neighbours(ids: list[int], marker: int, sites: int) -> tuple[int, int]:
    """What stands left and right of every marker; all alike, none at an edge, as many as sites."""
    at = [i for i, t in enumerate(ids) if t == marker]
    require(len(at) == sites, f"{len(at)} markers for {sites} sites")
    require(all(0 < i < len(ids) - 1 for i in at), "a marker stands at an edge")
    found = {(ids[i - 1], ids[i + 1]) for i in at}
    require(len(found) == 1, f"neighbours differ: {sorted(found)}")
    return found.pop()


def token_metadata(tokenizer: Tokenizer, actor: str, sites: int, critic_tail: str | None = None):
    """Marker, neighbours and critic suffix for a tokenizer and templates, ready to be recorded."""
    from brindle.meta import Tokens

    marker, at = find_marker(tokenizer)
    left, right = canonical_neighbours(tokenizer.ids(actor.replace("{injection_char}", marker)), at, sites)
    return Tokens(marker, at, left, right, stable_suffix(tokenizer, critic_tail) if critic_tail else None)


def verify_tokens(meta, tokenizer: Tokenizer, unknown: int | None = None) -> None:
    """That a tokenizer still gives what was recorded: one known id for the marker, the same sites and neighbours."""
    require(meta.tokens is not None, f"{meta.dataset_id} records no tokens")
    ids = tokenizer.ids(meta.tokens.marker)
    require(ids == [meta.tokens.marker_id] and ids[0] != unknown, f"the marker is {ids} now, {meta.tokens.marker_id} was recorded")
    found = canonical_neighbours(tokenizer.ids(meta.templates["actor"].replace("{injection_char}", meta.tokens.marker)), ids[0], len(meta.depths))
    require(found == (meta.tokens.left_id, meta.tokens.right_id), f"neighbours are {found} now")
