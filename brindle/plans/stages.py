"""The pipeline's stages as functions from datasets to datasets; nothing is computed before a stage is written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.functions import vectors as V
from brindle.meta import Checkpoint
from brindle.operators import joins, ordering
from brindle.operators.contracts import require, require_columns
from brindle.sources.datasets import spread
from brindle.streaming.scoring import resumable

INJECT = "<INJECT>"
PLACE = "{injection_char}"


@dataclass
class Explained:
    """Rows with an explanation and one activation column a depth."""

    rows: DataFrame


def default_actor_template(depths: list[int]) -> str:
    """One marked site for one depth, a labelled line a depth, earliest first, for several."""
    require(bool(depths), "no depths")
    if len(depths) == 1:
        return f"Describe what this vector holds: <concept>{PLACE}</concept>"
    lines = "\n".join(f"{'before any layer' if x == 0 else f'after layer {x}'}: <concept>{PLACE}</concept>" for x in depths)
    return f"Describe what these vectors hold together, earliest first.\n{lines}"


def prompt_column(template: str) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), F.lit(template.replace(PLACE, INJECT)).alias("content")))


def build_training(explained: Explained, stage: str, *, actor: str | None = None, critic: X.Template | None = None, depth: int | None = None, joint: list[int] | None = None, keep_text: bool = False, suffix: list | None = None, tokenize=None) -> DataFrame:
    """Training rows of a stage: one selected ``depth`` (renamed activation_vector) or a ``joint`` bundle.

    Column order is part of the contract. The critic's stage takes one depth only; ``suffix`` with ``tokenize`` (a
    Column function) makes each critic prompt end in these tokens or fail.
    """
    df, names = explained.rows, explained.rows.columns
    require(stage in ("av_sft", "ar_sft", "rl"), f"unknown stage {stage!r}")
    require((depth is None) != (joint is None), "give one depth or a joint list of depths")
    require(stage != "ar_sft" or joint is None, "ar_sft takes one depth")
    require_columns(df, "doc_id", "n_raw_tokens", *(["api_explanation"] if stage != "rl" else []))
    sites = joint if joint is not None else [depth]
    marks = [Checkpoint.at(x) for x in sites]
    require_columns(df, *[m.column for m in marks])
    require(list(sites) == sorted(set(sites)), f"depths {sites} must be sorted and unique")
    if stage != "ar_sft":
        template = actor or default_actor_template(sites)
        require(template.count(PLACE) == len(sites), f"the actor's template has {template.count(PLACE)} sites for {len(sites)} depths")
        out = [prompt_column(template).alias("prompt")]
    else:
        require(critic is not None, "ar_sft needs a critic template")
        prompt = critic.fill(F.col("api_explanation"))
        if suffix is not None:
            ends = V.suffix_is(tokenize(prompt), suffix)
            prompt = F.when(ends, prompt).otherwise(F.raise_error(F.lit("a critic prompt does not end in the expected suffix")).cast("string"))
        out = [prompt.alias("prompt")]
    if stage == "av_sft":
        out.append(X.wrapped(F.col("api_explanation")).alias("response"))
    if joint is None:
        m = marks[0]
        out += [F.col(m.column).alias("activation_vector"), F.col("n_raw_tokens"), F.lit(m.name).alias("activation_checkpoint"), F.lit(m.depth).cast("long").alias("activation_depth"), F.lit(m.layer).cast("long").alias("activation_layer")]
    else:
        out += [F.col(m.column) for m in marks] + [F.col("n_raw_tokens")]
    out.append(F.col("doc_id"))
    if keep_text and "detokenized_text_truncated" in names:
        out.append(F.col("detokenized_text_truncated"))
    return df.select(*out)


def extract_base(corpus: DataFrame, extractor, *, depths: list[int], positions: int, seed: int, specials: list[str], first: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stage 0: ``positions`` keyed positions a document with their bundle; ``extractor`` gives (doc_id, tokens) and looks
    up vectors, see :class:`brindle.plugins.Extractor`."""
    tokens = extractor.tokens(spread(corpus.select(doc_id, text)), doc_id, text)
    places = tokens.select(doc_id, F.posexplode("tokens").alias("pos", "token")).where((F.col("pos") >= first) & ~F.col("token").isin(*specials))
    drawn = ordering.keyed_sample(places.withColumn("pos", F.col("pos").cast("long")), [doc_id], "pos", seed, positions)
    rows = extractor.attach(drawn, doc_id, "pos", depths)
    prefix = F.array_join(F.filter(F.slice("tokens", F.lit(1), (F.col("pos") + 1).cast("int")), lambda t: ~t.isin(*specials)), " ")
    out = rows.join(tokens, doc_id).select(doc_id, (F.col("pos") + 1).alias("n_raw_tokens"), "sample_order", prefix.alias("detokenized_text_truncated"), *[Checkpoint.at(x).column for x in depths])
    return out


def split_documents(base: DataFrame, seed: int, fractions: dict[str, float], doc_id: str = "doc_id") -> DataFrame:
    """Stage 1: every row with the bucket of its document; write with ``partitionBy("bucket")``."""
    return base.join(ordering.document_split(base, doc_id, seed, fractions), doc_id)


def explain(rows: DataFrame, provider, caches: list[DataFrame], *, pattern: str = X.ANSWER, least: int = 2, text: str = "detokenized_text_truncated", chunks: int = 1, folder: str | None = None) -> DataFrame:
    """Stage 2: cached explanations where there are any, the provider's for the rest, cleaned; too short ones dropped.

    With a ``folder`` the provider's raw answers are kept there chunk by chunk as they come: a run that is broken off pays
    for the chunks that were not done, and a changed input, provider or number of chunks reuses none.
    """
    known = joins.cache_union(caches, "row", text, "api_explanation") if caches else None
    hits = joins.cache_lookup(rows, text, known, "api_explanation") if known is not None else rows.withColumn("api_explanation", F.lit(None).cast("string"))
    have, want = hits.where(F.col("api_explanation").isNotNull()), hits.where(F.col("api_explanation").isNull()).drop("api_explanation")
    answer = lambda part: provider.complete(part, text, "_raw")
    told = {"provider": type(provider).__name__, "settings": getattr(provider, "settings", {})}
    raw = answer(want) if folder is None else resumable(want, text, chunks, answer, folder, told)
    fresh = raw.withColumn("api_explanation", X.cleaned(F.col("_raw"), pattern)).drop("_raw")
    return have.unionByName(fresh).where(X.worth_keeping(F.col("api_explanation"), least))


def rejoin(rows: DataFrame, prior: DataFrame, ordinal: str, value: str = "api_explanation", least: float = joins.LEAST_MATCH) -> DataFrame:
    """Stage 2, fast path: explanations of a prior run by exact key."""
    return joins.exact_key_join(rows, prior, ["doc_id", "n_raw_tokens"], ordinal, value, least)


def shuffle(rows: DataFrame, key: str, seed: int, dataset_id: str) -> DataFrame:
    """Rows in a new order, range-partitioned by it, so that files follow the permutation."""
    placed = ordering.permutation(rows, key, seed, dataset_id, "_place")
    return placed.repartitionByRange("_place").sortWithinPartitions("_place").drop("_place")


def shuffle_bundles(rows: DataFrame, key: str, bundle: list[str], seed: int, dataset_id: str) -> DataFrame:
    """The baseline: all columns of ``bundle`` move by one permutation, texts and keys stay."""
    require_columns(rows, key, *bundle)
    require(bool(bundle), "no columns to move")
    return ordering.bundle_permutation(rows, key, bundle, seed, dataset_id)


def recover(training: DataFrame, text: str = "detokenized_text_truncated", template: X.Template | None = None) -> DataFrame:
    """A cache table from training rows: the response's payload, or the critic prompt's filling; null or empty raises."""
    value = template.unfill(F.col("prompt")) if template else X.payload(F.col("response"))
    good = F.when(F.length(value) > 0, value).otherwise(F.raise_error(F.lit("an explanation is missing or empty")).cast("string"))
    return training.select(F.col(text).alias("detokenized_text_truncated"), good.alias("api_explanation"))
