"""The batch pipeline: named stages over datasets on disk, from a configuration with dotted overrides."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.meta import Checkpoint, DatasetMeta, Tokens, base_id, checkpoints, training_id
from brindle.operators.contracts import require
from brindle.plans import stages as S
from brindle.sources.datasets import corpus_slice
from brindle.sources.storage import Files, complete, read_dataset, read_meta, write_dataset

STAGES = ("extract", "split", "explain", "build", "shuffle")


@dataclass(frozen=True)
class Preset:
    """What a model brings along; explicit settings win over it."""

    layers: int
    width: int
    settings: dict = field(default_factory=dict)

    @property
    def default_layer(self) -> int:
        return 2 * self.layers // 3


def presets_from(spark: SparkSession, path: str) -> dict[str, Preset]:
    """Presets from a JSON file: name to layers, width and whatever else they set."""
    found = json.loads(Files(spark).read(path))
    require(isinstance(found, dict), f"{path} holds no presets")
    return {name: Preset(p["layers"], p["width"], {"width": p["width"], **{k: v for k, v in p.items() if k not in ("layers", "width")}}) for name, p in found.items()}


def overridden(config: dict, changes: list[str]) -> dict:
    """``a.b=value`` with JSON values; a bare word is a string."""
    config = copy.deepcopy(config)
    for change in changes:
        path, _, raw = change.partition("=")
        try:
            value = json.loads(raw)
        except ValueError:
            value = raw
        *above, last = path.split(".")
        reduce(lambda d, k: d.setdefault(k, {}), above, config)[last] = value
    return config


def resolved(config: dict, presets: dict[str, Preset]) -> dict:
    """The preset's settings under the explicit ones; a default layer only where no depths are given."""
    config = copy.deepcopy(config)
    if (name := config.get("model")) is None:
        return config
    require(name in presets, f"unknown preset {name!r}; there are {sorted(presets)}")
    preset = presets[name]
    for key, value in preset.settings.items():
        config.setdefault(key, value)
    if "depths" not in config:
        config.setdefault("layer", preset.default_layer)
    require(max(config.get("depths", [0])) <= preset.layers, "a depth is beyond the model")
    return config


def validated(config: dict) -> dict:
    require(("depths" in config) != ("layer" in config), "give depths or a layer, and one of them")
    wanted = config.get("stages", list(STAGES))
    require(all(s in STAGES for s in wanted), f"unknown stages in {wanted}")
    depths = config["depths"] if "depths" in config else [config["layer"] + 1]
    checkpoints(depths)
    return {**config, "depths": depths, "stages": [s for s in STAGES if s in wanted]}


def training_outputs(depths: list[int], joint: bool) -> list[tuple[str, list[int] | None, int | None]]:
    """(stage, joint depths, one depth): one table each for one depth; for several, joint ones and a critic a depth."""
    if len(depths) == 1 or not joint:
        return [(s, None, depths[0]) for s in ("av_sft", "ar_sft", "rl")]
    return [("av_sft", depths, None), ("rl", depths, None), *[("ar_sft", None, d) for d in depths]]


def path_of(out: str, name: str, stage: str, *, joint: bool = False, checkpoint: str | None = None, shuffled: int | None = None, bundles: int | None = None) -> str:
    """Where a dataset stands: ``base``, ``raw``, ``explained`` of a bucket (``av_sft_explained``), or a training table of one
    checkpoint, of several one by one, or joint; shuffled by rows, or by bundles as a baseline."""
    if stage == "base":
        return f"{out}/{name}"
    if stage == "raw" or stage.endswith("_explained"):
        return f"{out}/{name}__{stage}"
    path = f"{out}/{training_id(stage, name, checkpoint, joint)}"
    return path + (f"__shuf{shuffled}" if shuffled is not None else "") + (f"__bundles{bundles}" if bundles is not None else "")


def same_settings(recorded: DatasetMeta, asked: dict, path: str) -> None:
    """A finished dataset stands for the settings that it was made with, and for no others."""
    other = {k: (recorded.settings.get(k), v) for k, v in asked.items() if recorded.settings.get(k) != v}
    require(not other, f"{path} was made with other settings (recorded, asked): {other}; choose another folder")


def run(
    spark: SparkSession, config: dict, corpus: DataFrame, extractor, provider, *, presets: dict[str, Preset] | None = None, overrides: list[str] = (), caches: list[DataFrame] = (),
    prior: DataFrame | None = None, upload: Callable[[list[str], str], None] | None = None,
) -> list[str]:
    """Run the stages asked for, in order; finished datasets of the same identity and settings are kept. Returns the final
    folders. ``upload`` gets the final and the explained folders, and the run's name.

    ``config``: out, model_name, corpus_name, key (integer), start, length, positions, seed, depths or layer, specials,
    fractions, critic (template), tokens (marker, ids), joint, shuffle_seed, stages, chunks (of the explain stage),
    baseline (a seed: bundles are shuffled apart from their rows too). ``prior``: an explained table of an earlier run
    (doc_id, n_raw_tokens, ordinal, api_explanation), which stands in for the provider by exact key.
    """
    c = validated(resolved(overridden(config, list(overrides)), presets or {}))
    depths, out = c["depths"], c["out"]
    part = {"start": c["start"], "length": c["length"]}
    name = base_id(c["model_name"], depths, c["corpus_name"], part)
    asked = {"seed": c["seed"], "positions": c["positions"], "specials": sorted(c.get("specials", [])), "first": c.get("first", 50), "key": c["key"], "split": c.get("split", "train"), "width": c["width"]}
    meta = DatasetMeta(name, "base", 0, c["model_name"], c["corpus_name"], c["width"], depths, part, c["positions"], c["seed"], created_by="extract", settings=asked)
    base_path, raws = path_of(out, name, "base"), path_of(out, name, "raw")
    if "extract" in c["stages"]:
        if complete(spark, base_path):
            same_settings(read_meta(spark, base_path), asked, base_path)
        else:
            docs = corpus_slice(corpus, c["key"], c["start"], c["length"]).withColumn("doc_id", X.document_id(c["corpus_name"], asked["split"], F.col("row_index"))).select("doc_id", "text")
            rows = S.extract_base(docs, extractor, depths=depths, positions=c["positions"], seed=c["seed"], specials=asked["specials"], first=asked["first"])
            write_dataset(rows, base_path, meta)
    if "split" in c["stages"]:
        base, base_meta = read_dataset(spark, base_path)
        same_settings(base_meta, asked, base_path)
        write_dataset(S.split_documents(base, c["seed"], c["fractions"]), raws, base_meta.derived("raw"), partition_by=["bucket"])
    explained = {bucket: path_of(out, name, f"{bucket}_explained") for bucket in ("av_sft", "ar_sft")}
    if "explain" in c["stages"]:
        raw, raw_meta = read_dataset(spark, raws)
        for bucket, path in explained.items():
            rows = raw.where(F.col("bucket") == bucket).drop("bucket")
            if prior is not None:
                found = S.rejoin(rows, prior, "ordinal")
            else:
                found = S.explain(rows, provider, list(caches), chunks=c.get("chunks", 8), folder=f"{path}__chunks")
            write_dataset(found, path, raw_meta.derived(f"{bucket}_explained"))
    finals = []
    critic = X.Template(c["critic"], "explanation") if c.get("critic") else None
    for stage, joint, depth in training_outputs(depths, c.get("joint", True)):
        which = {"joint": bool(joint), "checkpoint": None if joint or len(depths) == 1 else Checkpoint.at(depth).name}
        label = training_id(stage, name, which["checkpoint"], which["joint"])
        path = path_of(out, name, stage, **which)
        if "build" in c["stages"]:
            if stage == "rl":
                raw, source = read_dataset(spark, raws)
                rows = raw.where("bucket = 'rl'").drop("bucket")
            else:
                rows, source = read_dataset(spark, explained[stage])
            require(source.stage == "base", f"{source.dataset_id} is of stage {source.stage}: training tables can't be built from it")
            actor = S.default_actor_template(joint or [depth])
            table = S.build_training(S.Explained(rows), stage, critic=critic if stage == "ar_sft" else None, depth=depth, joint=joint)
            made = replace(source.derived(label), dataset_id=label, stage=stage, depths=joint or [depth], tokens=Tokens(**c["tokens"]), templates={"actor": actor, **({"critic": c["critic"]} if critic else {})})
            write_dataset(table.withColumn("row_id", X.sha256(F.concat_ws("|", "doc_id", "n_raw_tokens"))), path, made)
        if "shuffle" in c["stages"]:
            table, table_meta = read_dataset(spark, path)
            path = path_of(out, name, stage, **which, shuffled=c["shuffle_seed"])
            write_dataset(S.shuffle(table, "row_id", c["shuffle_seed"], label), path, table_meta.derived(f"shuf{c['shuffle_seed']}"))
        finals.append(path)
        if c.get("baseline") is not None and stage != "rl":
            table, table_meta = read_dataset(spark, path)
            bundle = [x for x in table.columns if x.startswith("activation_") and x not in ("activation_checkpoint", "activation_depth", "activation_layer")]
            path = f"{path}__bundles{c['baseline']}"
            write_dataset(S.shuffle_bundles(table, "row_id", bundle, c["baseline"], label), path, table_meta.derived(f"bundles{c['baseline']}"))
            finals.append(path)
    if upload is not None:
        upload([*finals, *[p for p in explained.values() if complete(spark, p)]], name)
    return finals


def recover_caches(spark: SparkSession, folders: list[str], out: str, text: str = "detokenized_text_truncated") -> list[str]:
    """Explanation caches from finished training tables that kept their texts: a table each, without metadata, for caches
    are no datasets. The critic's tables are inverted by their recorded template, the actor's by their tags."""
    made = []
    for folder in folders:
        table, meta = read_dataset(spark, folder)
        template = X.Template(meta.templates["critic"], "explanation") if meta.stage == "ar_sft" else None
        path = f"{out}/{meta.dataset_id}__cache"
        S.recover(table, text, template).write.mode("overwrite").parquet(path)
        made.append(path)
    return made


def load_corpus(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A corpus by path; ``corpus.parquet@[a:b]`` is its rows a to b - 1 in the order of ``key``."""
    folder, part = X.sliced_path(path)
    corpus = spark.read.parquet(folder)
    if part is None:
        return corpus
    start, end = part
    return corpus_slice(corpus, key, start, (end if end is not None else corpus.count()) - start)


def load_samples(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """A training table as the loader sees it, its depths from the metadata. A slice of one is refused: its metadata would
    not be of the rows."""
    folder, part = X.sliced_path(path)
    require(part is None, f"{path}: training tables are read whole")
    table, meta = read_dataset(spark, folder)
    return samples(table, meta.depths, marker)


def variant_of(df: DataFrame) -> str:
    """What a training table is by its columns: one with responses the actor's, one whose prompt is a text the critic's."""
    require("prompt" in df.columns, f"no training table: {df.columns}")
    return "av_sft" if "response" in df.columns else "ar_sft" if dict(df.dtypes)["prompt"] == "string" else "rl"


def samples(df: DataFrame, depths: list[int], marker: str, sites: int | None = None) -> DataFrame:
    """The loader's view of a training table: the bundle as one array, the marker in place of its placeholder; a response
    comes along where the table has one, as the actor's have.

    A prompt with another number of placeholders than sites is an error, found when the row is read.
    """
    require(depths != [] and "prompt" in df.columns, "no depths or no prompt")
    columns = ["activation_vector"] if len(depths) == 1 else [Checkpoint.at(d).column for d in depths]
    for column in columns:
        require(column in df.columns, f"{column} is missing")
    kind = dict(df.dtypes)["prompt"]
    want = sites if sites is not None else len(depths)
    n = X.occurrences(F.col("prompt"), S.INJECT) if kind == "string" else X.count_in_messages(F.col("prompt"), S.INJECT)
    by = F.replace("prompt", F.lit(S.INJECT), F.lit(marker)) if kind == "string" else X.replace_in_messages(F.col("prompt"), S.INJECT, marker)
    checked = F.when(n == want, by).otherwise(F.raise_error(F.concat(F.lit(f"expected {want} markers, found "), n.cast("string"))).cast(df.schema["prompt"].dataType))
    rest = [c for c in df.columns if c not in ("prompt", *columns)]
    return df.select(checked.alias("prompt"), F.array(*[F.col(c) for c in columns]).alias("bundle"), *rest)


def report(rollouts: DataFrame, top: int = 5, middle: int = 5, bottom: int = 5, shown: int = 400, labels: list[tuple[str, str]] = ()) -> DataFrame:
    """The rollout report's rows: picked samples with source, shortened text and explanation, in order of reward."""
    from brindle.operators.ordering import top_middle_bottom

    picked = top_middle_bottom(rollouts, "reward", "sample_id", top, middle, bottom)
    source = X.source_label(F.col("doc_id"), list(labels)) if "doc_id" in rollouts.columns else F.lit("other")
    lines = picked.select("section", "sample_id", "reward", source.alias("source"), X.shortened(F.col("text"), shown).alias("text"), X.body(F.col("response")).alias("explanation"))
    return lines.orderBy(F.desc("reward"), "sample_id")


def boxed(lines: DataFrame, width: int = 100) -> DataFrame:
    """The report as text, a value a row, wrapped to ``width``, ready for ``write.text``."""
    bar = "─" * (width + 2)
    inside = F.flatten(F.transform(F.split("text", "\n"), lambda x: X.wrapped_lines(x, width)))
    body = F.array_join(F.transform(inside, lambda x: F.concat(F.lit("  │ "), F.rpad(x, width, " "), F.lit(" │"))), "\n")
    said = F.array_join(F.flatten(F.transform(F.split("explanation", "\n"), lambda x: X.wrapped_lines(x, width))), "\n")
    head = F.format_string("[%s] sample %s  %s  reward %.4f", "section", F.col("sample_id").cast("string"), "source", "reward")
    return lines.select(F.concat(head, F.lit(f"\n  ┌{bar}┐\n"), body, F.lit(f"\n  └{bar}┘\n"), said, F.lit("\n")).alias("value"))


def write_report(rollouts: DataFrame, path: str, **picked) -> None:
    """The report as a text file: a few dozen rows, in order."""
    boxed(report(rollouts, **picked)).coalesce(1).write.mode("overwrite").text(path)
