"""Golden values, contracts and properties of the core engine."""

import hashlib

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.functions import vectors as V
from brindle.meta import Checkpoint, DatasetMeta, Tokens, base_id, checkpoints
from brindle.operators import joins, markers, metrics, ordering, rollout
from brindle.operators.contracts import ContractError
from brindle.plans import pipeline as P
from brindle.plans import stages as S
from brindle.plugins import CallableProvider, EchoProvider, TableExtractor, WordTokenizer, canonical_neighbours, find_marker, keyword_arguments, load_class, stable_suffix
from brindle.sources import datasets, storage
from brindle.streaming.scoring import Cursor, resumable, score_stream


def one(df):
    return df.collect()[0][0]


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_identities():
    part = {"start": 0, "length": 10}
    assert base_id("Qwen/Qwen2.5-0.5B-Instruct", [0, 4, 8, 12, 16, 20, 24], "example/corpus", part) == "base_Qwen2.5-0.5B-Instruct_C0-4-8-12-16-20-24_646ce655"
    assert base_id("Qwen/Qwen2.5-0.5B-Instruct", [11], "example/corpus", part, layer=10) == "base_Qwen2.5-0.5B-Instruct_L10_04c3cedc"


def test_checkpoints():
    assert [c.column for c in checkpoints([0, 4, 24])] == ["activation_embedding", "activation_block_04", "activation_block_24"]
    assert Checkpoint.at(0).layer is None and Checkpoint.at(24).layer == 23
    for bad in ([], [4, 0], [1, 1], [-1]):
        with pytest.raises(ContractError):
            checkpoints(bad)
    with pytest.raises(ContractError):
        checkpoints([30], layers=24)


def test_metadata_round_trip_and_upgrade():
    meta = DatasetMeta("base_x", "base", 3, depths=[0, 24], width=2)
    assert DatasetMeta.from_json(meta.to_json()).depths == [0, 24]
    old = '{"kind": "dataset", "version": 1, "dataset_id": "a", "stage": "base", "row_count": 1, "layer_index": 10, "unknown": 1}'
    assert DatasetMeta.from_json(old).depths == [11] and DatasetMeta.from_json(old).version == 2
    with pytest.raises(ContractError):
        DatasetMeta.from_json(old.replace('"version": 1', '"version": 9'))
    with pytest.raises(ContractError):
        DatasetMeta("a", "av_sft", 1, depths=[0]).checked()
    with pytest.raises(ContractError):
        DatasetMeta("a", "av_sft", 1, depths=[0, 24], tokens=Tokens("m", 1, 2, 3), templates={"actor": "{injection_char}"}).checked()


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<explanation>\n a b \n</explanation>", "a b"),
        ("<explanation></explanation>", ""),
        ("no tags", None),
        ("<explanation>cut", None),
        ("x<explanation>1</explanation><explanation>2</explanation>", "1"),
    ],
)
def test_payload(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert one(df.select(X.payload(F.col("t")))) == want
    assert one(df.select(X.payload_or_text(F.col("t")))) == (raw if want is None else want)


@pytest.mark.parametrize("marker", ["-", "•", "–", "1.", "2)", "(3)", "a.", "(b)", "iv."])
def test_cleaning(spark, marker):
    raw = f"<analysis>\n{marker} **Head:** one\n\n{marker} two_*\n</analysis>"
    df = spark.createDataFrame([(raw,), ("<analysis>cut",)], "t string")
    got = [r[0] for r in df.select(X.cleaned(F.col("t"))).collect()]
    assert got == ["Head: one\n\ntwo", None]
    assert [r[0] for r in df.select(X.worth_keeping(X.cleaned(F.col("t")))).collect()] == [True, False]


def test_template(spark):
    t = X.Template("a{{x}} {v} z", "v")
    df = spark.createDataFrame([("{braces}",)], "v string")
    filled = df.select(t.fill(F.col("v")).alias("p"))
    assert one(filled) == "a{x} {braces} z" and one(filled.select(t.unfill(F.col("p")))) == "{braces}"
    with pytest.raises(Exception, match="does not fit"):
        df.select(t.unfill(F.col("v"))).collect()
    with pytest.raises(ValueError):
        X.Template("none", "v")


def test_scaling_keeps_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [list(r[0]) for r in df.select(V.scaled(F.col("v"), 10.0)).collect()] == [[6.0, 8.0], [0.0, 0.0]]
    assert [r[0] for r in df.select(V.cosine(F.col("v"), F.col("v"))).collect()] == [1.0, None]
    assert V.target_scale("sqrt_d_model", 64) == 8.0 and V.target_scale("raw", 64) is None
    with pytest.raises(ValueError):
        V.target_scale("other", 64)
    with pytest.raises(Exception, match="expected 3 components"):
        df.select(V.checked_vector(F.col("v"), 3)).collect()


def test_rewards(spark):
    df = spark.createDataFrame([(0.5, False), (0.0, False), (0.1, True)], "e double, f boolean")
    assert [r[0] for r in df.select(V.reward(F.col("e"), F.col("f"))).collect()] == [-0.5, -0.0, -2.0]
    log = [r[0] for r in df.select(V.reward(F.col("e"), F.col("f"), log=True)).collect()]
    assert log[1] == pytest.approx(18.420680744) and log[2] == pytest.approx(-0.693147181)


def test_keyed_sample_depends_on_its_document_alone(spark):
    rows = spark.range(60).select(F.col("id").alias("pos")).crossJoin(spark.createDataFrame([("a",), ("b",)], "doc string"))
    whole = ordering.keyed_sample(rows, ["doc"], "pos", 42, 5)
    alone = ordering.keyed_sample(rows.where("doc = 'a'"), ["doc"], "pos", 42, 5)
    assert values(whole.where("doc = 'a'")) == values(alone)
    want = sorted(range(60), key=lambda p: hashlib.sha256(f"42|a|{p}".encode()).hexdigest())[:5]
    assert [r["pos"] for r in alone.orderBy("sample_order").collect()] == want
    assert whole.count() == 10 and {r["pos"] for r in whole.where("doc = 'b'").collect()} != set(want)


def test_split_is_a_partition(spark):
    docs = spark.range(100).select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("doc_id"))
    got = {r["bucket"]: r["count"] for r in ordering.document_split(docs.union(docs), "doc_id", 1, {"a": 0.29, "b": 0.3, "c": 0.41}).groupBy("bucket").count().collect()}
    assert got == {"a": 28, "b": 30, "c": 42}  # 100 * 0.29 is 28.99... in double precision
    with pytest.raises(ValueError):
        ordering.document_split(docs, "doc_id", 1, {"a": 0.5, "b": 0.6})


def test_permutations_are_bijections(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 10).alias("a"), (F.col("id") * 100).alias("b"))
    assert sorted(r[0] for r in ordering.permutation(df, "k", 1, "x").select("new_position").collect()) == list(range(500))
    moved = ordering.bundle_permutation(df, "k", ["a", "b"], 1, "x").collect()
    assert sorted(r["k"] for r in moved) == list(range(500)) and all(r["b"] == 10 * r["a"] for r in moved)
    assert any(r["a"] != 10 * r["k"] for r in moved)
    assert values(ordering.epoch_order(df, "k", 1, 2)) == values(ordering.epoch_order(df, "k", 1, 2)) != values(ordering.epoch_order(df, "k", 1, 3))


def test_ranks_across_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (9000, 5, 4096, 4095, 12000)], "k long")
    assert values(ordering.id_ranked(df, "k")) == [(5, 0), (4095, 1), (4096, 2), (9000, 3), (12000, 4)]


def test_top_middle_bottom(spark):
    rewards = [0.5, -0.1, -2, 0.3, -0.7, -0.2, -1.1, -0.4, -2, -0.05, -0.9, -0.6]
    df = spark.createDataFrame([(i, float(r)) for i, r in enumerate(rewards)], "id long, r double")
    got = {r["id"]: r["section"] for r in ordering.top_middle_bottom(df, "r", "id", 2, 4, 2).collect()}
    assert got == {0: "top", 3: "top", 5: "middle", 7: "middle", 11: "middle", 4: "middle", 2: "bottom", 8: "bottom"}
    assert ordering.top_middle_bottom(df, "r", "id", 20, 0, 0).count() == 12
    ties = spark.range(9000).select("id", F.when(F.col("id") % 9 == 0, F.col("id").cast("double")).when(F.col("id") % 9 > 1, 1.5).alias("r"))
    want = sorted(((-r["r"] if r["r"] is not None else float("inf"), r["id"]) for r in ties.collect()))
    for start, n in ((0, 3), (998, 5), (4497, 6), (7998, 4), (8997, 9)):
        assert sorted(r["id"] for r in ordering.at_ranks(ties, "r", "id", start, n).collect()) == sorted(i for _, i in want[start : start + n])


def test_last_wins_and_match_rate(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n long")
    prior = spark.createDataFrame([("a", 1, 1, "old"), ("a", 1, 2, "new")], "doc_id string, n long, o long, e string")
    with pytest.raises(ValueError, match="1 of 2"):
        joins.exact_key_join(rows, prior, ["doc_id", "n"], "o", "e")
    assert values(joins.exact_key_join(rows, prior, ["doc_id", "n"], "o", "e", least=0.5)) == [("a", 1, "new")]


def test_later_cache_wins(spark):
    a = spark.createDataFrame([("t", 9, "first")], "t string, row long, e string")
    b = spark.createDataFrame([("t", 1, "second"), ("u", 1, "other")], "t string, row long, e string")
    got = joins.cache_lookup(spark.createDataFrame([("t",), ("x",)], "t string"), "t", joins.cache_union([a, b], "row", "t", "e"), "e")
    assert {tuple(r) for r in got.collect()} == {("t", "second"), ("x", None)}
    assert values(joins.cache_misses(spark.createDataFrame([("t",), ("x",)], "t string"), "t", joins.cache_union([a, b], "row", "t", "e"))) == [("x",)]


def test_markers(spark):
    ids = [8, 7, 8, 9, 8, 6, 9, 8]
    df = spark.createDataFrame([(0, ids), (1, [7, 8, 9, 7, 8, 9]), (2, []), (3, [8])], "k long, ids array<int>")
    assert values(markers.exploded_sites(df, "k", "ids", 8, 7, 9)) == [(0, 2, 0), (1, 1, 1), (1, 4, 2)]
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "nth long, v array<double>")
    with pytest.raises(ValueError, match="3 sites but 2 vectors"):
        markers.injected(markers.exploded_sites(df, "k", "ids", 8, 7, 9), vectors, "nth", "v")
    assert canonical_neighbours([7, 8, 9, 7, 8, 9], 8, 2) == (7, 9)
    for bad, n in (([8, 9], 1), ([7, 8, 9, 6, 8, 9], 2), ([7, 8, 9], 2)):
        with pytest.raises(ContractError):
            canonical_neighbours(bad, 8, n)


def test_rank_truncation(spark):
    df = spark.createDataFrame([(r, i) for r, n in ((0, 9), (1, 7), (2, 12)) for i in range(n)], "rank long, i long")
    got = rollout.rank_min_truncate(df, "rank", "i", 3).collect()
    assert all(r["i"] < 6 for r in got)
    assert len(got) == 18 and {r["global_rows"] for r in got} == {18}
    with pytest.raises(ValueError):
        rollout.ranges(df, "i", 2, 3)


def test_merge_contracts(spark):
    a, b = spark.range(0, 3), spark.range(3, 5)
    first, second = {"stage": "base", "start": 0, "length": 3, "row_count": 3}, {"stage": "base", "start": 3, "length": 2, "row_count": 2}
    assert [r[0] for r in datasets.merge_shards([(b, second), (a, first)]).collect()] == [0, 1, 2, 3, 4]
    for bad in ({"start": 4}, {"stage": "rl"}, {"row_count": 7}, {"seed": 1}):
        with pytest.raises(ContractError):
            datasets.merge_shards([(a, first), (b, second | bad)])
    with pytest.raises(ContractError):
        datasets.corpus_slice(spark.range(10), "id", 5, 6)


def test_training_tables(spark):
    rows = spark.createDataFrame([("d", 51, "text", [0.0, 0.5], [24.0, 24.5], "why")], "doc_id string, n_raw_tokens long, detokenized_text_truncated string, activation_embedding array<float>, activation_block_24 array<float>, api_explanation string")
    e = S.Explained(rows)
    av = S.build_training(e, "av_sft", depth=0)
    assert av.columns == ["prompt", "response", "activation_vector", "n_raw_tokens", "activation_checkpoint", "activation_depth", "activation_layer", "doc_id"]
    assert av.collect()[0]["activation_layer"] is None and S.build_training(e, "av_sft", depth=24).collect()[0]["activation_layer"] == 23
    joint = S.build_training(e, "rl", joint=[0, 24], keep_text=True)
    assert joint.columns == ["prompt", "activation_embedding", "activation_block_24", "n_raw_tokens", "doc_id", "detokenized_text_truncated"]
    assert joint.collect()[0]["prompt"][0]["content"].count(S.INJECT) == 2
    critic = X.Template("<t>{explanation}</t> <s>", "explanation")
    assert S.build_training(e, "ar_sft", critic=critic, depth=24).collect()[0]["prompt"] == "<t>why</t> <s>"
    for bad in ({"stage": "ar_sft", "joint": [0, 24], "critic": critic}, {"stage": "av_sft", "depth": 4}, {"stage": "av_sft", "joint": [24, 0]}, {"stage": "other", "depth": 0}, {"stage": "rl", "depth": 0, "joint": [0]}, {"stage": "rl", "depth": 0, "actor": "none"}):
        with pytest.raises(ContractError):
            S.build_training(e, **bad)
    with pytest.raises(ContractError):
        S.build_training(S.Explained(rows.drop("api_explanation")), "av_sft", depth=0)
    split = lambda c: F.split(c, " ")
    assert S.build_training(e, "ar_sft", critic=critic, depth=24, suffix=["<s>"], tokenize=split).count() == 1
    with pytest.raises(Exception, match="expected suffix"):
        S.build_training(e, "ar_sft", critic=critic, depth=24, suffix=["</s>"], tokenize=split).collect()
    got = P.samples(joint, [0, 24], "㊗").collect()[0]
    assert len(got["bundle"]) == 2 and got["prompt"][0]["content"].count("㊗") == 2
    with pytest.raises(Exception, match="expected 3 markers"):
        P.samples(joint, [0, 24], "㊗", sites=3).collect()


def test_whole_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    config = {
        "out": str(tmp_path), "model_name": "org/probe", "corpus_name": "documents", "key": "doc_id", "start": 0, "length": 60, "positions": 3, "seed": 42, "width": 64,
        "depths": [0, 24], "specials": ["of"], "fractions": {"av_sft": 0.3, "ar_sft": 0.3, "rl": 0.4}, "critic": "<t>{explanation}</t> <s>", "shuffle_seed": 1,
        "tokens": {"marker": "㊗", "marker_id": 8, "left_id": 7, "right_id": 9, "critic_suffix": [1, 2]},
    }
    extractor = TableExtractor(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sent = []
    finals = P.run(spark, config, docs, extractor, EchoProvider(), upload=lambda files, name: sent.extend(files[:4]), overrides=["positions=4"])
    assert sent == finals and len(finals) == 4
    for path in finals:
        df, meta = storage.read_dataset(spark, path)
        assert df.count() == meta.row_count > 0 and meta.stage in ("av_sft", "ar_sft", "rl")
    buckets = spark.read.parquet(f"{tmp_path}/{base_id('org/probe', [0, 24], 'documents', {'start': 0, 'length': 60})}__raw")
    assert buckets.groupBy("doc_id").agg(F.count_distinct("bucket").alias("n")).where("n > 1").isEmpty()
    assert buckets.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4
    with pytest.raises(ContractError):
        P.run(spark, config | {"layer": 3}, docs, extractor, EchoProvider())
    with pytest.raises(ContractError):
        P.run(spark, config | {"stages": ["nothing"]}, docs, extractor, EchoProvider())


def test_presets_and_overrides():
    presets = {"small": P.Preset(24, 896, {"width": 896})}
    assert P.Preset(28, 1).default_layer == 18
    assert P.resolved({"model": "small"}, presets) == {"model": "small", "width": 896, "layer": 16}
    assert P.resolved({"model": "small", "depths": [4], "width": 1}, presets) == {"model": "small", "width": 1, "depths": [4]}
    assert P.overridden({"a": {"b": 1}}, ["a.c=[1]", "a.b=x"]) == {"a": {"b": "x", "c": [1]}}
    assert P.training_outputs([0, 24], True) == [("av_sft", [0, 24], None), ("rl", [0, 24], None), ("ar_sft", None, 0), ("ar_sft", None, 24)]


def test_providers(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    got = CallableProvider(lambda xs: [x.upper() if x == "a" else None for x in xs]).complete(df, "t", "r")
    assert {tuple(r) for r in got.collect()} == {("a", "A"), ("b", None)}
    with pytest.raises(Exception, match="2 rows, 1 results|1 rows, 0 results"):
        CallableProvider(lambda xs: xs[1:]).complete(df.coalesce(1), "t", "r").collect()


def test_plugins():
    assert load_class("brindle.plugins:EchoProvider") is EchoProvider
    for bad in ("brindle.plugins:find_marker", "brindle.plugins:Nothing", "name"):
        with pytest.raises(ContractError):
            load_class(bad)
    assert keyword_arguments('{"a": 1}') == {"a": 1} and keyword_arguments(None) == {}
    with pytest.raises(ContractError):
        keyword_arguments('{"model_name": "x"}')
    marker, at = find_marker(WordTokenizer())
    assert 0x3200 <= ord(marker) <= 0x33FF and at == 0
    assert len(stable_suffix(WordTokenizer(), "</text> <summary>")) >= 2
    with pytest.raises(ContractError):
        stable_suffix(WordTokenizer(), "x")


def test_storage(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    files = storage.Files(spark)
    files.write(f"{a}/x.txt", "häl")
    assert files.read(f"{a}/x.txt") == "häl"
    with pytest.raises(ContractError):
        storage.pull(spark, b, f"{tmp_path}/c")
    assert storage.push(spark, a, b) == ["x.txt"] and storage.pull(spark, b, f"{tmp_path}/c") == ["x.txt"]
    df = spark.createDataFrame([(1, "fine"), (2, "a SECRET here")], "i long, t string")
    assert values(storage.lint(df, "t", ["secret"])) == [(2, "a SECRET here", "secret")]
    assert storage.scrubbed({"a": {"b": 1, "c": 2}}, {"b": "d"}, ["c"]) == {"a": {"d": 1}}
    with pytest.raises(ContractError):
        storage.card("{{x}} {{y}}", {"x": "1"})
    with pytest.raises(ContractError):
        storage.write_dataset(df.where("i > 5"), f"{tmp_path}/d", DatasetMeta("d", "base", 0, depths=[0]))
    assert not storage.complete(spark, f"{tmp_path}/d")


def test_cursor(spark, tmp_path):
    c = Cursor(5)
    assert c.take(3) == [(0, 0), (0, 1), (0, 2)] and c.take(4) == [(0, 3), (0, 4), (1, 0), (1, 1)]
    c.give_back(9)
    assert c.offset == 0 and c.epoch == 1
    c.save(spark, f"{tmp_path}/cursor.json")
    assert vars(Cursor.load(spark, f"{tmp_path}/cursor.json")) == vars(c)
    with pytest.raises(Exception):
        Cursor.load(spark, f"{tmp_path}/none.json")


def test_resumable_chunks(spark, tmp_path):
    df, runs = spark.range(50), []

    def work(part):
        runs.append(1)
        return part.withColumn("x", F.col("id") * 2)

    assert resumable(df, "id", 4, work, str(tmp_path), {"p": 1}).count() == 50 and len(runs) == 4
    assert resumable(df, "id", 4, work, str(tmp_path), {"p": 1}).count() == 50 and len(runs) == 4
    assert resumable(df, "id", 2, work, str(tmp_path), {"p": 1}).count() == 50 and len(runs) == 6  # other chunks, no stale reuse


def test_stream(spark, tmp_path):
    spark.range(40).withColumn("v", F.col("id") / 10).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = score_stream(stream, lambda b: b.withColumn("reward", -F.col("v")), f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 40 and got.select("batch").distinct().count() == 4

    def fails(batch):
        raise RuntimeError("scorer is down")

    with pytest.raises(Exception, match="scorer is down"):
        score_stream(stream, fails, f"{tmp_path}/out2", f"{tmp_path}/ck2").awaitTermination(120)


def test_metrics_edges(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "g long, r double")
    assert [r["advantage"] for r in metrics.advantages(df, "g", "r").orderBy("g", "r").collect()] == [-1.0, 1.0, 0.0]
    few = spark.createDataFrame([(1, 1.0, 1.0)], "k long, a double, b double")
    assert metrics.path_agreement(few, "a", "b", "k").first()["agree"] is None


def test_token_metadata_and_drift():
    from brindle.plugins import token_metadata, verify_tokens

    tok = WordTokenizer()
    actor = "See <concept>{injection_char}</concept> and <concept>{injection_char}</concept>."
    tokens = token_metadata(tok, actor, 2, "</text> <summary>")
    meta = DatasetMeta("x", "ar_sft", 1, depths=[0, 24], tokens=tokens, templates={"actor": actor, "critic": "{explanation}"})
    verify_tokens(meta, tok)
    other = WordTokenizer()
    other.ids("shifts all ids")
    with pytest.raises(ContractError):
        verify_tokens(meta, other)
    with pytest.raises(ContractError):
        verify_tokens(DatasetMeta("x", "base", 1, depths=[0]), tok)


def test_greedy_files(spark, sf_dir):
    from brindle.operators.embedding import embedded, greedy_files
    from brindle.plans.catalog import QUERIES

    parts = {}
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey").collect():
        parts.setdefault(r["p_brand"], []).append((r["p_partkey"], r["p_size"]))
    want = []
    for brand, items in parts.items():
        file, used = 0, 0
        for key, size in items:
            if used and used + size > 100:
                file, used = file + 1, 0
            used += size
            want.append((brand, key, file))
    assert values(QUERIES["tensor_files"](spark, sf_dir)) == sorted(want)
    assert greedy_files(spark.read.parquet(f"{sf_dir}/part.parquet").where("false"), "p_brand", "p_partkey", "p_size", 9).count() == 0
    with pytest.raises(Exception, match="no vector for token 5"):
        embedded(spark.createDataFrame([(5,)], "t long"), "t", spark.createDataFrame([(1, [1.0])], "k long, v array<double>"), "k", "v").collect()
