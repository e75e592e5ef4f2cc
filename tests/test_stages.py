"""Contracts that must fail, stages that must resume, and what stands beside the data."""

import json
import textwrap

import pytest
from pyspark.sql import functions as F

from brindle import plugins
from brindle.functions import text as X
from brindle.functions import vectors as V
from brindle.meta import DatasetMeta, Tokens, base_id, checkpoints, source_of
from brindle.operators import embedding, metrics, ordering, rollout
from brindle.operators.contracts import ContractError
from brindle.plans import pipeline as P
from brindle.plans import stages as S
from brindle.sources import rollouts, storage
from brindle.streaming import scoring


def values(df):
    return sorted(tuple(r) for r in df.collect())


# metadata


def test_all_faults_are_told_at_once():
    meta = DatasetMeta("a", "ar_sft", 1, depths=[24, 0], norm="l2")
    found = " ".join(meta.faults())
    assert "sorted" in found and "l2" in found and "tokens" in found and "critic's template" in found
    with pytest.raises(ContractError, match="a .ar_sft."):
        meta.to_json()
    good = DatasetMeta("a", "ar_sft", 1, depths=[24], tokens=Tokens("m", 1, 2, 3, [4, 5]), templates={"actor": "x {injection_char}", "critic": "{explanation}"}, settings={"k": [1]})
    back = DatasetMeta.from_json(good.to_json())
    assert back.tokens == good.tokens and back.settings == {"k": [1]} and back.created_at and "seed" not in json.loads(good.to_json())
    assert DatasetMeta.from_json(back.to_json()) == back
    with pytest.raises(ContractError, match="row_count"):
        DatasetMeta.from_json(good.to_json().replace('"row_count": 1', '"row_count": "1"'))
    with pytest.raises(ContractError, match="without a layer"):
        DatasetMeta.from_json('{"kind": "dataset", "version": 1, "dataset_id": "a", "stage": "base", "row_count": 1}')
    with pytest.raises(ContractError, match="not a dataset"):
        DatasetMeta.from_json("[]")
    with pytest.raises(ContractError, match="beyond 20"):
        checkpoints([4, 24], 20)


def test_where_settings_come_from():
    holds = {"/m"}.__contains__
    assert source_of("/x", "/m", "/d", holds) == "/x"
    assert source_of(None, "/m", "/d", holds) == "/m"
    assert source_of(None, "/none", "/d", holds) == "/d"
    with pytest.raises(ContractError):
        source_of(None, "/none", None, holds)


# text


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("word **bold** more", "word **bold** more"),
        ("**a*b** c", "a*b c"),
        ("**Head:**   text**", "Head: text"),
        ("**one** **two**", "one **two"),
        ("- **x**y", "x y"),
        (" - **x** y ", "x y"),
        ("***x*** y", "x * y"),
        ("****", ""),
    ],
)
def test_emphasis_is_unwrapped_at_the_start_only(spark, line, want):
    df = spark.createDataFrame([(f"<analysis>{line}\nlast</analysis>",)], "t string")
    assert df.select(X.cleaned(F.col("t"))).first()[0] == "\n\n".join(x for x in (want, "last") if x)


def test_sliced_paths():
    assert X.sliced_path("a/b.parquet@[3:9]") == ("a/b.parquet", (3, 9))
    assert X.sliced_path("a@[:]") == ("a", (0, None)) and X.sliced_path("a@[2:]") == ("a", (2, None)) and X.sliced_path("a@[:0]") == ("a", (0, 0))
    assert X.sliced_path("a") == ("a", None)


@pytest.mark.parametrize("text", ["", "one", "some words that go on for more than one line of text", "averyveryverylongwordthatfitsnoline and more", "a  b   c " * 9])
def test_wrapping(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(X.wrapped_lines(F.col("t"), 12)).first()[0]
    assert all(0 < len(x) <= 12 for x in got) and "".join("".join(got).split()) == "".join(text.split())
    if not any(len(w) > 12 for w in text.split()) and "  " not in text:
        assert got == textwrap.wrap(text, 12)


# vectors


def test_vectors_are_checked(spark):
    rows = [([1.0, 2.0],), (None,), ([1.0],), ([1.0, float("nan")],), ([1.0, None],)]
    good = V.checked_vector(F.col("v"), 2)
    assert spark.createDataFrame(rows[:1], "v array<double>").select(good.alias("v")).first()[0] == [1.0, 2.0]
    for k, said in ((1, "null"), (2, "1 components"), (3, "not finite"), (4, "not finite")):
        with pytest.raises(Exception, match=said):
            spark.createDataFrame([rows[k]], "v array<double>").select(good).collect()


def test_reshaping(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "v array<double>")
    got = df.select(V.reshaped(F.col("v"), 2).alias("m")).select("m", V.flattened(F.col("m")).alias("v")).collect()
    assert [list(map(list, r["m"])) for r in got] == [[[1.0, 2.0], [3.0, 4.0]], []] and [r["v"] for r in got] == [[1.0, 2.0, 3.0, 4.0], []]
    with pytest.raises(Exception, match="no rows of 3"):
        df.select(V.reshaped(F.col("v"), 3)).collect()


def test_response_mask(spark):
    df = spark.createDataFrame([([1, 2, 9], [1, 2, 3, 4]), ([1, 2], [1, 2]), ([], [5])], "a array<int>, b array<int>")
    got = [r[0] for r in df.select(V.response_mask(F.array("a", "b"), F.array(F.lit(7)))).collect()]
    assert got == [[0, 0, 1, 1, 1], [0, 0, 1], [1, 1]]


def test_block_scales(spark):
    df = spark.createDataFrame([(0, [1.0, -4.48, 0.0]), (1, [0.0, 0.0, 0.0]), (2, [8.96, 0.0, 0.0])], "r long, v array<double>")
    got = {(r["tile_row"], r["tile_column"]): r["scale"] for r in metrics.block_scales(df, "r", "v", 2).collect()}
    assert got == {(0, 0): pytest.approx(0.01), (0, 1): 0.0, (1, 0): pytest.approx(0.02), (1, 1): 0.0}


# ranks


def test_smallest_rank_below_a_micro_batch(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "rank long, i long")
    with pytest.raises(ValueError, match="fewer than a micro-batch of 2"):
        rollout.rank_min_truncate(df, "rank", "i", 2)
    assert rollout.rank_min_truncate(df.where("false"), "rank", "i", 2).count() == 0


def test_lists_of_strided_ranks(spark):
    parts = {0: [1, 5], 1: [2], 2: [3, 4, 9], 3: [7], 4: [0, 8]}
    df = spark.createDataFrame([(p, x, 10 * p) for p, xs in parts.items() for x in xs], "part long, x long, total long")
    rows = rollout.repartitioned(df, "part", "x", 2, ["total"]).orderBy("target_rank", "position").collect()
    got = {}
    for r in rows:
        got.setdefault(r["target_rank"], []).append((r["x"], r["total"]))
    assert got == {0: [(x, 0) for p in (0, 2, 4) for x in parts[p]], 1: [(x, 10) for p in (1, 3) for x in parts[p]]}
    assert [r["position"] for r in rows] == [0, 1, 2, 3, 4, 5, 6, 0, 1]
    with pytest.raises(ValueError, match="6 targets for 5 parts"):
        rollout.repartitioned(df, "part", "x", 6)


def test_offsets_across_ranges(spark):
    df = spark.createDataFrame([("hot" if i % 3 else None, i * 700, i % 5) for i in range(200)], "g string, k long, n long")
    got = {(r["g"], r["k"]): r["last_index"] for r in ordering.last_token_offsets(df, ["g"], "k", "n").collect()}
    sums = {}
    for g, k, n in sorted(((r["g"] or "", r["k"], r["n"]) for r in df.collect())):
        sums[g] = sums.get(g, 0) + n
        assert got[(g or None, k)] == sums[g] - 1


def test_first_by_key(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), (None, 5, "n")], "k string, o long, v string")
    assert set(map(tuple, ordering.first_by_key(df, ["k"], "o").collect())) == {("a", 1, "y"), ("b", 2, "z"), (None, 5, "n")}


def test_exact_percentiles(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for values_ in ([], [2.5], [1.0, 2.0], [3.0] * 50, [*rng.normal(size=3000).tolist(), *[0.25] * 2000, None, None]):
        df = spark.createDataFrame([(x,) for x in values_], "r double").repartition(3)
        got = metrics.reward_summary(df, "r").first()
        known = [x for x in values_ if x is not None]
        assert got["n"] == len(known)
        for p in metrics.PERCENTILES:
            assert got[f"p{round(100 * p)}"] == (pytest.approx(np.quantile(known, p)) if known else None)


def test_bundles_by_text_keys(spark):
    df = spark.createDataFrame([(f"k{i}", float(i), i * 10) for i in range(50)], "k string, activation_a double, n long")
    got = S.shuffle_bundles(df, "k", ["activation_a"], 3, "x").collect()
    assert {(r["k"], r["n"]) for r in got} == {(f"k{i}", i * 10) for i in range(50)} and sorted(r["activation_a"] for r in got) == [float(i) for i in range(50)]
    assert any(r["n"] != 10 * r["activation_a"] for r in got)
    with pytest.raises(ContractError):
        S.shuffle_bundles(df, "k", [], 3, "x")


def test_packed_rows(spark):
    df = spark.createDataFrame([(0, 1, ["a", "b"], 3), (0, 2, ["c"], 3), (0, 3, ["d", "e", "f"], 3)], "b long, n long, t array<string>, w int")
    got = embedding.packed_rows(df, "b", "n", "t", "<p>", "w").orderBy("n").collect()
    assert [(r["begins"], r["ends"]) for r in got] == [(0, 2), (2, 3), (3, 6)]
    assert got[1]["padded"] == ["c", "<p>", "<p>"] and got[1]["mask"] == [1, 0, 0]


# storage


def test_push_takes_the_whole_tree(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    spark.range(30).withColumn("bucket", F.col("id") % 3).write.partitionBy("bucket").parquet(a)
    storage.push(spark, a, b)
    storage.pull(spark, b, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").groupBy("bucket").count().count() == 3 and spark.read.parquet(b).count() == 30
    files = storage.Files(spark)
    for n in (9, 80, 500):
        files.write(f"{tmp_path}/runs/iter_{n}/w.txt", str(n))
    assert storage.push(spark, f"{tmp_path}/runs", f"{tmp_path}/last", latest="iter_") == ["w.txt"] and files.read(f"{tmp_path}/last/w.txt") == "500"
    with pytest.raises(ContractError, match="one name"):
        storage.push(spark, f"{tmp_path}/runs", f"{tmp_path}/flat", flat=True)
    assert storage.push(spark, f"{tmp_path}/runs/iter_9", f"{tmp_path}/flat", flat=True) == ["w.txt"]
    with pytest.raises(ContractError, match="no folder"):
        storage.push(spark, f"{tmp_path}/runs", f"{tmp_path}/x", latest="step_")


def test_rows_must_be_as_recorded(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "id long, activation_vector array<double>")
    meta = DatasetMeta("d", "base", 0, depths=[0], width=2)
    path = f"{tmp_path}/d"
    schema = spark.createDataFrame([], "activation_vector array<float>, id int").schema
    assert storage.write_dataset(df, path, meta, rows_per_file=4, schema=schema, rows_per_group=3).row_count == 10
    got, _ = storage.read_dataset(spark, path)
    assert got.dtypes == [("activation_vector", "array<float>"), ("id", "int")]
    import pyarrow.parquet as pq

    sizes = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in (tmp_path / "d").glob("*.parquet") for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert sum(sizes) == 10 and max(sizes) <= 4
    df.limit(1).select(F.col("activation_vector").cast("array<float>").alias("activation_vector"), F.col("id").cast("int")).write.mode("append").parquet(path)
    with pytest.raises(ContractError, match="11 rows, 10"):
        storage.read_dataset(spark, path)
    with pytest.raises(Exception, match="expected 3 components"):
        storage.write_dataset(df, f"{tmp_path}/e", DatasetMeta("d", "base", 0, depths=[0], width=3))
    with pytest.raises(ContractError, match="recorded"):
        storage.write_dataset(df.drop("id"), f"{tmp_path}/e", meta, schema=schema)
    assert not storage.complete(spark, f"{tmp_path}/e")


class Listed(storage.Files):
    """A store of a user's own."""


def test_stores_and_copies(spark, tmp_path):
    store = storage.storage_of(spark, f"{__name__}:Listed")
    assert isinstance(store, Listed) and isinstance(storage.storage_of(spark), storage.Files)
    store.write(f"{tmp_path}/x.txt", "one")
    at = storage.fetched(spark, f"{tmp_path}/x.txt", f"{tmp_path}/cache", store)
    store.write(f"{tmp_path}/x.txt", "two")
    assert storage.fetched(spark, f"{tmp_path}/x.txt", f"{tmp_path}/cache") == at and store.read(at) == "one"
    spark.range(5).write.parquet(f"{tmp_path}/t")
    assert spark.read.parquet(storage.fetched(spark, f"{tmp_path}/t", f"{tmp_path}/cache")).count() == 5
    assert storage.card("{{licence}} of {{x}}", {"x": "y"}, "small-base", {"small": "A", "small-base": "B"}) == "B of y"
    with pytest.raises(ContractError, match="no licence"):
        storage.card("{{licence}}", {}, "other", {"small": "A"})


# chunks and streams


def test_chunks_follow_what_rows_hold(spark, tmp_path):
    runs = []

    def work(part):
        runs.append(1)
        return part.select("id", F.upper("t").alias("u"))

    first = spark.createDataFrame([(1, "old", {"a": 1}), (2, "same", None), (2, "same", None)], "id long, t string, m map<string,int>")
    got = lambda df, **p: values(scoring.resumable(df, "id", 2, work, str(tmp_path), p))
    assert got(first) == [(1, "OLD"), (2, "SAME"), (2, "SAME")] and len(runs) == 2
    assert got(first.repartition(5)) == got(first) and len(runs) == 2
    changed = spark.createDataFrame([(1, "NEW", {"a": 1}), (2, "same", None), (2, "same", None)], first.schema)
    assert got(changed) == [(1, "NEW"), (2, "SAME"), (2, "SAME")] and len(runs) == 3
    got(first.limit(0).union(first.where("id = 1")))
    assert len(runs) == 4  # the repeated rows do not cancel out
    got(first, p=1)
    assert len(runs) == 6
    swapped = spark.createDataFrame([(1, None, "x"), (2, "x", None)], "id long, a string, b string")
    d = [swapped.agg(*scoring.content(swapped)).first(), swapped.select("id", F.col("b").alias("a"), F.col("a").alias("b")).agg(*scoring.content(swapped)).first()]
    assert d[0] != d[1]


def test_calls_are_bounded(spark, tmp_path):
    spark.range(45).write.parquet(f"{tmp_path}/in")
    sizes = []

    def scorer(batch):
        sizes.append(batch.count())
        return batch.withColumn("r", F.col("id") * 2)

    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    scoring.score_stream(stream, scorer, f"{tmp_path}/out", f"{tmp_path}/ck", size=16, key="id").awaitTermination(120)
    assert sizes == [16, 16, 13] and spark.read.parquet(f"{tmp_path}/out/batch=0").count() == 45


def test_mailbox_and_refreshed_tables(spark, tmp_path):
    box = scoring.Mailbox()
    assert box.get() is None
    box.put_latest(spark.createDataFrame([(2, "b"), (1, "a")], "n long, v string"), "n")
    assert box.get()["v"] == "b"
    box.put_latest(spark.createDataFrame([], "n long, v string"), "n")
    assert box.get()["v"] == "b"
    clock = [0.0]
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    table = scoring.Refreshed(spark, path, 1.0, lambda: clock[0])
    assert table().count() == 3 and table.reads == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    clock[0] = 0.5
    table()
    assert table.reads == 1  # not looked at again so soon
    clock[0] = 2.0
    assert table().count() == 5 and table.reads == 2
    clock[0] = 4.0
    table()
    assert table.reads == 2  # looked at, unchanged


def test_last_write_wins_in_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "k string, s long, v string").withColumn("t", F.timestamp_seconds(F.col("s"))).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, s long, v string, t timestamp").parquet(f"{tmp_path}/in")
    query = scoring.latest_by_key(stream, "k", "s", "1 minute", "t").writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["k"], r["row"]["v"]) for r in spark.table("latest").collect()} == {("a", "z"), ("b", "y")}


# plug-ins


def shout(texts):
    return [t.upper() for t in texts]


def test_functions_by_path():
    assert plugins.load_callable(f"{__name__}:shout") is shout
    assert plugins.wired({"reward": f"{__name__}.shout", "source": f"{__name__}:Listed"}) == {"reward": shout, "source": Listed}
    for bad in ({"other": "a.b"}, {"reward": f"{__name__}:values.x"}, {"reward": "brindle.meta:VERSION"}, {"source": f"{__name__}:shout"}):
        with pytest.raises((ContractError, ImportError)):
            plugins.wired(bad)
    assert plugins.embedding_scale("gemma-3", 64) == 8.0 and plugins.embedding_scale("qwen2", 64) == 1.0


def test_transient_failures_are_tried_again(spark):
    calls = []

    def flaky(given):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError("busy")
        return given

    assert plugins.patient(flaky, (TimeoutError,), 4, 0.0)([1]) == [1] and len(calls) == 3
    calls.clear()
    with pytest.raises(TimeoutError):
        plugins.patient(flaky, (TimeoutError,), 2, 0.0)([1])
    calls.clear()
    with pytest.raises(TimeoutError):
        plugins.patient(flaky, (ConnectionError,), 9, 0.0)([1])
    df = spark.createDataFrame([(str(i),) for i in range(20)], "t string")
    out = plugins.CallableProvider(shout, 4, concurrency=3).complete(df, "t", "r")
    assert out.rdd.getNumPartitions() == 3 and out.where("t <> r").isEmpty()
    with pytest.raises(Exception, match="an answer is empty"):
        plugins.CallableProvider(lambda xs: ["" for _ in xs]).complete(df, "t", "r").collect()


def test_boundaries_between_texts_and_vectors(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "t string")
    v = plugins.reconstruct(df, "t", "v", lambda ts: [[float(len(t)), 1.0] for t in ts], 2)
    assert values(v) == [("ab", [2.0, 1.0]), ("c", [1.0, 1.0])] and dict(v.dtypes)["v"] == "array<float>"
    assert values(plugins.generate(v, "v", "u", lambda vs: [str(x[0]) for x in vs]).select("t", "u")) == [("ab", "2.0"), ("c", "1.0")]
    for fn in (lambda ts: [[1.0] for _ in ts], lambda ts: [[1.0, float("nan")] for _ in ts]):
        with pytest.raises(Exception, match="expected 2 finite"):
            plugins.reconstruct(df, "t", "v", fn, 2).collect()
    with pytest.raises(Exception, match="without a text"):
        plugins.generate(v, "v", "u", lambda vs: [None for _ in vs]).collect()


def test_extractors_by_layer_must_agree(spark):
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(7)], "vec_id long, embedding array<float>")
    one, two = plugins.TableExtractor(vectors), plugins.TableExtractor(vectors)
    docs = spark.createDataFrame([("d", "a b c")], "doc_id string, text string")
    both = plugins.LayerwiseExtractor({24: two, 0: one})
    tokens = both.tokens(docs, "doc_id", "text")
    assert tokens.first()["tokens"] == ["a", "b", "c"]
    assert both.attach(tokens.withColumn("pos", F.lit(1)), "doc_id", "pos", [0, 24]).columns[-2:] == ["activation_embedding", "activation_block_24"]
    two.tokens = lambda d, i, t: d.select(i, F.split(F.upper(t), " ").alias("tokens"))
    with pytest.raises(Exception, match="different tokens in d"):
        both.tokens(docs, "doc_id", "text").collect()
    with pytest.raises(ContractError, match="no extractor"):
        both.attach(tokens, "doc_id", "pos", [4])


def test_markers_are_kept_by_name_and_checked():
    tok = plugins.WordTokenizer()
    first = plugins.marker_of(tok, "t1")
    assert plugins.marker_of(tok, "t1") == first
    other = plugins.WordTokenizer()
    other.ids("shifts all")
    with pytest.raises(ContractError, match="its marker"):
        plugins.marker_of(other, "t1")


def test_settings_of_a_run(spark, tmp_path):
    tok, actor = plugins.WordTokenizer(), "See <concept>{injection_char}</concept>."
    meta = DatasetMeta("kept", "av_sft", 0, depths=[0], width=1, tokens=plugins.token_metadata(tok, actor, 1), templates={"actor": actor})
    rows = spark.createDataFrame([([1.0],)], "activation_vector array<float>")
    storage.write_dataset(rows, f"{tmp_path}/data", meta)
    got = plugins.runtime_settings(spark, tok, model_dir=f"{tmp_path}/nothing", dataset=f"{tmp_path}/data")
    assert got.tokens == meta.tokens and got.row_count == 1
    assert plugins.runtime_settings(spark, tok, model_dir=f"{tmp_path}/data", dataset=f"{tmp_path}/nothing").dataset_id == "kept"
    other = plugins.WordTokenizer()
    other.ids("shifts all ids")
    with pytest.raises(ContractError):
        plugins.runtime_settings(spark, other, dataset=f"{tmp_path}/data")
    with pytest.raises(ContractError):
        plugins.runtime_settings(spark, tok, model_dir=f"{tmp_path}/nothing")


def test_presets_of_a_file(spark, tmp_path):
    storage.Files(spark).write(f"{tmp_path}/presets.json", '{"small": {"layers": 24, "width": 896, "joint": false}}')
    found = P.presets_from(spark, f"{tmp_path}/presets.json")
    assert P.resolved({"model": "small"}, found) == {"model": "small", "width": 896, "joint": False, "layer": 16}


# the pipeline's stages


CONFIG = {
    "model_name": "org/probe", "corpus_name": "documents", "key": "doc_id", "start": 0, "length": 60, "positions": 3, "seed": 42, "width": 64, "depths": [0, 24], "specials": ["of"],
    "fractions": {"av_sft": 0.3, "ar_sft": 0.3, "rl": 0.4}, "critic": "<t>{explanation}</t> <s>", "shuffle_seed": 1, "tokens": {"marker": "㊗", "marker_id": 8, "left_id": 7, "right_id": 9, "critic_suffix": [1, 2]},
}


class Counting(plugins.EchoProvider):
    settings = {"model": "echo"}

    def __init__(self, fail_at=None):
        self.calls, self.fail_at = 0, fail_at

    def complete(self, rows, text, into):
        self.calls += 1
        if self.calls == self.fail_at:
            raise RuntimeError("out of credit")
        return super().complete(rows, text, into)


def test_stages_resume_rejoin_recover_and_shuffle(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extractor = plugins.TableExtractor(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    config = CONFIG | {"out": str(tmp_path), "chunks": 3, "joint": False}
    with pytest.raises(RuntimeError, match="out of credit"):
        P.run(spark, config, docs, extractor, Counting(fail_at=3))
    again, sent = Counting(), []
    finals = P.run(spark, config | {"baseline": 7}, docs, extractor, again, upload=lambda files, name: sent.append((files, name)))
    assert again.calls == 4  # two of the first three chunks were paid for
    name = base_id("org/probe", [0, 24], "documents", {"start": 0, "length": 60})
    explained = [P.path_of(str(tmp_path), name, f"{b}_explained") for b in ("av_sft", "ar_sft")]
    assert sent == [([*finals, *explained], name)]
    for path in finals:
        if "__bundles7" in path:
            moved, _ = storage.read_dataset(spark, path)
            rows, meta = storage.read_dataset(spark, path.removesuffix("__bundles7"))
            assert moved.count() == meta.row_count and moved.drop("activation_vector").exceptAll(rows.drop("activation_vector")).isEmpty()
            assert not moved.select("row_id", "activation_vector").exceptAll(rows.select("row_id", "activation_vector")).isEmpty()
    loaded = P.load_samples(spark, next(p for p in finals if "/av_sft" in p and "bundles" not in p), "㊗")
    assert "response" in loaded.columns and "㊗" in loaded.first()["prompt"][0]["content"]
    with pytest.raises(ContractError, match="read whole"):
        P.load_samples(spark, finals[0] + "@[0:5]", "㊗")
    assert P.load_corpus(spark, f"{sf_dir}/documents.parquet@[5:15]", "doc_id").count() == 10
    with pytest.raises(ContractError, match="other settings"):
        P.run(spark, config, docs, extractor, Counting(), overrides=["positions=4"])
    # an earlier run's explanations by exact key
    prior = spark.read.parquet(*explained).select("doc_id", "n_raw_tokens", F.lit(1).alias("ordinal"), "api_explanation")
    everything = prior.union(spark.read.parquet(P.path_of(str(tmp_path), name, "raw")).select("doc_id", "n_raw_tokens", F.lit(0), F.lit("a\n\nb")))
    other = config | {"out": f"{tmp_path}/second", "stages": ["extract", "split", "explain"]}
    P.run(spark, other, docs, extractor, Counting(fail_at=1), prior=everything)
    second = spark.read.parquet(P.path_of(f"{tmp_path}/second", name, "av_sft_explained"))
    assert second.count() == spark.read.parquet(P.path_of(f"{tmp_path}/second", name, "raw")).where("bucket = 'av_sft'").count()
    with pytest.raises(ValueError, match="rows match"):
        P.run(spark, other | {"out": f"{tmp_path}/third"}, docs, extractor, Counting(), prior=prior.limit(3))
    # caches from training tables that kept their texts
    rows = spark.read.parquet(explained[0])
    table = S.build_training(S.Explained(rows), "av_sft", depth=0, keep_text=True)
    meta = DatasetMeta("kept", "av_sft", 0, depths=[0], width=64, tokens=Tokens("㊗", 8, 7, 9), templates={"actor": "{injection_char}"})
    storage.write_dataset(table, f"{tmp_path}/kept", meta)
    (cache,) = P.recover_caches(spark, [f"{tmp_path}/kept"], f"{tmp_path}/caches")
    assert values(spark.read.parquet(cache)) == values(rows.select("detokenized_text_truncated", "api_explanation")) and not storage.complete(spark, cache)
    with pytest.raises(Exception, match="missing or empty"):
        S.recover(table.withColumn("response", F.lit("none"))).collect()


def test_dump_to_report(spark, tmp_path):
    for n in range(2):
        samples = [{"reward": -i / 10 - n, "group_index": i // 4, "response": f"<explanation>why {i}</explanation>", "response_length": 3, "metadata": {"doc_id": f"web:{i}", "detokenized_text_truncated": "some words of a text " * 9, "n_raw_tokens": 51, "activation_vector": [1.0, 2.0]}} for i in range(12)]
        (tmp_path / f"dump{n}.json").write_text(json.dumps({"rollout_id": n, "samples": samples}))
    rows = rollouts.rollout_dumps(spark, str(tmp_path / "dump*.json"))
    assert rows.count() == 24 and rows.where("rollout_id = 1 AND sample_id = 3").first()["reward"] == pytest.approx(-1.3)
    P.write_report(rows.where("rollout_id = 0"), f"{tmp_path}/report", top=2, middle=2, bottom=1, shown=60, labels=[("web", "the web")])
    told = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(f"{tmp_path}/report").collect())
    assert told.count("[top]") == 2 and told.count("[bottom]") == 1 and "the web" in told and "more chars]" in told and "why 11" in told
    assert {len(x) for x in told.split("\n") if x.startswith("  │")} == {100 + 2 + 4}
    (tmp_path / "bad.json").write_text("{broken")
    with pytest.raises(Exception):
        rollouts.rollout_dumps(spark, str(tmp_path / "bad.json")).collect()
