"""Text functions, templates, caches and training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.operators import joins
from brindle.plans.registry import WITH_ANSWERS, WITH_BASE, WITH_CLEAN, answers, clean, kept_base, query, table, vectors

CRITIC = X.Template("Summary of what follows.\n<text>{explanation}</text> <summary>", "explanation")
ACTOR = "Describe what this vector holds: <concept>{injection_char}</concept>"


@query(f"WITH {WITH_CLEAN} SELECT doc_id, explanation FROM c")
def explain_clean(spark, d):
    """Answers without tags, list markers and emphasis; null without both tags."""
    return clean(spark, d)


@query(f"WITH {WITH_CLEAN} SELECT doc_id, len(string_split(explanation, chr(10) || chr(10))) AS n_paragraphs FROM c WHERE len(string_split(explanation, chr(10) || chr(10))) >= 2")
def explain_keep(spark, d):
    return clean(spark, d).where(X.worth_keeping(F.col("explanation"))).select("doc_id", X.paragraphs(F.col("explanation")).alias("n_paragraphs"))


@query(f"""WITH {WITH_CLEAN} SELECT CASE WHEN explanation IS NULL THEN 'no answer' WHEN len(string_split(explanation, chr(10) || chr(10))) < 2 THEN 'too few' ELSE 'kept' END AS outcome, count(*) AS n FROM c GROUP BY 1""")
def drop_counts(spark, d):
    outcome = F.when(F.col("explanation").isNull(), "no answer").when(X.paragraphs(F.col("explanation")) < 2, "too few").otherwise("kept")
    return clean(spark, d).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id, sha256('<explanation>' || chr(10) || text || chr(10) || '</explanation>') AS wrapped_sha256, regexp_replace(text, '^\s+|\s+$', '', 'g') AS payload,
'<explanation></explanation>' LIKE '%<explanation>%' AND doc_id % 3 = 0 AS is_empty FROM documents""")
def wrap_extract(spark, d):
    """Wrap and extract again; every third document wraps nothing too, which extracts as ''."""
    w = X.wrapped(F.col("text"))
    empty = X.payload(F.lit("<explanation></explanation>")) == ""
    return table(spark, d, "documents").select("doc_id", X.sha256(w).alias("wrapped_sha256"), X.payload(w).alias("payload"), (empty & (F.pmod("doc_id", F.lit(3)) == 0)).alias("is_empty"))


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<explanation> ' || text || '</explanation> more' WHEN 1 THEN '</explanation><explanation>' || text WHEN 2 THEN '<explanation>' || text ELSE ' ' || text || ' ' END AS r FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(r, '<explanation>(.*?)</explanation>', 's') THEN regexp_replace(regexp_extract(r, '<explanation>(.*?)</explanation>', 1, 's'), '^\s+|\s+$', '', 'g') ELSE r END AS or_text,
regexp_replace(CASE WHEN instr(r, '<explanation>') > 0 AND instr(r, '</explanation>') > 0 THEN substring(r, instr(r, '<explanation>') + 13, greatest(instr(r, '</explanation>') - instr(r, '<explanation>') - 13, 0)) ELSE r END, '^\s+|\s+$', '', 'g') AS body FROM t""")
def extract_lenient(spark, d):
    t, n = F.col("text"), F.pmod("doc_id", F.lit(4))
    r = F.when(n == 0, F.concat(F.lit("<explanation> "), t, F.lit("</explanation> more"))).when(n == 1, F.concat(F.lit("</explanation><explanation>"), t)).when(n == 2, F.concat(F.lit("<explanation>"), t)).otherwise(F.concat(F.lit(" "), t, F.lit(" ")))
    return table(spark, d, "documents").select("doc_id", r.alias("r")).select("doc_id", X.payload_or_text(F.col("r")).alias("or_text"), X.body(F.col("r")).alias("body"))


@query("SELECT doc_id, 'Summary of what follows.' || chr(10) || '<text>' || text || '</text> <summary>' AS prompt FROM documents")
def critic_prompt(spark, d):
    return table(spark, d, "documents").select("doc_id", CRITIC.fill(F.col("text")).alias("prompt"))


@query("SELECT doc_id, text FROM documents")
def unwrap_template(spark, d):
    """Fill and invert the critic's template: the text comes back."""
    return critic_prompt(spark, d).select("doc_id", CRITIC.unfill(F.col("prompt")).alias("text"))


CACHES = """ca AS (SELECT sha256(text) AS key, arg_max(value, (cache, doc_id)) AS explanation FROM (
  SELECT 0 AS cache, doc_id, text, 'first ' || doc_id AS value FROM documents WHERE source IN ('src0', 'src1')
  UNION ALL SELECT 1, doc_id, text, 'second ' || doc_id FROM documents WHERE source IN ('src1', 'src2')) GROUP BY 1)"""


def caches(spark, d):
    docs = table(spark, d, "documents")
    first = docs.where(F.col("source").isin("src0", "src1")).select("doc_id", "text", F.concat(F.lit("first "), F.col("doc_id").cast("string")).alias("explanation"))
    second = docs.where(F.col("source").isin("src1", "src2")).select("doc_id", "text", F.concat(F.lit("second "), F.col("doc_id").cast("string")).alias("explanation"))
    return joins.cache_union([first, second], "doc_id", "text", "explanation")


@query(f"WITH {CACHES} SELECT doc_id, explanation FROM documents LEFT JOIN ca ON sha256(text) = key")
def cache_join(spark, d):
    return joins.cache_lookup(table(spark, d, "documents").select("doc_id", "text"), "text", caches(spark, d), "explanation").select("doc_id", "explanation")


@query(f"WITH {CACHES} SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT key FROM ca)")
def cache_misses(spark, d):
    return joins.cache_misses(table(spark, d, "documents").select("doc_id", "text"), "text", caches(spark, d)).select("doc_id")


@query(f"WITH {CACHES}, {WITH_CLEAN} SELECT doc_id, coalesce(ca.explanation, c.explanation) AS explanation, ca.explanation IS NOT NULL AS cached FROM documents LEFT JOIN ca ON sha256(text) = key JOIN c USING (doc_id)")
def cache_coalesce(spark, d):
    hit = cache_join(spark, d).withColumnRenamed("explanation", "hit")
    fresh = clean(spark, d).withColumnRenamed("explanation", "fresh")
    return hit.join(fresh, "doc_id").select("doc_id", joins.coalesced(F.col("hit"), F.col("fresh")).alias("explanation"), F.col("hit").isNotNull().alias("cached"))


PRIOR = """prior AS (SELECT doc_id, n_raw_tokens, arg_max(value, ordinal) AS explanation FROM (
  SELECT doc_id, n_raw_tokens, n AS ordinal, 'old ' || n_raw_tokens AS value FROM base UNION ALL SELECT doc_id, n_raw_tokens, n + 1, 'new ' || n_raw_tokens FROM base WHERE n % 3 = 0) GROUP BY ALL)"""


def prior(rows):
    """An earlier run's rows, all of them, a third of them twice: the later of two wins."""
    said = lambda word: F.concat(F.lit(f"{word} "), F.col("n_raw_tokens").cast("string")).alias("explanation")
    old = rows.select("doc_id", "n_raw_tokens", F.col("n").alias("ordinal"), said("old"))
    return old.union(rows.where(F.pmod("n", F.lit(3)) == 0).select("doc_id", "n_raw_tokens", (F.col("n") + 1).alias("ordinal"), said("new")))


@query(f"WITH {WITH_BASE}, {PRIOR} SELECT doc_id, n_raw_tokens, explanation FROM base JOIN prior USING (doc_id, n_raw_tokens)")
def exact_key_join(spark, d):
    rows = kept_base(spark, d)
    return joins.exact_key_join(rows.select("doc_id", "n_raw_tokens"), prior(rows), ["doc_id", "n_raw_tokens"], "ordinal", "explanation")


@query(f"WITH {WITH_BASE}, {PRIOR} SELECT count(*) AS n_rows, count(prior.doc_id) AS n_matched, count(prior.doc_id) / count(*) AS rate FROM base LEFT JOIN prior USING (doc_id, n_raw_tokens)")
def match_rate(spark, d):
    rows = kept_base(spark, d)
    return joins.match_rate(rows, prior(rows), ["doc_id", "n_raw_tokens"])


@query(f"WITH {WITH_BASE}, {PRIOR} SELECT doc_id || ' ' || n_raw_tokens AS detokenized_text_truncated, explanation AS api_explanation FROM prior")
def recover_cache(spark, d):
    """A cache recovered from the critic's and the actor's training rows, half each, by inverting template and tags."""
    from brindle.plans.stages import recover

    last = joins.last_wins(prior(kept_base(spark, d)), ["doc_id", "n_raw_tokens"], "ordinal", "explanation")
    rows = last.select(F.concat_ws(" ", "doc_id", "n_raw_tokens").alias("detokenized_text_truncated"), "n_raw_tokens", X.wrapped(F.col("explanation")).alias("response"), CRITIC.fill(F.col("explanation")).alias("prompt"))
    half = F.pmod("n_raw_tokens", F.lit(2)) == 0
    return recover(rows.where(half)).union(recover(rows.where(~half), template=CRITIC))


TRAIN = f"WITH {WITH_BASE}, {PRIOR}"
PROMPT = "'user: Describe what this vector holds: <concept><INJECT></concept>'"


def told(df, prompt="prompt"):
    """Messages as text, a line each, so that both engines show them alike."""
    return df.withColumn(prompt, F.array_join(F.transform(prompt, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n"))


def training_rows(spark, d):
    from brindle.plans.stages import Explained

    rows = kept_base(spark, d)
    rows = joins.exact_key_join(rows.select("doc_id", "n_raw_tokens", "v24"), prior(rows), ["doc_id", "n_raw_tokens"], "ordinal", "explanation")
    v = vectors(spark, d).select(F.col("vec_id").alias("v24"), F.col("embedding").alias("activation_block_24"))
    return Explained(rows.join(v, "v24").withColumnRenamed("explanation", "api_explanation").drop("v24"))


@query(f"""{TRAIN} SELECT {PROMPT} AS prompt, '<explanation>' || chr(10) || explanation || chr(10) || '</explanation>' AS response, embedding AS activation_vector, n_raw_tokens,
'block_24' AS activation_checkpoint, 24::BIGINT AS activation_depth, 23::BIGINT AS activation_layer, doc_id FROM base JOIN prior USING (doc_id, n_raw_tokens) JOIN embeddings ON vec_id = v24""")
def train_av(spark, d):
    from brindle.plans.stages import build_training

    return told(build_training(training_rows(spark, d), "av_sft", actor=ACTOR, depth=24))


@query(f"""{TRAIN} SELECT 'Summary of what follows.' || chr(10) || '<text>' || explanation || '</text> <summary>' AS prompt, embedding AS activation_vector, n_raw_tokens,
'block_24' AS activation_checkpoint, 24::BIGINT AS activation_depth, 23::BIGINT AS activation_layer, doc_id FROM base JOIN prior USING (doc_id, n_raw_tokens) JOIN embeddings ON vec_id = v24""")
def train_ar(spark, d):
    from brindle.plans.stages import build_training

    return build_training(training_rows(spark, d), "ar_sft", critic=CRITIC, depth=24)


@query(f"""{TRAIN} SELECT {PROMPT} AS prompt, embedding AS activation_block_24, n_raw_tokens, doc_id FROM base JOIN prior USING (doc_id, n_raw_tokens) JOIN embeddings ON vec_id = v24""")
def train_rl(spark, d):
    from brindle.plans.stages import build_training

    return told(build_training(training_rows(spark, d), "rl", actor=ACTOR, joint=[24]))


MARKED = "text || CASE WHEN turn = 0 THEN ' <INJECT> and <INJECT>' ELSE '' END"


def turns(spark, d):
    """Messages a row each: a conversation of any length is never one value. First turns hold two sites."""
    c = table(spark, d, "conversations")
    content = F.concat("text", F.when(F.col("turn") == 0, " <INJECT> and <INJECT>").otherwise(""))
    return c.select("conv_id", "turn", "role", "text", F.array(F.struct("role", content.alias("content"))).alias("prompt"))


@query(f"SELECT conv_id, sum((length(x) - length(replace(x, '<INJECT>', ''))) // 8)::BIGINT AS n_sites FROM (SELECT conv_id, {MARKED} AS x FROM conversations) GROUP BY conv_id")
def marker_count(spark, d):
    """Sites of a conversation: counts of its messages, which add up before the shuffle."""
    return turns(spark, d).groupBy("conv_id").agg(F.sum(X.count_in_messages(F.col("prompt"), "<INJECT>")).alias("n_sites"))


@query(f"SELECT conv_id, turn, role || ': ' || replace({MARKED}, '<INJECT>', '㊗') AS prompt FROM conversations")
def marker_replace(spark, d):
    return told(turns(spark, d).select("conv_id", "turn", X.replace_in_messages(F.col("prompt"), "<INJECT>", "㊗").alias("prompt")))


@query("""SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || ' … [' || (length(text) - 100) || ' more chars]' ELSE text END AS shown,
CASE WHEN contains(source, 'src1') THEN 'one' WHEN contains(source, 'src2') THEN 'two' ELSE 'other' END AS label FROM documents""")
def report_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.shortened(F.col("text"), 100).alias("shown"), X.source_label(F.col("source"), [("src1", "one"), ("src2", "two")]).alias("label"))


@query(f"WITH {WITH_ANSWERS} SELECT doc_id, sha256(raw) AS raw_sha256 FROM a")
def raw_answers(spark, d):
    return answers(spark, d).select("doc_id", X.sha256(F.col("raw")).alias("raw_sha256"))


@query("WITH t AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents) SELECT doc_id, sha256(text) AS text_sha256 FROM t WHERE nth = 1")
def ordered_distinct(spark, d):
    """Distinct texts, each by its first row."""
    from brindle.operators.ordering import first_by_key

    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), "doc_id", X.sha256(F.col("text")).alias("text_sha256"))
    return first_by_key(rows, ["text_sha256"], "ordinal").select("doc_id", "text_sha256")


TRAINED = f"{TRAIN} SELECT doc_id, n_raw_tokens, 'user: Describe what this vector holds: <concept>㊗</concept>' AS prompt, [embedding] AS bundle FROM base JOIN prior USING (doc_id, n_raw_tokens) JOIN embeddings ON vec_id = v24"


@query(TRAINED)
def samples_view(spark, d):
    """The loader's view of a training table: the marker in place, the bundle as one array."""
    from brindle.plans.pipeline import samples
    from brindle.plans.stages import build_training

    table_ = build_training(training_rows(spark, d), "rl", actor=ACTOR, depth=24)
    return told(samples(table_, [24], "㊗")).select("doc_id", "n_raw_tokens", "prompt", "bundle")


@query("SELECT * FROM (VALUES ('av_sft', 'av_sft', 8), ('ar_sft', 'ar_sft', 7), ('rl', 'rl', 7), ('rl joint', 'rl', 4)) v(made, variant, n_columns)")
def table_variants(spark, d):
    """Training tables tell what they are by their columns."""
    from brindle.plans.pipeline import variant_of
    from brindle.plans.stages import build_training

    rows = training_rows(spark, d)
    made = {"av_sft": build_training(rows, "av_sft", depth=24), "ar_sft": build_training(rows, "ar_sft", critic=CRITIC, depth=24), "rl": build_training(rows, "rl", depth=24), "rl joint": build_training(rows, "rl", joint=[24])}
    return spark.createDataFrame([(k, variant_of(t), len(t.columns)) for k, t in made.items()], "made string, variant string, n_columns int")


ECHO = r"regexp_replace('Starts: ' || array_to_string(t[1:8], ' '), '[\s*_]+$', '') || chr(10) || chr(10) || regexp_replace('Ends: ' || array_to_string(list_reverse(t)[1:8], ' '), '[\s*_]+$', '')"


@query(rf"""WITH {CACHES}, t AS (SELECT doc_id, text, regexp_split_to_array(text, '\s+') AS t FROM documents)
SELECT doc_id, coalesce(ca.explanation || chr(10) || chr(10) || 'cached', {ECHO}) AS api_explanation FROM t LEFT JOIN ca ON sha256(text) = key""")
def explain_stage(spark, d):
    """The explain stage: caches first, the provider for the rest in chunks that are kept, cleaned, too short ones dropped."""
    from brindle.plans.stages import explain
    from brindle.plugins import EchoProvider
    from brindle.sources.shared import shared_folder

    rows = table(spark, d, "documents").select("doc_id", F.col("text").alias("detokenized_text_truncated"))
    keyed = table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("detokenized_text_truncated"), F.col("doc_id").alias("row"))
    said = lambda word: F.concat(F.lit(f"{word} "), F.col("doc_id").cast("string"), F.lit("\n\ncached")).alias("api_explanation")
    known = [keyed.where(F.col("source").isin(*which)).select("row", "detokenized_text_truncated", said(word)) for word, which in (("first", ("src0", "src1")), ("second", ("src1", "src2")))]
    return explain(rows, EchoProvider(), known, chunks=2, folder=f"{shared_folder(spark)}/explain_stage").select("doc_id", "api_explanation")


@query("SELECT doc_id, sha256(text || '!') AS answer FROM documents")
def provider_answers(spark, d):
    """A plain function's answers, batch by batch, each with its row."""
    import hashlib

    from brindle.plugins import CallableProvider

    def answer(texts):
        return [hashlib.sha256(t.encode()).hexdigest() for t in texts]

    rows = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("!")).alias("text"))
    return CallableProvider(answer, 32).complete(rows, "text", "answer").select("doc_id", "answer")


@query("SELECT count(*) AS n_rows, sum(octet_length(encode(text)))::BIGINT AS n_bytes, true AS bounded FROM documents")
def scan_batches(spark, d):
    """A scan in batches of at most 256 rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from brindle.sources.datasets import scanned

    def sizes(batch):
        return pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([pc.sum(pc.binary_length(batch.column(0))).as_py() or 0])], names=["n", "bytes"])

    rows = scanned(table(spark, d, "documents").select("text"), sizes, "n long, bytes long", 256)
    return rows.agg(F.sum("n").alias("n_rows"), F.sum("bytes").alias("n_bytes"), (F.max("n") <= 256).alias("bounded"))


@query("SELECT source, 'av_sft_joint_probe_C0-24_' || source AS training_id, 'probe_C0-24_' || source AS bare FROM (SELECT DISTINCT source FROM documents)")
def training_names(spark, d):
    """Names of what is made of a base: its own without the prefix."""
    base_id = F.concat(F.lit("base_probe_C0-24_"), F.col("source"))
    bare = X.without_base(base_id)
    return table(spark, d, "documents").select("source").distinct().select("source", F.concat(F.lit("av_sft_joint_"), bare).alias("training_id"), bare.alias("bare"))


@query("""WITH o AS (SELECT event_id, value, user_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS place, count(*) OVER () AS n FROM events)
SELECT event_id AS sample_id, value AS reward, CASE WHEN place < 5 THEN 'top' WHEN place >= n // 2 - 2 AND place < n // 2 + 3 THEN 'middle' ELSE 'bottom' END AS section,
CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'other' END AS source, 'some text of event ' || event_id || ' …' AS text, 'why ' || event_id AS explanation FROM o
WHERE place < 5 OR place >= n // 2 - 2 AND place < n // 2 + 3 OR place >= n - 5""")
def report_lines(spark, d):
    """The rollout report's rows: picked by reward, labelled by source, payloads out of their tags."""
    from brindle.plans.pipeline import report

    n = F.col("event_id").cast("string")
    doc = F.when(F.pmod("user_id", F.lit(2)) == 0, "web:even").otherwise("web:odd")
    rows = table(spark, d, "events").select(F.col("event_id").alias("sample_id"), F.col("value").alias("reward"), doc.alias("doc_id"), F.concat(F.lit("some text of event "), n, F.lit(" …")).alias("text"), F.concat(F.lit("x <explanation>why "), n, F.lit("</explanation>")).alias("response"))
    return report(rows, labels=[(":even", "even")]).select("sample_id", "reward", "section", "source", "text", "explanation")
