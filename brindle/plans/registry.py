"""How a query and the SQL that it must agree with are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with DuckDB SQL where SQL can say it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Surrogates: what stands for corpora, activations, answers and rollouts in the driver's tables.
SEED, POSITIONS, FIRST, SPECIALS = 42, 10, 50, ("of", "de", "und", "la")
DEPTHS = (0, 24)
WIDTH = 64
FRACTIONS = {"av_sft": 0.25, "ar_sft": 0.25, "rl": 0.5}

WITH_DOCS = r"""d AS (SELECT doc_id AS n, 'documents:train:' || doc_id AS doc_id, text, regexp_split_to_array(text, '\s+') AS tokens FROM documents)"""
WITH_POSITIONS = WITH_DOCS + """,
p AS (SELECT n, doc_id, tokens, unnest(tokens) AS token, (generate_subscripts(tokens, 1) - 1)::BIGINT AS pos FROM d)"""
WITH_ELIGIBLE = WITH_POSITIONS + f""",
e AS (SELECT * FROM p WHERE pos >= {FIRST} AND token NOT IN {SPECIALS})"""
WITH_SAMPLE = WITH_ELIGIBLE + f""",
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sha256('{SEED}|' || doc_id || '|' || pos), pos) - 1 AS sample_order FROM e QUALIFY sample_order < {POSITIONS})"""
WITH_BASE = WITH_SAMPLE + """,
base AS (SELECT n, doc_id, pos + 1 AS n_raw_tokens, sample_order, tokens,
  (n * 7 + pos * 13) % (SELECT count(*) FROM embeddings) AS v0, (n * 7 + pos * 13 + 24 * 17) % (SELECT count(*) FROM embeddings) AS v24 FROM k)"""
WITH_SPLIT = WITH_BASE + f""",
u AS (SELECT DISTINCT doc_id FROM base),
s AS (SELECT doc_id, CASE WHEN place < floor(total * 0.25::DOUBLE) THEN 'av_sft' WHEN place < floor(total * 0.25::DOUBLE) + floor(total * 0.25::DOUBLE) THEN 'ar_sft' ELSE 'rl' END AS bucket
  FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('{SEED}|' || doc_id), doc_id) - 1 AS place, (SELECT count(*) FROM u) AS total FROM u))"""


def documents(spark, d, docs: DataFrame | None = None) -> DataFrame:
    docs = table(spark, d, "documents") if docs is None else docs
    return docs.select(F.col("doc_id").alias("n"), F.concat(F.lit("documents:train:"), F.col("doc_id").cast("string")).alias("doc_id"), "text", F.split("text", r"\s+").alias("tokens"))


def positions(spark, d) -> DataFrame:
    from brindle.sources.datasets import spread

    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return documents(spark, d, docs).select("n", "doc_id", F.posexplode("tokens").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


def eligible(spark, d) -> DataFrame:
    return positions(spark, d).where((F.col("pos") >= FIRST) & ~F.col("token").isin(*SPECIALS))


def sample(spark, d) -> DataFrame:
    from brindle.operators.ordering import keyed_sample

    return keyed_sample(eligible(spark, d), ["doc_id"], "pos", SEED, POSITIONS)


#: Positions of a text that are put in order at once.
PART = 4096


def drawn_positions(tokens: str, doc_id: str):
    """The positions that :func:`sample` draws from one row, in their order, as an array: rows of a text are neither exploded
    nor sorted for it. A long text is gone through part by part."""
    from brindle.operators.ordering import keyed_hash

    def part(k):
        words = F.slice(F.col(tokens), k * PART + 1, F.lit(PART))
        at = lambda i: (k * PART + i).cast("long")
        row = lambda t, i: F.when((at(i) >= FIRST) & ~t.isin(*SPECIALS), F.struct(keyed_hash(SEED, F.col(doc_id), at(i)).alias("h"), at(i).alias("pos")))
        return F.filter(F.transform(words, row), lambda x: x.isNotNull())

    parts = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / PART).cast("int"))
    least = F.aggregate(parts, F.array().cast("array<struct<h:string,pos:bigint>>"), lambda kept, k: F.slice(F.sort_array(F.concat(kept, part(k))), 1, POSITIONS))
    return F.transform(F.when(F.col(tokens).isNotNull(), least), lambda x: x["pos"])


def vector_at(spark, d, depth: int):
    """The number of the vector that stands for a position at a depth."""
    n = table(spark, d, "embeddings").agg(F.count(F.lit(1))).scalar()
    return F.pmod(F.col("n") * 7 + F.col("pos") * 13 + depth * 17, n)


def base(spark, d) -> DataFrame:
    rows = sample(spark, d).select("n", "doc_id", "pos", "sample_order", (F.col("pos") + 1).alias("n_raw_tokens"))
    return rows.select("n", "doc_id", "n_raw_tokens", "sample_order", vector_at(spark, d, 0).alias("v0"), vector_at(spark, d, 24).alias("v24"))


def kept_base(spark, d) -> DataFrame:
    """The base as a table in the shared folder, for queries that go through it more than once."""
    from brindle.sources.shared import written

    return written(base(spark, d), "base")


def split(spark, d, rows: DataFrame | None = None) -> DataFrame:
    from brindle.operators.ordering import document_split

    return document_split(kept_base(spark, d) if rows is None else rows, "doc_id", SEED, FRACTIONS)


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def pairs(spark, d) -> DataFrame:
    """Predictions and golds: each vector with the one before it."""
    v = vectors(spark, d)
    return v.select(F.col("vec_id"), F.col("embedding").alias("gold")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("pred")), "vec_id")


WITH_PAIRS = "pr AS (SELECT a.vec_id, a.embedding AS gold, b.embedding AS pred FROM embeddings a JOIN embeddings b ON b.vec_id - 1 = a.vec_id)"
WITH_NORM = "list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE))"


#: What the surrogate answers put before a line, and how they emphasise it ({} is the line).
MARKERS = ("-", "•", "–", "1.", "2)", "(3)", "a.", "(b)", "iv.")
EMPHASES = ("**Line:** {}", "word **bold** {}**", "**a*b** {}", "_{}_*", "*** **{}**")


def answers(spark, d) -> DataFrame:
    """Raw provider answers: list items made of each document's lines, all markers and kinds of emphasis in turn; every
    seventh is cut before the closing tag."""
    docs = table(spark, d, "documents")

    def item(x, i):
        marker = F.element_at(F.array(*map(F.lit, MARKERS)), (F.pmod(F.col("doc_id") + i, F.lit(len(MARKERS))) + 1).cast("int"))
        kinds = [F.concat(F.lit(k.partition("{}")[0]), x, F.lit(k.partition("{}")[2])) for k in EMPHASES]
        return F.concat(marker, F.lit(" "), F.element_at(F.array(*kinds), (F.pmod(F.col("doc_id") + i, F.lit(len(kinds))) + 1).cast("int")))

    items = F.array_join(F.transform(F.split("text", "\n"), item), "\n")
    return docs.select("doc_id", F.concat(F.lit("Sure.\n<analysis>\n"), items, F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit("")).otherwise(F.lit("\n</analysis> done"))).alias("raw"))


ITEM = f"{list(MARKERS)}[(doc_id + i - 1) % {len(MARKERS)} + 1] || ' ' || CASE (doc_id + i - 1) % {len(EMPHASES)} " + " ".join(f"WHEN {n} THEN '{k.partition('{}')[0]}' || x || '{k.partition('{}')[2]}'" for n, k in enumerate(EMPHASES)) + " END"
WITH_ANSWERS = rf"""a AS (SELECT doc_id, 'Sure.' || chr(10) || '<analysis>' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {ITEM}), chr(10))
  || CASE WHEN doc_id % 7 = 0 THEN '' ELSE chr(10) || '</analysis> done' END AS raw FROM documents)"""
# The SQL unwraps emphasis by positions rather than by a pattern: between a leading ** and the next ** after a character.
LISTS = r"'^\s*(?:[-*•+–—]|\d+[.)]|\(\d+\)|[a-zA-Z][.)]|\([a-zA-Z]\)|[ivxIVX]+[.)])\s+'"
WITH_CLEAN = WITH_ANSWERS + rf""",
l AS (SELECT doc_id, unnest(string_split(inner_, chr(10))) AS x, generate_subscripts(string_split(inner_, chr(10)), 1) AS nth
  FROM (SELECT doc_id, regexp_extract(raw, '<analysis>\s*(.*?)\s*</analysis>', 1, 's') AS inner_ FROM a WHERE regexp_matches(raw, '<analysis>\s*(.*?)\s*</analysis>', 's'))),
b AS (SELECT doc_id, nth, regexp_replace(x, {LISTS}, '') AS x FROM l),
e AS (SELECT doc_id, nth, x, CASE WHEN starts_with(x, '**') THEN instr(substring(x, 4), '**') ELSE 0 END AS p FROM b),
o AS (SELECT doc_id, nth, regexp_replace(trim(CASE WHEN p > 0 THEN substring(x, 3, p) || ' ' || ltrim(substring(x, p + 5), ' ' || chr(9) || chr(13)) ELSE x END, ' ' || chr(9) || chr(13)), '^[*_]+|[*_]+$', '', 'g') AS x FROM e),
c AS (SELECT a.doc_id, CASE WHEN regexp_matches(any_value(raw), '<analysis>\s*(.*?)\s*</analysis>', 's') THEN coalesce(string_agg(x, chr(10) || chr(10) ORDER BY nth) FILTER (WHERE x <> ''), '') END AS explanation
  FROM a LEFT JOIN o USING (doc_id) GROUP BY a.doc_id)"""


def clean(spark, d) -> DataFrame:
    from brindle.functions.text import cleaned

    return answers(spark, d).select("doc_id", cleaned(F.col("raw")).alias("explanation"))


def rollouts(spark, d) -> DataFrame:
    """Samples: events stand for rewards, users for groups, ids for ranks; statuses and responses by event type."""
    e = table(spark, d, "events")
    status = F.when(F.pmod("event_id", F.lit(11)) == 0, "TRUNCATED").otherwise("COMPLETED")
    response = F.when(F.pmod("event_id", F.lit(5)) == 0, F.concat(F.lit("no tags: "), F.col("event_type"))).otherwise(F.concat(F.lit("<explanation>\n"), F.col("event_type"), F.lit("\n</explanation>")))
    return e.select("event_id", "user_id", F.col("value").alias("reward"), status.alias("status"), response.alias("response"), F.pmod("event_id", F.lit(8)).alias("rank"), "event_type")


WITH_ROLLOUTS = """r AS (SELECT event_id, user_id, value AS reward, CASE WHEN event_id % 11 = 0 THEN 'TRUNCATED' ELSE 'COMPLETED' END AS status,
  CASE WHEN event_id % 5 = 0 THEN 'no tags: ' || event_type ELSE '<explanation>' || chr(10) || event_type || chr(10) || '</explanation>' END AS response, event_id % 8 AS rank, event_type FROM events)"""
