"""Rollouts, ranks, markers and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as X
from brindle.functions import vectors as V
from brindle.operators import joins, markers, ordering, rollout
from brindle.plans.registry import WITH_DOCS, WITH_ROLLOUTS, documents, query, rollouts, table, vectors

PAYLOAD = r"CASE WHEN regexp_matches(response, '<explanation>(.*?)</explanation>', 's') THEN regexp_replace(regexp_extract(response, '<explanation>(.*?)</explanation>', 1, 's'), '^\s+|\s+$', '', 'g') END"


@query(f"""WITH {WITH_ROLLOUTS} SELECT event_id, CASE WHEN status = 'TRUNCATED' OR {PAYLOAD} IS NULL OR length(response) > 40 THEN 'FAILED' ELSE status END AS status, length(response) > 30 AS is_overlong FROM r""")
def failed_routing(spark, d):
    length = F.length("response")
    return rollouts(spark, d).select("event_id", rollout.final_status(F.col("status"), F.col("response"), length, 40).alias("status"), rollout.overlong(length, 30).alias("is_overlong"))


@query(f"WITH {WITH_ROLLOUTS} SELECT event_id, {PAYLOAD} AS explanation FROM r WHERE status = 'COMPLETED' AND {PAYLOAD} IS NOT NULL")
def scorable_rollouts(spark, d):
    rows = rollouts(spark, d).where(rollout.scorable(F.col("status"), F.col("response")))
    return rows.select("event_id", X.payload(F.col("response")).alias("explanation"))


@query(f"""WITH {WITH_ROLLOUTS} SELECT event_id, rank, regexp_split_to_array(event_type, '_') AS tokens, len(regexp_split_to_array(event_type, '_')) AS total_length, 0::BIGINT AS response_length, []::INTEGER[] AS loss_mask, reward AS activation
FROM r WHERE status = 'COMPLETED' AND {PAYLOAD} IS NOT NULL""")
def rollout_swap(spark, d):
    """Actor rows become critic rows: other tokens, new lengths, empty masks, nothing else."""
    ok = rollout.scorable(F.col("status"), F.col("response"))
    rows = rollouts(spark, d).withColumn("critic", F.when(ok, F.split("event_type", "_"))).withColumn("activation", F.col("reward"))
    return rollout.critic_rows(rows, "critic", "activation", ["event_id", "rank"])


@query(f"""WITH {WITH_ROLLOUTS}, f AS (SELECT * FROM r WHERE status = 'COMPLETED'), l AS (SELECT min(n) // 16 * 16 AS least, count(*) AS ranks FROM (SELECT rank, count(*) AS n FROM f GROUP BY 1))
SELECT event_id, rank, (least * ranks)::BIGINT AS global_rows FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY event_id) AS place FROM f), l WHERE place <= least""")
def rank_min_truncate(spark, d):
    done = rollouts(spark, d).where("status = 'COMPLETED'").select("event_id", "rank")
    return rollout.rank_min_truncate(done, "rank", "event_id", 16)


@query(f"""WITH {WITH_ROLLOUTS}, p AS (SELECT rank % 3 AS target_rank, rank // 3 AS place, rank, event_id, row_number() OVER (PARTITION BY rank ORDER BY event_id) - 1 AS own FROM r),
s AS (SELECT target_rank, place, count(*) AS n FROM p GROUP BY ALL), o AS (SELECT target_rank, place, sum(n) OVER (PARTITION BY target_rank ORDER BY place) - n AS start FROM s)
SELECT event_id, target_rank, place, target_rank AS first_rank, (start + own)::BIGINT AS position FROM p JOIN o USING (target_rank, place)""")
def strided_repartition(spark, d):
    """The lists of ranks i, i + 3, ... laid end to end; of what is one value a rank, the first rank's."""
    rows = rollouts(spark, d).select("event_id", "rank", F.col("rank").alias("first_rank"))
    return rollout.repartitioned(rows, "rank", "event_id", 3, ["first_rank"]).select("event_id", "target_rank", "place", "first_rank", F.col("position").cast("long").alias("position"))


@query("SELECT event_id, event_id % 5 AS endpoint, event_id // 16 AS batch FROM events")
def endpoint_batches(spark, d):
    rows = table(spark, d, "events").select("event_id")
    return rollout.micro_batches(rollout.endpoints(rows, "event_id", 5), "event_id", 16)


@query("""SELECT doc_id, i AS copy, doc_id AS group_index, doc_id * 4 + i AS sample_index FROM documents, (SELECT unnest([0, 1, 2, 3])::BIGINT AS i)""")
def group_copies(spark, d):
    return rollout.group_copies(table(spark, d, "documents").select("doc_id"), "doc_id", 4)


@query("SELECT user_id, event_id, sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS last_index FROM events")
def last_token_offsets(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.length("props").cast("long").alias("n"))
    return ordering.last_token_offsets(rows, ["user_id"], "event_id", "n").select("user_id", "event_id", "last_index")


@query(f"""WITH {WITH_DOCS}, q AS (SELECT n, list_transform(tokens, lambda t: CASE WHEN length(t) > 6 THEN 1 ELSE 0 END) AS mask FROM d)
SELECT n, list_max(list_filter(list_transform(mask, lambda m, i: CASE WHEN m = 1 THEN i - 1 END), lambda x: x IS NOT NULL))::BIGINT AS last FROM q""")
def rightmost_mask(spark, d):
    mask = F.transform("tokens", lambda t: F.when(F.length(t) > 6, 1).otherwise(0))
    return documents(spark, d).select("n", V.rightmost(mask).alias("last"))


# Markers: every comma-ending token stands for the marker, between short words.
WITH_MARKS = WITH_DOCS + r""",
ids AS (SELECT n, list_transform(tokens, lambda t: CASE WHEN t LIKE '%,' THEN 8 WHEN length(t) <= 4 THEN 7 ELSE 9 END) AS ids FROM d),
x AS (SELECT n, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS position FROM ids),
w AS (SELECT *, lag(id) OVER (PARTITION BY n ORDER BY position) AS l, lead(id) OVER (PARTITION BY n ORDER BY position) AS r FROM x),
sites AS (SELECT n, position::BIGINT AS position, row_number() OVER (ORDER BY n, position) - 1 AS nth FROM w WHERE id = 8 AND l = 7 AND r = 9)"""


def marked(spark, d):
    ids = F.transform("tokens", lambda t: F.when(t.endswith(","), 8).when(F.length(t) <= 4, 7).otherwise(9))
    return documents(spark, d).select("n", ids.alias("ids"))


@query(f"WITH {WITH_MARKS} SELECT n, position, nth FROM sites")
def marker_sites(spark, d):
    return markers.exploded_sites(marked(spark, d), "n", "ids", 8, 7, 9)


@query(f"WITH {WITH_MARKS} SELECT n, position, nth, embedding FROM sites JOIN embeddings ON vec_id = nth")
def marker_inject(spark, d):
    """Sites in row-major order take the vectors in their order."""
    return markers.injected(marker_sites(spark, d), vectors(spark, d).withColumnRenamed("vec_id", "nth"), "nth", "embedding", check=False)


@query(f'WITH {WITH_MARKS} SELECT l AS "left", r AS "right", count(*) AS n_sites FROM w WHERE id = 8 GROUP BY ALL')
def marker_neighbours(spark, d):
    return markers.neighbours(marked(spark, d), "ids", 8)


@query(f"WITH {WITH_DOCS} SELECT n, len(tokens) >= 2 AND tokens[-1] LIKE '%.' AS ends, tokens[len(tokens) - 1:] = ['the', 'of'] AS is_suffix FROM d")
def suffix_check(spark, d):
    ends = (F.size("tokens") >= 2) & F.element_at("tokens", -1).endswith(".")
    return documents(spark, d).select("n", ends.alias("ends"), V.suffix_is(F.col("tokens"), ["the", "of"]).alias("is_suffix"))


@query(f"""WITH {WITH_DOCS}, q AS (SELECT n, len(tokens) // 3 AS p, len(tokens) AS t FROM d)
SELECT n, list_concat(list_transform(range(p), lambda i: 0), list_transform(range(t + 2 - p), lambda i: 1)) AS loss_mask, t + 2 - p AS response_length FROM q""")
def loss_mask(spark, d):
    """The prompt is a third of a document and a mark of its own; what both renders begin with is masked, what closes counts."""
    third = F.slice("tokens", F.lit(1), F.expr("cast(size(tokens) div 3 as int)"))
    renders = F.array(F.concat(third, F.array(F.lit("<prompt>"))), F.col("tokens"))
    mask = V.response_mask(renders, F.array(F.lit("<end>"), F.lit("<turn>")))
    return documents(spark, d).select("n", mask.alias("loss_mask")).withColumn("response_length", F.size(F.filter("loss_mask", lambda x: x == 1)).cast("long"))


@query(f"""WITH {WITH_DOCS}, b AS (SELECT n // 8 AS batch, max(len(tokens)) AS wide FROM d GROUP BY 1)
SELECT n, n // 8 AS batch, wide AS padded_length, wide - len(tokens) AS n_pad, len(tokens) AS n_mask,
(sum(len(tokens)) OVER (PARTITION BY n // 8 ORDER BY n) - len(tokens))::BIGINT AS begins, (sum(len(tokens)) OVER (PARTITION BY n // 8 ORDER BY n))::BIGINT AS ends FROM d JOIN b ON n // 8 = batch""")
def pad_pack(spark, d):
    from brindle.operators.embedding import packed_rows

    rows = documents(spark, d).select("n", F.expr("n div 8").alias("batch"), "tokens")
    wide = rows.groupBy("batch").agg(F.max(F.size("tokens")).alias("wide"))
    out = packed_rows(rows.join(wide, "batch"), "batch", "n", "tokens", "<pad>", "wide")
    pads = F.size(F.filter("mask", lambda x: x == 0)).cast("long")
    return out.select("n", "batch", F.size("padded").cast("long").alias("padded_length"), pads.alias("n_pad"), (F.size("mask") - pads).alias("n_mask"), "begins", "ends")


@query(f"""WITH {WITH_DOCS}, o AS (SELECT a.n, a.tokens AS a, b.tokens AS b FROM d a JOIN d b ON b.n = a.n + 1), z AS (SELECT n, list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]) AS same, least(len(a), len(b)) AS m FROM o)
SELECT n, coalesce(list_position(same, false) - 1, m)::BIGINT AS shared FROM z""")
def common_prefix(spark, d):
    t = documents(spark, d).select("n", "tokens")
    both = t.join(t.select((F.col("n") - 1).alias("n"), F.col("tokens").alias("other")), "n")
    m = F.least(F.size("tokens"), F.size("other"))
    return both.select("n", V.common_prefix(F.slice("tokens", F.lit(1), m), F.slice("other", F.lit(1), m)).alias("shared"))


# What wrappers put before the names of a model's tensors.
PREFIXES = ["model_state.model.", "model_state.", "model.", "module.", ""]


@query("""WITH k AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'model.' WHEN 1 THEN 'model_state.' ELSE '' END || p_name AS key FROM part), t AS (SELECT DISTINCT p_name AS target FROM part),
p AS (SELECT * FROM (VALUES (0, 'model_state.model.'), (1, 'model_state.'), (2, 'model.'), (3, 'module.'), (4, '')) v(ordinal, prefix) WHERE prefix = '' OR EXISTS (SELECT 1 FROM k WHERE starts_with(key, prefix))),
c AS (SELECT ordinal, prefix, count(DISTINCT target) AS n FROM p, k JOIN t ON target = CASE WHEN starts_with(key, prefix) THEN substring(key, length(prefix) + 1) ELSE key END GROUP BY ALL)
SELECT arg_max(prefix, (n, -ordinal)) AS prefix, max(n) AS n_matched FROM c""")
def prefix_argmax(spark, d):
    head = F.when(F.pmod("p_partkey", F.lit(3)) == 0, "model.").when(F.pmod("p_partkey", F.lit(3)) == 1, "model_state.").otherwise("")
    part = table(spark, d, "part")
    return joins.best_prefix(part.select(F.concat(head, F.col("p_name")).alias("key")), part.select(F.col("p_name").alias("target")), "key", "target", PREFIXES)
