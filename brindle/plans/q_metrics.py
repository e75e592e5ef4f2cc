"""Vectors, reconstruction metrics and reward summaries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators import metrics, ordering
from brindle.plans.registry import WIDTH, WITH_NORM, WITH_PAIRS, pairs, query, rollouts, table, vectors

SCALE = math.sqrt(WIDTH)
NORM = f"sqrt({WITH_NORM.format(v='{v}')})"


def scaled_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x::DOUBLE / (greatest({NORM.format(v=v)}, 1e-12) / 8.0::DOUBLE))"


SCALED_PAIRS = f"{WITH_PAIRS}, sp AS (SELECT vec_id, pred, gold, {scaled_sql('pred')} AS p, {scaled_sql('gold')} AS g FROM pr)"
MSE = "list_sum(list_transform(list_zip(p, g), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(p)"
COMPONENTS = f"se AS (SELECT vec_id, unnest({scaled_sql('embedding')}) AS x, generate_subscripts(embedding, 1) - 1 AS component FROM embeddings)"


@query(f"SELECT vec_id, list_transform({scaled_sql('embedding')}, lambda x: round(x, 9)) AS scaled FROM embeddings")
def l2_normalize(spark, d):
    return vectors(spark, d).select("vec_id", F.transform(V.scaled(F.col("embedding"), SCALE), lambda x: V.rounded(x, 9)).alias("scaled"))


@query(f"SELECT vec_id, round({NORM.format(v='embedding')}, 12) AS norm FROM embeddings")
def vector_norm(spark, d):
    return vectors(spark, d).select("vec_id", F.round(V.norm(F.col("embedding")), 12).alias("norm"))


@query(f"""WITH {SCALED_PAIRS} SELECT vec_id, round({MSE}, 9) AS mse, round(list_sum(list_transform(list_zip(pred, gold), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / ({NORM.format(v='pred')} * {NORM.format(v='gold')}), 9) AS cosine FROM sp""")
def mse_cosine(spark, d):
    p, g = F.col("pred"), F.col("gold")
    return pairs(spark, d).select("vec_id", F.round(V.mse(p, g, SCALE), 9).alias("mse"), F.round(V.cosine(p, g), 9).alias("cosine"))


@query(f"""WITH {SCALED_PAIRS}, e AS (SELECT vec_id, {MSE} AS e FROM sp)
SELECT vec_id, round(CASE WHEN vec_id % 10 = 0 THEN -2.0::DOUBLE ELSE -e END, 9) AS reward, round(CASE WHEN vec_id % 10 = 0 THEN -ln(2.0::DOUBLE) ELSE -ln(greatest(e, 1e-8)) END, 9) AS log_reward FROM e""")
def reward(spark, d):
    error, failed = V.mse(F.col("pred"), F.col("gold"), SCALE), F.pmod("vec_id", F.lit(10)) == 0
    return pairs(spark, d).select("vec_id", F.round(V.reward(error, failed), 9).alias("reward"), F.round(V.reward(error, failed, log=True), 9).alias("log_reward"))


@query("""SELECT component::BIGINT AS component, round(avg(x::DOUBLE), 9) AS mean FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS component FROM embeddings) GROUP BY 1""")
def mean_vector(spark, d):
    return metrics.mean_vector(vectors(spark, d), "embedding").select("component", F.round("mean", 9).alias("mean"))


@query(f"WITH {COMPONENTS} SELECT round(avg(v), 9) AS baseline FROM (SELECT component, var_pop(x) AS v FROM se GROUP BY 1)")
def rawvar_baseline(spark, d):
    return metrics.raw_variance_baseline(vectors(spark, d), "embedding", SCALE).select(F.round("baseline", 9).alias("baseline"))


@query(f"""WITH {COMPONENTS}, m AS (SELECT component, avg(x) AS m FROM se GROUP BY 1), s AS (SELECT sqrt(sum(m * m)) AS n FROM m)
SELECT round(avg((x - m * 8.0::DOUBLE / n) * (x - m * 8.0::DOUBLE / n)), 9) AS baseline FROM se JOIN m USING (component), s""")
def meannorm_baseline(spark, d):
    return metrics.mean_norm_baseline(vectors(spark, d), "embedding", SCALE).select(F.round("baseline", 9).alias("baseline"))


@query(f"""WITH se AS (SELECT unnest({scaled_sql('embedding')}) AS x, generate_subscripts(embedding, 1) - 1 AS component FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 50000))
SELECT round(avg(v), 9) AS baseline FROM (SELECT component, var_pop(x) AS v FROM se GROUP BY 1)""")
def capped_baseline(spark, d):
    """The baseline over the first rows in file order: the cap is the feature."""
    head = metrics.capped(vectors(spark, d), "vec_id")
    return metrics.raw_variance_baseline(head, "embedding", SCALE).select(F.round("baseline", 9).alias("baseline"))


@query(f"""WITH {SCALED_PAIRS}, e AS (SELECT avg({MSE}) AS error FROM sp),
v AS (SELECT avg(v) AS spread FROM (SELECT component, var_pop(x) AS v FROM (SELECT unnest(g) AS x, generate_subscripts(g, 1) AS component FROM sp) GROUP BY 1))
SELECT round(error, 9) AS error, round(spread, 9) AS spread, round(1 - error / spread, 9) AS fve FROM e, v""")
def fve(spark, d):
    out = metrics.explained(pairs(spark, d), "pred", "gold", SCALE)
    return out.select(*[F.round(c, 9).alias(c) for c in ("error", "spread", "fve")])


@query(f"""WITH {SCALED_PAIRS} SELECT vec_id // 16 AS batch, round(sum({MSE}), 6) AS loss, round(sum({NORM.format(v='pred')}), 6) AS pred_norm, round(sum({NORM.format(v='gold')}), 6) AS gold_norm,
round(count(*) * 8.0::DOUBLE, 6) AS mse_scale, count(*) AS n, round((1 - avg({MSE}) / 0.9::DOUBLE) * count(*), 6) AS fve FROM sp GROUP BY 1""")
def critic_loss_sums(spark, d):
    rows = pairs(spark, d).withColumn("batch", F.expr("vec_id div 16"))
    out = metrics.critic_sums(rows, "batch", "pred", "gold", SCALE, 0.9)
    return out.select("batch", "n", *[F.round(c, 6).alias(c) for c in ("loss", "pred_norm", "gold_norm", "mse_scale", "fve")])


@query("""SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max,
round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90 FROM events""")
def reward_summary(spark, d):
    out = metrics.reward_summary(table(spark, d, "events"), "value")
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


@query("SELECT count(*) AS n_samples, count(DISTINCT user_id) AS n_groups, count(*) // count(DISTINCT user_id) AS per_group FROM events")
def group_counts(spark, d):
    return metrics.group_counts(table(spark, d, "events"), "user_id")


@query("""SELECT source, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 0) AS n_bad, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (quality IS NULL) AS n_unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def label_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("quality") == 0).alias("n_bad"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("quality").isNull()).alias("n_unlabelled"))


@query("""WITH o AS (SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS place, count(*) OVER () AS n FROM events)
SELECT event_id, value, CASE WHEN place < 5 THEN 'top' WHEN place >= n // 2 - 3 AND place < n // 2 + 4 THEN 'middle' ELSE 'bottom' END AS section FROM o
WHERE place < 5 OR place >= n // 2 - 3 AND place < n // 2 + 4 OR place >= n - 4""")
def top_mid_bottom(spark, d):
    rows = table(spark, d, "events").select("event_id", "value")
    return ordering.top_middle_bottom(rows, "value", "event_id", 5, 7, 4)


@query("""WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN s > 1e-12 THEN (value - m) / s ELSE 0 END, 6) AS advantage FROM events JOIN s USING (user_id)""")
def group_advantage(spark, d):
    return metrics.advantages(table(spark, d, "events"), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("""SELECT l_orderkey, l_linenumber, round(exp(l_discount - l_tax), 9) AS tis, round(abs(exp(l_discount - l_tax) - 1), 9) AS tis_abs, round(exp(l_discount - l_tax) - 1 - (l_discount - l_tax), 9) AS tis_k3 FROM lineitem""")
def ratio_metrics(spark, d):
    out = metrics.ratio_metrics(table(spark, d, "lineitem"), "l_discount", "l_tax")
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 9).alias(c) for c in ("tis", "tis_abs", "tis_k3")])


@query("""WITH h AS (SELECT abs((value + 1000.0::DOUBLE) / (value + 1001.0::DOUBLE) - 1) AS off FROM events ORDER BY event_id LIMIT 32)
SELECT count(*) AS n, round(avg(off), 9) AS mean_deviation, round(max(off), 9) AS max_deviation, CASE WHEN count(*) >= 4 THEN max(off) <= 0.1 END AS agree FROM h""")
def path_agreement(spark, d):
    """Two scoring paths over the first 32 rows: the head is the feature."""
    rows = table(spark, d, "events").select("event_id", (F.col("value") + 1000.0).alias("a"), (F.col("value") + 1001.0).alias("b"))
    out = metrics.path_agreement(rows, "a", "b", "event_id")
    return out.select("n", F.round("mean_deviation", 9).alias("mean_deviation"), F.round("max_deviation", 9).alias("max_deviation"), "agree")


@query("""WITH c AS (SELECT vec_id, greatest(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 1e-12) / 448.0::DOUBLE AS channel_scale FROM embeddings)
SELECT vec_id, round(channel_scale, 12) AS channel_scale, round((SELECT max(channel_scale) FROM c), 12) AS tensor_scale FROM c""")
def absmax_scales(spark, d):
    out = metrics.absmax_scale(table(spark, d, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", F.round("channel_scale", 12).alias("channel_scale"), F.round("tensor_scale", 12).alias("tensor_scale"))


@query("SELECT status, count(*) AS n, round(avg(reward), 6) AS mean_reward FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'TRUNCATED' ELSE 'COMPLETED' END AS status, value AS reward FROM events) GROUP BY 1")
def status_rewards(spark, d):
    return rollouts(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 6).alias("mean_reward"))


@query("""WITH c AS (SELECT vec_id // 24 AS tile_row, (generate_subscripts(embedding, 1) - 1) // 24 AS tile_column, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT tile_row::BIGINT AS tile_row, tile_column::BIGINT AS tile_column, round(max(abs(x)) / 448.0::DOUBLE, 12) AS scale FROM c GROUP BY ALL""")
def block_scales(spark, d):
    """Scales of tiles of 24 x 24: the edge tiles are padded."""
    out = metrics.block_scales(vectors(spark, d), "vec_id", "embedding", 24)
    return out.select("tile_row", F.col("tile_column").cast("long").alias("tile_column"), F.round("scale", 12).alias("scale"))


@query("SELECT DISTINCT p_size::BIGINT AS width, round(sqrt(p_size), 12) AS scale FROM part")
def target_scales(spark, d):
    """The norm that a setting asks for, by width: here the root of it."""
    sizes = [r[0] for r in table(spark, d, "part").select(F.col("p_size").cast("long")).distinct().collect()]
    return spark.createDataFrame([(n, round(V.target_scale("sqrt_d_model", n), 12)) for n in sizes], "width long, scale double")
