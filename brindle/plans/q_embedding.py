"""Token embeddings, windows and packing of tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import vectors as V
from brindle.operators import embedding as E
from brindle.plans.q_rollout import WITH_MARKS, marker_sites
from brindle.plans.registry import WITH_DOCS, WITH_NORM, WITH_POSITIONS, documents, positions, query, table, vectors

WITH_TOKENS = WITH_POSITIONS + ", t AS (SELECT n, pos, (length(token) * 37 + pos) % (SELECT count(*) FROM embeddings) AS token_id FROM p)"


def token_ids(spark, d):
    n = table(spark, d, "embeddings").agg(F.count(F.lit(1))).scalar()
    return positions(spark, d).select("n", "pos", F.pmod(F.length("token") * 37 + F.col("pos"), n).alias("token_id"))


@query(f"""WITH {WITH_TOKENS} SELECT n, count(*) AS n_tokens, round(avg(8.0::DOUBLE * sqrt({WITH_NORM.format(v='embedding')})), 6) AS avg_norm FROM t JOIN embeddings ON vec_id = token_id GROUP BY n""")
def embedding_lookup(spark, d):
    rows = E.embedded(token_ids(spark, d), "token_id", vectors(spark, d), "vec_id", "embedding", 8.0)
    return rows.groupBy("n").agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.avg(V.norm(F.col("vector"))), 6).alias("avg_norm"))


@query(f"""WITH {WITH_MARKS}, t AS (SELECT n, x.position, (id * 37 + x.position) % (SELECT count(*) FROM embeddings) AS token_id FROM x),
put AS (SELECT n, position, embedding FROM sites JOIN embeddings ON vec_id = nth)
SELECT n, count(*) FILTER (put.embedding IS NOT NULL) AS n_sites, round(avg(coalesce(put.embedding[1]::DOUBLE, e.embedding[1]::DOUBLE * 8.0::DOUBLE)), 9) AS avg_first
FROM t JOIN embeddings e ON e.vec_id = token_id LEFT JOIN put USING (n, position) GROUP BY n""")
def embedding_inject(spark, d):
    """Embedded sequences with the vectors of the marked sites in place."""
    from brindle.plans.q_rollout import marked

    n = table(spark, d, "embeddings").agg(F.count(F.lit(1))).scalar()
    ids = marked(spark, d).select("n", F.posexplode("ids").alias("position", "id")).withColumn("position", F.col("position").cast("long"))
    rows = E.embedded(ids.withColumn("token_id", F.pmod(F.col("id") * 37 + F.col("position"), n)), "token_id", vectors(spark, d), "vec_id", "embedding", 8.0)
    sites = marker_sites(spark, d).join(vectors(spark, d).withColumnRenamed("vec_id", "nth"), "nth").select("n", "position", "embedding")
    out = E.injected_embeddings(rows, ["n", "position"], sites)
    return out.groupBy("n").agg(F.count_if("is_site").alias("n_sites"), F.round(F.avg(F.element_at("vector", 1)), 9).alias("avg_first"))


@query("""SELECT vec_id, layer, embedding[layer * 16 + 1 : layer * 16 + 16] AS part FROM embeddings, (SELECT unnest([0, 1, 2, 3])::BIGINT AS layer)""")
def layer_unstack(spark, d):
    return E.unstacked(vectors(spark, d), "vec_id", "embedding", 4)


@query(f"""WITH {WITH_DOCS}, s AS (SELECT n, tokens, ('0x' || substring(sha256('5|' || n), 1, 8))::BIGINT % (len(tokens) - 32 + 1) AS start FROM d WHERE len(tokens) >= 32)
SELECT n, start, array_to_string(tokens[start + 1 : start + 32], ' ') AS text FROM s""")
def calibration_windows(spark, d):
    """A window of 32 tokens of every document that has them: the window is the feature."""
    out = E.token_windows(documents(spark, d).select("n", "tokens"), "n", "tokens", 32, 5)
    return out.select("n", "start", F.array_join("window", " ").alias("text"))


@query("""WITH RECURSIVE i AS (SELECT p_brand, p_partkey, p_size::BIGINT AS z, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth FROM part),
f AS (SELECT p_brand, p_partkey, nth, 0::BIGINT AS file, z AS used FROM i WHERE nth = 1
  UNION ALL SELECT i.p_brand, i.p_partkey, i.nth, f.file + CASE WHEN used > 0 AND used + z > 100 THEN 1 ELSE 0 END, CASE WHEN used > 0 AND used + z > 100 THEN z ELSE used + z END
  FROM f JOIN i ON i.p_brand = f.p_brand AND i.nth = f.nth + 1)
SELECT p_brand, p_partkey, file FROM f""")
def tensor_files(spark, d):
    """Size-bounded files in order: a fold over each brand's parts."""
    return E.greedy_files(table(spark, d, "part"), "p_brand", "p_partkey", "p_size", 100)


@query(f"""WITH {WITH_MARKS}, t AS (SELECT n, position, id FROM x WHERE position BETWEEN 32 AND 95),
put AS (SELECT n, position, embedding FROM sites JOIN embeddings ON vec_id = nth)
SELECT n, count(*) AS n_local, max(position) - 32 AS last_local, count(put.embedding) AS n_sites, round(sum(put.embedding[1]::DOUBLE), 9) AS first FROM t LEFT JOIN put USING (n, position) GROUP BY n""")
def embedding_slice(spark, d):
    """What the holder of positions 32 to 95 has of each sequence: sites are numbered over whole sequences."""
    from brindle.plans.q_rollout import marked

    ids = marked(spark, d).select("n", F.posexplode("ids").alias("position", "id")).withColumn("position", F.col("position").cast("long"))
    sites = marker_sites(spark, d).join(vectors(spark, d).withColumnRenamed("vec_id", "nth"), "nth").select("n", "position", "embedding")
    local = E.sequence_slice(ids.join(sites, ["n", "position"], "left"), "position", 32, 64)
    first = F.round(F.sum(F.element_at("embedding", 1).cast("double")), 9)
    return local.groupBy("n").agg(F.count(F.lit(1)).alias("n_local"), F.max("local").alias("last_local"), F.count("embedding").alias("n_sites"), first.alias("first"))


@query("SELECT vec_id, embedding AS flat, len(embedding) // 16 AS n_rows FROM embeddings")
def flatten_rows(spark, d):
    """A vector as a matrix of rows of 16, and flat again."""
    rows = vectors(spark, d).select("vec_id", V.reshaped(F.col("embedding"), 16).alias("m"))
    return rows.select("vec_id", V.flattened(F.col("m")).alias("flat"), F.size("m").cast("long").alias("n_rows"))
