"""Dumps of rollouts: one JSON object a file, with its number and its samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())
SAMPLE = T.StructType([
    T.StructField("reward", T.DoubleType()), T.StructField("group_index", T.LongType()), T.StructField("response", T.StringType()), T.StructField("response_length", T.LongType()),
    T.StructField("metadata", T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("detokenized_text_truncated", T.StringType()), T.StructField("n_raw_tokens", T.LongType()), T.StructField("activation_vector", VECTOR)])),
])
DUMP = T.StructType([T.StructField("rollout_id", T.LongType()), T.StructField("samples", T.ArrayType(SAMPLE))])


def rollout_dumps(spark: SparkSession, path: str) -> DataFrame:
    """One row a sample: rollout_id, sample_id (its place in the dump), reward, group_index, response, response_length and
    what its metadata hold. A file that is no dump is an error."""
    dumps = spark.read.schema(DUMP).option("multiLine", True).option("mode", "FAILFAST").json(path)
    samples = dumps.select("rollout_id", F.posexplode("samples").alias("sample_id", "s")).select("rollout_id", F.col("sample_id").cast("long").alias("sample_id"), "s.*")
    return samples.select(*[c for c in samples.columns if c != "metadata"], "metadata.*").withColumnRenamed("detokenized_text_truncated", "text")
