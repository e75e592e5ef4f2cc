"""What the review of the second round found, each case small."""

import math
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from brindle.llm import simhash
from brindle.plans import catalog, q_extract


def same(spark, folder, name, tables, query=None):
    """The query's rows and those of its SQL over some tables, sorted as text, which tells -0.0 and NaN."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    got = (query or catalog.QUERIES[name])(spark, str(folder))
    want = con.execute(catalog.ORACLE_SQL[name]).fetchall()
    names = [c[0] for c in con.description]
    return [sorted(map(repr, rows)) for rows in ([tuple(r[c] for c in names) for r in got.collect()], [tuple(r) for r in want])]


#: Its component 3 times 8 over its norm is a half at nine decimals in binary, and below it as the shortest decimal.
HALF = "3b708fbf45e54e3f62b6833fee7d9bbf377f893f7fcba23e1a5cc83fe760f5bef94079bfa3f31c3fd90fdc3d8ad3823e50454fbff066fabe611601c0b99eb7be11d15c3f164bc7bd448421bfc147e13eda4a923dff87023f23d1c3bd251ca7bfb6bbfebd6fec35be1ea2723e110a4b3f1a74283d2ac3babdb994a4bf20f105bdd839923d4497823d13de63bdfa11c83fe41bf83e4280eb3fa312b33fefe8573fc2e543bf060e7d3f1375633e3fe6bc3f43de463eda363a3fa2dd783ea48d843df2a5a13fae546f3edb3e05c03c2e96bf11fcd9bee1f22e3ef70980bf48d2a43fb6b6e7bed26064bf67bd333f16f6bd3df9cafe3d66cd1cbed1bf2fbe50ecbe3f"


def test_l2_normalize_rounds_as_its_sql(spark, tmp_path):
    vectors = [struct.unpack("<64f", bytes.fromhex(HALF)), [1.0, None, 2.0], [], None, [None], [0.0, -0.0], [math.nan, 1.0], [math.inf, -1.0], [-1e-12, 1.0], [3.0, 4.0]]
    table = pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))})
    got, want = same(spark, tmp_path, "l2_normalize", {"embeddings": table})
    assert got == want


def corpus(copies: int = 1):
    """Texts of all lengths, one of more parts than one, one null, and every row ``copies`` times."""
    texts = [" ".join(f"w{(7 * k + i * i) % 91}" if i % 5 else "de" for i in range(n)) for k, n in enumerate([0, 1, 50, 51, 57, 300, 9000])] + [None]
    rows = [(k, t) for k, t in enumerate(texts) for _ in range(copies)]
    vectors = [[float(i), i / 7, -1.0] for i in range(23)]
    docs = pa.table({"doc_id": pa.array([k for k, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})
    return {"documents": docs, "embeddings": pa.table({"vec_id": pa.array(range(23), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))})}


@pytest.mark.parametrize("most", [0, q_extract.BUNDLE_BYTES])
@pytest.mark.parametrize("copies", [1, 2])
def test_base_rows_equal_their_sql(spark, tmp_path, most, copies):
    got, want = same(spark, tmp_path, "base_rows", corpus(copies), lambda s, d: q_extract.activation_rows(s, d, most))
    assert len(want) >= 20 and got == want


def test_base_rows_move_no_words(spark, sf_dir):
    """Neither sorted nor shuffled: the texts' positions with their words filled the disk at 0.1 GB."""
    plan = catalog.QUERIES["base_rows"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "hashpartitioning" not in plan


def test_every_document_counts_for_the_order_of_shingles(spark):
    """Counted by hand over all documents, more than the 65,536 of the sample there was."""
    texts = [f"a b c{i % 3} d{i % 1000} e f" for i in range(150_000)] + [None, "", "a b", "a b c0 d0 e f a b c0 d0 e f"]
    df = spark.createDataFrame(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})).repartition(7)
    counts = {}
    for t in texts:
        for h in np.unique(simhash.hashed_shingles(t and t.encode(), 5)).tolist():
            counts[h >> (64 - simhash.BUCKETS)] = counts.get(h >> (64 - simhash.BUCKETS), 0) + 1
    levels = simhash.shingle_levels(df, "text", 5)
    assert {k: int(levels[k]) for k in counts} == {k: n.bit_length() - 1 for k, n in counts.items()}
    assert np.count_nonzero(levels) == sum(n > 1 for n in counts.values())
