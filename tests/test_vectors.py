"""Many-query vector search and the vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import vector_index
from marlstone.operators.scratch import shared_folder

VECTORS, ASKED = "slug long, embedding array<double>", "qid long, embedding array<double>"


def hard_vectors(seed=1, n=400, dims=8):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(6, dims))
    rows = [(i, (centres[i % 6] + 0.4 * pick.normal(size=dims)).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # one vector many times
    rows += [(2000, [0.0] * dims), (2001, None), (2002, [1.0]), (2003, [float("nan")] * dims), (2004, [*rows[0][1][:7], None]), (2005, [])]
    asked = [(i, rows[i][1]) for i in range(0, n, 23)] + [(900, None), (901, [1.0, 2.0]), (902, [0.0] * dims), (903, [float("inf")] * dims)]
    return rows, asked


def brute(rows, asked, k, dims=8):
    fit = lambda v: v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)
    def unit(v):
        n = np.linalg.norm(v)
        return np.array(v) / n if n else np.array(v)
    good = [(i, unit(v)) for i, v in rows if fit(v)]
    out = {}
    for q, v in asked:
        if fit(v):
            scored = sorted(((round(-float(unit(v) @ x), 9) + 0.0, i) for i, x in good))[:k]
            out.update({(q, r): (i, -s) for r, (s, i) in enumerate(scored)})
    return out


def same(found, want):
    got = {(r.qid, r["rank"]): (r.slug, r.score) for r in found.collect()}
    assert set(got) == set(want)
    for key, (slug, score) in want.items():
        assert got[key][1] == pytest.approx(score, abs=1e-8)
        assert got[key][0] == slug or abs(score) < 1e-8, key  # of equal zeros the order is by slug


@pytest.mark.parametrize("k", [1, 5, 30])
def test_search_in_blocks(spark, monkeypatch, k):
    monkeypatch.setattr(vector_index, "BLOCK", 64)
    rows, asked = hard_vectors()
    same(vector_index.search_in_blocks(spark.createDataFrame(rows, VECTORS).repartition(3), spark.createDataFrame(asked, ASKED), k), brute(rows, asked, k))


def test_index_with_all_cells_is_exact_and_else_finds_most(spark):
    rows, asked = hard_vectors()
    vectors, queries = spark.createDataFrame(rows, VECTORS).repartition(3), spark.createDataFrame(asked, ASKED)
    index = vector_index.VectorIndex(spark, f"{shared_folder(spark)}/test-{np.random.randint(1 << 40)}").build(vectors)
    exact = brute(rows, asked, 10)
    same(index.search(queries, 10, 1000), exact)
    want = spark.createDataFrame([(q, s) for (q, _), (s, _) in exact.items() if q != 902], "qid long, slug long")
    assert vector_index.recall(index.search(queries, 10), want).agg(F.avg("recall")).first()[0] >= 0.9
    assert index._read("members").count() == 701 and index._read("entries").count() == 401


def test_recall_over_the_embeddings(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("slug"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = e.filter("slug % 50 = 0").withColumnRenamed("slug", "qid")
    index = vector_index.VectorIndex(spark, f"{shared_folder(spark)}/test-{np.random.randint(1 << 40)}").build(e)
    exact = vector_index.search_in_blocks(e, asked, 10)
    assert vector_index.recall(index.search(asked, 10), exact).agg(F.avg("recall")).first()[0] >= 0.9


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], VECTORS), spark.createDataFrame([(1, [1.0])], ASKED)
    assert vector_index.search_in_blocks(none, one, 3).count() == 0
    index = vector_index.VectorIndex(spark, f"{shared_folder(spark)}/test-{np.random.randint(1 << 40)}").build(none)
    assert index.search(one, 3).count() == 0
    assert vector_index.search_in_blocks(spark.createDataFrame([(1, [1.0])], VECTORS), spark.createDataFrame([], ASKED), 3).count() == 0
