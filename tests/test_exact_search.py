"""Exact search in NumPy: what the column functions say, without a join of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.vectors import metric
from nearfield.operators import search

NAMES = ["l2", "ip", "l1", "linf", "lp", "canberra", "bray_curtis", "jaccard", "jensen_shannon", "nan_euclidean"]


def odd_rows(spark):
    rng = np.random.default_rng(3)
    x = np.abs(np.round(rng.normal(size=(90, 6)) * 2) / 2)  # many ties
    rows = [(int(i), [float(a) for a in r]) for i, r in enumerate(np.concatenate([x, x[:30]]))]
    rows += [(500, None), (501, [float("nan")] * 6), (502, [0.0] * 6), (503, [float("inf")] + [1.0] * 5), (504, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("name", NAMES)
def test_exact_search_is_what_the_columns_say(spark, name):
    v = odd_rows(spark)
    q = search.queries_of(v, "vec_id % 10 = 0 and vec_id < 500")
    f, greater = metric(name, 3.0)
    pairs = q.crossJoin(v.where("size(embedding) = 6")).select("query_id", "vec_id", F.round(f(F.col("q"), F.col("embedding")), 6).alias("distance")).where("distance is not null")
    for k in (7, 200):
        found = search.knn(q, v, k, name, 3.0)
        assert "NestedLoopJoin" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
        assert sorted(found.collect()) == sorted(search._best(pairs, k, greater).collect())


def test_blocks_and_tiles_keep_the_results(spark, monkeypatch):
    v = odd_rows(spark)
    q = search.queries_of(v, "vec_id % 7 = 0 and vec_id < 500")
    want = sorted(search.knn(q, v, 5, "l1").collect())
    monkeypatch.setattr(search, "BLOCK_BYTES", 1000)
    assert len(search.query_blocks(q, 6)) > 1
    assert sorted(search.knn(q, v, 5, "l1").collect()) == want
    assert search.knn(q.where("query_id < 0"), v, 5).count() == search.knn(q, v.where("vec_id < 0"), 5).count() == 0


@pytest.mark.parametrize("name", ["l2", "ip", "l1", "lp"])
def test_ranges_are_what_the_columns_say(spark, name):
    v = odd_rows(spark).unionByName(spark.createDataFrame([(505, [None] * 6), (506, [None, *[1.0] * 5]), (None, [1.0] * 6)], "vec_id long, embedding array<float>"))
    q = search.queries_of(v, "vec_id % 10 = 0 and vec_id < 500")
    f, greater = metric(name, 3.0)
    pairs = q.crossJoin(v).select("query_id", "vec_id", F.round(f(F.col("q"), F.col("embedding")), 6).alias("distance")).where("size(embedding) = 6")
    for radius in (0.4, 3.0, 4.25):  # squares of halves: 4.25 is a distance, which is not inside
        found = search.range_join(q, v, radius, name, 3.0)
        assert "NestedLoopJoin" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
        want = pairs.where(F.col("distance") > radius if greater else F.col("distance") < radius)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_the_best_of_buckets_are_what_a_window_finds(spark, monkeypatch):
    v = odd_rows(spark)
    q = search.queries_of(v, "vec_id % 10 = 0 and vec_id < 500")
    found = search.approximate_top(q, v, 10)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
    got = sorted(found.collect())
    monkeypatch.setattr(search, "_arrays", lambda *_: False)
    assert got == sorted(search.approximate_top(q, v.where("size(embedding) = 6"), 10).collect()) and len(got) == 120
