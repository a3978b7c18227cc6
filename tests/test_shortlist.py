"""Shortlists that follow the table: refined where they lie, whatever their length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import ivf, quantize, search, shortlist
from nearfield.plans.factory import Index


@pytest.fixture(scope="module")
def v(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 700)] + rng.normal(size=(700, 16)) / 2
    x[600:] = x[:100]  # copies
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3).cache()


def nearer(found, plain):
    """Whether each result is as near as the ranked shortlist's of the same rank."""
    rows = found.alias("a").join(plain.alias("b"), ["query_id", "rank"], "right").select(F.col("a.distance") <= F.col("b.distance")).collect()
    return len(rows) > 0 and all(r[0] for r in rows)


@pytest.mark.parametrize("by_residual", [False, True])
def test_all_rows_within_the_distance_are_refined(spark, v, by_residual, monkeypatch):
    q = search.queries_of(v, "vec_id % 50 = 0")
    index = ivf.IVF(5, codec=quantize.ProductQuantizer(4, 4), by_residual=by_residual).fit(v, 3).add(v)
    monkeypatch.setattr(shortlist, "SCORES", 700)  # several tiles
    found = index.search_refined(q, v, 6, 300, 3)
    assert nearer(found, search.rerank(index.search(q, 300, 3), q, v, 6))
    # what is within the end of the wide-th code distance's bin, and nothing else
    codes = {}
    for r in index.scan(ivf.probes(q, index.centroids, 3), 1000).collect():
        codes.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"]))
    raw = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in v.collect()}
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for i, own in codes.items():
        last = sorted(own)[min(300, len(own)) - 1][0]
        cut = shortlist.edge(int(shortlist.bins_of(np.array([last]))[0]))
        want = sorted((round(float(((raw[j] - raw[i]) ** 2).sum()), 6), j) for d, j in own if d <= cut)[:6]
        assert got[i] == [j for _, j in want]


def test_bins_hold_every_distance():
    d = np.array([0.0, -1e-12, 1e-30, 0.1, 1.0, 1.01, 3.5, 1e5, 1e30, np.inf, np.nan])
    at = shortlist.bins_of(d)
    assert all(np.isnan(x) or x <= shortlist.edge(int(b)) for x, b in zip(d, at, strict=True))
    assert shortlist.bins_of(np.array([1.0]))[0] < shortlist.bins_of(np.array([1.02]))[0]


@pytest.mark.parametrize("text", ["PQ4x4,RFlat", "IVF4,RQ2x4,RFlat", "PCA8,IVF4,Flat,RFlat", "LSH16,RFlat"])
def test_factories_refine_long_shortlists(v, text):
    q = search.queries_of(v, "vec_id % 70 = 0")
    index = Index(text).fit(v).add(v)
    long, exact = index.search(q, 5, 4, k_factor=140), search.knn(q, v, 5)
    assert sorted(long.collect()) == sorted(exact.collect())
