"""Search beyond plain kNN: pruned inverted files, reconstruction, binary indexes, blocks of queries, selectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import binary, evaluate, graph, quantize, search
from nearfield.operators.ivf import IVF, RefinedIVF, hash_search


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 16)) * 2
    return (centers[rng.integers(0, 8, 400)] + rng.normal(size=(400, 16))).astype(np.float32)


@pytest.fixture(scope="module")
def v(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>").cache()


@pytest.fixture(scope="module")
def q(v):
    return search.queries_of(v, "vec_id % 40 = 0").cache()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def mean_recall(found, v, q, k=10):
    return evaluate.recall(found, search.knn(q, v, k), k).agg(F.avg("recall")).first()[0]


@pytest.fixture(scope="module")
def ivf(v):
    return IVF(8).fit(v, 3).add(v)


def test_scan_equals_the_join(ivf, v, q):
    from nearfield.operators.ivf import probes

    probed = probes(q, ivf.centroids, 3)
    joined = search._best(ivf.candidates(probed), 10, False)
    assert rows(ivf.search(q, 10, 3), "query_id", "rank", "vec_id", "distance") == rows(joined, "query_id", "rank", "vec_id", "distance")
    assert rows(ivf.search(q, 10, 8), "query_id", "rank", "vec_id") == rows(search.knn(q, v, 10), "query_id", "rank", "vec_id")
    assert rows(ivf.range_search(q, 9.0, 8), "query_id", "vec_id", "distance") == rows(search.range_join(q, v, 9.0), "query_id", "vec_id", "distance")


def test_only_probed_lists_are_read(spark, ivf, q, tmp_path):
    ivf.save(f"file://{tmp_path}/ivf")
    found = IVF.load(spark, f"file://{tmp_path}/ivf").search(q.limit(1), 5, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_no" in plan and "IN (" in plan
    assert found.count() == 5


def test_small_blocks_of_queries_lose_none(monkeypatch, ivf, v, q):
    want = rows(search.knn(q, v, 5), "query_id", "rank", "vec_id")
    g = graph.build(v, 8)
    whole = rows(graph.merged(graph.search(g, q, 5, 64), 5), "query_id", "rank", "vec_id")
    b = binary.to_binary(v)
    bq = b.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("words").alias("qw"))
    hamming = rows(binary.knn(bq, b, 5), "query_id", "rank", "vec_id")
    monkeypatch.setattr(search, "BLOCK_BYTES", 300)
    assert len(search.query_blocks(q, 16)) > 3
    assert rows(search.split_dimensions(q, v, 3, 5), "query_id", "rank", "vec_id") == want
    assert rows(search.knn_arrow(q, v, 5), "query_id", "rank", "vec_id") == want
    assert rows(ivf.search(q, 5, 8), "query_id", "rank", "vec_id") == want
    assert rows(graph.merged(graph.search(g, q, 5, 64), 5), "query_id", "rank", "vec_id") == whole
    assert rows(binary.knn(bq, b, 5), "query_id", "rank", "vec_id") == hamming
    sign = quantize.SignHash(32).fit(v)
    assert hash_search(q, v, sign, 5).count() == 5 * len({r[0] for r in want})


def test_codes_are_scored_by_tables(v, q, x):
    pq = quantize.ProductQuantizer(8, 4)
    index = IVF(4, codec=pq, by_residual=True).fit(v, 3).add(v)
    got = {(r["query_id"], r["vec_id"]): r["distance"] for r in index.search(q, 10, 4).collect()}
    y = {r["vec_id"]: np.array(r["embedding"]) for r in index.reconstruct(v).collect()}
    assert all(abs(((x[a] - y[b]) ** 2).sum() - d) < 1e-3 for (a, b), d in got.items())


def test_results_with_vectors_and_codes(ivf, v, q):
    r = ivf.search_and_reconstruct(q, 3, 8)
    own = {i["vec_id"]: i["embedding"] for i in v.collect()}
    assert r.count() == 3 * q.count() and all(own[i["vec_id"]] == i["embedding"] for i in r.collect())
    index = IVF(4, codec=quantize.ScalarQuantizer("8bit")).fit(v, 2).add(v)
    c = index.search_and_return_codes(q, 3, 4)
    assert c.count() == 3 * q.count() and all(len(i["code"]) == 16 for i in c.collect())


def test_a_second_code_refines(v, q):
    base = IVF(4, codec=quantize.ProductQuantizer(4, 4), by_residual=True)
    two = RefinedIVF(base, quantize.ProductQuantizer(8, 4), k_factor=8).fit(v, 3).add(v)
    assert mean_recall(two.search(q, 10, 4), v, q) > mean_recall(base.search(q, 10, 4), v, q) + 0.1


def test_binary_indexes(v):
    b = binary.to_binary(v)
    bq = b.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("words").alias("qw"))
    exact = binary.knn(bq, b, 5)
    index = binary.BinaryIVF(4, 16).fit(b, 3).add(b)
    assert rows(index.search(bq, 5, 4), "query_id", "rank", "vec_id", "distance") == rows(exact, "query_id", "rank", "vec_id", "distance")
    assert rows(index.range_search(bq, 4, 4), "query_id", "vec_id", "distance") == rows(binary.range_join(bq, b, 4), "query_id", "vec_id", "distance")
    found = binary.graph_search(binary.build_graph(b, 16, 8), bq, 16, 5, 64)
    near = {(r["query_id"], r["rank"]): r["distance"] for r in exact.collect()}
    assert np.mean([near[r["query_id"], r["rank"]] == r["distance"] for r in found.collect()]) > 0.9
    counts = {r["query_id"]: r["n"] for r in binary.count_within(bq, b, 4).collect()}
    assert counts == {i: sum(1 for a, _, d in rows(binary.pairs(bq, b), "query_id", "vec_id", "distance") if a == i and d <= 4) for i in counts}


def test_range_search_of_a_graph_has_no_cap(v, q):
    exact = {(a, b) for a, b in rows(search.range_join(q, v, 30.0), "query_id", "vec_id")}
    found = {(a, b) for a, b in rows(graph.search(graph.build(v, 16), q, 1, 16, radius=30.0), "query_id", "vec_id")}
    assert len(exact) > 16 * q.count() and found <= exact and len(found) >= 0.9 * len(exact)


def test_knn_graph_is_exact_over_shards(v, x):
    got = rows(graph.knn_graph(v, 4, shard_points=90), "vec_id", "rank", "neighbor")
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert got == sorted((i, j + 1, int(near[i, j])) for i in range(len(x)) for j in range(4))


def test_lines_of_numbers(spark):
    rng = np.random.default_rng(0)
    xs = rng.integers(0, 40, 200) / 4.0
    values = spark.createDataFrame([(i, float(a)) for i, a in enumerate(xs)], "vec_id long, x double").repartition(3)
    queries = spark.createDataFrame([(i, float(a)) for i, a in enumerate([0.0, 3.1, 9.75, 50.0, -4.0])], "query_id long, x double")
    got = rows(search.knn_line(queries, values, 7), "query_id", "rank", "vec_id")
    want = [(i, r + 1, int(j)) for i, a in enumerate([0.0, 3.1, 9.75, 50.0, -4.0]) for r, j in enumerate(np.lexsort((np.arange(200), np.round(np.abs(xs - a), 6)))[:7])]
    assert got == sorted(want)


def test_selectors(spark, v):
    bits = bytearray(30)
    for i in (0, 7, 8, 100, 239):
        bits[i // 8] |= 1 << i % 8
    assert [r[0] for r in rows(v.where(search.id_bitmap(bytes(bits))), "vec_id")] == [0, 7, 8, 100, 239]
    with pytest.raises(ValueError, match="bitmap"):
        search.id_bitmap(bytes(search.BITMAP_BYTES + 1))
    ids = spark.createDataFrame([(i, 1000 + i) for i in range(400)], "vec_id long, external_id long")
    assert [r[0] for r in rows(search.translated(v, ids, search.id_range(1003, 1006)), "vec_id")] == [3, 4, 5]


def test_results_meet(v, q):
    a, b = search.knn(q, v, 10), search.knn(q, v, 5)
    assert rows(search.intersect(a, b), "query_id", "vec_id") == rows(b, "query_id", "vec_id")
    ranged = search.range_join(q, v, 60.0)
    ds = sorted(r[0] for r in ranged.select("distance").collect())
    for total in (1, 17, 400, len(ds) + 5):
        n = search.max_results(ranged, total).count()
        assert n <= total and (n == len(ds) or len([d for d in ds if d <= ds[n]]) > total)


def test_big_batches_go_on(spark, v, q, tmp_path):
    path = f"file://{tmp_path}/batch"
    got = rows(search.big_batch(q, v, 4, path, 3), "query_id", "rank", "vec_id")
    assert got == rows(search.knn(q, v, 4), "query_id", "rank", "vec_id")
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    (next(tmp_path.glob("batch/block=1/_manifest.json"))).unlink()
    assert rows(search.big_batch(q, v, 4, path, 3), "query_id", "rank", "vec_id") == got
    assert all(p.exists() for p in before if "block=1" not in str(p))
    # blocks of another k, or of other rows, are stale
    assert rows(search.big_batch(q, v, 2, path, 3), "query_id", "rank", "vec_id") == rows(search.knn(q, v, 2), "query_id", "rank", "vec_id")
    fewer = v.where("vec_id > 20")
    assert rows(search.big_batch(q, fewer, 2, path, 3), "query_id", "rank", "vec_id") == rows(search.knn(q, fewer, 2), "query_id", "rank", "vec_id")
